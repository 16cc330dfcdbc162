import re
import textwrap

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import clean, extract


def run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def plain_chain(s):
    s = textwrap.dedent(s or "").strip()
    for p, put, f in ((r"```.+?```", " ", re.S), (r"^(\s*\|.*\|)\s*$", " ", re.M), (r"^\s*\d{1,4}\s*$", " ", re.M), (r"^\s*(DAFECD|AFECD|AFI|AFMAN|USSF).*$", " ", re.M | re.I), (r"^\s*NOTE:.*$", " ", re.M | re.I), (r"(\w)-\n(\w)", r"\1\2", 0)):
        s = re.sub(p, put, s, flags=f)
    return re.sub(r"\s+", " ", s.replace("\r", "\n")).strip()


CASES = [
    None, "", "  \n ", "  foo-\n  bar", "a\n12\nb", "AFI 1-2 says\nrest", "DAFOCD stays", "x\nNOTE: gone\ny", "some-\nthing", "some-\r\nthing", "| a | b |\nrest", "x ```code\nmore``` y", "é-\nà   ü", "\t\tdeep\n\t\t\tmore-\n\t\tx", "1234\n12345",
]


def test_clean_chain(spark):
    assert run(spark, CASES, clean.clean_text("t")) == [plain_chain(x) for x in CASES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab-é \n\t1|`:NOTEAFI", max_size=40), min_size=1, max_size=25))
def test_clean_chain_any(spark, values):
    assert run(spark, values, clean.clean_text("t")) == [plain_chain(x) for x in values]


def test_canonical_item(spark):
    assert run(spark, ["Imagery  Analysis.", "(Mensuration)", " plain / ", None, "a.b"], clean.canonical_item("t")) == ["imagery exploitation", "geoint mensuration", "plain", "", "a.b"]


def test_short_and_pattern(spark):
    assert run(spark, ["one two three four five", "short", None], T.short("t", 17)) == ["one two [...]", "short", None]
    assert run(spark, ["a.b axb A.B"], F.regexp_count("t", F.lit("(?i)" + T.literal_pattern("a.b")))) == [2]


def test_knowledge_text(spark):
    got = run(spark, ["Based on the text: **radar** theory", "1. Knowledge is mandatory of map reading. More", '"Quoted" rest', "x - Exact quote: y"], clean.knowledge_text("t"))
    assert got == ["radar theory", "map reading", "Quoted rest", "x"]


def test_verb_phrases_and_fallbacks(spark):
    docs = spark.createDataFrame([(1, "They analyze complex radar data sets and analyzing things. Plans large joint training events"), (2, "nothing here"), (3, None), (4, "")], "d long, t string")
    got = {(r.d, r.text, r.source) for r in extract.mined_items(docs, "d", "t").collect()}
    assert (1, "analyze complex radar data sets", "fallback-pattern") in got
    assert (1, "plan large joint training events", "fallback-pattern") in got
    assert {(d, t) for d, t, s in got if s == "fallback-generic"} == {(d, t) for d in (2, 3, 4) for t in extract.GENERIC_ITEMS}


def test_domain_phrase_drops_its_word(spark):
    docs = spark.createDataFrame([(1, "interdisciplinary analysis.")], "d long, t string")
    assert [r.phrase for r in extract.domain_phrases(docs, "d", "t").collect()] == ["interdisciplinary"]


def test_classified_ties(spark):
    assert run(spark, ["knowledge to operate", "operate and adapt", "", "theory able to lead manage"], extract.classified("t")) == ["knowledge", "skill", "skill", "ability"]


def test_evidence(spark):
    t = F.lit("Short. The crew repairs radar masts daily. The crew repairs radar masts daily and paints them too.")
    df = spark.range(1)
    one = lambda item: df.select(extract.evidence_sentence(t, F.lit(item))).first()[0]
    assert one("repairs radar masts") == "The crew repairs radar masts daily."
    assert one("paints nothing") .startswith("...") and one("of a to").endswith("...")
    assert df.select(extract.evidence_window(t, F.lit("radar masts daily"), 5)).first()[0] == "...airs radar masts daily. The..."
    assert df.select(extract.evidence_window(t, F.lit("(none)"))).first()[0] == ""


def test_sections(spark):
    docs = spark.createDataFrame([(1, "AFSC 11F3X, Pilot, Senior\nbody one\nAFSC 12B3X, Nav\nbody two"), (2, "no header"), (3, "AFSC 1N0X1 loose text")], "d long, t string")
    got = {(r.d, r.sec_no, r.code, r.title, r.section) for r in extract.split_sections(docs, "d", "t").collect()}
    assert got == {(1, 0, "11F3X", "Pilot, Senior", "body one"), (1, 1, "12B3X", "Nav", "body two"), (3, 0, "1N0X1", "", "loose text")}


def test_sections_of_whole_files(spark, tmp_path):
    from skein.plans import q_text

    rows = [(1, "4F0X1-TNFVR", "Late", "f", 9, None, "raw  body\n\nAFSC LOOSE WORDS\n1. More"), (2, "4F0X1-AB123", None, "f", 2, "clean", "x"), (3, "1N0X1", "Other", "g", None, None, None), (4, "4F0X1-TNFVR", "Last", "f", None, "", "y"), (5, "11F3", "A, B", "f", 2, "again", None)]
    spark.createDataFrame(rows, "afsc_doc_id long, code string, title string, source_pdf string, page_start int, clean_text string, raw_text string").write.parquet(str(tmp_path / "afsc_doc.parquet"))
    got = sorted(tuple(r) for r in q_text.x19_sections(spark, str(tmp_path)).collect())
    assert got == [
        ("f", 0, 2, "4F0X1-AB123", "untitled", "clean", True), ("f", 1, 5, "11F3", "A, B", "again", True), ("f", 2, 1, "4F0X1-TNFVR", "Late", "raw  body\n\nAFSC LOOSE WORDS\n1. More", True),
        ("f", 3, 4, "4F0X1-TNFVR", "Last", "", True), ("g", 0, 3, "1N0X1", "Other", "", True),
    ]


def test_search_matches_places(spark):
    text = "Radar here, radar there"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "d long, t string")
    got = [(r.match_no, r.char_start, r.hit) for r in extract.search_matches(docs, "d", "t", "radar", 10).collect()]
    assert got == [(i, m.start(), m.group()) for i, m in enumerate(re.finditer("(?i)radar", text))]


def test_knowledge_sections_cap(spark):
    docs = spark.createDataFrame([(1, "3.1. Knowledge. " + "x" * 2000 + "\n3.2 next")], "d long, t string")
    assert max(len(r.passage) for r in extract.knowledge_sections(docs, "d", "t").collect()) == 1500
