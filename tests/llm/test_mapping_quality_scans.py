import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import examples, mapping, mixture, quality, scans, textstats


CATALOG = [("ESCO.1234", " Inspect  radar masts", "examine radar masts; inspecting radar masts;; radar mast inspection"), ("ESCO.2345", "inspect copper kettles", "examine copper kettles;inspection of copper kettles; inspecting copper kettles"), ("ESCO.3456", "paint copper kettles", None), ("ESCO.4567", "configure copper masts", "set up copper masts"), ("ESCO.5678", "configure radar masts", "set up radar masts; "), ("ESCO.6789", None, "x")]


def test_meant_entries(spark):
    cat = spark.createDataFrame(CATALOG, "esco_id string, label string, alt_labels string")
    typed = {
        "inspect radar masts": "ESCO.1234", "Ability to EXAMINE the radar-masts (level 5)": "ESCO.1234", "masts, radar: inspceting": "ESCO.1234", "inspect copperkettles": "ESCO.2345", "set up copper masts as required": "ESCO.4567", "inspect radar gondolas": "none",
        "paint radar masts": "none", "TBD": "none", "pain­t copper​ kettels": "ESCO.3456", "inspect cop. kettles": "ESCO.2345", "?": "none",
    }
    exports = {"ESCO.1234": "ESCO.1234", "[esco 2345]": "ESCO.2345", "ESC0#34S6": "ESCO.3456", "04567": "ESCO.4567", "ESCO.9999": "none", "skill/1234": "ESCO.1234", "ESCO.9999 paint copper kettles": "ESCO.3456", "n/a": "none"}
    items = [(i, n, None, "extra") for i, n in enumerate(typed)] + [(100, None, None, ""), (101, " ", "", ""), (102, "inspect radar masts", "ESCO.1", ""), (103, "inspect radar masts", " ", "")]
    checks = [(i, n) for i, n in enumerate(exports)] + [(50, None), (51, "\n")]
    got = {(r.src, r.row_id): r.esco_id for r in mapping.meant_entries(spark.createDataFrame(items, "item_id long, name string, esco_id string, label string"), spark.createDataFrame(checks, "validation_id long, esco_export string"), cat).collect()}
    want = {("ksa_item", i): e for i, e in enumerate(typed.values())} | {("ksa_item", 103): "ESCO.1234"} | {("laiser_similarity_validation", i): e for i, e in enumerate(exports.values())}
    assert got == want


def test_meant_entries_of_nothing(spark):
    cat = spark.createDataFrame([], "esco_id string, label string, alt_labels string")
    items = spark.createDataFrame([(1, "x y", None)], "item_id long, name string, esco_id string")
    none = spark.createDataFrame([], "validation_id long, esco_export string")
    assert [r.esco_id for r in mapping.meant_entries(items, none, cat).collect()] == ["none"]
    assert mapping.meant_entries(items.limit(0), none, cat).count() == 0


def test_entries_of_one_word(spark):
    cat = spark.createDataFrame([("ESCO.0001", "Welding", None), ("ESCO.0002", "operate radar", "run radar"), ("ESCO.0003", "operate sonar", "run sonar")], "esco_id string, label string, alt_labels string")
    typed = {"Welding": "ESCO.0001", "wleding": "ESCO.0001", "welding radar": "none", "radar": "none", "Run Radar": "ESCO.0002", "operateradar": "ESCO.0002"}
    items = spark.createDataFrame([(i, n, None) for i, n in enumerate(typed)], "item_id long, name string, esco_id string")
    got = {r.row_id: r.esco_id for r in mapping.meant_entries(items, spark.createDataFrame([], "validation_id long, esco_export string"), cat).collect()}
    assert got == dict(enumerate(typed.values()))


def test_words_against_all_ways(spark):
    """Every way of writing is tried for every word; the keys must have found all that an exact cost accepts."""
    rng = random.Random(12)
    ways = sorted({"".join(rng.choices("abcs", k=rng.randint(2, 11))) for _ in range(60)})
    single = {w: frozenset({w, f"x{i % 9}"}) for i, w in enumerate(ways)}
    typed = set(ways[:5]) | {ways[i] + ways[j] for i, j in ((1, 2), (7, 9))}
    for _ in range(250):
        w = list(rng.choice(ways))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "s"])
        typed.add("".join(w) or "q")
    typed |= {w[:k] for w in ways for k in (2, 3, 4)} | {w[0] + w[2:4] + w[-1] for w in ways if len(w) > 4} | {w[:3] + "s" for w in ways}
    got = {r.word: (r.cost, r.options) for r in mapping.meant_words(spark.createDataFrame([(w,) for w in typed], "word string"), single).collect()}
    for w in typed:
        halves = [(rest, other, z) for i in range(2, len(w) - 1) for other, rest in ((w[:i], w[i:]), (w[i:], w[:i])) if other in single and len(rest) >= 3 for z in ways]
        cost, options = mapping.word_options(w, [(w, None, z) for z in ways] + halves, single)
        assert got.get(w, (9.0, [])) == (cost, options), w


def test_edits():
    assert [mapping.edits(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abcd"), ("abcd", "xbcy"), ("abc", "xyz"))] == [0, 1, 1, 2, 3]
    assert mapping.short_for("gens", "generators") and mapping.short_for("eqpt", "equipment") and not mapping.short_for("ge", "generators")


def test_mixture_finds_two_clouds(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(-2, 0.5, (300, 2)), rng.normal(2, 1.0, (600, 2))])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(5)
    start = np.array([mixture.moments(np.array([[a, a], [a + 0.1, a - 0.1]])).mean(axis=0) for a in (-1.0, 1.0)])
    m = mixture.fit(df, "x", start, 40, 1e-3, 1e-6)
    assert np.allclose(m.weights, [1 / 3, 2 / 3], atol=0.03) and np.allclose(m.means, [[-2, -2], [2, 2]], atol=0.2)


def test_kinds_of_held_out_examples(spark):
    shown = examples.examples(seed=77)  # drawn anew: none of them is an inspected one
    df = spark.createDataFrame([(i, t, "c") for i, (_, _, t) in enumerate(shown)] + [(-1, None, ""), (-2, " \n", "")], "doc_id long, text string, kind string")
    words = spark.createDataFrame([("en", w) for w in "the of and to a in is that it for was on with as are be this by at from".split()] + [("de", w) for w in "der die und in den von zu das mit sich ist im dem nicht ein".split()] + [("fr", w) for w in "de la le et les des en un du une que est pour ce qui dans".split()] + [("es", w) for w in "de la que el en y a los se del las un por con no una".split()], "lang string, word string")
    got = {r.doc_id: r.kind for r in quality.text_quality(df, words).collect()}
    assert set(got) == set(range(len(shown)))
    right = sum(got[i] == k for i, (_, k, _) in enumerate(shown))
    assert right / len(shown) >= 0.93
    assert quality.text_quality(df.limit(0), words).count() == 0


def test_stats_of_odd_texts():
    words = {"en": frozenset({"the"})}
    for t in ("a", "=" * 9000, "\x00\x01", "🛩" * 50, "\r\n\r\nx", "|" * 40, "1", "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "word " * 50_000):
        assert len(textstats.text_stats(t, words)) == len(textstats.STATS) and np.isfinite(textstats.vectors(np.array([textstats.text_stats(t, words)]))).all()


def test_stats_after_tokens_start_anew(monkeypatch):
    """A worker that has met more tokens than it remembers finds the same figures as one that begins with each text."""
    words = {"en": frozenset({"the", "of"}), "de": frozenset({"der"})}
    texts = [f"The end of no{k}n, {k} w{k}x of der m{k}ll. " + " ".join(f"t{j}" for j in range(k % 9)) for k in range(60)]
    want = np.concatenate([textstats.stats_of([t], textstats.Tokens(words)) for t in texts])
    monkeypatch.setattr(textstats, "REMEMBERED", 32)
    tokens = textstats.Tokens(words)
    got = np.concatenate([textstats.stats_of(texts[at : at + 3], tokens) for at in range(0, len(texts), 3)])
    assert len(tokens) < 64 and np.array_equal(got, want)
    monkeypatch.setattr(textstats, "AT_ONCE", 40)  # begins anew within a batch too
    tokens = textstats.Tokens(words)
    assert np.array_equal(textstats.stats_of(texts, tokens), want) and len(tokens) < 128


def test_scan_repair():
    k = scans.Known({w: 5 for w in "the crew checks copper kettles and multi-sensor masts short- long-range in order to repair modern barns burn while maintaining them certificate tables".split()}, {scans.line_key("Guide to Barns, Change 8"), scans.line_key("Printed copies are void")})
    text = "BARN KEEPER\n1. Summary: The crevv checks cop-\nper kettles and multi-\nsensor masts.\nl2\nGuide to Barns, Change 9\nThe c rew checks short-\nand long-\nrange rnasts in order to re pair tab les.\nPrinted  copies are v0id\n13"
    events, clean = scans.repair(text, "Barn Keeper", 12, 13, k)
    assert set(events) == {
        (2, "misread", "crew"), (2, "hyphen", "copper"), (3, "hyphen", "multi-sensor"), (5, "page", ""), (6, "head", ""), (7, "misread", "crew"), (8, "hyphen", "long-range"), (9, "misread", "masts"), (9, "misread", "repair"), (9, "misread", "tables"), (10, "head", ""), (11, "page", ""),
    }
    assert clean == "1. Summary: The crew checks copper kettles and multi-sensor masts. The crew checks short- and long-range masts in order to repair tables."


def test_numbers_that_are_pages():
    assert scans.page_values("- l66 -")[0] & {166} and 137 in scans.page_values("cxxxvii")[0] and scans.page_values("Page lOl of 396") == ({101}, True) and not scans.page_values("669700")[0] - {669700}
    assert scans._pages("12\nword\n669700", ["12", "word", "669700"], 10, 14) == {0}
    assert scans.roman("xciv") == 94 and scans.roman("abc") == 0


def test_scans_from_corpus(spark):
    body = "The crew checks the copper kettles in the barn and reports what has to be repaired. "
    rows = [(i, "T", body * 3, body * 3, None, None) for i in range(6)]
    for i in range(6, 12):
        rows.append((i, "T", f"Old Barn Bulletin, Vol {i}\n1. The crew checks the cop-\nper kett1es in the barn and rep orts what has\n{i}\nOld Barn Bulletin, Vol {i}\nto be repaired.", None, i, i + 1))
    rows += [(20, None, None, None, 1, 2), (21, None, "", None, None, None), (22, None, "\n\n\r\n", None, 3, 1)]
    df = spark.createDataFrame(rows, "afsc_doc_id long, title string, raw_text string, clean_text string, page_start int, page_end int").withColumn("word", F.lit("clash"))
    got = {}
    for r in scans.repairs(df).collect():
        got.setdefault(r.afsc_doc_id, set()).add((r.line_no, r.kind, r.word))
    assert set(got) == set(range(6, 12))
    assert all(v == {(1, "head", ""), (2, "hyphen", "copper"), (3, "misread", "kettles"), (3, "misread", "reports"), (4, "page", ""), (5, "head", "")} for v in got.values())
    texts = {r.afsc_doc_id: r.clean_text for r in scans.repaired(df).collect()}
    assert texts[6] == "1. The crew checks the copper kettles in the barn and reports what has to be repaired." and texts[21] == "" and 20 not in texts
    assert scans.repairs(df.limit(0)).count() == 0


def test_headers_of_ordinary_words_at_any_size(spark):
    body = "The crew checks the copper kettles in the barn and reports what has to be repaired. "
    for n in (1, 3, 20):
        rows = [(i, "Barn Keeper", body * 3, body * 3, None, None) for i in range(6)]
        for i in range(100, 100 + n):
            rows.append((i, "Barn Keeper", f"Barn Keeper\nThe crew checks the cop-\nThe copper barn\n{i}\nper kettles in the barn and reports what has\nThe copper barn\n{i + 1}\nBarn Keeper\nto be repaired.", None, i, i + 1))
        df = spark.createDataFrame(rows, "afsc_doc_id long, title string, raw_text string, clean_text string, page_start int, page_end int")
        assert [(r.n_docs, r.again) for r in scans.repeated_lines(df).where("again").collect()] == [(n, True)]
        texts = {r.afsc_doc_id: r.clean_text for r in scans.repaired(df).collect()}
        assert set(texts.values()) == {body.strip()} and len(texts) == n


DOC = "afsc_doc_id long, title string, raw_text string, clean_text string, page_start int, page_end int"


def corpus(rng, n):
    """Trusted texts and scans of invented words, some in few texts, with headers of several files."""
    vocabulary = ["".join(rng.choices("aeimnorstlud", k=rng.randint(3, 9))) for _ in range(80)]
    broken = lambda w: rng.choice([w.replace("m", "rn", 1), w.replace("l", "1", 1), w[:2] + " " + w[2:], w])
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) if rng.random() > 0.3 else rng.choice(vocabulary[:9]) for _ in range(60)]
        lines = [" ".join(words[j : j + 6]) for j in range(0, 60, 6)]
        if i % 2:
            rows.append((i, f"Title {i}", "\n".join(lines), "\n\n".join([" ".join(words)]), None, None))
            continue
        head = f"Bulletin of {'Kraaz Zwokk Quazz Jopp'.split()[i % 4]} Zjagg"
        scan = []
        for j, line in enumerate(lines):
            if j % 5 == 0:
                scan += [str(20 + j // 5), head if j or i % 3 else head[:-2] + "gq"]
            ws = [broken(w) if rng.random() < 0.2 else w for w in line.split()]
            if len(ws[-1]) > 5 and rng.random() < 0.5 and j < 9:
                scan.append(" ".join(ws)[:-3] + "-")
                lines[j + 1] = ws[-1][-3:] + " " + lines[j + 1]
            else:
                scan.append(" ".join(ws))
        rows.append((i, f"Title {i}", "\n".join(scan), None, 20, 22))
    return rows


def test_rarer_words_and_headers_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(corpus(random.Random(21), 60), DOC)
    get = lambda: sorted(map(tuple, scans.repaired(df).collect()))
    want = get()
    assert sum(len(r[2]) for r in want) > 100 and {e.kind for r in want for e in r[2]} == {"head", "page", "hyphen", "misread"}
    for words, heads in ((10, 100_000), (10, 1), (1_000_000, 1), (0, 0)):
        monkeypatch.setattr(scans, "VOCABULARY_BOUND", words)
        monkeypatch.setattr(scans, "HEADS_BOUND", heads)
        _, rare, more = scans.known(df)
        assert (rare is not None) == (words < 100) and (more is not None) == (heads < 100)
        assert get() == want


def test_documents_loaded_again_change_nothing(spark):
    rows = corpus(random.Random(22), 40)
    once = {r.afsc_doc_id: tuple(r)[1:] for r in scans.repaired(spark.createDataFrame(rows, DOC)).collect()}
    many = scans.repaired(spark.createDataFrame([(1000 * k + i, *rest) for k in range(20) for i, *rest in rows], DOC).repartition(6)).collect()
    assert len(many) == 20 * len(once) and all(tuple(r)[1:] == once[r.afsc_doc_id % 1000] for r in many)
