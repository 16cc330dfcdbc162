"""From texts to items, phrases, evidence and sections."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import ascii_shape, col, computed, literal_pattern, short, squeeze, strip, sub
from skein.operators.items import top_rows

# Fixed values of the phrase miner, in their order.
VERBS = (
    "perform", "conduct", "analyze", "develop", "manage", "coordinate", "evaluate", "assess", "prepare", "produce", "execute", "direct", "integrate", "synthesize", "collect",
    "process", "disseminate", "target", "exploit", "brief", "maintain", "establish", "implement", "monitor", "support", "plan", "organize", "identify", "determine",
)
DOMAIN_WORDS = ("intelligence", "analysis", "targeting", "collection", "exploitation", "assessment", "planning", "operations", "coordination", "management", "briefing", "reporting", "evaluation", "integration", "production")
FILLERS = ("and the", "or the", "of the", "to the")
GENERIC_ITEMS = ("intelligence analysis", "data processing")
ABILITY_VERBS = ("analyze", "conduct", "synthesize", "assess", "brief", "collect", "evaluate", "integrate", "develop")
TOPIC_NOUNS = "analysis|intelligence|security|threats|operations|collection|targeting|briefing|reporting"
CLASS_WORDS = {
    "knowledge": ("knowledge", "understand", "theory", "principles", "concepts", "awareness", "familiarity"),
    "skill": ("operate", "perform", "execute", "conduct", "implement", "maintain", "repair", "troubleshoot", "analyze"),
    "ability": ("able to", "capability", "capacity", "aptitude", "competence", "proficiency", "adapt", "lead", "manage", "coordinate"),
}
SECTIONS = (
    r"3\.1\.?\s*Knowledge[.\s]+(.+?)(?=\n3\.\d|\n2\.|$)",
    r"Knowledge[.\s]*(?:is mandatory of|includes?|requires?)[:\s]+(.+?)(?=\n\d\.|$)",
    r"(?:principles?|theory|concepts?)\s+of[:\s]+(.+?)(?=\n|\.{2,}|$)",
)
# What a code, a section's header line and a heading look like.
SECTION_CODE = "[0-9A-Z]{2,5}[A-Z0-9X]{1,2}"
SECTION_MARK, HEADER, HEADING = r"(?md)^\s*AFSC\s+", r"(?md)^\s*AFSC\s+({codes})\s*,\s*(.+?)\s*$", r"(\d+\.\d+\.?\s*[A-Z][^.]+)"
LAST_RESORT = (("knowledge", "knowledge of intelligence cycle", "knowledge"), ("skill", "imagery exploitation", "skill"), ("abilit", "brief intelligence findings", "ability"))
NOTHING_FOUND = "general geospatial intelligence competence"


def _numbered(hits: Column, **more: Column) -> Column:
    """Each of ``hits`` with its place and what ``more`` says."""
    return F.transform(hits, lambda h, j: F.struct(*[v.alias(k) for k, v in more.items()], j.alias("pos"), h.alias("hit")))


def _verb_array(shape: Column, most: int) -> Column:
    """The first ``most`` verb phrases of a shaped text: vord, pos, phrase."""
    none = F.array().cast("array<string>")
    # a plain search first: most texts lack most verbs
    hits = {v: F.when(shape.contains(v), F.regexp_extract_all(shape, F.lit(rf"\b{v}(?:s|es|ing)?\s+([a-z]+\s+[a-z]+(?:\s+[a-z]+){{0,2}})\b"), F.lit(1))).otherwise(none) for v in VERBS}
    each = [_numbered(h, vord=F.lit(i), verb=F.lit(v)) for i, (v, h) in enumerate(hits.items())]
    good = F.filter(F.flatten(F.array(*each)), lambda x: (F.length(F.trim(x["hit"])) > 15) & ~x["hit"].rlike("|".join(FILLERS)))
    phrase = lambda x: F.regexp_replace(F.concat(x["verb"], F.lit(" "), x["hit"]), r"\s+(and|or|the|for|with|from)$", "")
    return F.transform(F.slice(good, 1, most), lambda x: F.struct(x["vord"].alias("vord"), x["pos"].alias("pos"), phrase(x).alias("phrase")))


def _domain_array(shape: Column) -> Column:
    """Domain phrases of a shaped text: word_no, phrase."""
    each = []
    for i, w in enumerate(DOMAIN_WORDS):
        rx = rf"\b([a-z]+\s+){w}(\s+[a-z]+)?\b"
        around = F.when(shape.contains(w), F.trim(F.concat(F.regexp_extract(shape, rx, 1), F.coalesce(F.regexp_extract(shape, rx, 2), F.lit(""))))).otherwise(F.lit(""))
        each.append(F.struct(F.lit(i).alias("word_no"), around.alias("phrase")))
    return F.filter(F.array(*each), lambda x: F.length(x["phrase"]).between(15, 60) & ~x["phrase"].contains("  "))


def verb_phrases(docs: DataFrame, ident: str, text: str, most: int = 8) -> DataFrame:
    """Verb and object phrases: ``ident``, vord, pos, phrase, the first ``most`` of each document in order of verb and place."""
    return computed(docs.select(ident, col(text).alias("_t")), _s=ascii_shape("_t")).select(ident, F.inline(_verb_array(F.col("_s"), most)))


def domain_phrases(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Of each domain word's first match the words around it, if they make 15 to 60 characters without a double blank."""
    return computed(docs.select(ident, col(text).alias("_t")), _s=ascii_shape("_t")).select(ident, F.inline(_domain_array(F.col("_s"))))


def _first_of_equal(items: Column, key, most: int) -> Column:
    """The first ``most`` elements of those whose key no earlier one has; ``items`` is evaluated once, and each compared with ``most`` at most."""
    return F.aggregate(items, F.slice(items, 1, 0), lambda kept, x: F.when((F.size(kept) >= most) | F.exists(kept, lambda y: key(y) == key(x)), kept).otherwise(F.concat(kept, F.array(x))))


def with_mined(docs: DataFrame, text: str, most: int = 6) -> DataFrame:
    """``docs`` with ``mined``, an array of items (ord, text, confidence, source); a document's items come from its own row.

    Verb phrases; domain phrases if these are under four; generic items if there are none. Of equal texts the first,
    longer than 8 characters, ``most`` of them. No shuffle: nothing is joined or grouped.
    """
    item = lambda o, t, c, s: F.struct(o.cast("long").alias("ord"), t.alias("text"), F.lit(c).alias("confidence"), F.lit(s).alias("source"))
    df = computed(computed(docs, _s=ascii_shape(text)), _v=_verb_array(F.col("_s"), 8))
    df = computed(df, _d=F.when(F.size("_v") < 4, _domain_array(F.col("_s"))).otherwise(F.array().cast("array<struct<word_no:int,phrase:string>>")))
    verbs = F.transform("_v", lambda x: item(x["vord"] * 1000 + x["pos"], x["phrase"], 0.55, "fallback-pattern"))
    domain = F.transform("_d", lambda x: item(x["word_no"] + 100_000, x["phrase"], 0.50, "fallback-domain"))
    df = computed(df, _every=F.filter(F.concat(verbs, domain), lambda x: F.length(F.trim(x["text"])) > 8))
    df = computed(df, _all=_first_of_equal(F.col("_every"), lambda x: F.lower(F.trim(x["text"])), most))
    generic = F.array(*[item(F.lit(200_000 + i), F.lit(t), 0.3, "fallback-generic") for i, t in enumerate(GENERIC_ITEMS)])
    return df.withColumn("mined", F.when(F.size("_all") > 0, F.col("_all")).otherwise(generic)).drop("_s", "_v", "_d", "_every", "_all")


def mined_items(docs: DataFrame, ident: str, text: str, most: int = 6) -> DataFrame:
    """The items of :func:`with_mined` as rows: ``ident``, ord, text, confidence, source, item_type. A null text counts as empty."""
    df = with_mined(docs.select(ident, F.coalesce(text, F.lit("")).alias("_t")), "_t", most)
    return df.select(ident, F.inline("mined")).withColumn("item_type", F.lit("skill"))


def last_resort_items(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Fixed items by keyword where extraction gave nothing."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    rows = [F.when(low.contains(k), F.struct(F.lit(t).alias("text"), F.lit(kind).alias("item_type"), F.lit(0.2).alias("confidence"))) for k, t, kind in LAST_RESORT]
    found = F.filter(F.array(*rows), lambda x: x.isNotNull())
    nothing = F.array(F.struct(F.lit(NOTHING_FOUND).alias("text"), F.lit("skill").alias("item_type"), F.lit(0.1).alias("confidence")))
    return docs.select(ident, F.inline(F.when(F.size(found) > 0, found).otherwise(nothing)))


def classified(c: Column | str) -> Column:
    """knowledge, skill or ability by the number of its keywords that occur; ties in this order, skill if none does."""
    low = F.lower(col(c))
    n = {k: sum((low.contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in CLASS_WORDS.items()}
    k, s, a = n["knowledge"], n["skill"], n["ability"]
    return F.when((k > 0) & (k >= s) & (k >= a), F.lit("knowledge")).when((s > 0) & (s >= a), F.lit("skill")).when(a > 0, F.lit("ability")).otherwise(F.lit("skill"))


def _topic_array(text: Column) -> Column:
    """Topics of a text: ord, topic."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\x{85}\p{Z}]", " "), r"[^\x{00}-\x{7F}\p{L}\p{M}\p{N}]", "#"), r"[^\x{00}-\x{7F}]", "_")
    caps = F.regexp_extract_all(s, F.lit(r"\b([A-Z][a-zA-Z0-9/\-+]+(?:\s+[A-Z][a-zA-Z0-9/\-+]+){0,3})\b"), F.lit(1))
    before = F.regexp_extract_all(s, F.lit(rf"(?i)\b([A-Za-z0-9/\-+]+\s+(?:{TOPIC_NOUNS}))\b"), F.lit(1))
    return F.transform(F.concat(caps, before), lambda t, i: F.struct(i.alias("ord"), t.alias("topic")))


def topics(docs: DataFrame, ident: str, text: str, most: int = 8) -> DataFrame:
    """Capitalised runs, then words before topic nouns; of equal ones the first, ``most`` a document: ``ident``, ord, topic."""
    found = F.filter(_topic_array(col("_x")), lambda x: F.length(F.trim(x["topic"])) > 3)
    df = computed(docs.select(ident, col(text).alias("_x")), _t=found).drop("_x")
    return df.select(ident, F.inline(_first_of_equal(F.col("_t"), lambda x: F.lower(F.trim(x["topic"])), most)))


def with_heuristics(df: DataFrame, text: str) -> DataFrame:
    """``df`` (with ``mined``) with ``more``: abilities from the first two skills with a fitting verb, knowledge from the first three topics."""
    item = lambda o, t, k: F.struct(o.cast("long").alias("ord"), t.alias("text"), F.lit(0.55).alias("confidence"), F.lit("llm-heuristic").alias("source"), F.lit(k).alias("item_type"))
    fit = F.slice(F.filter("mined", lambda x: F.lower(F.split(x["text"], " ")[0]).isin(*ABILITY_VERBS)), 1, 2)
    ability = F.transform(fit, lambda x, i: item(i + 300_000, F.concat(F.lit("Ability to "), F.lower(F.left(x["text"], F.lit(1))), F.substring(x["text"], 2, 1 << 30)), "ability"))
    df = computed(df, _t=F.filter(_topic_array(col(text)), lambda x: F.length(F.trim(x["topic"])) > 3))
    three = _first_of_equal(F.col("_t"), lambda x: F.lower(F.trim(x["topic"])), 3)
    know = F.transform(three, lambda x, i: item(i + 400_000, F.concat(F.lit("Knowledge of "), x["topic"]), "knowledge"))
    return df.withColumn("more", F.concat(ability, know)).drop("_t")


def heuristic_items(docs: DataFrame, items: DataFrame, ident: str, text: str) -> DataFrame:
    """As :func:`with_heuristics` for items that come as rows of their own: abilities where a document has none, knowledge likewise."""
    has = lambda kind: items.where(F.col("item_type") == kind).select(ident).distinct()
    skills = items.where((F.col("item_type") == "skill") & F.lower(F.split("text", " ")[0]).isin(*ABILITY_VERBS)).join(has("ability"), ident, "left_anti")
    ability = top_rows(skills, [ident], [F.col("ord")], 2).select(ident, F.concat(F.lit("Ability to "), F.lower(F.left("text", F.lit(1))), F.substring("text", 2, 1 << 30)).alias("text"), F.lit("ability").alias("item_type"))
    know = topics(docs.join(has("knowledge"), ident, "left_anti"), ident, text, 3).select(ident, F.concat(F.lit("Knowledge of "), "topic").alias("text"), F.lit("knowledge").alias("item_type"))
    return ability.unionByName(know).withColumns({"confidence": F.lit(0.55), "source": F.lit("llm-heuristic")})


def knowledge_sections(docs: DataFrame, ident: str, text: str, most: int = 1500) -> DataFrame:
    """Passages that state knowledge: ``ident``, pattern_no, pos, passage of at most ``most`` characters."""
    each = [_numbered(F.regexp_extract_all(col(text), F.lit(f"(?is){rx}"), F.lit(1)), pattern_no=F.lit(i)) for i, rx in enumerate(SECTIONS)]
    return docs.select(ident, F.inline(F.flatten(F.array(*each)))).select(ident, "pattern_no", "pos", F.left("hit", F.lit(most)).alias("passage"))


def evidence_sentence(text: Column | str, item: Column | str) -> Column:
    """The sentence that holds most of the item's first three longer words, the shortest of these; else a window; else the start."""
    t, low = col(text), F.lower(col(text))
    terms = F.slice(F.filter(F.split(F.lower(col(item)), r"\s+"), lambda w: F.length(w) > 3), 1, 3)
    met = lambda s: F.size(F.filter(terms, lambda w: F.contains(F.lower(s), w)))
    sentences = F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s, i: F.struct((met(s) * 1000 - F.length(strip(s))).alias("score"), (-i).alias("place"), strip(s).alias("s"), met(s).alias("n"))), lambda x: (F.length(x["s"]) >= 20) & (x["n"] >= 2) & (x["score"] > 0))
    best = F.array_max(sentences)["s"]
    term = F.get(F.filter(terms, lambda w: F.contains(low, w)), 0)
    at = F.instr(low, term)
    begin = F.greatest(at - 51, F.lit(0))
    window = F.concat(F.lit("..."), strip(F.substr(t, begin + 1, at - 1 + F.length(term) + 100 - begin)), F.lit("..."))
    start = F.concat(strip(F.left(t, F.lit(150))), F.lit("..."))
    return F.when(F.size(terms) == 0, start).when(best.isNotNull(), F.left(best, F.lit(200))).when(term.isNotNull(), window).otherwise(start)


def evidence_window(text: Column | str, item: Column | str, around: int = 100) -> Column:
    """``around`` characters on both sides of the item's first three words, in dots; empty if they don't occur."""
    words = F.slice(F.filter(F.split(F.coalesce(col(item), F.lit("")), r"\s+"), lambda w: w != ""), 1, 3)
    anchor = F.concat(F.lit(r"(?i)\b"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+"))
    hit = F.when(F.size(words) > 0, F.call_function("regexp_extract", col(text), anchor, F.lit(0)))
    at = F.instr(col(text), hit)
    begin = F.greatest(at - around - 1, F.lit(0))
    window = F.substr(col(text), begin + 1, at - 1 - begin + F.length(hit) + around)
    return F.coalesce(F.when(F.coalesce(hit, F.lit("")) != "", F.concat(F.lit("..."), strip(window), F.lit("..."))), F.lit(""))


def section_label(text: Column, position: Column, default: str = "3.1 Knowledge") -> Column:
    """The last section heading in the 200 characters before ``position`` (from 0), 20 characters of it."""
    before = F.right(F.left(text, position), F.lit(200))
    return F.coalesce(F.left(F.try_element_at(F.regexp_extract_all(before, F.lit(HEADING), F.lit(1)), F.lit(-1)), F.lit(20)), F.lit(default))


def split_sections(docs: DataFrame, ident: str, text: str, codes: str = SECTION_CODE) -> DataFrame:
    """A text of many sections by its header lines: ``ident``, sec_no, code, title, section. ``codes`` is what a code looks like.

    Where no line is a full header, a line that opens with the mark and a code does, and the title is empty.
    """
    t = col(text)
    header = HEADER.replace("{codes}", codes)
    cut = F.split(F.regexp_replace(t, header, "\u0001$1\u0002$2\u0002"), "\u0001")
    full = F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda x: F.struct(F.trim(F.split(x, "\u0002")[0]).alias("code"), strip(F.split(x, "\u0002")[1]).alias("title"), strip(F.split(x, "\u0002")[2]).alias("section")))
    loose = F.split(F.regexp_replace(t, SECTION_MARK, "\u0001"), "\u0001")
    code = rf"(?s)^({codes})\s*[, ]\s*(.*)"
    plain = F.filter(F.transform(F.slice(loose, 2, F.greatest(F.size(loose) - 1, F.lit(0))), lambda x: F.struct(F.regexp_extract(x, code, 1).alias("code"), F.lit("").alias("title"), strip(F.regexp_extract(x, code, 2)).alias("section"))), lambda x: x["code"] != "")
    return docs.where(t.isNotNull()).select(ident, F.posexplode(F.when(F.size(full) > 0, full).otherwise(plain))).select(ident, F.col("pos").alias("sec_no"), "col.*")


def search_pages(pages: DataFrame, ident: str, text: str, query: str, width: int = 700, most: int | None = None) -> DataFrame:
    """Pages that hold ``query`` in any case: ``ident``, n_matches, snippet; the first ``most`` of them in order of ``ident``.

    A blank query finds nothing.
    """
    rx = "(?i)" + literal_pattern(query)
    found = pages.where(F.contains(F.lower(text), F.lit(query.lower())) & F.lit(bool(query.strip()))).select(ident, F.regexp_count(text, F.lit(rx)).alias("n_matches"), short(text, width).alias("snippet"))
    return found.orderBy(ident).limit(most) if most is not None else found


def search_pattern(query: str, code: bool = False) -> str:
    """The pattern of a typed query: of a code, with whatever letters and digits follow it; else the query itself, a pattern if it has any of ``.*?+[]()``."""
    if code:
        return r"\b" + literal_pattern(query.strip().upper()) + r"[A-Z0-9]*\b"
    return query if any(c in query for c in ".*?+[]()") else literal_pattern(query)


def search_matches(docs: DataFrame, ident: str, text: str, pattern: str, width: int = 120, most: int | None = None) -> DataFrame:
    """One row for each match of a pattern in any case: ``ident``, match_no, char_start, hit, snippet with ``width`` / 2 on both sides.

    With ``most`` the first so many in order of ``ident`` and place. Matches are found in the JVM; their places are running
    sums of lengths and their windows slices, one pass over each text that has a match.
    """
    t = col(text)
    hits = F.regexp_extract_all(t, F.lit(f"(?i){pattern}"), F.lit(0))
    between = F.transform(F.split(t, f"(?i){pattern}", -1), lambda x: F.length(x))
    rows = docs.where(t.rlike(f"(?i){pattern}")).select(ident, t.alias("_t"), hits.alias("_h"), between.alias("_b"))
    half = width // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, number, start, hit, around = [], [], [], [], []
            for i, (body, found, gaps) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                at = 0
                for k, (h, gap) in enumerate(zip(found, gaps, strict=False)):
                    at += gap
                    of.append(i)
                    number.append(k)
                    start.append(at)
                    hit.append(h)
                    around.append(body[max(0, at - half) : at + len(h) + half])
                    at += len(h)
            cols = [b.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(hit, pa.string()), pa.array(around, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[ident, "match_no", "char_start", "hit", "snippet"])

    kind = docs.schema[ident].dataType.simpleString()
    got = rows.mapInArrow(run, f"{ident} {kind}, match_no int, char_start int, hit string, snippet string").withColumn("snippet", squeeze("snippet"))
    return got.orderBy(ident, "char_start").limit(most) if most is not None else got


def highlighted(c: Column | str, query: str) -> Column:
    """Every match of the text ``query`` in any case set between double asterisks."""
    return F.regexp_replace(col(c), f"(?i)({literal_pattern(query)})", "**$1**")
