"""Freely typed values mapped to the entries of a reference list."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.setjoin import similarity_join
from skein.session import cut

# Words that say nothing about which entry is meant.
LEADS = ("ability to", "experienced in", "skilled in", "knowledge", "must be able to", "able to")
TAILS = ("as required", "etc", "iaw local guidance", "general", "level")
FILLERS = ("the", "of", "a", "an")
#: Fixed value: characters misread for digits in ids.
MISREAD = ("OISBZL", "015821")
#: Least Jaccard similarity of words at which an entry is looked at.
VALUE_LIKE = 0.6
#: What the list teaches is learned and broadcast up to so many ways of writing entries (some 100 MB); more are an error.
LIST_BOUND = 200_000
#: Edits allowed in a whole value, and the length from which a word may have two.
EDITS, TWO_FROM = 3.0, 6


def plain(c: Column) -> Column:
    """Words of a value in lower case, without marks, invisible characters, numbers by themselves, leads, tails and fillers."""
    s = F.lower(F.regexp_replace(c, r"\p{Cf}+", ""))
    s = F.trim(F.regexp_replace(s, r"(?U)[\W_]+", " "))
    s = F.regexp_replace(s, rf"\b(?:{'|'.join(FILLERS)}|\w|\d+)\b", " ")
    s = F.trim(F.regexp_replace(s, " +", " "))
    s = F.regexp_replace(s, rf"^(?:(?:{'|'.join(LEADS)}) )+", "")
    return F.regexp_replace(s, rf"(?:(?:^| )(?:{'|'.join(TAILS)}))+$", "")


def typed_id(c: Column, prefix: str = "ESCO.", digits: int = 4) -> Column:
    """The id a value names in any notation (brackets, other separators, misread digits, leading zeros), or null."""
    s = F.upper(F.regexp_replace(c, r"(?U)[\p{Cf}\s]+", " "))
    found = F.regexp_extract(s, rf"^[^\p{{L}}\p{{N}}]*(?:ESC[O0]|SKILL)?[^\p{{L}}\p{{N}}]*0*([0-9OISBZL]{{{digits}}})(?![\p{{L}}\p{{N}}])", 1)
    found = F.translate(found, *MISREAD)
    return F.when(found.rlike(rf"^\d{{{digits}}}$"), F.concat(F.lit(prefix), found))


def learn_variants(entries: list[tuple[str, list[str]]]) -> dict[str, set[str]]:
    """For each word of the labels the ways the list's own alternatives write it.

    ``entries`` are (label, alternatives), plain. An alternative's words that are those of the label, or begin alike, are
    set against each other; where one word of the label is left over, what is left of the alternative stands for it.
    A way counts if two entries or more have it.
    """
    seen: dict[str, Counter[str]] = defaultdict(Counter)
    for label, alts in entries:
        words = label.split()
        for alt in alts:
            rest, left = alt.split(), list(words)
            for w in words:
                if w in rest:
                    rest.remove(w)
                    left.remove(w)
            for w in list(left):
                near = [r for r in rest if r[:3] == w[:3] and abs(len(r) - len(w)) <= 3 and _stem(r) == _stem(w)]
                if near:
                    seen[w][near[0]] += 1
                    rest.remove(near[0])
                    left.remove(w)
            if len(left) == 1 and rest:
                seen[left[0]][" ".join(rest)] += 1
    words = {w for label, _ in entries for w in label.split()}
    return {w: {w} | {v for v, n in seen[w].items() if n >= 2} for w in words}


def _stem(w: str) -> str:
    for end, put in (("ies", "y"), ("ches", "ch"), ("ses", "s"), ("s", "")):
        if w.endswith(end) and len(w) > len(end) + 2:
            return w[: -len(end)] + put
    return w


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def short_for(a: str, w: str) -> bool:
    """Whether ``a`` abbreviates ``w``: its beginning, with or without a plural s, or its letters in order from first to last."""
    if not 3 <= len(a) < len(w):
        return False
    if w.startswith(a) or (a[-1] == "s" and w[-1] == "s" and w.startswith(a[:-1])):
        return True
    it = iter(w)
    return len(a) <= 5 and a[0] == w[0] and a[-1] == w[-1] and all(c in it for c in a)


def word_cost(typed: str, ways: frozenset[str]) -> float:
    """0 if written so, 0.5 if abbreviated, else the edits; 9 beyond what its length allows."""
    if typed in ways:
        return 0.0
    if any(short_for(typed, w) for w in ways):
        return 0.5
    best = 9.0
    for w in ways:
        most = 2 if min(len(w), len(typed)) >= TWO_FROM else 1
        d = edits(typed, w, most)
        if d <= most and len(typed) > 2:
            best = min(best, float(d))
    return best


def word_options(typed: str, like: list[tuple[str, str | None, str]], ways: dict[str, frozenset[str]]) -> tuple[float, list[str]]:
    """The words of the list that a typed word may stand for, and at what cost; 9 and none if it stands for nothing.

    ``like`` are candidates (rest, other, way): the whole word or, where the blank between two words is missing, the rest
    beside a way of writing ``other``. ``ways`` has the words that each way of writing is a way of.
    """
    whole = [(word_cost(rest, frozenset((w,))), w) for rest, other, w in like if other is None]
    cost = min((c for c, _ in whole), default=9.0)
    if cost < 9:
        return cost, sorted({x for c, w in whole if c == cost for x in ways[w]})
    halves = [(word_cost(rest, frozenset((w,))) + 0.25, other, w) for rest, other, w in like if other is not None and other != w]
    cost = min((c for c, _, _ in halves), default=9.0)
    if cost >= 9:
        return 9.0, []
    return cost, sorted({x for c, a, b in halves if c == cost for x in ways[a] | ways[b]})


def forms(catalog: DataFrame) -> DataFrame:
    """Every way the list writes an entry: esco_id, label, form (plain)."""
    alts = F.filter(F.transform(F.split(F.coalesce("alt_labels", F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != "")
    each = catalog.where(F.col("label").isNotNull()).select("esco_id", plain(F.col("label")).alias("label"), F.explode(F.concat(F.array("label"), alts)).alias("_form"))
    return each.select("esco_id", "label", plain(F.col("_form")).alias("form")).where(F.col("form") != "").distinct()


def _without_one(c: Column) -> Column:
    """A word's spellings with one letter left out."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))


def edit_keys(c: Column) -> Column:
    """What a word and any other within its edits (:func:`word_cost`) have in common: spellings with up to one, or two, letters left out."""
    one = _without_one(c)
    return F.array_distinct(F.concat(F.array(c), one, F.when(F.length(c) >= TWO_FROM, F.flatten(F.transform(one, _without_one))).otherwise(F.array().cast("array<string>"))))


def short_keys(c: Column) -> Column:
    """Keys under which a typed word asks for what it may be short for: as a beginning, and by its outer letters and one or two between."""
    n = F.length(c)
    between = F.when(n == 3, F.substring(c, 2, 1)).otherwise(F.substring(c, 2, 2))
    begins = F.when(n >= 3, F.concat(F.lit("^"), c))
    return F.filter(F.array(begins, F.when(n.between(3, 5), F.concat_ws("~", F.substring(c, 1, 1), between, F.right(c, F.lit(1))))), lambda k: k.isNotNull())


def long_keys(c: Column) -> Column:
    """The keys of all that a way of writing may be shortened to (:func:`short_for`)."""
    n = F.length(c)
    none = F.array().cast("array<string>")
    begins = F.when(n > 3, F.transform(F.sequence(F.lit(3), F.greatest(n - 1, F.lit(3))), lambda i: F.concat(F.lit("^"), F.substring(c, F.lit(1), i)))).otherwise(none)
    plural = F.when((n > 3) & F.endswith(c, F.lit("s")), F.transform(F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2))), lambda i: F.concat(F.lit("^"), F.substring(c, F.lit(1), i), F.lit("s")))).otherwise(none)
    inner = F.slice(F.split(c, ""), F.lit(2), F.greatest(n - 2, F.lit(0)))
    two = F.flatten(F.transform(inner, lambda x, i: F.transform(F.slice(inner, i + 2, n), lambda y: F.concat(x, y))))
    middle = F.transform(F.concat(inner, two), lambda m: F.concat_ws("~", F.substring(c, 1, 1), m, F.right(c, F.lit(1))))
    return F.array_distinct(F.concat(begins, plural, F.when(n > 3, middle).otherwise(none)))


def known_ways(listed: dict[str, list[str]]) -> tuple[dict[str, frozenset[str]], dict[str, list[list[str]]]]:
    """What the list itself teaches: each single way of writing with the label words it stands for, and for each label word the ways of several words.

    ``listed`` has the ways in which each label is written.
    """
    learned = learn_variants(sorted((k, sorted(v)) for k, v in listed.items()))
    single: dict[str, set[str]] = defaultdict(set)
    several: dict[str, list[list[str]]] = defaultdict(list)
    for word, ways in learned.items():
        for way in ways:
            parts = way.split()
            if len(parts) == 1:
                single[way].add(word)
            else:
                several[word].append(parts)
                for part in parts:
                    single[part].add(f"+{part}")
    return {k: frozenset(v) for k, v in single.items()}, dict(several)


def meant_words(words: DataFrame, single: dict[str, frozenset[str]]) -> DataFrame:
    """What typed words (``word``, distinct) stand for: word, cost, options; those that stand for nothing are absent.

    A word meets the ways of writing by shared keys: spellings with a letter or two left out (so every pair within its
    edits), its own beginning or outer letters (every abbreviation), and, where it begins or ends with a way, the same for
    the rest (a missing blank). An exact cost decides. No pair that it would accept goes unseen.
    """
    spark = words.sparkSession
    ways = spark.createDataFrame([(w,) for w in sorted(single)], "way string")
    known = spark.sparkContext.broadcast(single)
    n = F.length("word")
    at = F.transform(F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2))), lambda i: F.array(F.struct(F.substring("word", F.lit(1), i).alias("other"), F.substring(F.col("word"), i + 1, n).alias("rest")), F.struct(F.substring(F.col("word"), i + 1, n).alias("other"), F.substring("word", F.lit(1), i).alias("rest"))))
    halves = words.where(n >= 5).select("word", F.inline(F.filter(F.flatten(at), lambda x: F.length(x["rest"]) >= 3)))
    halves = halves.join(ways.select(F.col("way").alias("other")), "other").select("word", "rest", "other")
    asked = words.select("word", F.col("word").alias("rest"), F.lit(None).cast("string").alias("other")).unionByName(halves)
    asked = asked.select("word", "rest", "other", F.explode(F.concat(edit_keys(F.col("rest")), short_keys(F.col("rest")))).alias("key"))
    keyed = ways.select("way", F.explode(F.concat(edit_keys(F.col("way")), long_keys(F.col("way")))).alias("key"))

    def stand_for(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [word_options(w, [(x["rest"], x["other"], x["way"]) for x in like], known.value) for w, like in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in found], pa.float64()), pa.array([o for _, o in found], pa.list_(pa.string()))], names=["word", "cost", "options"])

    near = asked.join(keyed, "key").groupBy("word").agg(F.collect_set(F.struct("rest", "other", "way")).alias("like"))  # a word meets at most all ways
    return near.mapInArrow(stand_for, "word string, cost double, options array<string>").where(F.col("cost") < 9)


def map_values(typed: DataFrame, catalog: DataFrame, value: str) -> DataFrame:
    """The entry meant by each distinct plain value of ``typed``: value, esco_id, cost, jaccard; values without one are absent.

    First each distinct word is read as a word of the list (:func:`meant_words`), which makes a value a set of such words.
    Then :func:`similarity_join` is run between the distinct sets and the entries at ``VALUE_LIKE``: tokens by rarity, rare
    prefixes joined, length and positional filters, Jaccard exact. An entry counts if all its words, be it one, are met; the
    most similar, then smallest id is kept. A value may have ``EDITS`` edits in all. Each distinct word, value and set is
    looked at once, however many rows have it.
    """
    listed: dict[str, list[str]] = defaultdict(list)
    entries: set[tuple[str, str]] = set()
    rows = forms(catalog).limit(LIST_BOUND + 1).collect()
    if len(rows) > LIST_BOUND:
        raise ValueError(f"the reference list has more than {LIST_BOUND} ways of writing entries")
    for r in rows:
        listed[r["label"]].append(r["form"])
        entries.add((r["esco_id"], r["label"]))
    single, several = known_ways(listed)
    spark = typed.sparkSession
    values = cut(typed.select(F.col(value).alias("lid")).where(F.col("lid") != "").distinct())
    each = values.select("lid", F.explode(F.split("lid", " ")).alias("word"))
    meant = meant_words(each.select("word").distinct(), single)
    # a word that stands for nothing stays in the set, marked, and makes it less similar
    tokens = each.join(meant, "word", "left").groupBy("lid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("options", F.array(F.concat(F.lit("?"), F.col("word")))))))).alias("tokens"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
    )
    tokens = cut(tokens.where((F.col("cost") <= EDITS) & F.exists("tokens", lambda t: ~t.startswith("?"))).withColumn("set", F.array_join("tokens", " ")))

    sets: list[tuple[str, str, list[str]]] = []
    for n, (ident, label) in enumerate(sorted(entries)):
        parts = sorted(set(label.split()))
        sets.append((f"{n}", ident, parts))
        for w in parts:
            for k, way in enumerate(several.get(w, [])):
                sets.append((f"{n} {w} {k}", ident, sorted({x for x in parts if x != w} | {f"+{x}" for x in way})))
    right = spark.createDataFrame(sets, "rid string, esco_id string, tokens array<string>")
    distinct = tokens.groupBy("set").agg(F.first("tokens").alias("tokens")).select(F.col("set").alias("lid"), "tokens")
    pairs = similarity_join(distinct, right.select("rid", "tokens"), VALUE_LIKE)
    pairs = pairs.join(right.withColumnRenamed("tokens", "needed"), "rid").where(F.size(F.array_except("needed", F.split("lid", " "))) == 0)
    best = pairs.groupBy(F.col("lid").alias("set")).agg(F.min(F.struct((-F.col("jaccard")).alias("_j"), "esco_id")).alias("b"))
    return tokens.join(best, "set").select(F.col("lid").alias(value), "b.esco_id", "cost", (-F.col("b._j")).alias("jaccard"))


def typed_values(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows to map: src, row_id, typed. Blank values, and items that have an id already, are no case."""
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)[\s\p{Cf}]+", "") == "", F.lit(True))
    a = items.where(~blank(F.col("name")) & blank(F.col("esco_id"))).select(F.lit("ksa_item").alias("src"), F.col("item_id").alias("row_id"), F.col("name").alias("typed"))
    b = checks.where(~blank(F.col("esco_export"))).select(F.lit("laiser_similarity_validation").alias("src"), F.col("validation_id").alias("row_id"), F.col("esco_export").alias("typed"))
    return a.unionByName(b)


def meant_entries(items: DataFrame, checks: DataFrame, catalog: DataFrame) -> DataFrame:
    """src, row_id, esco_id of every row of :func:`typed_values`; ``none`` if the list has no entry that is meant.

    A value with an id of the list means that entry, which takes no search; else its words decide, by :func:`map_values`.
    Values are mapped once each, however many rows have them; the result is joined back to the rows, where AQE splits the
    partition of a hot value.
    """
    rows = typed_values(items, checks).select("src", "row_id", typed_id(F.col("typed")).alias("_id"), plain(F.regexp_replace("typed", r"(?i)^\W*(?:esc[o0]|skill)\b\W*[0-9OISBZl]{4,5}\b", " ")).alias("_value"))
    ids = catalog.select(F.col("esco_id").alias("_id"), F.col("esco_id").alias("by_id")).distinct()
    rows = cut(rows.join(ids, "_id", "left").select("src", "row_id", "by_id", F.when(F.col("by_id").isNull(), F.col("_value")).alias("_value")))  # read twice
    names = map_values(rows.where(F.col("by_id").isNull()), catalog, "_value").select("_value", F.col("esco_id").alias("by_name"))
    return rows.join(names, "_value", "left").select("src", "row_id", F.coalesce("by_id", "by_name", F.lit("none")).alias("esco_id"))
