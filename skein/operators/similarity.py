"""Token and character similarity, greedy clustering and best-match alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import col, filled, match_form, tokens
from skein.operators.clean import without_prefix
from skein.operators.items import has_id
from skein.operators.setjoin import similarity_join
from skein.session import cut

WEIGHT_TOKENS, WEIGHT_CHARS = 0.6, 0.4
SAME, SHORTEST = 0.86, 4
THRESHOLDS = {"skill": 0.90, "knowledge": 0.92, "ability": 0.90}


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of the distinct words of two match forms; 1 if both have none, 0 if one has."""
    x, y = tokens(a), tokens(b)
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / n)


def ratio(a: str, b: str) -> float:
    """Matching-blocks ratio of two strings; the order of the two matters."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`ratio` row by row, in Arrow batches; null if either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def hybrid(a: Column | str, b: Column | str) -> Column:
    return WEIGHT_TOKENS * jaccard(a, b) + WEIGHT_CHARS * char_ratio(col(a), col(b))


def least_jaccard(threshold: float) -> float:
    """Below this word similarity no character similarity reaches ``threshold``, so blocking by words loses nothing."""
    return (threshold - WEIGHT_CHARS) / WEIGHT_TOKENS


#: Up to so many pairs that are still open one task settles them; beyond, a distributed round comes first.
OPEN_AT_ONCE = 1_000_000


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (g, v) among pairs that come sorted by the place of v: v is a member if one of its earlier likes is none."""
    members: set[tuple[str, int]] = set()
    for b in batches:
        got = []
        for g, u, v in zip(*(b.column(c).to_pylist() for c in ("g", "u", "v")), strict=True):
            if (g, u) not in members and (g, v) not in members:
                members.add((g, v))
                got.append((g, v))
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.string()), pa.array([v for _, v in got], pa.int64())], names=["g", "v"])


def members_of(pairs: DataFrame) -> DataFrame:
    """Who joins another, greedily: g, v of ``pairs`` (g, at, u, v: in group g, v is at place ``at`` and like the earlier u).

    Best first, each opens a cluster unless an earlier one it is like has. All groups go on at once: in a round those with no
    open earlier like open a cluster, and those like them become members; what is left shrinks quickly. When no more than
    ``OPEN_AT_ONCE`` pairs are open, these are settled in order of place, with only the members' numbers kept.
    """
    found = None
    pairs = cut(pairs)
    while pairs.limit(OPEN_AT_ONCE + 1).count() > OPEN_AT_ONCE:
        opens = pairs.select("g", F.col("u").alias("o")).distinct().join(pairs.select("g", F.col("v").alias("o")).distinct(), ["g", "o"], "left_anti")
        joins = cut(pairs.join(opens.withColumnRenamed("o", "u"), ["g", "u"], "left_semi").select("g", "v").distinct())
        found = joins if found is None else found.unionByName(joins)
        pairs = cut(pairs.join(joins, ["g", "v"], "left_anti").join(joins.withColumnRenamed("v", "u"), ["g", "u"], "left_anti"))
    rest = pairs.coalesce(1).sortWithinPartitions("g", "at", "u").mapInArrow(_settle, "g string, v long")
    return rest if found is None else found.unionByName(rest)


def greedy_clusters(items: DataFrame, threshold: float = SAME, shortest: int = SHORTEST) -> DataFrame:
    """Near duplicates of a document and type joined, best first: the items (doc_code, item_type, ord, text, esco_id) with leader_ord.

    Items go in order of (has id, confidence, length) descending, then ``ord`` (unique in its document and type); each joins
    the first cluster whose leader is similar enough, texts under ``shortest`` characters never do. Null texts count as
    empty, null and NaN confidences as 0; null codes and types are equal.

    Texts that are equal for matching all join the same cluster, so only one of them goes on. Similar pairs come from one
    prefix-filter join on words within the group, lossless for ``threshold``, and are compared by character in parallel; the
    greedy order is then resolved on these pairs alone. A group costs its similar pairs and not its square, and no group is
    gathered anywhere.
    """
    if threshold <= WEIGHT_CHARS:
        raise ValueError(f"threshold must be above {WEIGHT_CHARS}")
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    group = F.concat(mark("doc_code"), F.lit("\u0001"), mark("item_type"))
    conf = F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.0))
    text = F.coalesce("text", F.lit(""))
    place = F.struct((~has_id("esco_id")).alias("a"), (-conf).alias("b"), (-F.length("text")).alias("c"), F.col("ord").alias("d"))
    ranked = cut(items.withColumn("text", text).select("doc_code", "item_type", group.alias("g"), "ord", "text", match_form("text").alias("form"), place.alias("at"), "esco_id"))
    # of each form the best text that may join, and the best that only opens
    long = F.length("text") >= shortest
    forms = ranked.groupBy("g", "form").agg(F.min(F.when(long, F.col("at"))).alias("long"), F.min(F.when(~long, F.col("at"))).alias("short"))
    forms = cut(forms.withColumn("no", F.monotonically_increasing_id()))
    sets = forms.select("g", F.col("no").alias("lid"), F.when(F.col("form") == "", F.array(F.lit(""))).otherwise(tokens("form")).alias("tokens"))
    near = cut(similarity_join(sets, None, least_jaccard(threshold), "g"))
    few = F.broadcast if near.limit(OPEN_AT_ONCE + 1).count() <= OPEN_AT_ONCE else lambda df: df
    side = lambda n: forms.select(F.col("no").alias(f"_{n}"), F.struct("form", "long", "short").alias(n))
    near = side("lid").join(few(near.withColumnsRenamed({"lid": "_lid", "rid": "_rid"})), "_lid")
    near = side("rid").join(few(near) if few is F.broadcast else near, "_rid")
    # the later of two is compared with the earlier, which may have been opened by either kind of text
    way = lambda v, u, k: F.when(F.col(f"{u}.{k}") < F.col(f"{v}.long"), F.struct(F.col(f"{v}.long").alias("at"), F.col(f"{v}.form").alias("form"), F.col(f"{u}.{k}").alias("u"), F.col(f"{u}.form").alias("of"), F.lit(k == "short").alias("opens")))
    both = F.array(*[way(v, u, k) for v, u in (("lid", "rid"), ("rid", "lid")) for k in ("long", "short")])
    near = near.select("g", "jaccard", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("p")).select("g", "jaccard", "p.*")
    score = WEIGHT_TOKENS * F.col("jaccard") + WEIGHT_CHARS * char_ratio("form", "of")
    alike = near.withColumn("score", score).where(F.col("score") >= threshold).select("g", "at", "u", "opens")
    own = forms.where(F.col("short") < F.col("long")).select("g", F.col("long").alias("at"), F.col("short").alias("u"), F.lit(True).alias("opens"))
    alike = cut(alike.unionByName(own).withColumn("v", F.col("at.d")))
    # a short text always opens: who is like an earlier one is a member at once
    sure = alike.where("opens").select("g", "v").distinct()
    rest = alike.where(~F.col("opens")).select("g", "at", F.col("u.d").alias("u"), "v").join(sure, ["g", "v"], "left_anti").join(sure.withColumnRenamed("v", "u"), ["g", "u"], "left_anti")
    members = cut(sure.unionByName(members_of(rest)))
    named = alike.where(~F.col("opens")).withColumn("_u", F.col("u.d")).join(members.withColumnRenamed("v", "_u"), ["g", "_u"], "left_anti").drop("_u")
    leads = named.unionByName(alike.where("opens"))
    to = leads.groupBy("g", "v").agg(F.min("u").alias("lead")).select("g", "v", F.col("lead.d").alias("led"))
    heads = forms.where(F.col("long").isNotNull()).select("g", "form", F.col("long.d").alias("v")).join(to, ["g", "v"], "left").select("g", "form", F.coalesce("led", "v").alias("led"))
    # short texts open a cluster each, which their own repeats join
    opened = ranked.where(~long).groupBy("g", "text").agg(F.min("at").alias("_o")).select("g", "text", F.col("_o.d").alias("_own"))
    out = ranked.where(long).join(heads, ["g", "form"]).select("doc_code", "item_type", "ord", "text", "esco_id", F.col("led").alias("leader_ord"))
    return out.unionByName(ranked.where(~long).join(opened, ["g", "text"]).select("doc_code", "item_type", "ord", "text", "esco_id", F.col("_own").alias("leader_ord")))


def canonical_items(items: DataFrame, threshold: float = SAME, shortest: int = SHORTEST) -> DataFrame:
    """Of each cluster the leader, with the first id of its members where it has none, and the cluster's size."""
    ids = F.min_by(F.when(has_id("esco_id"), F.col("esco_id")), F.when(has_id("esco_id"), F.col("ord")))
    return greedy_clusters(items, threshold, shortest).groupBy("doc_code", "item_type", "leader_ord").agg(F.max(F.when(F.col("ord") == F.col("leader_ord"), F.col("text"))).alias("text"), ids.alias("esco_id"), F.count(F.lit(1)).alias("n_members"))


def align(items: DataFrame, catalog: DataFrame, alts: int = 8, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """The best entry of ``catalog`` (esco_id, label, alt_labels) for each item: ord, esco_id, score.

    Labels count before alternatives, entries in order of id; the first best wins, if it reaches its type's threshold.
    Pairs come from the prefix-filter join on words, which is lossless for the thresholds; only these are compared by
    character. Words without letters or digits make no query.
    """
    alt = F.slice(F.filter(F.transform(F.split(F.coalesce("alt_labels", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""), 1, alts)
    cand = catalog.where(has_id("esco_id") & filled("label").isNotNull()).select("esco_id", F.posexplode(F.concat(F.array("label"), alt)).alias("alt_no", "cand"))
    cand = cand.select("esco_id", "alt_no", match_form("cand").alias("cand")).where(F.col("cand") != "")
    query = items.select(F.col("item_type"), match_form(without_prefix("text", "item_type")).alias("q")).where(F.length("q") >= 3).distinct()
    need = F.coalesce(*[F.when(F.col("item_type") == k, F.lit(v)) for k, v in thresholds.items()], F.lit(0.90))
    lowest = least_jaccard(min(0.90, *thresholds.values()))
    sets = lambda df, c, ident: df.select(F.col(c).alias(ident)).distinct().select(ident, tokens(ident).alias("tokens"))
    near = similarity_join(sets(query, "q", "lid"), sets(cand, "cand", "rid"), lowest).select(F.col("lid").alias("q"), F.col("rid").alias("cand"), F.col("jaccard").alias("j"))
    pairs = near.withColumn("ratio", char_ratio("q", "cand")).join(query, "q").join(cand, "cand")
    scored = pairs.withColumn("score", WEIGHT_TOKENS * F.col("j") + WEIGHT_CHARS * F.col("ratio")).where(F.col("score") >= need)
    best = scored.groupBy("item_type", "q").agg(F.min(F.struct((-F.col("score")).alias("s"), "alt_no", "esco_id")).alias("b")).select("item_type", "q", F.col("b.esco_id").alias("esco_id"), (-F.col("b.s")).alias("score"))
    keyed = items.select("ord", "item_type", match_form(without_prefix("text", "item_type")).alias("q"))
    return keyed.join(best, ["item_type", "q"]).select("ord", "esco_id", "score")
