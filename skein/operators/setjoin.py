"""Set-similarity join by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import cut

#: Up to so many distinct tokens their ranks go to the workers by broadcast (some 100 bytes each); beyond, ranks are joined by shuffle.
RANKS_BY_BROADCAST = 500_000


def rank_table(frequency: DataFrame):
    """Ranks of all tokens, rarest first, as a broadcast; None if there are more than ``RANKS_BY_BROADCAST``."""
    rows = frequency.limit(RANKS_BY_BROADCAST + 1).toPandas()
    if len(rows) > RANKS_BY_BROADCAST:
        return None
    order = rows.sort_values(["n", "token"])["token"]
    return frequency.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(order)})


def rank_rows(frequency: DataFrame) -> DataFrame:
    """token and its rank ``_r``, rarest first, ties by token: numbers by place in a range-partitioned sort, so no two tokens share one."""
    return cut(frequency.orderBy("n", "token").select("token", F.monotonically_increasing_id().alias("_r")))


def ranked(df: DataFrame, tokens: str, table, rows: DataFrame | None, ident: str) -> DataFrame:
    """``df`` with ``tokens`` as ``_ranks``, sorted ranks (bigint, rarest first), by the broadcast ``table`` or by joining ``rows``."""
    if table is None:
        each = df.select(ident, F.explode(tokens).alias("token")).join(rows, "token")
        return each.groupBy(ident).agg(F.array_sort(F.collect_list("_r")).alias("_ranks")).join(df.drop(tokens), ident)
    others = [c for c in df.columns if c != tokens]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for b in batches:
            lists = b.column(len(others))
            flat = np.fromiter((known[t] for t in lists.flatten().to_pylist()), dtype=np.int64)
            sizes = np.asarray(lists.value_lengths())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            flat = flat[np.lexsort((flat, owner))]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*others, "_ranks"])

    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("_ranks", T.ArrayType(T.LongType()))])
    return df.select(*others, tokens).mapInArrow(run, schema)


def similarity_join(left: DataFrame, right: DataFrame | None, threshold: float, by: str | None = None) -> DataFrame:
    """All pairs of a left and a right set with Jaccard >= ``threshold``: lid, rid, jaccard, and ``by`` where given.

    ``left`` has lid and tokens, ``right`` rid and tokens; ids are unique (within ``by``), tokens distinct and not null.
    Null and empty sets meet nothing. With ``by`` only sets of equal, non-null ``by`` meet. Without ``right`` the left sets
    are joined with themselves, and only pairs with lid < rid come out.

    Tokens are ordered by their frequency over both sides, rarest first. Two sets that must share two tokens or more share the
    two rarest of these among the first |x| - ceil(t|x|) + 2 of either, so pairs of such prefix tokens are joined; sets so
    small that one shared token is enough are joined by single tokens. Then come the length and the positional filter, and
    Jaccard is computed exactly. A pair is emitted at its first shared tokens only, so no pass for distinct pairs is needed.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    alone = right is None
    keys = [by] if by else []
    left = left.where(F.size("tokens") > 0)
    words = left.select(F.explode("tokens").alias("token"))
    if not alone:
        right = right.where(F.size("tokens") > 0)
        words = words.unionAll(right.select(F.explode("tokens").alias("token")))
    frequency = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    t = F.lit(threshold)
    table = rank_table(frequency)
    rows = rank_rows(frequency) if table is None else None

    single = (1 + threshold) / threshold + 1e-9  # sets of so many tokens together need to share only one

    def sets(df: DataFrame, ident: str) -> DataFrame:
        unique = F.struct(*keys, ident) if by else F.col(ident)
        return ranked(df.select(*keys, ident, "tokens", unique.alias("_u")), "tokens", table, rows, "_u").drop("_u").withColumnRenamed("_ranks", "x")

    def prefixes(r: DataFrame, ident: str) -> DataFrame:
        n = F.size("x")
        first = F.slice("x", F.lit(1), F.least(n, n - F.ceil(t * n - 1e-9).cast("int") + 2))
        two = F.flatten(F.transform(first, lambda v, i: F.transform(F.slice(first, i + 2, n), lambda w, k: F.struct(v.alias("v"), w.alias("w"), (i + k + 1).alias("i")))))
        one = F.when(n + 1 <= single, F.transform("x", lambda v, i: F.struct(v.alias("v"), F.lit(-1).cast("long").alias("w"), i.alias("i")))).otherwise(F.array().cast("array<struct<v:bigint,w:bigint,i:int>>"))
        return r.select(*keys, ident, "x", F.explode(F.concat(two, one)).alias("k")).select(*keys, ident, "x", "k.*")

    one_side = cut(sets(left, "lid")) if alone else sets(left, "lid")  # read twice
    a = prefixes(one_side, "lid")
    b = prefixes(one_side.withColumnRenamed("lid", "rid") if alone else sets(right, "rid"), "rid").withColumnsRenamed({"x": "y", "i": "j"})
    pairs = a.join(b, [*keys, "v", "w"])
    if alone:
        pairs = pairs.where(F.col("lid") < F.col("rid"))
    nx, ny = F.size("x"), F.size("y")
    lone = F.col("w") < 0
    need = F.ceil((t / (1 + t)) * (nx + ny) - 1e-9)
    pairs = pairs.where((ny >= t * nx - 1e-9) & (nx >= t * ny - 1e-9) & (lone == (nx + ny <= single)))  # length filter
    so_far = F.when(lone, 1).otherwise(2)
    pairs = pairs.where(so_far + F.least(nx - F.col("i") - 1, ny - F.col("j") - 1) >= need)  # positional filter
    before = F.size(F.array_intersect(F.slice("x", F.lit(1), F.col("i")), F.slice("y", F.lit(1), F.col("j"))))
    pairs = pairs.where(before == so_far - 1)
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.select(*keys, "lid", "rid", (shared / (nx + ny - shared)).alias("jaccard")).where(F.col("jaccard") >= t - 1e-9)
