"""The N best items of every group, by secondary sort and streaming.

No group is ever buffered: rows are sorted inside their partition by Spark's external (spilling) sort and pass through
Python as Arrow batches; all that is kept between two batches is the current group's key and how many rows it has given.
A group of any size is first cut down inside every partition of the incoming data, so at most N rows a group and
partition are shuffled by group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before; the first row is True. Nulls are equal."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        col = batch.column(k)
        a, b = col[1:], col[:-1]
        same = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        new[1:] |= ~np.asarray(pc.or_(same, both).to_numpy(zero_copy_only=False), dtype=bool)
    return new


def _emit(keys: list[str], n: int, rank: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = _runs(b, keys)
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, at, 0))
            pos = at - start + 1
            head = tuple(b.column(k)[0].as_py() for k in keys)
            if head == last:  # the group goes on from the batch before
                pos = np.where(start == 0, pos + given, pos)
            last, given = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys), int(pos[-1])
            keep = pos <= n
            if keep.any():
                ranks = pa.array(pos[keep].astype(np.int32))
                out = b.filter(pa.array(keep))
                names = [x for x in out.schema.names if x != rank]
                yield pa.RecordBatch.from_arrays([out.column(x) for x in names] + [ranks], names=[*names, rank])

    return run


def _pass(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    cols = [x for x in df.columns if x != rank]
    schema = df.select(*cols, F.lit(0).cast("int").alias(rank)).schema
    return df.select(*cols).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], *order).mapInArrow(_emit(keys, n, rank), schema)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """The first ``n`` rows by ``order`` of each group of ``keys``, numbered from 1 in ``rank``.

    ``order`` must end in a unique column, else the choice among ties is open. Null keys form a group of their own.
    The first pass works on the partitions as they are and so needs no shuffle. Rows of a hot group are thereby cut down
    where they lie, and the second pass, hash-partitioned by group, gets at most ``n`` rows of it from each partition. An empty table gives an empty table; columns not named pass through; a column called as
    ``rank`` is replaced.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    local = _pass(df, keys, order, n, rank)
    return _pass(local.drop(rank).repartition(*[F.col(k) for k in keys]), keys, order, n, rank)


def latest_rows(rels: DataFrame) -> DataFrame:
    """Valid rows of rels_requires, the latest of each code, type and item name: afsc_code, item_type, rel_id, confidence.

    Rows with null code, type or name, or a confidence that is null, NaN or outside 0..1, are left out. The latest row
    is taken by a partial aggregation, so a third of all rows under one name is one row a task before the shuffle.
    """
    conf = F.col("confidence")
    valid = rels.select(
        F.upper(F.regexp_replace("afsc_code", r"(?U)^\s+|\s+$", "")).alias("afsc_code"),
        F.lower(F.regexp_replace("item_type", r"(?U)^\s+|\s+$", "")).alias("item_type"),
        "item_name", "rel_id", "ingested_at", "confidence",
    ).where(F.col("afsc_code").isNotNull() & F.col("item_type").isNotNull() & F.col("item_name").isNotNull() & ~F.isnan(conf) & conf.between(0.0, 1.0))
    best = F.max(F.struct("ingested_at", "rel_id", "confidence")).alias("best")
    return valid.groupBy("afsc_code", "item_type", "item_name").agg(best).select("afsc_code", "item_type", F.col("best.rel_id").alias("rel_id"), F.col("best.confidence").alias("confidence"))


def best_requirements(rels: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` rows of highest confidence of each code and type; ties by smaller ``rel_id``.

    Shuffles: one by (code, type, name), which also scatters each group over all tasks, and one of at most ``n`` rows a
    group and task.
    """
    got = top_n(latest_rows(rels), ["afsc_code", "item_type"], [F.col("confidence").desc(), F.col("rel_id").asc()], n)
    return got.select("afsc_code", "item_type", "rank_no", "rel_id")
