"""Items of varying length packed into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.tokens import token_sizes
from skein.session import cut

CAPACITY = 4096
#: Items that a worker packs together; bounds its memory (some 50 bytes an item). Each block leaves a few part-filled containers.
BLOCK = 200_000
#: Part-filled containers that each block hands on, and blocks or groups whose open containers are packed anew together.
OPEN, FAN_IN = 16, 64


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each size (all 1..capacity) and the reciprocal class of each container.

    Harmonic packing: class k holds the sizes in (capacity/(k+1), capacity/k]; of these a container of class k takes k,
    largest first, which always fit while no k+1 do. The room left is topped up with the largest sizes that fit it, which
    all are of higher classes. Where class k itself runs out, the top-up fills its last container.
    """
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    where = np.empty(len(sizes), dtype=np.int64)
    present, starts, counts = np.unique(-ordered, return_index=True, return_counts=True)
    rows = {int(-s): (int(a), int(n)) for s, a, n in zip(present, starts, counts, strict=True)}
    left = {s: n for s, (_, n) in rows.items()}
    below = list(range(capacity + 1))  # below[s]: the largest size at most s that is left, found by path halving
    for s in range(1, capacity + 1):
        if s not in left:
            below[s] = s - 1

    def find(s: int) -> int:
        while below[s] != s:
            below[s] = below[below[s]]
            s = below[s]
        return s

    kinds: list[int] = []
    top = find(capacity)
    while top:
        k = capacity // top  # the class of the largest size left
        room, number = capacity, len(kinds)
        while True:
            s = find(room)
            if not s:
                break
            a, n = rows[s]
            m = min(left[s], room // s)
            from_ = a + n - left[s]
            where[order[from_ : from_ + m]] = number
            left[s] -= m
            room -= m * s
            if not left[s]:
                below[s] = s - 1
            if not room:
                break
        kinds.append(k)
        top = find(top)
    return where, np.array(kinds, dtype=np.int32)


def _placed(length: np.ndarray, capacity: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Container, its class and whether it is among the ``OPEN`` emptiest that have room, of each length; and the next number."""
    where, kinds = pack_sizes(length, capacity)
    room = capacity - np.bincount(where, weights=length, minlength=len(kinds))
    emptiest = np.argsort(-room, kind="stable")[:OPEN]
    is_open = np.zeros(len(kinds), dtype=bool)
    is_open[emptiest[room[emptiest] > 0]] = True
    return where + first, kinds[where] if len(kinds) else kinds, is_open[where] if len(kinds) else is_open, first + len(kinds)


def _pack(capacity: int, ident: str):
    names = [ident, "piece", "piece_tokens", "n_pieces", "container_id", "container_class", "_open"]

    def flush(ids: list[pa.Array], sizes: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        keys, size = pa.concat_arrays(ids), np.concatenate(sizes)
        pieces = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.where(piece == pieces[row] - 1, size[row] - (pieces[row] - 1) * capacity, capacity)
        where, kinds, is_open, after = _placed(length, capacity, first)
        cols = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(length, pa.int64()), pa.array(pieces[row], pa.int32()), pa.array(where, pa.int64()), pa.array(kinds, pa.int32()), pa.array(is_open, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=names), after

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        first = (ctx.partitionId() if ctx else 0) << 40
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        held = 0
        for b in batches:
            size = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
            keep = size > 0
            if not keep.any():
                continue
            ids.append(b.column(0).filter(pa.array(keep)))
            sizes.append(size[keep])
            held += int(keep.sum())
            if held >= BLOCK:
                out, first = flush(ids, sizes, first)
                yield out
                ids, sizes, held = [], [], 0
        if held:
            yield flush(ids, sizes, first)[0]

    return run


def pack(sized: DataFrame, ident: str, size: str, capacity: int = CAPACITY, refill: bool = True) -> DataFrame:
    """Containers for the items of ``sized``: ``ident``, piece, piece_tokens, n_pieces, container_id, container_class.

    Each task packs what it reads, in blocks: no shuffle at any size, and an item's source or group plays no part. An item
    above ``capacity`` is divided into full pieces and a rest, which are packed like items; no other is divided. Items
    of null or no size get no row. Equal rows are packed each by itself. Container numbers are unique; they depend on
    how the input is divided into partitions.

    With ``refill`` the ``OPEN`` emptiest containers of each block are emptied and packed anew, those of ``FAN_IN`` tasks
    together, and so on up a tree, so that many small tasks leave as little room as few large ones. Only their few items
    are shuffled; the rest is written once, so ``sized`` is read at once.
    """
    schema = T.StructType([
        T.StructField(ident, sized.schema[ident].dataType), T.StructField("piece", T.IntegerType()), T.StructField("piece_tokens", T.LongType()),
        T.StructField("n_pieces", T.IntegerType()), T.StructField("container_id", T.LongType()), T.StructField("container_class", T.IntegerType()), T.StructField("_open", T.BooleanType()),
    ])
    packed = sized.select(F.col(ident), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")).mapInArrow(_pack(capacity, ident), schema)
    if not refill:
        return packed.drop("_open")
    packed = cut(packed)
    done = packed.where(~F.col("_open"))
    rest = packed.where("_open").withColumn("_group", F.shiftright("container_id", 40))
    groups, level = packed.rdd.getNumPartitions(), 0
    while True:
        groups, level = -(-groups // FAN_IN), level + 1
        again = rest.withColumn("_group", F.floor(F.col("_group") / FAN_IN))
        rest = cut(again.groupBy("_group").applyInArrow(_repack(capacity, level), again.schema))
        done = done.unionByName((rest if groups <= 1 else rest.where(~F.col("_open"))).drop("_group"))
        if groups <= 1:
            return done.drop("_open")
        rest = rest.where("_open")


def _repack(capacity: int, level: int):
    def group(table: pa.Table) -> pa.Table:
        first = (level << 56) + (table["_group"][0].as_py() << 40)
        table = table.sort_by([("piece_tokens", "descending"), ("container_id", "ascending")])
        where, kinds, is_open, _ = _placed(table["piece_tokens"].to_numpy(), capacity, first)
        for name, col in (("container_id", pa.array(where, pa.int64())), ("container_class", pa.array(kinds, pa.int32())), ("_open", pa.array(is_open, pa.bool_()))):
            table = table.set_column(table.column_names.index(name), name, col)
        return table

    return group


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, refill: bool = True) -> DataFrame:
    """The documents' texts in containers of ``capacity`` tokens; blank and null texts as :func:`pack` says of no size."""
    return pack(token_sizes(documents, "text", ["doc_id"], vocabulary=vocabulary), "doc_id", "tokens", capacity, refill)


def oversized(packed: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Ids of the items that had to be divided, once each."""
    return packed.where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select(ident)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per class: containers, pieces, tokens and the share of the room filled. Two small aggregations."""
    each = packed.groupBy("container_id").agg(F.first("container_class").alias("container_class"), F.count(F.lit(1)).alias("n"), F.sum("piece_tokens").alias("t"))
    return each.groupBy("container_class").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.max("t").alias("fullest"))
