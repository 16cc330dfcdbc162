"""An extension beyond the batch engine: documents from a stream upserted into stored node and edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skein.operators.graph import store, stored, upsert


def ingest(stream: DataFrame, items_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, clock: Callable[[int], int]) -> StreamingQuery:
    """Each micro-batch is turned into items and merged; batch n writes version n+1 from version n, so a retry repeats itself exactly."""

    def merge(batch: DataFrame, n: int) -> None:
        store(upsert(stored(batch.sparkSession, path, n), items_of(batch), clock(n)), path, n + 1)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
