"""From raw documents to items ready for the graph, all documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import computed, md5_left
from skein.operators.clean import clean_text
from skein.operators.extract import with_heuristics, with_mined
from skein.operators.graph import store, stored, upsert, upsert_counters
from skein.operators.items import LOW_CONFIDENCE, MAX_LEN_OTHER, MAX_LEN_SKILL, MIN_LEN, min_confidence, quality_filter
from skein.operators.similarity import SAME, SHORTEST, canonical_items
from skein.operators.stats import count_types
from skein.session import cut
from skein.sources import sinks


@dataclass(frozen=True)
class Config:
    """Knobs of a run; explicit, so that executors need no environment."""

    min_confidence: float = 0.0
    keep_types: bool = True
    strict: bool = False
    domain_bias: bool = False
    dedupe: bool = True
    enhance: bool = False
    top_k: int = 6
    min_len: int = MIN_LEN
    max_len: int = MAX_LEN_SKILL
    max_len_other: int = MAX_LEN_OTHER
    low_confidence: float = LOW_CONFIDENCE
    same: float = SAME
    shortest: int = SHORTEST


def run(docs: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Items and a summary row a document from ``docs`` (doc_code, raw_text; codes unique).

    clean, extract, confidence, enhancement, quality filter, near duplicates; nothing is written.
    """
    df = with_mined(computed(docs.select("doc_code", "raw_text"), _text=clean_text("raw_text")).drop("raw_text"), "_text", config.top_k)
    found = F.transform("mined", lambda x: F.struct(x["ord"].alias("ord"), x["text"].alias("text"), x["confidence"].alias("confidence"), x["source"].alias("source"), F.lit("skill").alias("item_type")))
    if config.enhance:
        df = with_heuristics(df, "_text")
        found = F.concat(found, F.col("more"))
    items = df.select("doc_code", F.size("mined").alias("n_items_raw"), F.inline(found)).withColumn("esco_id", F.lit(None).cast("string"))
    items = min_confidence(items, config.min_confidence)
    if not config.keep_types:
        items = items.withColumn("item_type", F.lit("skill"))
    # one number for all documents, in order within each
    items = items.withColumn("ord", F.xxhash64("doc_code", "text", "item_type").bitwiseAND(F.lit((1 << 40) - 1)) + F.col("ord") * F.lit(1 << 40))
    items = cut(items)  # read three times below; small beside the texts it comes from
    good = quality_filter(items, config.strict, config.domain_bias, (config.min_len, config.max_len, config.max_len_other), config.low_confidence)
    final = good
    if config.dedupe:
        kept = canonical_items(good, config.same, config.shortest).select("doc_code", "item_type", F.col("leader_ord").alias("ord"), F.col("esco_id").alias("lifted_id"))
        final = good.join(kept, ["doc_code", "item_type", "ord"]).withColumn("esco_id", F.coalesce("esco_id", "lifted_id")).drop("lifted_id")
    counts = good.groupBy("doc_code").agg(F.max("n_items_raw").alias("n_items_raw"), F.count(F.lit(1)).alias("n_items_after_filters"))
    kept = count_types(final, "doc_code").withColumnRenamed("total", "n_items_after_dedupe")
    summary = docs.select("doc_code").join(counts, "doc_code", "left").join(kept, "doc_code", "left").na.fill(0)
    return final.withColumn("content_sig", md5_left(F.col("text"), 16)), summary


def ingest(docs: DataFrame, path: str, version: int, now_ms: int, config: Config = Config(), write: bool = True) -> tuple[DataFrame, DataFrame]:
    """:func:`run`, and its items upserted into the graph stored as ``version`` under ``path``, giving version + 1: summary and counters.

    An audit row a document is appended. Without ``write`` nothing is stored, and the counters say what would have been done.
    """
    spark = docs.sparkSession
    final, summary = run(docs, config)
    final, summary = cut(final), cut(summary)
    before = stored(spark, path, version)
    counters = cut(upsert_counters(before, final))
    if write:
        store(upsert(before, final, now_ms), path, version + 1)
        metrics = F.create_map(*[x for c in ("n_items_raw", "n_items_after_filters", "n_items_after_dedupe") for x in (F.lit(c), F.col(c).cast("long"))])
        stamp = F.date_format(F.timestamp_millis(F.lit(now_ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        sinks.audit(summary.select(stamp.alias("timestamp"), F.col("doc_code").alias("afsc"), F.lit("batch").alias("mode"), F.lit("ok").alias("status"), metrics.alias("metrics"), F.lit(None).cast("string").alias("error")), f"{path}/audit")
    return summary, counters
