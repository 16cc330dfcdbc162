"""Sinks: CSV, JSON, text by section, audit log, cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.items import has_id

AUDIT = ("timestamp", "afsc", "mode", "status", "metrics", "error")


def csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    df.select(*(columns or df.columns)).write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def documents(df: DataFrame, path: str) -> None:
    """Each row as one JSON document, nested columns as they are."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def sections(df: DataFrame, path: str, key: str = "code", text: str = "text") -> None:
    """The text of each key in a folder of its own."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def audit(df: DataFrame, path: str, most: int = 5000) -> None:
    """Rows appended to an audit log; errors are cut to ``most`` characters."""
    df.select(*AUDIT).withColumn("error", F.left("error", F.lit(most))).write.mode("append").json(path)


def cache(df: DataFrame, path: str, key: str) -> None:
    """New rows of a cache table appended, one a key."""
    df.groupBy(key).agg(F.min("reply").alias("reply")).write.mode("append").parquet(path)


def bulk_import(items: DataFrame, names: DataFrame, path: str) -> None:
    """Nodes and relationships as three CSV folders for a bulk import; similarities are empty where the items have none."""
    none = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("double").alias(c)
    csv(names.select("code", "name"), f"{path}/nodes_afsc")
    csv(items.groupBy(F.col("text").alias("name"), F.col("item_type").alias("type")).agg(F.min_by("source", "ord").alias("source"), F.min_by(F.when(has_id("esco_id"), F.col("esco_id")), F.when(has_id("esco_id"), F.col("ord"))).alias("esco_id")), f"{path}/nodes_item")
    csv(items.select(F.col("doc_code").alias("afsc_code"), F.col("text").alias("item_name"), "item_type", "evidence", "esco_id", "confidence", none("sim_skill_evidence"), none("sim_skill_esco")), f"{path}/rels_requires")
