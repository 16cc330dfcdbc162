"""Sources: whole text files, JSON lines, CSV, taxonomy lists, pages, graph exports. All with declared schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TextIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import filled
from skein.operators.clean import plain_name

CORPUS = "doc_id string, afsc string, title string, category string, text string, page_start int"
GRAPH = "nodes array<struct<id string, type string, properties map<string,string>>>, edges array<struct<source string, target string, relationship string, properties map<string,string>>>"


def text_files(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """One row a file: code (the file's stem), path, text. With ``wanted`` (code, title) its rows, and missing where there is no file."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("code"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if wanted is None:
        return files
    return wanted.join(files, "code", "left").withColumn("missing", F.col("path").isNull())


def given_text(spark: SparkSession, text: str | None = None, path: str | None = None, stream: TextIO | None = None, placeholder: str = "") -> DataFrame:
    """One row of text: what is given, else the file's, else what the stream holds, else the placeholder; a blank one counts as none."""
    got = text if text and text.strip() else None
    if got is None and path:
        return spark.read.text(path, wholetext=True).select(F.when(F.trim("value") == "", placeholder).otherwise(F.col("value")).alias("text"))
    if got is None and stream is not None:
        got = stream.read()
    return spark.createDataFrame([(got if got and got.strip() else placeholder,)], "text string")


def rows_between(df: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (from 0, the last left out) in ``order``."""
    return df.orderBy(*order).offset(first).limit(last - first)


def with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with those of ``columns`` that it lacks, as empty texts."""
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})


def first_existing(df: DataFrame, names: list[str], put: str) -> DataFrame:
    """``df`` with the first of ``names`` that it has called ``put``; unchanged if it has none."""
    found = next((n for n in names if n in df.columns), None)
    return df.withColumnRenamed(found, put) if found else df


def json_lines(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def require_columns(df: DataFrame, needed: set[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := needed - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def bulk_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (afsc, text) of an upload, and the lines that are none with the reason.

    The text is ``md``, else ``sections`` as JSON, else ``{}``; a line needs an ``afsc``.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    j = F.from_json("value", "afsc string, md string, sections string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.select("value", j.alias("j")).select("value", "j.*")
    reason = F.when(F.col("_bad").isNotNull() | (F.get_json_object("value", "$").isNull()), F.lit("malformed")).when(filled(F.trim("afsc")).isNull(), F.lit("missing afsc"))
    rows = rows.withColumn("reason", reason)
    good = rows.where(F.col("reason").isNull()).select(F.trim("afsc").alias("afsc"), F.coalesce(filled("md"), F.get_json_object("value", "$.sections"), F.lit("{}")).alias("text"))
    return good, rows.where(F.col("reason").isNotNull()).select("value", "reason")


def csv(spark: SparkSession, path: str, schema: str | None = None, plain: bool = False) -> DataFrame:
    """CSV with a header and quoted cells of several lines; ``plain`` writes the names in lower case with _."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*map(plain_name, df.columns)) if plain else df


def taxonomy(spark: SparkSession, path: str, alts: int = 8) -> DataFrame:
    """esco_id, label, alts of a taxonomy CSV with a header in any case; no rows if there is no file."""
    try:
        df = csv(spark, path, plain=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "esco_id string, label string, alts array<string>")
    alt = next((c for c in ("alt_labels", "alts", "altlabels") if c in df.columns), None)
    listed = F.slice(F.filter(F.transform(F.split(F.coalesce(F.col(alt), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""), 1, alts) if alt else F.array().cast("array<string>")
    return df.select(F.trim("esco_id").alias("esco_id"), F.trim("label").alias("label"), listed.alias("alts")).where((F.col("esco_id") != "") & (F.col("label") != ""))


def pages(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page (from 1), text of binary files, by a parser that gives one text a page; a file it can't read has one empty page."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts = parser(bytes(content))
                except Exception:  # noqa: BLE001 - a broken file is an empty page
                    texts = [""]
                rows += [(p, i, t or "") for i, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.mapInPandas(run, "path string, page int, text string")


def page_texts(pages_: DataFrame) -> DataFrame:
    """The pages of each file joined by an empty line."""
    got = pages_.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return got.select("path", F.array_join("p.text", "\n\n").alias("text"))


def file_index(spark: SparkSession, folder: str, suffix: str = "md") -> DataFrame:
    """stem, folder and path of the files of a tree; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "path")


def graph_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of exported graphs: a graph a file, or with ``lines`` a graph a line."""
    doc = spark.read.schema(GRAPH).option("multiLine", not lines).json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))
