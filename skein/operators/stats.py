"""Counts, shares, samples and checks over items and similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.items import GENERIC_TERMS, has_id, numbered
from skein.session import cut

# The steps of the threshold sweep, as floating-point arithmetic makes them.
SWEEP = (0.3, 0.35, 0.39999999999999997, 0.44999999999999996, 0.49999999999999994, 0.5499999999999999, 0.5999999999999999, 0.6499999999999999, 0.6999999999999998, 0.7499999999999998, 0.7999999999999998)
LOW_EVIDENCE, LOW_ENTRY = 0.45, 0.35


def count_types(df: DataFrame, *keys: str) -> DataFrame:
    """Items of each type, and with an id, of each key (or overall)."""
    kind = lambda k: F.count_if(F.col("item_type") == k)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), kind("knowledge").alias("knowledge"), kind("skill").alias("skills"), kind("ability").alias("abilities"), F.count_if(has_id("esco_id")).alias("aligned"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows and percentage of each value of ``key``."""
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("n")).withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column; exact percentiles, null and NaN left out.

    One scan; quartiles are read off at their places in a range-partitioned sort, so no task holds all values.
    """
    each = F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]), lambda x: x["v"].isNotNull() & ~F.isnan(x["v"]))
    placed = cut(numbered(df.select(F.inline(each)), ["name"], [F.col("v")]))
    sums = placed.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * q).alias("at")) for i, q in enumerate((0.25, 0.5, 0.75))]))
    wanted = sums.select("name", quarter.alias("q")).select("name", "q.i", "q.at", F.explode(F.array_distinct(F.array(F.floor("q.at"), F.ceil("q.at")))).alias("k"))
    met = placed.select("name", (F.col("place") - 1).alias("k"), "v").join(wanted, ["name", "k"])  # six rows a column at most
    weight = F.when(F.floor("at") == F.ceil("at"), F.lit(1.0)).when(F.col("k") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    q = met.groupBy("name").agg(*[F.sum(F.when(F.col("i") == i, weight * F.col("v"))).alias(f"q{p}") for i, p in enumerate((25, 50, 75))])
    out = names.join(sums, "name", "left").join(q, "name", "left")
    return out.select("name", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", "q25", "q50", "q75", "max")


def sweep(df: DataFrame, column: str) -> DataFrame:
    """Percentage of rows at each threshold or above, in one pass; rows without a value are left out."""
    v = F.when(~F.isnan(column), F.col(column))
    each = df.where(v.isNotNull()).agg(*[(F.avg((v >= t).cast("double")) * 100).alias(f"t{i}") for i, t in enumerate(SWEEP)])
    return each.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("pct")) for i, t in enumerate(SWEEP)])))


def hash_sample(df: DataFrame, stratum: str, key: Column, n: int) -> DataFrame:
    """Up to ``n`` rows of each stratum, the same ones on every run: those of smallest md5 of the key."""
    w = Window.partitionBy(stratum).orderBy(F.md5(key.cast("string")), key)
    return df.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= n)


def repeated(df: DataFrame, key: Column) -> DataFrame:
    """Rows whose key another row has too. Keys are counted first and joined back, so no key is gathered in one task."""
    keyed = df.withColumn("_k", key)
    again = keyed.groupBy("_k").count().where(F.col("count") > 1).select("_k")
    return keyed.join(again, "_k", "left_semi").drop("_k")


def issues(df: DataFrame) -> DataFrame:
    """Check names and how many rows or documents fail each."""
    conf = F.col("confidence")
    flat = df.agg(F.count_if((conf < 0) | (conf > 1)).alias("confidence_out_of_range"), F.count_if(F.trim("text") == "").alias("blank_text"), F.count_if(conf.isNull()).alias("confidence_missing"))
    few = df.groupBy("doc_code").count().where(F.col("count") < 3).agg(F.count(F.lit(1)).alias("documents_under_three"))
    out = flat.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n")) for c in flat.columns])))
    return out.unionByName(few.select(F.lit("documents_under_three").alias("check_name"), F.col("documents_under_three").alias("n")))


def generic_counts(df: DataFrame) -> DataFrame:
    """How many knowledge items of each document hold each generic term: doc_code, term, n."""
    low = F.lower("text")
    hit = F.filter(F.array(*map(F.lit, GENERIC_TERMS)), lambda t: F.contains(low, t))
    return df.where(F.col("item_type") == "knowledge").select("doc_code", F.explode(hit).alias("term")).groupBy("doc_code", "term").agg(F.count(F.lit(1)).alias("n"))


def cosine(a: Column, b: Column) -> Column:
    """Of two equally long arrays; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
