"""The working item: a short typed statement of a document. Every function is DataFrame -> DataFrame and lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import filled, strip
from skein.operators.clean import canonical_item
from skein.session import cut

# Fixed values of the quality filter.
BANNED = ("business intelligence", "perform cleaning duties", "source (digital game creation systems)", "operation of transport equipment", "develop defence policies")
HINT = r"\b(imagery|geospatial|geoint|gis|remote sensing|target(ing)?|mensurat|terrain|annotation|coordinates?|azimuth|order of battle|brief(ing)?|ipoe|aoc)\b"
STOPLIST = ("navy operations", "naval operations", "small vessel", "maritime", "marine operations", "ship operations")
MIN_LEN, MAX_LEN_SKILL, MAX_LEN_OTHER, LOW_CONFIDENCE, MIN_SCORE = 3, 80, 150, 0.60, 0.55
# Fixed values of the checks.
LEADING_VERBS = r"^(apply|perform|conduct|operate|manage|lead|coordinate|supervise|implement|analyze|assess|develop)\b"
GENERIC = (r"\bpolicies and procedures\b", r"\bregulations\b", r"\bstandards\b", r"\bsafety practices\b", r"\brequirements\b", r"\bgeneral knowledge\b")
GENERIC_TERMS = ("policies and procedures", "applicable regulations", "safety practices", "standard procedures")


def items_of(rels: DataFrame, *more: str) -> DataFrame:
    """Items from the requirement table: doc_code, ord, text, item_type, confidence, source, esco_id, evidence, and columns ``more``."""
    conf = F.when(~F.isnan("confidence"), F.col("confidence"))
    return rels.where(F.col("afsc_code").isNotNull() & F.col("item_name").isNotNull() & F.col("item_type").isNotNull()).select(
        F.upper(strip("afsc_code")).alias("doc_code"), F.col("rel_id").alias("ord"), F.col("item_name").alias("text"), F.lower(strip("item_type")).alias("item_type"),
        conf.alias("confidence"), F.when(has_id("esco_id"), F.lit("extractor-a")).otherwise(F.lit("llm-b")).alias("source"), "esco_id", "evidence", *more,
    )


def has_id(c: Column | str) -> Column:
    """Whether an id is neither null nor blank."""
    return filled(F.trim(c)).isNotNull()


def first_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key; null keys are equal.

    One aggregation with partial minima, so a key that holds a third of all rows is a row a task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.col(order))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*[F.col(c) if c in keys else F.col(f"_b.{c}") for c in df.columns])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Up to ``n`` rows of each key, in order; Spark cuts groups down before and after the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row in its group from 1, in ``order`` (which should end in a unique column).

    Rows are sorted over ranges of (keys, order), so a group of any size lies in as many tasks as it needs; what is added to
    the places within a task is one number a group and task. Null keys form a group.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_add"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(runs, same).select(*df.columns, (F.col("_at") + F.col("_add")).alias(name))


def min_confidence(df: DataFrame, least: float) -> DataFrame:
    """Items at ``least`` or more, null counting as 0; all of them if ``least`` isn't above 0."""
    return df.where(F.coalesce("confidence", F.lit(0.0)) >= least) if least > 0 else df


def quality_filter(df: DataFrame, strict: bool = False, domain_bias: bool = False, lengths: tuple[int, int, int] = (MIN_LEN, MAX_LEN_SKILL, MAX_LEN_OTHER), low_confidence: float = LOW_CONFIDENCE) -> DataFrame:
    """Items whose canonical text has a sound length and isn't banned, once each of a document and type, first wins.

    ``domain_bias`` wants a domain word, ``strict`` an id, of skills of low confidence. Duplicates go last, so an item
    that is dropped never hides a later one. ``lengths`` are the least, and the most of skills and of others.
    """
    text, skill = F.col("text"), F.col("item_type") == "skill"
    kept = df.where(filled("text").isNotNull()).withColumn("text", canonical_item("text"))
    kept = kept.where((F.length(text) >= lengths[0]) & (F.length(text) <= F.when(skill, lengths[1]).otherwise(lengths[2])) & ~text.isin(*BANNED))
    low = skill & (F.coalesce("confidence", F.lit(0.0)) < low_confidence)
    if domain_bias:
        kept = kept.where(~low | text.rlike(f"(?i){HINT}"))
    if strict:
        kept = kept.where(~low | has_id("esco_id"))
    return first_wins(kept, ["doc_code", "item_type", "text"])


def stoplisted(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(STOPLIST))


def with_bounds(df: DataFrame) -> DataFrame:
    """Types in lower case (null: skill), confidence within 0..1 (null: .5), blanks filled, and a review status."""
    conf = F.coalesce(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)), F.lit(0.5))
    return df.withColumns({"item_type": F.lower(F.coalesce("item_type", F.lit("skill"))), "confidence": conf, "evidence": F.coalesce("evidence", F.lit("")), "esco_id": F.coalesce("esco_id", F.lit(""))}).withColumn(
        "review_status", F.when(F.col("confidence") >= 0.8, F.lit("auto")).otherwise(F.lit("needs_review"))
    )
