"""Records of several sources mixed to target shares of the total size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tokens import token_sizes
from skein.session import cut

#: Records of a source that are rounded together, on average, and residual records that the reduction tree joins at most.
BUCKET, FAN_IN = 50_000, 64
#: Up to so many sources with a target their plan is broadcast.
SOURCES_BOUND = 100_000


def pivot(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Weighted pivotal rounding of fractional probabilities ``p`` of records of size ``w``.

    The running fractional record meets the next one; mass is moved between the two, in either direction with such
    odds that each one's expectation stays, and so much that one becomes 0 or 1 while sum(p*w) stays as it was. Returns
    the probabilities, all integral but for at most one, and the place of that one or -1.
    """
    p = p.copy()
    eps = 1e-12
    i = -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if p[j] <= eps or p[j] >= 1 - eps:
            p[j] = float(p[j] > 0.5)
            continue
        if i < 0:
            i = j
            continue
        # moving mass m: p[i] += m / w[i], p[j] -= m / w[j], or the reverse
        up = min((1 - p[i]) * w[i], p[j] * w[j])
        down = min(p[i] * w[i], (1 - p[j]) * w[j])
        m = up if draws[j] * (up + down) < down else -down
        p[i] += m / w[i]
        p[j] -= m / w[j]
        open_i, open_j = eps < p[i] < 1 - eps, eps < p[j] < 1 - eps
        for k, is_open in ((i, open_i), (j, open_j)):
            if not is_open:
                p[k] = float(p[k] > 0.5)
        i = i if open_i else j if open_j else -1
    return p, i


def _rounded(names: list[str], seed: int, last: bool):
    """Rounds ``_p`` of a group of one source; at most one record keeps its fraction, or with ``last`` is rounded by its own chance.

    Order and draws follow from the records alone, so the same records give the same result however they are divided.
    """

    def group(table: pa.Table) -> pa.Table:
        table = table.select(names).sort_by([("tokens", "descending"), ("_draw", "ascending")])  # small records last: the open one is small
        rng = np.random.default_rng([seed, int(table["_draw"][0].as_py()) & 0x7FFFFFFF, table.num_rows])
        p, at = pivot(table["_p"].to_numpy(), table["tokens"].to_numpy().astype(float), rng)
        if last and at >= 0:
            p[at] = float(rng.random() < p[at])
        return table.set_column(names.index("_p"), "_p", pa.array(p))

    return group


def mix(sized: DataFrame, targets: DataFrame, ident: str = "doc_id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """How often each record is used, and the shares reached.

    ``sized`` has ``ident``, source, tokens; ``targets`` has source, target_share, max_uses (one row a source). The mix is
    as large as all records whose source has a target. A source wants target_share of that; each of its records gets
    wanted / available copies, max_uses at most. Whole copies are taken as they are; fractions are rounded by weighted
    pivotal rounding: first in buckets by a hash of the record, some ``BUCKET`` records of one source each, which leaves one
    open record a bucket, then these in a reduction tree of fan-in ``FAN_IN``. So a source misses its size by less than
    one record, and no source, however large, is gathered anywhere. Buckets, order and draws follow from the records and
    ``seed`` alone: the mix is the same however the input is divided into partitions.

    Records of null or unknown source, or of no size, take no part; a source with a target and no record has reached 0.
    Returns (``ident``, source, tokens, copies >= 1) and (source, target_share, max_uses, available, wanted, reached, share,
    short). ``sized`` is read several times: pass a written or checkpointed table.
    """
    by_source = sized.where(F.col("source").isNotNull() & (F.col("tokens") > 0)).groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("_n"))
    plan = cut(targets.select("source", "target_share", "max_uses").join(by_source, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))))  # a row a source
    facts = plan.agg(F.sum("available").alias("size"), F.max("_n").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    plan = plan.withColumn("wanted", F.col("target_share") * F.lit(facts["size"] or 0))
    plan = plan.withColumn("uses", F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_uses").cast("double"))).otherwise(F.lit(0.0)))
    uses = plan.select("source", "uses", F.ceil(F.col("_n") / BUCKET).alias("_buckets"))
    if facts["sources"] <= SOURCES_BOUND:  # so a source with a third of all rows stays where it is; beyond, AQE splits it
        uses = F.broadcast(uses)

    whole = F.floor(F.col("uses") + 1e-9)
    rows = sized.select(ident, "source", "tokens").where(F.col("tokens") > 0).join(uses, "source")
    rows = rows.select(
        F.col(ident), "source", F.col("tokens").cast("long").alias("tokens"), whole.cast("int").alias("_whole"), F.greatest(F.col("uses") - whole, F.lit(0.0)).alias("_p"),
        F.xxhash64(ident, F.lit(seed)).alias("_draw"), F.pmod(F.xxhash64(ident, F.lit(seed + 1)), "_buckets").alias("_bucket"),
    )
    done = rows.where(F.col("_p") <= 0)
    rest = rows.where(F.col("_p") > 0)
    buckets = -(-(facts["most"] or 0) // BUCKET)
    is_open = (F.col("_p") > 0) & (F.col("_p") < 1)
    while True:
        last = buckets <= 1
        rest = cut(rest.groupBy("source", "_bucket").applyInArrow(_rounded(rows.columns, seed, last), rest.schema))
        done = done.unionByName(rest if last else rest.where(~is_open))
        if last:
            break
        buckets = -(-buckets // FAN_IN)
        rest = rest.where(is_open).withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN))

    used = done.select(ident, "source", "tokens", (F.col("_whole") + F.round("_p").cast("int")).alias("copies")).where(F.col("copies") > 0)
    reached = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
    report = cut(plan.drop("uses", "_n").join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0))))
    size = report.agg(F.sum("reached")).first()[0] or 0
    report = report.withColumn("share", F.col("reached") / F.lit(size) if size else F.lit(0.0))
    # short: every record is used as often as allowed, and that is not enough
    full = F.col("available") * F.col("max_uses")
    return used, report.withColumn("short", (F.col("reached") >= full) & (full < F.col("wanted")))


def sized_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source and tokens of each document, counted once and kept for the passes that follow."""
    return cut(token_sizes(documents, "text", ["doc_id", "source"], vocabulary=vocabulary))
