"""Text quality figures of documents, and what they say a text is."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.examples import examples
from skein.llm.mixture import fit, moments, posteriors, rows_of
from skein.llm.textstats import STATS, Tokens, stats_of, vectors
from skein.session import cut

#: White space and characters that aren't seen.
BLANK = re.compile(r"[\s\u00ad\u200b-\u200f\u2060-\u2064\ufeff]*")
KINDS = ("prose", "list", "table", "junk")
#: Common words are a short list of function words; more than this is taken for a mistake.
WORDS_BOUND = 100_000
#: Observations that the inspected examples of a style count for in the fit, and all examples in the standardization.
ANCHOR, PRIOR = 10.0, 100.0


def common_words(table: DataFrame) -> dict[str, frozenset[str]]:
    """The common words of each language, in lower case."""
    rows = table.select("lang", "word").where(F.col("word").isNotNull()).limit(WORDS_BOUND + 1).collect()
    if len(rows) > WORDS_BOUND:
        raise ValueError(f"more than {WORDS_BOUND} common words")
    by: dict[str, set[str]] = defaultdict(set)
    for r in rows:
        by[r["lang"] or ""].add(r["word"].lower())
    return {k: frozenset(v) for k, v in by.items()}


def measured(df: DataFrame, ident: str, text: str, words: dict[str, frozenset[str]]) -> DataFrame:
    """``ident``, the figures ``stats`` and their ``vector``; null and blank texts give no row. One pass, no shuffle."""

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(words)
        for b in batches:
            texts = b.column(1).to_pylist()
            filled = [t is not None and not BLANK.fullmatch(t) for t in texts]
            figures = stats_of([t for t, f in zip(texts, filled, strict=True) if f], tokens)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(filled, pa.bool_())), lists(figures), lists(vectors(figures))], names=[ident, "stats", "vector"])

    schema = T.StructType([T.StructField(ident, df.schema[ident].dataType), T.StructField("stats", T.ArrayType(T.DoubleType())), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return df.select(ident, text).mapInArrow(run, schema)


def text_quality(documents: DataFrame, words: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures and kind of each text that isn't blank: ``ident``, the columns ``STATS``, kind, certainty.

    The figures are standardized over all texts; a Gaussian mixture with one component for each style of the inspected
    examples starts at these and is fitted to all texts by expectation-maximization. A component is of the kinds that the
    examples it holds are of; a text gets the kind with the highest probability. That a text packs to almost nothing, or
    mostly consists of whole sentences in clean, common words, are two of the figures the mixture sees. In the
    standardization the examples count for ``PRIOR`` texts at every size, so it stands for a few texts as well. Every text
    is measured whole, once; the fit passes over the vectors only. Equal rows each get their row.
    """
    known = common_words(words)
    table = cut(measured(documents, ident, text, known))
    shown = examples()
    own = vectors(stats_of([t for _, _, t in shown], Tokens(known)))
    size = own.shape[1]
    sums = table.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("vector")[i]).alias(f"m{i}") for i in range(size)], *[F.sum(F.col("vector")[i] * F.col("vector")[i]).alias(f"s{i}") for i in range(size)]).first()
    n = sums["n"] + PRIOR
    mean = (np.array([sums[f"m{i}"] or 0.0 for i in range(size)]) + PRIOR * own.mean(axis=0)) / n
    square = (np.array([sums[f"s{i}"] or 0.0 for i in range(size)]) + PRIOR * (own**2).mean(axis=0)) / n
    dev = np.sqrt(np.maximum(square - mean**2, 0.0)) + 1e-6

    at = (own - mean) / dev
    styles = sorted({s for s, _, _ in shown})
    rows = [np.array([s == style for s, _, _ in shown]) for style in styles]
    start = np.array([moments(at[r]).mean(axis=0) * ANCHOR for r in rows])

    scaled = table.select(F.transform("vector", lambda x, i: (x - F.element_at(F.lit(mean.tolist()), i + 1)) / F.element_at(F.lit(dev.tolist()), i + 1)).alias("x"))
    mixture = fit(scaled, "x", start)

    theta = mixture.coefficients()
    held = posteriors(at, theta)[1]
    kind_of = np.array([[held[[k == kind for _, k, _ in shown], j].sum() / sum(k == kind for _, k, _ in shown) for kind in KINDS] for j in range(len(styles))])
    own_kind = np.array([[next(k for s, k, _ in shown if s == style) == kind for kind in KINDS] for style in styles], dtype=float)
    kind_of += 1e-6 * own_kind
    kind_of /= kind_of.sum(axis=1, keepdims=True)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, x = rows_of(b.column(1)), (rows_of(b.column(2)) - mean) / dev
            if not len(x):
                continue
            p = posteriors(x, theta)[1] @ kind_of
            kind = p.argmax(axis=1)
            sure = p.max(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, i]) for i in range(len(STATS))), pa.array(np.array(KINDS, dtype=object)[kind], pa.string()), pa.array(sure)], names=[ident, *STATS, "kind", "certainty"])

    schema = T.StructType([T.StructField(ident, documents.schema[ident].dataType), *(T.StructField(c, T.DoubleType()) for c in STATS), T.StructField("kind", T.StringType()), T.StructField("certainty", T.DoubleType())])
    return table.mapInArrow(judge, schema)
