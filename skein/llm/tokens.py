"""Sizes of texts in tokens of a public subword vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary lies on the driver unless a query names another; executors get its bytes by broadcast (under 1 MB).
VOCABULARY = os.environ.get("SKEIN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in parts of about this size, divided where the pattern always divides.
PART = 200_000
_SEAM = re.compile(r"(?<=\S) (?=\S)")


def encoder(raw: bytes) -> Callable[[str], int]:
    """A function that counts a text's tokens, for the bytes of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc = tiktoken.Encoding("skein", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        n, at = 0, 0
        while len(text) - at > PART:
            seam = _SEAM.search(text, at + PART)
            if seam is None:
                break
            n += len(enc.encode_ordinary(text[at : seam.start()]))
            at = seam.start()
        return n + len(enc.encode_ordinary(text[at:] if at else text))

    return count


def token_sizes(df: DataFrame, text: str, keep: list[str], size: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and the text's token count as ``size``; null texts count 0. One pass, no shuffle."""
    sc = df.sparkSession.sparkContext
    raw = sc.broadcast(Path(vocabulary or VOCABULARY).read_bytes())
    names = [c for c in keep if c != size]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(raw.value)
        for b in batches:
            texts = b.column(len(names))
            sizes = pa.array([count(t.as_py()) if t.is_valid else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], sizes], names=[*names, size])

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(size, T.LongType())])
    return df.select(*names, df[text].alias("_text")).mapInArrow(run, schema)
