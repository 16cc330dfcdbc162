"""Texts over a size limit, cut at natural boundaries with an overlap.

Every place where a piece might start (the start of the text, and the overlap before every boundary) is a node; it is
joined to the farthest legal end of its piece, which gives the start of the piece after it (in an unbroken passage: of
the first piece after the whole row of cuts made anywhere). Squaring that successor table (pointer doubling) marks all
greedy cuts of all texts of a block at once, in log2(pieces) steps over arrays
instead of a walk along each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: After these a full stop ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "approx.", "No.", "Fig.")
SENTENCE = re.compile(r"[.!?](?=\s|\Z)")
ABBREVIATION = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r")(?=\s|\Z)")
PARAGRAPH = re.compile(r"\n(?=\n)")
NUMBERING = re.compile(r"(?:\A|(?<=\n\n))[ \t]*(?:\d+\.)+(?=\s|\Z)")
SPACE = re.compile(r"\s")
#: Characters of a block of texts that is cut at once; bounds a worker's memory, not the texts.
BLOCK = 1_000_000


def _ends(rx: re.Pattern, text: str, base: int) -> np.ndarray:
    return np.fromiter((m.end() for m in rx.finditer(text)), dtype=np.int64) + base


def boundaries(text: str, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ends of paragraphs, of sentences, and places of white space, shifted by ``base``."""
    paragraphs = np.fromiter((m.start() for m in PARAGRAPH.finditer(text)), dtype=np.int64) + base
    sentences = _ends(SENTENCE, text, base)
    not_ends = np.concatenate([_ends(ABBREVIATION, text, base), _ends(NUMBERING, text, base)])
    sentences = np.setdiff1d(sentences, not_ends, assume_unique=False)
    spaces = np.fromiter((m.start() for m in SPACE.finditer(text)), dtype=np.int64) + base
    return paragraphs, sentences, spaces


def _last(places: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The last of ``places`` with least < place <= most, or -1."""
    if not len(places):
        return np.full(len(least), -1, dtype=np.int64)
    at = np.searchsorted(places, most, side="right") - 1
    got = places[np.maximum(at, 0)]
    return np.where((at >= 0) & (got > least), got, -1)


def cuts(texts: list[str], limit: int, least: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of every piece of ``texts`` (each longer than ``limit``), in order.

    The texts lie end to end on one axis; no window crosses a text's end, since a start within ``limit`` of it ends there.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    stop = np.cumsum(sizes)
    zero = stop - sizes
    parts = [boundaries(t, int(b)) for t, b in zip(texts, zero, strict=True)]
    levels = [np.concatenate([p[i] for p in parts]) for i in range(3)]

    natural = np.unique(np.concatenate(levels)) if any(len(x) for x in levels) else np.empty(0, dtype=np.int64)
    stride = limit - overlap

    def step(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End of the piece that starts at each s, how many pieces cut anywhere come in a row there, and whether it is the last of its text.

        In an unbroken passage the pieces start at s, s + stride, ...; how many there are follows from the next boundary and
        the end of the text.
        """
        end_of = stop[np.searchsorted(stop, s, side="right")]
        last = end_of - s <= limit
        e = np.full(len(s), -1, dtype=np.int64)
        for places in levels:
            e = np.where(e < 0, _last(places, s + least, s + limit), e)
        at = np.searchsorted(natural, s + limit, side="right")
        following = np.where(at < len(natural), natural[np.minimum(at, len(natural) - 1)], end_of) if len(natural) else end_of
        reach = np.minimum(following, end_of)  # the piece that has it within its limit isn't cut just anywhere
        run = np.where(last | (e >= 0), 1, np.maximum(1, -(-(reach - limit - s) // stride)))
        return np.where(last, end_of, np.where(e < 0, s + limit, e)), run, last

    back = natural - overlap
    begin = zero[np.searchsorted(stop, natural, side="left")] if len(natural) else natural
    nodes = np.unique(np.concatenate([zero, back[back > begin]]))
    found = [(nodes, *step(nodes))]
    seen: set[int] = set()
    fresh = nodes
    while True:  # a row of cuts in an unbroken passage may start the next piece at a place that is no boundary less the overlap
        at, e, run, last = found[-1]
        fresh = np.setdiff1d((e + (run - 1) * stride - overlap)[~last], nodes)
        fresh = np.array([x for x in fresh.tolist() if x not in seen], dtype=np.int64)
        if not len(fresh):
            break
        seen.update(fresh.tolist())
        found.append((fresh, *step(fresh)))
    nodes, ends, runs, lasts = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(nodes, kind="stable")
    nodes, ends, runs, lasts = nodes[by], ends[by], runs[by], lasts[by]
    jump = np.where(lasts, np.arange(len(nodes)), np.searchsorted(nodes, ends + (runs - 1) * stride - overlap))
    reached = np.zeros(len(nodes), dtype=bool)
    reached[np.searchsorted(nodes, zero)] = True
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        jump = jump[jump]
        if (more == reached).all():
            break
        reached = more
    times = runs[reached]
    shift = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * stride
    s, e = np.repeat(nodes[reached], times) + shift, np.repeat(ends[reached], times) + shift
    which = np.searchsorted(stop, s, side="right")
    return which, s - zero[which], e - zero[which]


def _pieces(limit: int, least: int, overlap: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            block: list[tuple[int, str]] = []
            size = 0
            for i in range(b.num_rows + 1):
                if i < b.num_rows:
                    t = texts[i].as_py()
                    if t is not None and len(t) > limit:
                        block.append((i, t))
                        size += len(t)
                if block and (size > BLOCK or i == b.num_rows):
                    which, s, e = cuts([t for _, t in block], limit, least, overlap)
                    first = np.searchsorted(which, which, side="left")
                    cols = [ids.take(pa.array([block[w][0] for w in which], pa.int32())), pa.array(np.arange(len(which)) - first, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32())]
                    if with_text:
                        cols.append(pa.array([block[w][1][x:y] for w, x, y in zip(which, s, e, strict=True)], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "chunk_idx", "char_start", "char_end", "piece"][: len(cols)])
                    block, size = [], 0

    return run


def split_texts(df: DataFrame, ident: str, text: str, limit: int = 1200, least: int = 600, overlap: int = 150, with_text: bool = False) -> DataFrame:
    """Numbered pieces of each text longer than ``limit`` code points: ``ident``, chunk_idx, char_start, char_end.

    A piece from s ends at the last paragraph end e with s+least < e <= s+limit, else the last sentence end there, else
    the last place of white space, else at s+limit; the next starts at e-overlap. A rest of at most ``limit`` is the last
    piece. Null, empty and short texts give no row; a null ``ident`` passes through; each of several equal rows is cut.
    ``with_text`` adds ``piece``. Works on one row at a time: no shuffle, and texts of any length.
    """
    if not 0 <= overlap < least < limit:
        raise ValueError("needs 0 <= overlap < least < limit")
    cols = [T.StructField(ident, df.schema[ident].dataType), *(T.StructField(c, T.IntegerType()) for c in ("chunk_idx", "char_start", "char_end"))]
    if with_text:
        cols.append(T.StructField("piece", T.StringType()))
    long = df.where(F.length(text) > limit).select(F.col(ident), F.col(text))
    run = _pieces(limit, least, overlap, with_text)

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.rename_columns([ident, *b.schema.names[1:]])

    return long.mapInArrow(named, T.StructType(cols))
