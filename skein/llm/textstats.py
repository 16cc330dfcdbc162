"""Figures of a text that tell prose from lists, tables and junk."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np

#: The figures, in the order of the vectors.
STATS = (
    "n_chars", "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "punct_line_share", "common_share", "words_per_segment",
    "words_per_piece", "marker_share", "cell_share", "clean_share", "packed_ratio", "vowel_share", "longest_token", "distinct_lines", "strange_share", "stop_share", "prose_share",
)
WORD = re.compile(r"[^\W\d_]+")
CLEAN = re.compile(r"[(\"'“„«¿¡]*(?:[^\W\d_]+(?:['’-][^\W\d_]+)*-?|\d{1,4}(?:[.:]\d\d)?)[)\"'”“»]*[.,;:!?]*[)\"'”“»]*\Z")
MARKER = re.compile(r"\s*(?:[-+*•★●▪◦–→·»>#o]\s|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)]\s|\d+(?:\.\d+)+\.?\s|\d{1,3}\s[-–]\s)")
LEADER = re.compile(r"(?:\.{4,}|(?: \.){4,})\s*\d+\s*\Z")
RULE = re.compile(r"[\s|+:=_-]{3,}\Z")
CELLS = re.compile(r"\s*\|\s*|\t+|\s{2,}|;|,")
STOPS = (". ", "! ", "? ", "… ", ": ", "; ")
PIECES = (",", ";", "|", "\t", ":", "  ", " / ")
END = re.compile(r"[.!?:;…][\"'”»)]*\s*\Z")
STRANGE = re.compile(r"[^\w\s.,;:!?'\"()\[\]{}<>/|+*=&%$#@~^`\\_’‘“”„«»–—•★…¿¡°§€-]|[ÃÂâ][^\w\s]|[ÃÂ][ -¿]|â€")
#: What divides a segment that is no sentence, if there is much of it.
APART = (",", "|", "\t", "  ", '";')
#: Below this packed size a text of some length says the same thing over and over.
REPEATED, REPEATED_FROM = 0.11, 150
#: Words from which a segment can be a sentence.
SENTENCE = 8
VOWELS = frozenset("aeiouyàáâäãåæèéêëìíîïòóôöõœùúûü")
#: Tokens whose figures a worker remembers, and tokens that are added up at once.
REMEMBERED, AT_ONCE = 1 << 17, 1 << 18


class Tokens(dict):
    """Numbers of tokens (runs without white space), whose figures are in ``columns``; starts anew when it has grown large.

    The figures: length, letters, words, digits, vowels, whether it ends a sentence, whether it is a word or a short number
    with nothing but marks around it, and its common words of each language.
    """

    def __init__(self, common: dict[str, frozenset[str]]) -> None:
        super().__init__()
        self.common = [c for _, c in sorted(common.items())]
        self.columns = np.zeros((7 + len(self.common), REMEMBERED), dtype=np.int32)

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == self.columns.shape[1]:
            self.columns = np.concatenate([self.columns, np.zeros_like(self.columns)], axis=1)
        low = token.lower()
        if token.isascii() and token.isalpha():
            words, letters, digits, clean = [low], len(token), 0, 1
        else:
            words = WORD.findall(low)
            letters, digits, clean = sum(map(len, words)), sum(1 for c in token if "0" <= c <= "9"), CLEAN.match(token) is not None
        vowels = sum(1 for c in low if c in VOWELS)
        self.columns[:, n] = [len(token), letters, len(words), digits, vowels, token[-1] in ".!?", clean, *(sum(1 for w in words if w in c) for c in self.common)]
        self[token] = n
        return n

    def sums(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The figures added up over each list, and its longest token; no list may be empty."""
        if len(self) > REMEMBERED // 2:
            self.clear()
            self.columns = np.zeros((len(self.columns), REMEMBERED), dtype=np.int32)
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(sizes.sum()))
        at = np.cumsum(sizes) - sizes
        sums = np.stack([np.add.reduceat(c.take(ids), at, dtype=np.int64) for c in self.columns])
        return sums, np.maximum.reduceat(self.columns[0].take(ids), at)


def marks(lines: list[str]) -> int:
    """Lines that open as entries of a list do, or end in leaders and a page."""
    return sum(1 for x in lines if MARKER.match(x) or ("...." in x or " . ." in x) and LEADER.search(x))


def unwrapped(text: str) -> tuple[str, list[str]]:
    """The text with soft line breaks made blanks, and its lines that aren't blank.

    A break is soft if the next line's first word would not have fitted on the line, as wide as the widest line is, and
    neither line looks like an entry or a row.
    """
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n").split("\n")]
    full = [x for x in lines if x]
    if len(full) < 2:
        return "\n".join(lines), full
    width = max(map(len, full))
    if width < 24 or width > 200:
        return "\n".join(lines), full
    out = [lines[0]]
    for a, b in zip(lines, lines[1:], strict=False):
        soft = a and b and not b[0].isspace() and len(a) + 1 + len(b.split(" ", 1)[0]) > width - 4 and "|" not in a and not MARKER.match(b)
        out.append(" " if soft else "\n")
        out.append(b)
    return "".join(out), full


def _cells(x: str) -> int:
    """Short cells of a line, -1 for a rule, 0 for fewer than three."""
    if len(x) > 400:
        return 0
    if x[0] in " |+:=_-\t" and RULE.match(x):
        return -1
    tabs, bars, semis = "\t" in x, x.count("|"), x.count(";")
    wide = "  " in x or not x.isascii()
    if not (tabs or bars > 2 or semis > 1 or wide) and x.count(",") < 2:
        return 0
    s = x.strip()
    cells = s.count("\t") + 1 if "\t" in s else bars - 1 if bars > 2 else semis + 1 if semis > 1 else len([c for c in re.split(r"\s{2,}", s) if c]) if wide else 1
    if cells < 3 and s.count(",") > 1:
        cells = s.count(",") + 1
        if len(s.split()) > 3 * cells:
            cells = 0
    return cells if cells >= 3 else 0


def cell_share(lines: list[str]) -> float:
    """Share of the lines that are rows: three short cells or more, as many as another row near by has."""
    if len(lines) < 2:
        return 0.0
    counts = [_cells(x) for x in lines]
    rules = counts.count(-1)
    near = sum(1 for i, c in enumerate(counts) if c > 0 and (c in counts[max(0, i - 3) : i] or c in counts[i + 1 : i + 4]))
    return (near + (rules if near else 0)) / len(lines)


def _packed(raw: bytes) -> int:
    press = zlib.compressobj(1)
    return len(press.compress(raw)) + len(press.flush())


def layout(text: str) -> tuple[float, ...]:
    """What the lines, segments and bytes of a text say: shares of lines, squares and sums of segment lengths, pieces, packed size."""
    flat, lines = unwrapped(text)
    spread = flat
    for stop in STOPS:
        if stop in spread:
            spread = spread.replace(stop, stop[0] + "\n")
    squares = total = running = 0
    apart = [x for x in APART if x in spread]
    for seg in map(str.strip, spread.split("\n")):
        if seg:
            k = seg.count(" ") + 1
            squares += k * k
            total += k
            if k >= SENTENCE and seg[-1] in ".!?…:;" and k >= 3.5 * (1 + sum([seg.count(x) for x in apart])):
                running += k
    for mark in PIECES:
        if mark in spread:
            spread = spread.replace(mark, "\n")
    pieces = sum(map(bool, map(str.strip, spread.split("\n"))))
    raw = text.encode("utf-8", "surrogatepass")
    ended = sum(1 for x in lines if x[-1] in ".!?" or END.search(x[-6:]))
    n = max(1, len(lines))
    strange = 0 if text.isascii() else len(STRANGE.findall(text)) / len(text)
    return (float(len(text)), ended / n, squares / max(1, total), pieces, marks(lines) / n, cell_share(lines), _packed(raw) / (len(raw) + 60), len(set(lines)) / n, strange, running)


def stats_of(texts: list[str], tokens: Tokens) -> np.ndarray:
    """The figures ``STATS`` of texts none of which is blank, one row each; ``tokens`` knows the common words.

    The language is the one whose common words are met most, since what is said of it is not to be trusted. What is said of
    a token is remembered and added up, so only lines and segments are looked at text by text.
    """
    out = np.zeros((len(texts), len(STATS)))
    at = 0
    while at < len(texts):
        lists, held, start = [], 0, at
        while at < len(texts) and (not lists or held < AT_ONCE):
            lists.append(texts[at].split() or [texts[at]])  # nothing but control characters that count as blanks
            held += len(lists[-1])
            at += 1
        sums, longest = tokens.sums(lists)
        size, ended, per_segment, pieces, marked, cells, packed, distinct, strange, running = np.array([layout(t) for t in texts[start:at]]).T
        counts = np.array([len(x) for x in lists], dtype=float)
        seen, letters, words, digits, vowels, stops, clean = sums[:7].astype(float)
        solid = np.maximum(1, seen)
        common = sums[7:].max(axis=0) if len(sums) > 7 else np.zeros(sums.shape[1])
        some = np.maximum(1, words)
        out[start:at] = np.stack([
            size, words, letters / some, (seen - letters - digits) / solid, digits / solid, ended, common / some, per_segment, counts / np.maximum(1, pieces), marked, cells,
            clean / counts, packed, vowels / np.maximum(1, letters), longest.astype(float), distinct, strange, stops / counts, running / counts,
        ], axis=1)
    return out


def text_stats(text: str, common: dict[str, frozenset[str]]) -> list[float]:
    """The figures ``STATS`` of one text that isn't blank; ``common`` has the common words of each language."""
    return stats_of([text], Tokens(common))[0].tolist()


def vectors(stats: np.ndarray) -> np.ndarray:
    """The figures as the mixture sees them, one row each: lengths as logarithms, the sentence's stops against its words.

    Two say yes or no, so that the mixture can hold such texts apart: whether a text of some length packs to almost nothing,
    and whether it mostly consists of whole sentences in clean, common words.
    """
    d = dict(zip(STATS, stats.T, strict=True))
    log, least = np.log, np.minimum
    running = (d["prose_share"] >= 0.5) & (d["clean_share"] >= 0.8) & (d["common_share"] >= 0.08)
    repeated = (d["packed_ratio"] < REPEATED) & (d["n_chars"] > REPEATED_FROM)
    return np.stack([
        log(1 + d["mean_word_len"]), least(d["symbol_ratio"], 0.5), least(d["digit_ratio"], 0.5), d["common_share"], log(1 + d["words_per_segment"]), log(1 + least(d["words_per_piece"], 60)),
        d["marker_share"], d["cell_share"], d["clean_share"], log(0.02 + least(d["packed_ratio"], 0.6)), least(d["vowel_share"], 0.6), log(1 + least(d["longest_token"], 200)),
        d["distinct_lines"], least(20 * d["strange_share"], 2.0), least(10 * d["stop_share"], 1.5), d["prose_share"], running.astype(float), repeated.astype(float),
    ], axis=1)
