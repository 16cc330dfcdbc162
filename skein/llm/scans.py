"""Text of scanned pages repaired into continuous paragraphs.

Running headers and footers are found by how often a line comes back, in whatever spelling the scanner gave it, at the
edges of pages; page numbers by their sequence within the pages of a document; broken and misread words by a vocabulary
counted over all texts that can be trusted.
"""

from __future__ import annotations

import re
import unicodedata
from collections import ChainMap, defaultdict
from collections.abc import Callable, Container, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut

#: How scanners misread. Each character is written as what it may be taken for, so that two spellings of a
#: word that differ by misreading only become the same string (rn and m, ri and n, cl and d, ii and u, li and h, vv and w).
LOOKS = {
    "l": "i", "1": "i", "!": "i", "|": "i", "c": "e", "5": "s", "f": "t", "@": "a", "0": "o", "9": "g", "q": "g",
    "h": "ii", "b": "ii", "u": "ii", "n": "ri", "m": "rri", "d": "ei", "w": "vv", "‐": "-", "­": "-", "¬": "-",
}
_LOOKS = str.maketrans(LOOKS)
#: For whole lines t and e are taken for the same as well, since capital E is read as F.
_LINE_LOOKS = str.maketrans({**LOOKS, "t": "e", "f": "e", "c": "e"})
_DIGITS = str.maketrans("lIiOoSsBZz|!", "111005582211")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
HYPHENS = "-¬­‐‑"
#: Marks around words; one that may be a letter misread isn't taken off in front.
EDGE = ".,;:!?()[]{}\"'“”‘’„«»*•★●▪·"
FRONT = EDGE.replace("!", "")
NUMBER = re.compile(r"[\[({\-–—•·|~ ]*(?P<page>(?:p[a@][g9q][ec]|pg|p)\W{0,2})?(?P<n>[0-9lIiOoSsBZz|!]{1,5}|[ivxlcdm1|!]{1,9})(?P<of>\s*(?:of|0f|oi|/)\s*[0-9lIOoSBZ]{1,5})?[\])}\-–—•·|~ .]*\Z", re.IGNORECASE)
NUMBERLIKE = re.compile(r"\W*(?=\S*\d)[0-9lIOoSBZ|!]+\W*\Z|\W+\Z")
NUMBERED = re.compile(r"(?:\d+\.)+(?=\s|\Z)|[A-Z][\w ]{2,40}:(?=\s|\Z)")
LETTERS = re.compile(r"[^\W\d_]")
WORDLIKE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*-?\Z")
#: A line longer than this is no header; a key shorter says too little.
LINE_MOST, KEY_LEAST = 110, 6
#: A header is a line that comes back, stands at the edge of a page this often, and is found in trusted texts at most this
#: often for each time it is found in a scan.
AT_EDGE, IN_TRUSTED = 0.6, 0.02
#: A line seen this often for each document it is in comes back from page to page. One that stands once in each of its
#: documents must be in two different texts and have this share of its letters in words the trusted texts don't have.
AGAIN, UNKNOWN = 1.2, 0.3
#: So many words and headers, the most frequent ones, go to the workers by broadcast (some 200 MB); rarer ones are looked up
#: by a join on what each document asks for.
VOCABULARY_BOUND, HEADS_BOUND = 1_000_000, 100_000


def looks(word: str) -> str:
    """What a word looks like; equal for spellings that a scanner confuses."""
    return word.translate(_LOOKS)


def line_key(line: str) -> str:
    """A line's letters as they look, without numbers, blanks and marks."""
    words = [w for w in line.split() if not NUMBERLIKE.match(w)]
    return re.sub(r"[^a-z]", "", "".join(words).lower().translate(_LINE_LOOKS))


def roman(s: str) -> int:
    """Value of a Roman numeral, 0 if it is none."""
    total, before = 0, 0
    for c in reversed(s.lower()):
        v = ROMAN.get(c)
        if v is None:
            return 0
        total, before = (total - v, before) if v < before else (total + v, v)
    return total


def page_values(line: str) -> tuple[set[int], bool]:
    """The page numbers a line may stand for, and whether its form says that it is one."""
    m = NUMBER.match(line)
    if not m:
        return set(), False
    raw = m["n"]
    values = set()
    if any(c.isdigit() for c in raw) or m["page"] or m["of"] or any(c in "oO" for c in raw):
        read = raw.translate(_DIGITS)
        if read.isdigit():
            values.add(int(read))
    low = raw.lower()
    values |= {r for r in (roman(low), roman(re.sub("[1|!]", "l", low)), roman(re.sub("[1|!]", "i", low))) if r}
    plain = line.strip()
    sure = bool(m["page"] or m["of"]) or (plain[:1] in "[-–—(" and plain[-1:] in "])-–—" and any(c.isdigit() for c in raw))
    return values, sure


def split_lines(text: str) -> list[str]:
    return [x.replace("\r", "").replace("\f", " ").strip() for x in text.split("\n")]


def _pages(text: str, lines: list[str], first: int | None, last: int | None) -> set[int]:
    """Places of the lines that are only a page number."""
    found: set[int] = set()
    seen: list[tuple[int, set[int], bool]] = []
    raw = text.split("\n")
    for i, line in enumerate(lines):
        if line and len(line) <= 30:
            values, sure = page_values(line)
            if values:
                seen.append((i, values, sure))
    low = first if first is not None else last - 60 if last is not None else None
    high = last if last is not None else first + 60 if first is not None else None
    for k, (i, values, sure) in enumerate(seen):
        if low is not None and high is not None:
            if any(low <= v <= high for v in values):
                found.add(i)
            continue
        near = [v for j in (k - 1, k + 1) if 0 <= j < len(seen) for v in seen[j][1]]
        alone = i == 0 or i + 1 == len(lines) or not lines[i - 1] or not lines[i + 1] or "\f" in raw[i] or raw[i][:1].isspace()
        if sure or any(abs(v - n) == 1 for v in values for n in near) or (alone and lines[i].isdigit()):
            found.add(i)
    return found


def _own(title: str | None) -> set[str]:
    """Keys of a document's own title."""
    return {line_key(title), line_key("AFSC " + title)} - {""} if title else set()


def _edge_lines(text: str, title: str | None, first: int | None, last: int | None) -> Iterator[tuple[str, str, bool, bool]]:
    """Key, text, whether it stands at a page's edge, and whether it is the document's title (its first line, if it has none), of each line that could be a header or footer."""
    lines = split_lines(text)
    raw = text.split("\n")
    pages = _pages(text, lines, first, last)
    at_edge = {0, 1, len(lines) - 1, len(lines) - 2}
    for i in pages:
        at_edge |= {i - 2, i - 1, i + 1, i + 2}
    for i, x in enumerate(raw):
        if "\f" in x:
            at_edge |= {i - 1, i, i + 1}
    own = _own(title) or {line_key(next((x for i, x in enumerate(lines) if x and i not in pages), ""))}
    for i, line in enumerate(lines):
        if line and len(line) <= LINE_MOST and i not in pages and line[-1] not in ".,;:!?" and not line[0].islower():
            key = line_key(line)
            if len(key) >= KEY_LEAST:
                yield key, line, i in at_edge, key in own


def _hash(key: str) -> int:
    return int.from_bytes(blake2b(key.encode(), digest_size=8).digest(), "big", signed=True)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines at page edges that come back: key, sample, n_docs, n_trusted, and whether from page to page (again).

    A document's own title isn't counted as coming back in it. A text loaded again under another id is no other text: what
    counts is whether the smallest and the largest fingerprint of a line's texts differ.

    Counts are added up inside every batch first; what is shuffled is a hash and four numbers, and a line's text only
    where it stands at an edge.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])
            texts: dict[int, tuple[str, str]] = {}
            low: dict[int, int] = {}
            high: dict[int, int] = {}
            for raw, trusted, title, first, last in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                seen = set()
                mark = _hash(raw)
                for key, line, edge, own in _edge_lines(raw, title, first, last):
                    h = _hash(key)
                    s = sums[h]
                    if trusted:
                        s[3] += h not in seen
                    else:
                        s[0] += h not in seen
                        low[h], high[h] = min(low.get(h, mark), mark), max(high.get(h, mark), mark)
                        s[1] += 1
                        s[2] += edge
                        s[4] += edge and not own and h in seen
                        if edge:
                            texts[h] = (key, line)
                    seen.add(h)
            hs = list(sums)
            cols = [pa.array(hs, pa.int64()), *(pa.array([sums[h][i] for h in hs], pa.int64()) for i in range(5)), *(pa.array([texts[h][i] if h in texts else None for h in hs], pa.string()) for i in range(2)), *(pa.array([x.get(h) for h in hs], pa.int64()) for x in (low, high))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "n_docs", "n_seen", "n_edge", "n_trusted", "n_again", "key", "sample", "low", "high"])

    rows = docs.where(F.col("raw_text").isNotNull()).select("raw_text", F.col("clean_text").isNotNull(), "title", "page_start", "page_end")
    counted = rows.mapInArrow(run, "h long, n_docs long, n_seen long, n_edge long, n_trusted long, n_again long, key string, sample string, low long, high long")
    sums = counted.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_seen", "n_edge", "n_trusted", "n_again")], F.max(F.struct("key", "sample")).alias("t"), F.min("low").alias("low"), F.max("high").alias("high"))
    again = F.col("n_again") >= (AGAIN - 1) * F.col("n_docs")
    rare = (F.col("n_docs") > 0) & (F.col("n_edge") >= AT_EDGE * F.col("n_seen")) & (F.col("n_trusted") <= IN_TRUSTED * F.col("n_docs"))
    return sums.where(rare & (again | (F.col("low") != F.col("high")))).select("t.key", "t.sample", "n_docs", "n_trusted", again.alias("again"))


def trusted_words(docs: DataFrame) -> DataFrame:
    """Words of trusted texts with their counts: word, n (lower case, no marks around them, a last hyphen kept).

    A word must be met twice in one text or in two different ones; a text loaded again is no different one.
    """
    words = F.transform(F.split(F.lower("clean_text"), r"(?U)[\s/]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}-]+$", ""))
    good = F.array_sort(F.filter(words, lambda w: w.rlike(r"^\p{L}+(?:['’-]\p{L}+)*-?$")))
    texts = docs.where(F.col("clean_text").isNotNull()).select(F.xxhash64("clean_text").alias("mark"), good.alias("w"))
    each = texts.select("mark", F.inline(F.transform("w", lambda w, i: F.struct(w.alias("word"), F.coalesce(F.get("w", i + 1) == w, F.lit(False)).alias("twice")))))
    sums = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    return sums.where(F.col("twice") | (F.col("low") != F.col("high"))).select("word", "n")


@dataclass
class Known:
    """What the corpus knows: words with counts, the word that each look means, header keys."""

    words: Mapping[str, int]
    heads: Container[str] = field(default_factory=set)
    means: Mapping[str, str] = field(default_factory=dict)
    by_half: Mapping[str, frozenset[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.means:
            for w, n in self.words.items():
                k = looks(w)
                if k not in self.means or (n, w) > (self.words[self.means[k]], self.means[k]):
                    self.means[k] = w

    def meant(self, w: str) -> str | None:
        """The known word that ``w`` is or looks like."""
        return w if w in self.words else self.means.get(looks(w))

    def is_head(self, key: str) -> bool:
        """A header's key, or one with a little added at either end, or a few letters off."""
        if key in self.heads:
            return True
        if len(key) < KEY_LEAST:
            return False
        for more in range(1, min(14, len(key) - 10)):
            if key[:-more] in self.heads or key[more:] in self.heads:
                return True
        if len(key) >= 14:  # one letter lost, added or misread: then a half of the key is whole
            from difflib import SequenceMatcher

            none: frozenset[str] = frozenset()
            for h in self.by_half.get(key[:7], none) | self.by_half.get(key[-7:], none):
                if abs(len(h) - len(key)) <= 3 and SequenceMatcher(None, h, key, autojunk=False).ratio() >= 0.9:
                    return True
        return False


def halves(heads: Iterable[str]) -> dict[str, frozenset[str]]:
    """Longer headers by their first and last letters."""
    out: dict[str, set[str]] = defaultdict(set)
    for h in heads:
        if len(h) >= 14:
            out[h[:7]].add(h)
            out[h[-7:]].add(h)
    return {a: frozenset(b) for a, b in out.items()}


def sample_tokens(sample: str) -> list[str]:
    tokens = [t.strip(EDGE).lower() for t in sample.split()]
    return [t for t in tokens if LETTERS.search(t)]


def strange(sample: str, k: Known) -> bool:
    """Whether enough of a line's letters are in words that the trusted texts don't have."""
    tokens = sample_tokens(sample)
    letters = sum(map(len, tokens))
    return bool(letters) and sum(len(t) for t in tokens if k.meant(t) is None) / letters >= UNKNOWN


class Either:
    """In one of two."""

    def __init__(self, a: Container[str], b: Container[str]) -> None:
        self.a, self.b = a, b

    def __contains__(self, x: object) -> bool:
        return x in self.a or x in self.b


class Union(dict):
    """The sets of two tables together."""

    def __init__(self, a: Mapping[str, frozenset[str]], b: Mapping[str, frozenset[str]]) -> None:
        super().__init__(b)
        self.a = a

    def get(self, key: str, none: frozenset[str] = frozenset()) -> frozenset[str]:
        return self.a.get(key, none) | super().get(key, none)


def more_known(k: Known, found: list[dict] | None) -> Known:
    """``k`` with what was looked up for one document: rows (kind, s, word, n) of words, looks and headers."""
    if not found:
        return k
    words = {r["s"]: r["n"] for r in found if r["kind"] == "w"}
    means = {r["s"]: r["word"] for r in found if r["kind"] == "l"}
    heads = {r["word"] for r in found if r["kind"] == "h"}
    return Known(ChainMap(words, k.words), Either(k.heads, heads), ChainMap(k.means, means) if means else k.means, Union(k.by_half, halves(heads)))


def asked_heads(text: str) -> set[tuple[str, str]]:
    """Under which keys a text's lines may be found among headers, as (kind, s)."""
    keys = {line_key(x) for x in split_lines(text) if x and len(x) <= LINE_MOST and x[-1] not in ".,;:!?"}
    out = set()
    for key in keys:
        if len(key) >= KEY_LEAST:
            out |= {key, *(key[:-more] for more in range(1, min(14, len(key) - 10))), *(key[more:] for more in range(1, min(14, len(key) - 10)))}
            if len(key) >= 14:
                out |= {"7" + key[:7], "7" + key[-7:]}
    return {("h", x) for x in out}


def asked_words(text: str, title: str | None, first: int | None, last: int | None, k: Known) -> set[tuple[str, str]]:
    """What :func:`repair` may look up for a text that ``k`` doesn't have, as (kind, s)."""
    lines = split_lines(text)
    out = furniture(text, title, first, last, k)
    body = [lines[i].split() for i in range(len(lines)) if lines[i] and i not in out]
    forms: set[str] = set()
    for at, tokens in enumerate(body):
        bare = [_bare(t) for t in tokens]
        forms.update(bare)
        forms.update(unicodedata.normalize("NFKC", w) for w in bare)
        forms.update(a + b for a, b in zip(bare, bare[1:], strict=False))
        if at + 1 < len(body) and tokens[-1][-1] in HYPHENS:
            a, b = tokens[-1][:-1].lstrip(EDGE).lower(), body[at + 1][0].rstrip(EDGE).lower()
            forms |= {a, b, a + b, f"{a}-{b}", f"{a}-", a + b + _bare(body[at + 1][1]) if len(body[at + 1]) > 1 else ""}
    return asked_forms(forms, k)


def asked_forms(forms: Iterable[str], k: Known) -> set[tuple[str, str]]:
    forms = [w for w in forms if w]
    return {("w", w) for w in forms if w not in k.words} | {("l", x) for x in map(looks, forms) if x not in k.means}


def looked_up(df: DataFrame, ident: str, ask: Callable[..., set[tuple[str, str]]], columns: list[str], table: DataFrame) -> DataFrame:
    """``df`` with ``found``, the rows of ``table`` (kind, s, word, n) that each row's ``ask(*columns, found)`` names, added to those found before."""
    before = F.col("found") if "found" in df.columns else F.lit(None).cast(FOUND)
    df = df.withColumn("found", before)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, strings = [], [], []
            for i, *row in zip(*(b.column(c).to_pylist() for c in range(b.num_columns)), strict=True):
                for kind, x in ask(*row):
                    ids.append(i)
                    kinds.append(kind)
                    strings.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(strings, pa.string())], names=[ident, "kind", "s"])

    asked = df.select(ident, *columns, "found").mapInArrow(run, f"{ident} {df.schema[ident].dataType.simpleString()}, kind string, s string")
    got = asked.join(table, ["kind", "s"]).groupBy(ident).agg(F.collect_list(F.struct("kind", "s", "word", "n")).alias("_more"))
    none = F.array().cast(FOUND)
    return df.join(got, ident, "left").withColumn("found", F.concat(F.coalesce("found", none), F.coalesce("_more", none))).drop("_more")


FOUND = "array<struct<kind:string,s:string,word:string,n:bigint>>"


def rarer_words(words: DataFrame, least: int) -> DataFrame:
    """Words seen less than ``least`` times under themselves and under how they look: kind, s, word, n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([looks(w) for w in b.column(0).to_pylist()], pa.string()), *b.columns], names=["s", "word", "n"])

    rare = words.where(F.col("n") < least).select("word", "n")
    means = rare.mapInArrow(run, "s string, word string, n long").groupBy("s").agg(F.max(F.struct("n", "word")).alias("b"))
    return rare.select(F.lit("w").alias("kind"), F.col("word").alias("s"), "word", "n").unionByName(means.select(F.lit("l").alias("kind"), "s", "b.word", "b.n"))


def head_rows(heads: DataFrame) -> DataFrame:
    """Headers (key) under their keys and halves: kind, s, word, n."""
    keys = F.when(F.length("key") >= 14, F.array_distinct(F.array("key", F.concat(F.lit("7"), F.left("key", F.lit(7))), F.concat(F.lit("7"), F.right("key", F.lit(7)))))).otherwise(F.array("key"))
    return heads.select(F.lit("h").alias("kind"), F.explode(keys).alias("s"), F.col("key").alias("word"), F.lit(1).cast("long").alias("n"))


def known(docs: DataFrame) -> tuple[Known, DataFrame | None, DataFrame | None]:
    """Vocabulary and headers of ``docs``, both counted over all of them, the most frequent ones as :class:`Known`.

    The rest, if there is any, comes as tables of rarer words and of further headers (kind, s, word, n).
    """
    words = trusted_words(docs)
    rows = words.limit(VOCABULARY_BOUND + 1).collect()
    rare = None
    if len(rows) > VOCABULARY_BOUND:
        words, least = cut(words), 2
        while len(rows) > VOCABULARY_BOUND:
            least *= 2
            rows = words.where(F.col("n") >= least).limit(VOCABULARY_BOUND + 1).collect()
        rare = cut(rarer_words(words, least))
    k = Known({r["word"]: r["n"] for r in rows})
    lines = repeated_lines(docs)
    found = lines.limit(HEADS_BOUND + 1).collect()
    more = None
    if len(found) <= HEADS_BOUND and rare is None:
        k.heads = {r["key"] for r in found if r["again"] or strange(r["sample"], k)}
    else:
        lines = cut(lines)
        if rare is not None:
            lines = looked_up(lines, "key", lambda sample, _: asked_forms(sample_tokens(sample), k), ["sample"], rare)
        else:
            lines = lines.withColumn("found", F.lit(None).cast(FOUND))

        def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [again or strange(sample, more_known(k, got)) for sample, again, got in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield b.select(["key", "n_docs"]).filter(pa.array(keep, pa.bool_()))

        heads = cut(lines.select("key", "n_docs", "sample", "again", "found").mapInArrow(judge, "key string, n_docs long"))
        first = heads.orderBy(F.col("n_docs").desc(), "key").limit(HEADS_BOUND).collect()
        k.heads = {r["key"] for r in first}
        if first and len(first) == HEADS_BOUND or not HEADS_BOUND:
            last = first[-1] if first else None
            after = (F.col("n_docs") < last["n_docs"]) | ((F.col("n_docs") == last["n_docs"]) & (F.col("key") > last["key"])) if last else F.lit(True)
            more = head_rows(heads.where(after))
    k.by_half = halves(k.heads)
    return k, rare, more


def furniture(text: str, title: str | None, first: int | None, last: int | None, k: Known) -> dict[int, str]:
    """Places of the lines that are no body text, as ``page``, ``head`` or ``title``."""
    lines = split_lines(text)
    out = dict.fromkeys(_pages(text, lines, first, last), "page")
    own = _own(title)
    began = titled = False
    for i, line in enumerate(lines):
        if not line or i in out:
            continue
        if len(line) <= LINE_MOST and line[-1] not in ".,;:!?":
            key = line_key(line)
            if key in own or (not began and not titled and not own and len(line) <= 60 and not NUMBERED.match(line) and not k.is_head(key)):
                out[i] = "head" if titled else "title"
                titled = True
                own |= {key, key.removeprefix(line_key("AFSC"))}
                continue
            if len(key) >= KEY_LEAST and (not line[0].islower() or key in k.heads) and k.is_head(key):
                out[i] = "head"
                continue
        began = True
    return out


def _bare(token: str) -> str:
    return token.rstrip(EDGE).lstrip(FRONT).lower()


def joined(a: str, b: str, k: Known) -> str | None:
    """The word that ``a`` at a line's end and ``b`` at the next line's start make; None if they are two words."""
    whole, linked = a + b, f"{a}-{b}"
    n, m = k.words.get(whole, 0), k.words.get(linked, 0)
    if n or m:
        return whole if n >= m else linked
    if f"{a}-" in k.words and b in k.words:
        return None
    for w in (whole, linked):
        if w_ := k.means.get(looks(w)):
            return w_
    if a in k.words and b in k.words and len(a) > 2:
        return linked
    return whole


def repair(text: str, title: str | None, first: int | None, last: int | None, k: Known) -> tuple[list[tuple[int, str, str]], str]:
    """What is wrong in a scanned text, as (line, kind, word), and the text in paragraphs divided by an empty line."""
    lines = split_lines(text)
    raw = text.split("\n")
    out = furniture(text, title, first, last, k)
    events = [(i + 1, kind, "") for i, kind in out.items() if kind != "title"]
    body = [(i, lines[i].split()) for i in range(len(lines)) if lines[i] and i not in out]
    paragraphs: list[list[str]] = []
    carried, skip = "", 0  # a word that began on the line before, and tokens after its end that belong to it
    before = -1
    for at, (i, tokens) in enumerate(body):
        between = range(before + 1, i)
        empty = any(not lines[j] for j in between) and not any(j in out for j in between)
        opens = NUMBERED.match(lines[i]) or (raw[i][:2].isspace() and before >= 0 and not raw[before][:2].isspace())
        if not paragraphs or (not carried and (empty or opens)):
            paragraphs.append([])
        line: list[str] = []
        j = 0
        if carried:
            line.append(carried)
            carried, j = "", 1
            while j < len(tokens) and skip:
                j, skip = j + 1, skip - 1
        while j < len(tokens):
            token = tokens[j]
            end = j + 1 == len(tokens)
            if end and len(token) > 1 and token[-1] in HYPHENS and token[-2].isalpha() and at + 1 < len(body):
                following = body[at + 1][1]
                nxt = following[0]
                a, b = token[:-1].lstrip(EDGE).lower(), nxt.rstrip(EDGE).lower()
                if b and b[0].isalpha() or (b and k.meant(b)):
                    skip = 0
                    word = joined(a, b, k)
                    if word is not None and word == a + b and word not in k.words and len(following) > 1:
                        longer = k.meant(a + b + _bare(following[1]))  # the rest has a false gap
                        if longer:
                            word, skip, nxt = longer, 1, following[1]
                    if word is not None and WORDLIKE.match(word):
                        events.append((i + 1, "hyphen", word))
                        lead = token[: len(token) - len(token.lstrip(EDGE))]
                        tail = nxt[len(nxt.rstrip(EDGE)) :]
                        carried = lead + (word.capitalize() if token.lstrip(EDGE)[:1].isupper() else word) + tail
                        break
            word = _bare(token)
            if word and word not in k.words and "/" not in word:
                plain = unicodedata.normalize("NFKC", word)
                right = plain if plain in k.words else None
                gap = not end and (word[-1].isalpha() or word[-1] == "-") and token[-1] not in EDGE and tokens[j + 1][0] not in EDGE
                nxt = _bare(tokens[j + 1]) if gap else ""
                if right is None and nxt and nxt not in k.words and word + nxt in k.words:
                    right, j = word + nxt, j + 1  # before a single part is taken for another word
                if right is None and any(c.isalpha() for c in word):
                    right = k.means.get(looks(plain))
                if right is None and nxt:
                    both = word + nxt
                    if both in k.words:
                        right, j = both, j + 1
                    elif LETTERS.search(nxt) and nxt not in k.words and looks(both) in k.means:
                        right, j = k.means[looks(both)], j + 1
                if right is not None:
                    events.append((i + 1, "misread", right))
                    last_token = tokens[j]
                    lead, tail = token[: len(token) - len(token.lstrip(FRONT))], last_token[len(last_token.rstrip(EDGE)) :]
                    token = lead + (right.capitalize() if token.lstrip(FRONT)[:1].isupper() or (token[:1] in "5L0!1" and (not line or line[-1][-1] in ".:")) else right) + tail
            elif word and not end and token[-1] not in EDGE and tokens[j + 1][0] not in EDGE:
                nxt = _bare(tokens[j + 1])
                right = None
                if nxt and LETTERS.search(nxt) and nxt not in k.words and k.meant(nxt) is None:
                    right = k.meant(word + nxt)
                if right is not None:
                    events.append((i + 1, "misread", right))
                    last_token = tokens[j + 1]
                    tail = last_token[len(last_token.rstrip(EDGE)) :]
                    token = (right.capitalize() if token[:1].isupper() else right) + tail
                    j += 1
            line.append(token)
            j += 1
        paragraphs[-1].extend(line)
        before = i
    if carried:
        paragraphs[-1].append(carried)
    return events, "\n\n".join(" ".join(p) for p in paragraphs if p)


def scans(docs: DataFrame) -> DataFrame:
    """The records whose clean text is missing."""
    return docs.where(F.col("clean_text").isNull() & F.col("raw_text").isNotNull()).select("afsc_doc_id", "raw_text", "title", "page_start", "page_end")


def repaired(docs: DataFrame) -> DataFrame:
    """Each scanned record's text in paragraphs and what was repaired: afsc_doc_id, clean_text, repairs (line_no, kind, word).

    Null texts give no row, empty ones an empty text. Records are repaired one by one, whole; only the corpus's words and
    headers are shared. Equal records each give their row. Words and headers beyond the bounds of the broadcast are looked
    up by joins, so every text is repaired with all of them.
    """
    k, rare, more = known(docs)
    shared = docs.sparkSession.sparkContext.broadcast((k.words, k.heads, k.means, k.by_half))  # plain values: workers need no package
    rows = scans(docs)
    if more is not None:
        rows = looked_up(rows, "afsc_doc_id", lambda text, _: asked_heads(text), ["raw_text"], more)
    if rare is not None:
        ask = lambda *row: asked_words(*row[:4], more_known(Known(*shared.value), row[4]))
        rows = looked_up(rows, "afsc_doc_id", ask, ["raw_text", "title", "page_start", "page_end"], rare)
    if "found" not in rows.columns:
        rows = rows.withColumn("found", F.lit(None).cast(FOUND))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = Known(*shared.value)
        kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string()), ("word", pa.string())]))
        for b in batches:
            done = [repair(*row[:4], more_known(all_, row[4])) for row in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True)]
            events = [[{"line_no": n, "kind": x, "word": w} for n, x, w in sorted(set(e))] for e, _ in done]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for _, t in done], pa.string()), pa.array(events, kind)], names=["afsc_doc_id", "clean_text", "repairs"])

    columns = ["afsc_doc_id", "raw_text", "title", "page_start", "page_end", "found"]
    return rows.select(*columns).mapInArrow(run, "afsc_doc_id long, clean_text string, repairs array<struct<line_no:int,kind:string,word:string>>")


def repairs(docs: DataFrame) -> DataFrame:
    """afsc_doc_id, line_no, kind, word: distinct rows of all repairs."""
    return repaired(docs).select("afsc_doc_id", F.inline("repairs"))
