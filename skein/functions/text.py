"""String expressions. All stay in the JVM; all give null for null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c: Column | str, pattern: str, put: str = "") -> Column:
    """Replace all matches; classes and word bounds are Unicode's, only LF ends a line."""
    return F.regexp_replace(col(c), f"(?Ud){pattern}", put)


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return sub(c, r"\A\s+|\s+\z")


def squeeze(c: Column | str) -> Column:
    """Every run of white space one blank, none at the ends."""
    return F.trim(sub(c, r"\s+", " "))


def filled(c: Column | str) -> Column:
    """Null if null or empty: what counts as missing."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    """The first of ``cs`` that isn't null or empty."""
    return F.coalesce(*[filled(c) for c in cs])


def match_form(c: Column | str) -> Column:
    """For fuzzy matching: lower case, marks made blanks, white space squeezed; empty for null."""
    return squeeze(sub(F.lower(strip(F.coalesce(col(c), F.lit("")))), r"[^\w\s]", " "))


def tokens(c: Column | str) -> Column:
    """Distinct words of a squeezed text; none for an empty one."""
    return F.array_distinct(F.filter(F.split(col(c), " "), lambda t: t != ""))


def ascii_shape(c: Column | str) -> Column:
    """Lower case with every other script's letters written Z, blanks as blanks and marks as #.

    Patterns over a-z with word bounds then mean the same in every regular expression dialect.
    """
    s = F.lower(col(c))
    s = F.regexp_replace(s, r"[\x{85}\p{Z}]", " ")
    s = F.regexp_replace(s, r"[^\x{00}-\x{7F}\p{L}\p{M}\p{N}]", "#")
    return F.regexp_replace(s, r"[^\x{00}-\x{7F}]", "Z")


def short(c: Column | str, width: int, more: str = " [...]") -> Column:
    """Squeezed, and cut at a word's end so that it has at most ``width`` characters with ``more`` after it."""
    s = squeeze(c)
    head = F.regexp_extract(s, rf"^(.{{0,{width - len(more)}}})(?=\s)", 1)
    return F.when(F.length(s) <= width, s).otherwise(F.concat(head, F.when(head == "", F.lit(more.strip())).otherwise(F.lit(more))))


def slug(kind: Column, c: Column | str) -> Column:
    """kind, _, and the first 50 characters of the text with anything but a-z and digits made _."""
    return F.concat(kind, F.lit("_"), F.left(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), F.lit(50)))


def md5_left(c: Column, n: int) -> Column:
    return F.left(F.md5(c), F.lit(n))


def literal_pattern(q: str) -> str:
    """A pattern for the text ``q`` itself."""
    return r"\Q" + q.replace(r"\E", r"\E\\E\Q") + r"\E"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row.

    They pass through a generator, into which the optimizer doesn't copy them again for each place that names them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
