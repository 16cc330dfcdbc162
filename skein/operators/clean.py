"""Text cleaning: each step a column expression, and the chains made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import col, squeeze, strip, sub

# Characters that are stripped from both ends of an item, and phrases with another canonical form.
ENDS = " .,:;()[]{}\"'`|/\\"
CANONICAL = {"imagery analysis": "imagery exploitation", "mensuration": "geoint mensuration", "intelligence briefing": "brief intelligence findings"}
# Bullet glyphs of page extraction.
BULLETS = "•"
# What the steps of the chains look for.
FENCE, TABLE_ROW, PAGE_NUMBER = r"(?s)```.+?```", r"(?m)^(\s*\|.*\|)\s*$", r"(?m)^\s*\d{1,4}\s*$"
DIRECTIVE, NOTE, WRAP = r"(?im)^\s*(DAFECD|AFECD|AFI|AFMAN|USSF).*$", r"(?im)^\s*NOTE:.*$", r"(\w)-\n(\w)"
LINE_END, MANY_BREAKS, PAGE_HEAD, LOOSE_HYPHEN = r"[ \t]+\n", r"\n{3,}", r"(?m)^(DAF?E?CD.*|Page\s+\d+)\s*$", r"(\w)\s*-\s*(\w)"
WIDE_GAP, GAP_BEFORE_MARK, BLANKS = r"(\w)\s{2,}(\w)", r"(\w)\s+([.,;:])", r"[ \t]{2,}"
MODEL_LEAD, BOLD, QUOTED, EXACT_QUOTE = r"^(Based on.*?:|Quote:\s*|Here are.*?:|\d+\.\s*)", r"\*\*([^*]+)\*\*", r'^"([^"]+)"', r"\s*-\s*Exact quote:.*"
MANDATORY = r"Knowledge is mandatory of[:\s]+([^.]+)"
TAG, PREFIX, KNOWLEDGE_OF, ABILITY_TO = r"^-\s*\[(knowledge|ability)\]\s*", r"^-\s*(knowledge of|ability to)\s*", r"(?i)^\s*knowledge of\s+", r"(?i)^\s*ability to\s+"


def dedent(c: Column | str) -> Column:
    """Without the indent that all lines that aren't blank share; blank lines become empty, and the ends are stripped."""
    bare = sub(c, r"(?m)^[^\S\n]+$")
    indent = F.array_min(F.transform(F.filter(F.split(bare, "\n"), lambda x: x != ""), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))))
    shared = F.concat(F.lit("(?md)^[ \\t]{"), F.coalesce(indent, F.lit(0)).cast("string"), F.lit("}"))  # found once a text, not once a line
    return strip(F.regexp_replace(bare, shared, F.lit("")))


def drop_fences(c: Column | str) -> Column:
    return sub(c, FENCE, " ")


def drop_table_rows(c: Column | str) -> Column:
    return sub(c, TABLE_ROW, " ")


def drop_page_numbers(c: Column | str) -> Column:
    return sub(c, PAGE_NUMBER, " ")


def drop_headers(c: Column | str) -> Column:
    """Lines that open with the name of a directive."""
    return sub(c, DIRECTIVE, " ")


def drop_notes(c: Column | str) -> Column:
    return sub(c, NOTE, " ")


def join_wraps(c: Column | str) -> Column:
    """Words hyphenated at an LF joined; breaks at CRLF stay, since CR becomes LF only later."""
    return sub(c, WRAP, "$1$2")


def clean_text(c: Column | str) -> Column:
    """The whole chain, in its order; empty for null."""
    s = dedent(F.coalesce(col(c), F.lit("")))
    for step in (drop_fences, drop_table_rows, drop_page_numbers, drop_headers, drop_notes, join_wraps):
        s = step(s)
    return squeeze(F.translate(s, "\r", "\n"))


def repair_page_text(c: Column | str) -> Column:
    """Text extracted from pages: line ends, headers, bullets, loose hyphens and blanks, quotes."""
    s = F.translate(col(c), "\r", "\n")
    s = sub(s, LINE_END, "\n")
    s = sub(s, MANY_BREAKS, "\n\n")
    s = sub(s, PAGE_HEAD)
    s = F.regexp_replace(s, f"[{BULLETS}]", "* ")
    s = sub(s, LOOSE_HYPHEN, "$1-$2")
    s = sub(s, WIDE_GAP, "$1 $2")
    s = sub(s, GAP_BEFORE_MARK, "$1$2")
    s = F.translate(s, "’“”", "'\"\"")
    return strip(sub(s, BLANKS, " "))


def page_cleanup(c: Column | str) -> Column:
    """No blanks at line ends, no soft hyphens."""
    return F.replace(sub(c, LINE_END, "\n"), F.lit("­"), F.lit(""))


def knowledge_text(c: Column | str) -> Column:
    """A statement without what a model says around it; of an embedded statement only its object."""
    s = F.regexp_replace(col(c), MODEL_LEAD, "")
    s = F.regexp_replace(s, BOLD, "$1")
    s = F.regexp_replace(s, QUOTED, "$1")
    s = F.regexp_replace(s, EXACT_QUOTE, "")
    inner = F.regexp_extract(s, MANDATORY, 1)
    return strip(F.when(inner != "", inner).otherwise(s))


def canonical_item(c: Column | str) -> Column:
    """Squeezed, lower case, without marks at the ends, known variants replaced; empty for null."""
    s = F.trim(F.lower(squeeze(F.coalesce(col(c), F.lit("")))))
    s = F.btrim(s, F.lit(ENDS))
    known = F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])
    return F.coalesce(known[s], s)


def item_form(c: Column | str) -> Column:
    """For the guard against near duplicates: no tag, no prefix, only a-z, digits and blanks."""
    s = F.lower(strip(c))
    s = sub(s, TAG)
    s = sub(s, PREFIX)
    return sub(sub(s, r"[^a-z0-9\s]"), r"\s+", " ")


def without_prefix(c: Column | str, kind: Column | str) -> Column:
    """Without ``knowledge of`` or ``ability to``, as its type has it."""
    return F.when(col(kind) == "knowledge", F.regexp_replace(col(c), KNOWLEDGE_OF, "")).when(col(kind) == "ability", F.regexp_replace(col(c), ABILITY_TO, "")).otherwise(col(c))


def plain_name(name: str) -> str:
    """A column's name in lower case with _ for blanks."""
    return name.strip().lower().replace(" ", "_")
