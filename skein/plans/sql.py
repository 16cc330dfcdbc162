"""Pieces of SQL that the queries' counterparts share."""

WS = r"[\t\n\x0b\f\r \x{85}\p{Z}]"
WORD = r"[\p{L}\p{M}\p{N}_]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sub(x: str, pattern: str, put: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{put}', '{flags}')"


def match_form(x: str) -> str:
    return squeeze(sub(f"lower({strip(f"coalesce({x}, '')")})", r"[^\p{L}\p{M}\p{N}_\t\n\x0b\f\r \x{85}\p{Z}]", " "))


def shape(x: str) -> str:
    s = sub(f"lower({x})", r"[\x{85}\p{Z}]", " ")
    s = sub(s, r"[^\x00-\x7F\p{L}\p{M}\p{N}]", "#")
    return sub(s, r"[^\x00-\x7F]", "Z")


def words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({words(a)}, {words(b)}))) = 0 THEN 1.0 ELSE len(list_intersect({words(a)}, {words(b)}))::DOUBLE / len(list_distinct(list_concat({words(a)}, {words(b)}))) END"


ITEMS = f"""items AS (
  SELECT upper({strip("afsc_code")}) AS doc_code, rel_id AS ord, item_name AS text, lower({strip("item_type")}) AS item_type,
         CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence,
         CASE WHEN trim(coalesce(esco_id, '')) <> '' THEN 'extractor-a' ELSE 'llm-b' END AS source, esco_id, evidence
  FROM rels_requires WHERE afsc_code IS NOT NULL AND item_name IS NOT NULL AND item_type IS NOT NULL)"""


def with_items(select: str, more: str = "") -> str:
    return f"WITH {ITEMS}{', ' + more if more else ''} {select}"


def ratios(pairs: str, name: str = "ratios") -> str:
    """CTEs that give ``name`` (a, b, ratio) for the distinct pairs (a, b) of the CTE ``pairs``.

    Twice the length of all matching blocks over both lengths: the longest block, the first in a and then in b among equal
    ones, and in turn what lies left and right of it.
    """
    return f"""{name}_open AS (SELECT a, b, a AS x, b AS y, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT a, b FROM {pairs})
      UNION ALL SELECT a, b, unnest([left(x, i - 1), substr(x, i + n)]), unnest([left(y, j - 1), substr(y, j + n)]), n FROM (
        SELECT a, b, x, y, m.n AS n, -m.i AS i, instr(y, substr(x, -m.i, m.n)) AS j FROM (
          SELECT a, b, x, y, list_max(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, least(length(x) - i + 1, length(y)) + 1), lambda n: {{'n': n, 'i': -i}}))), lambda s: contains(y, substr(x, -s.i, s.n)))) AS m
          FROM {name}_open WHERE x <> '' AND y <> '') WHERE m IS NOT NULL)),
    {name} AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * (sum(n) / 2) / (length(a) + length(b)) END::DOUBLE AS ratio FROM {name}_open GROUP BY a, b)"""
