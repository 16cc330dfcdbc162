"""The pN_ queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chunking, copies, mapping, mixing, packing, quality, scans, topn
from skein.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repairs(table(spark, d, "afsc_doc"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of each scanned record, and how many repairs it took."""
    return scans.repaired(table(spark, d, "afsc_doc")).select("afsc_doc_id", "clean_text", F.size("repairs").alias("n_repairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_requirements(table(spark, d, "rels_requires"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mapping.meant_entries(table(spark, d, "ksa_item"), table(spark, d, "laiser_similarity_validation"), table(spark, d, "esco_catalog"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each table mean no entry of the list."""
    got = p3_found(spark, d)
    return got.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("esco_id") == "none").alias("n_unmatched"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_texts(table(spark, d, "afsc_doc"), "afsc_doc_id", "clean_text")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces, characters and longest piece of each document that is cut."""
    got = chunking.split_texts(table(spark, d, "afsc_doc"), "afsc_doc_id", "clean_text", with_text=True)
    return got.groupBy("afsc_doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(F.length("piece")).alias("n_chars"), F.max(F.length("piece")).alias("longest"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_sets(table(spark, d, "ksa_item"), table(spark, d, "ksa_candidates_v0_raw"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Which documents were divided; refilling the last containers moves none of them, so it is left out."""
    return packing.oversized(packing.pack_documents(table(spark, d, "documents"), refill=False))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each reciprocal class and how full they are."""
    return packing.fill_report(packing.pack_documents(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_target"))
    return report.where("short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, wanted and reached size of each source."""
    return mixing.mix(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_target"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_word")).where(F.col("kind") != "prose").select("doc_id", "kind")


def p8_figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures of every text that isn't blank."""
    return quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_word"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_repaired, p2_found, p3_found, p3_unmatched, p4_found, p4_pieces, p5_found, p6_found, p6_containers, p7_found, p7_shares, p8_found, p8_figures)
}

WHITE = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\p{Z}]"
#: The pieces of p4, cut one after another: boundaries as lists of places, then a step for each piece.
PIECES_SQL = rf"""c AS (SELECT afsc_doc_id, clean_text AS t, length(clean_text) AS n, regexp_extract_all(clean_text, '(?s).', 0) AS ch FROM afsc_doc WHERE length(clean_text) > 1200),
      marks AS (SELECT afsc_doc_id, t, n, ch, list_filter(range(0, n), lambda i: ch[i + 1] = chr(10) AND coalesce(ch[i + 2], '') = chr(10)) AS par,
        list_filter(range(0, n), lambda i: regexp_full_match(ch[i + 1], '{WHITE}')) AS spc, list_filter(range(1, n + 1), lambda e: ch[e] IN ('.', '!', '?') AND (e = n OR regexp_full_match(ch[e + 1], '{WHITE}'))) AS stop FROM c),
      b AS (SELECT afsc_doc_id, n, par, spc, list_filter(stop, lambda e: NOT regexp_matches(left(t, e), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(e\.g\.|i\.e\.|approx\.|No\.|Fig\.)$') AND NOT regexp_matches(left(t, e), '(^|\n\n)[ \t]*(\d+\.)+$')) AS sen FROM marks),
      cut AS (SELECT afsc_doc_id, n, par, sen, spc, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS s, CAST(150 AS BIGINT) AS e FROM b
        UNION ALL SELECT afsc_doc_id, n, par, sen, spc, k + 1, f, CASE WHEN n - f <= 1200 THEN n ELSE coalesce(list_max(list_filter(par, lambda x: x > f + 600 AND x <= f + 1200)), list_max(list_filter(sen, lambda x: x > f + 600 AND x <= f + 1200)),
          list_max(list_filter(spc, lambda x: x > f + 600 AND x <= f + 1200)), f + 1200) END FROM (SELECT *, e - 150 AS f FROM cut WHERE e < n)),
      pieces AS (SELECT afsc_doc_id, CAST(k AS INTEGER) AS chunk_idx, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end FROM cut WHERE k >= 0)"""

SQL: dict[str, str] = {
    "p2_found": r"""
        WITH valid AS (
          SELECT upper(regexp_replace(afsc_code, '^\s+|\s+$', '', 'g')) AS afsc_code, lower(regexp_replace(item_type, '^\s+|\s+$', '', 'g')) AS item_type,
                 item_name, rel_id, ingested_at, confidence
          FROM rels_requires
          WHERE afsc_code IS NOT NULL AND item_type IS NOT NULL AND item_name IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1),
        latest AS (SELECT *, row_number() OVER (PARTITION BY afsc_code, item_type, item_name ORDER BY ingested_at DESC NULLS LAST, rel_id DESC) AS k FROM valid),
        best AS (SELECT *, row_number() OVER (PARTITION BY afsc_code, item_type ORDER BY confidence DESC, rel_id) AS rank_no FROM latest WHERE k = 1)
        SELECT afsc_code, item_type, CAST(rank_no AS INTEGER) AS rank_no, rel_id FROM best WHERE rank_no <= 5""",
    "p5_found": r"""
        WITH items AS (
          SELECT item_id AS id, afsc_code AS a, type AS b, lower(regexp_replace(name, '[^\p{L}\p{M}\p{N}]+', '', 'g')) AS t,
                 list_sort(list_transform(map_entries(meta), lambda e: lower(regexp_replace(e.key, '[^\p{L}\p{M}\p{N}]+', '', 'g')) || '=' || lower(regexp_replace(e.value, '[^\p{L}\p{M}\p{N}]+', '', 'g')))) AS m
          FROM ksa_item WHERE regexp_replace(name, '[\s\p{Z}\p{Cf}]+', '', 'g') <> ''),
        i AS (SELECT 'ksa_item' AS src, min(id) AS keep_id, count(*) AS n_copies FROM items GROUP BY a, b, t, m HAVING count(*) > 1),
        low AS (SELECT *, lower(regexp_replace(text_norm, '\p{Cf}+', '', 'g')) AS s FROM ksa_candidates_v0_raw
                WHERE regexp_replace(text_norm, '[\s\p{Z}\p{Cf}]+', '', 'g') <> ''),
        marked AS (SELECT *, regexp_replace(s, '[^\p{L}\p{N}]*\b(action|object|setting|level)["\s]*[:=]', chr(1) || '\1' || chr(2), 'g') AS f FROM low),
        keyed AS (SELECT candidate_id AS id, afsc AS a, label AS b, source_doc AS c,
                    CASE WHEN contains(f, chr(1) || 'action' || chr(2)) AND contains(f, chr(1) || 'object' || chr(2)) AND contains(f, chr(1) || 'setting' || chr(2))
                      THEN regexp_replace(split_part(f, chr(1), 1), '[^\p{L}\p{M}\p{N}]+', '', 'g') || chr(1) || array_to_string(list_sort(list_transform(list_filter(string_split(f, chr(1)), lambda x: contains(x, chr(2))),
                             lambda x: split_part(x, chr(2), 1) || '=' || regexp_replace(split_part(x, chr(2), 2), '[^\p{L}\p{M}\p{N}]+', '', 'g'))), chr(1))
                      ELSE regexp_replace(s, '[^\p{L}\p{M}\p{N}]+', '', 'g') END AS t
                  FROM marked),
        k AS (SELECT 'ksa_candidates_v0_raw' AS src, min(id) AS keep_id, count(*) AS n_copies FROM keyed GROUP BY a, b, c, t HAVING count(*) > 1)
        SELECT src, keep_id, n_copies FROM i UNION ALL SELECT src, keep_id, n_copies FROM k""",
    "p4_found": f"WITH RECURSIVE {PIECES_SQL} SELECT * FROM pieces",
    "p4_pieces": f"WITH RECURSIVE {PIECES_SQL} SELECT afsc_doc_id, count(*) AS n_pieces, CAST(sum(char_end - char_start) AS BIGINT) AS n_chars, max(char_end - char_start) AS longest FROM pieces GROUP BY 1",
    # sizes in characters: no case is close enough for the measure to matter
    "p7_found": """
        WITH d AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents JOIN mix_target USING (source) GROUP BY 1)
        SELECT source FROM mix_target LEFT JOIN d USING (source) WHERE max_uses * coalesce(size, 0) < target_share * (SELECT sum(size) FROM d)""",
    # a text has at least as many tokens as pieces that the vocabulary's pattern divides it into; in these tables no text lies between
    "p6_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '(?:''(?:s|t|re|ve|m|ll|d))| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) > 4096",
}
