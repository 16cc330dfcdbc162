"""Queries over items: filters, windows, aggregates, similarity, model boundary, vectors."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import first_filled, match_form, md5_left
from skein.operators import items as I
from skein.operators import providers as P
from skein.operators import similarity as M
from skein.operators import stats as A
from skein.operators.clean import clean_text
from skein.plans import sql as S
from skein.plans.q_text import CANON_MAP, HEURISTIC_SQL, MINED_SQL, _canon, _form, of_cleaned, stub_sql
from skein.sources import readers
from skein.sources.tables import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _items(spark: SparkSession, d: str) -> DataFrame:
    return I.items_of(table(spark, d, "rels_requires"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "laiser_similarity_validation")


def _quality(strict: bool, bias: bool) -> str:
    banned = ", ".join(f"'{b}'" for b in I.BANNED)
    low = f"(item_type = 'skill' AND coalesce(confidence, 0) < {I.LOW_CONFIDENCE})"
    more = f" AND (NOT {low} OR regexp_matches(text, '(?i){I.HINT}'))" * bias + f" AND (NOT {low} OR trim(coalesce(esco_id, '')) <> '')" * strict
    return S.with_items(
        "SELECT doc_code, ord, text, item_type, confidence FROM once WHERE k = 1",
        f"""canon AS (SELECT * REPLACE ({CANON_MAP} AS text) FROM (SELECT *, {_canon('text')} AS t FROM items WHERE text <> '')),
        kept AS (SELECT * FROM canon WHERE length(text) >= {I.MIN_LEN} AND length(text) <= CASE WHEN item_type = 'skill' THEN {I.MAX_LEN_SKILL} ELSE {I.MAX_LEN_OTHER} END AND text NOT IN ({banned}){more}),
        once AS (SELECT *, row_number() OVER (PARTITION BY doc_code, item_type, text ORDER BY ord) AS k FROM kept)""",
    )


KEPT = ("doc_code", "ord", "text", "item_type", "confidence")


@query(_quality(False, False))
def f01_f04_quality_filter(spark, d):
    return I.quality_filter(_items(spark, d)).select(*KEPT)


@query(_quality(False, True))
def f05_domain_bias(spark, d):
    return I.quality_filter(_items(spark, d), domain_bias=True).select(*KEPT)


@query(_quality(True, False))
def f06_strict(spark, d):
    return I.quality_filter(_items(spark, d), strict=True).select(*KEPT)


@query(S.with_items("SELECT ord, confidence, 'skill' AS item_type FROM items WHERE coalesce(confidence, 0) >= 0.7"))
def f07_f08_min_confidence(spark, d):
    return I.min_confidence(_items(spark, d), 0.7).select("ord", "confidence", F.lit("skill").alias("item_type"))


@query(S.with_items(f"SELECT ord, text FROM items WHERE confidence >= 0.55 AND NOT regexp_matches(text, '(?i){'|'.join(I.STOPLIST)}')"))
def f09_f10_score_and_stoplist(spark, d):
    return _items(spark, d).where((F.col("confidence") >= I.MIN_SCORE) & ~I.stoplisted(F.col("text"))).select("ord", "text")


@query(S.with_items("SELECT ord, text FROM items WHERE item_type IN ('skill', 'ability') AND confidence >= 0.8 AND regexp_matches(text, '(?i)radar|sensor')"))
def f11_f12_chosen(spark, d):
    return _items(spark, d).where(F.col("item_type").isin("skill", "ability") & (F.col("confidence") >= 0.8) & F.col("text").rlike("(?i)radar|sensor")).select("ord", "text")


@query(S.with_items(f"""SELECT ord, length(text) BETWEEN 1 AND 6 AS fragment, length(text) > 60 AS too_long, regexp_matches(lower(text), '{I.LEADING_VERBS}') AS leading_verb,
    regexp_matches(lower(text), '{'|'.join(I.GENERIC)}') AS generic FROM items WHERE item_type = 'knowledge'"""))
def f13_knowledge_checks(spark, d):
    low = F.lower("text")
    return _items(spark, d).where(F.col("item_type") == "knowledge").select("ord", F.length("text").between(1, 6).alias("fragment"), (F.length("text") > 60).alias("too_long"), low.rlike(I.LEADING_VERBS).alias("leading_verb"), low.rlike("|".join(I.GENERIC)).alias("generic"))


@query(S.with_items(r"SELECT ord, text FROM items WHERE regexp_matches(text, '(?i)^(Based on|Quote:|\d+\.\s*\*\*|Here are)') OR length(text) > 60"))
def f14_malformed(spark, d):
    return _items(spark, d).where(F.col("text").rlike(r"(?i)^(Based on|Quote:|\d+\.\s*\*\*|Here are)") | (F.length("text") > 60)).select("ord", "text")


@query("SELECT rel_id, confidence FROM rels_requires WHERE NOT isnan(confidence) AND (confidence < 0 OR confidence > 1)")
def f15_out_of_range(spark, d):
    c = F.col("confidence")
    return table(spark, d, "rels_requires").where(~F.isnan(c) & ((c < 0) | (c > 1))).select("rel_id", "confidence")


@query(f"SELECT validation_id, sim_skill_evidence < {A.LOW_EVIDENCE} AS low_evidence, sim_skill_esco < {A.LOW_ENTRY} AS low_entry FROM laiser_similarity_validation WHERE NOT isnan(sim_skill_evidence) AND NOT isnan(sim_skill_esco)")
def f16_similarity_flags(spark, d):
    both = F.col("sim_skill_evidence").isNotNull() & F.col("sim_skill_esco").isNotNull()
    return _checks(spark, d).where(both & ~F.isnan("sim_skill_evidence") & ~F.isnan("sim_skill_esco")).select("validation_id", (F.col("sim_skill_evidence") < A.LOW_EVIDENCE).alias("low_evidence"), (F.col("sim_skill_esco") < A.LOW_ENTRY).alias("low_entry"))


@query("SELECT afsc_doc_id, code FROM afsc_doc WHERE source_pdf LIKE 'handbook%' AND contains(code, 'X1')")
def f18_index_filter(spark, d):
    return table(spark, d, "afsc_doc").where(F.col("source_pdf").startswith("handbook") & F.col("code").contains("X1")).select("afsc_doc_id", "code")


@query(S.with_items("SELECT ord, confidence FROM items WHERE item_type = 'knowledge' AND confidence < 0.82"))
def f19_low_knowledge(spark, d):
    return _items(spark, d).where((F.col("item_type") == "knowledge") & (F.col("confidence") < 0.82)).select("ord", "confidence")


# windows


@query(S.with_items("SELECT doc_code, item_type, text, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_code, item_type, text ORDER BY ord) AS k FROM items) WHERE k = 1"))
def w01_first_wins(spark, d):
    return I.first_wins(_items(spark, d).select("doc_code", "item_type", "text", "ord"), ["doc_code", "item_type", "text"])


@query(S.with_items("SELECT ord, item_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_code, item_type ORDER BY confidence DESC NULLS LAST, ord) AS k FROM items) WHERE k <= 15 OR item_type <> 'knowledge'"))
def w02_cap_knowledge(spark, d):
    i = _items(spark, d).select("doc_code", "ord", "item_type", "confidence")
    know = I.top_rows(i.where(F.col("item_type") == "knowledge"), ["doc_code"], [F.col("confidence").desc_nulls_last(), F.col("ord")], 15)
    return i.where(F.col("item_type") != "knowledge").select("ord", "item_type").unionByName(know.select("ord", "item_type"))


@query(S.with_items("SELECT doc_code, CAST(k AS INTEGER) AS rank_no, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_code ORDER BY confidence DESC NULLS LAST, ord) AS k FROM items) WHERE k <= 25"))
def w03_x08_top_items(spark, d):
    return I.top_rows(_items(spark, d).select("doc_code", "ord", "confidence"), ["doc_code"], [F.col("confidence").desc_nulls_last(), F.col("ord")], 25).select("doc_code", "rank_no", "ord")


@query("SELECT validation_id, sim_skill_evidence FROM laiser_similarity_validation WHERE NOT isnan(sim_skill_evidence) ORDER BY sim_skill_evidence, validation_id LIMIT 5")
def w04_least_similar(spark, d):
    return _checks(spark, d).where(F.col("sim_skill_evidence").isNotNull() & ~F.isnan("sim_skill_evidence")).select("validation_id", "sim_skill_evidence").orderBy("sim_skill_evidence", "validation_id").limit(5)


@query(f"SELECT item_id FROM (SELECT item_id, count(*) OVER (PARTITION BY lower({S.squeeze('name')})) AS n FROM ksa_item WHERE name IS NOT NULL) WHERE n > 1")
def w05_repeated(spark, d):
    from skein.functions.text import squeeze

    return A.repeated(table(spark, d, "ksa_item").where(F.col("name").isNotNull()), F.lower(squeeze("name"))).select("item_id")


@query(S.with_items("SELECT item_type, CAST(k AS INTEGER) AS sample_no, ord FROM (SELECT *, row_number() OVER (PARTITION BY item_type ORDER BY md5(CAST(ord AS VARCHAR)), ord) AS k FROM items) WHERE k <= 10"))
def w06_stratified_sample(spark, d):
    return A.hash_sample(_items(spark, d).select("item_type", "ord"), "item_type", F.col("ord"), 10).select("item_type", "sample_no", "ord")


@query(S.with_items("SELECT doc_code, source, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_code, source ORDER BY ord) AS k FROM items) WHERE k <= CASE WHEN source = 'extractor-a' THEN 2 ELSE 1 END"))
def w07_audit_pick(spark, d):
    top = I.top_rows(_items(spark, d).select("doc_code", "source", "ord"), ["doc_code", "source"], [F.col("ord")], 2)
    return top.where((F.col("source") == "extractor-a") | (F.col("rank_no") == 1)).select("doc_code", "source", "ord")


@query("SELECT afsc_doc_id, source_pdf, lead(page_start) OVER (PARTITION BY source_pdf ORDER BY page_start, afsc_doc_id) AS next_start FROM afsc_doc WHERE page_start IS NOT NULL")
def w08_next_start(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source_pdf").orderBy("page_start", "afsc_doc_id")
    return table(spark, d, "afsc_doc").where(F.col("page_start").isNotNull()).select("afsc_doc_id", "source_pdf", F.lead("page_start").over(w).alias("next_start"))


@query("SELECT code, title, category FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY afsc_doc_id) AS k FROM afsc_doc) WHERE k = 1")
def w09_first_of_code(spark, d):
    return I.first_wins(table(spark, d, "afsc_doc").select("code", "title", "category", "afsc_doc_id"), ["code"], "afsc_doc_id").drop("afsc_doc_id")


@query(S.with_items("SELECT doc_code, CAST(k AS INTEGER) AS rank_no, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_code ORDER BY length(text) DESC, ord) AS k FROM items WHERE item_type = 'knowledge') WHERE k <= 15"))
def w10_longest_first(spark, d):
    i = _items(spark, d).where(F.col("item_type") == "knowledge").select("doc_code", "ord", F.length("text").alias("size"))
    return I.top_rows(i, ["doc_code"], [F.col("size").desc(), F.col("ord")], 15).select("doc_code", "rank_no", "ord")


# aggregates

KINDS_SQL = "count(*) AS total, count(*) FILTER (item_type = 'knowledge') AS knowledge, count(*) FILTER (item_type = 'skill') AS skills, count(*) FILTER (item_type = 'ability') AS abilities, count(*) FILTER (trim(coalesce(esco_id, '')) <> '') AS aligned"


@query(S.with_items(f"SELECT {KINDS_SQL} FROM items"))
def a03_totals(spark, d):
    return A.count_types(_items(spark, d))


@query(S.with_items("SELECT count(*) FILTER (contains(source, 'extractor') OR trim(coalesce(esco_id, '')) <> '') AS extracted, count(*) FILTER (contains(source, 'llm-')) AS generated FROM items"))
def a05_provenance(spark, d):
    return _items(spark, d).agg(F.count_if(F.col("source").contains("extractor") | I.has_id("esco_id")).alias("extracted"), F.count_if(F.col("source").contains("llm-")).alias("generated"))


@query(S.with_items("SELECT item_type, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM items GROUP BY 1"))
def a06_shares(spark, d):
    return A.shares(_items(spark, d), "item_type")


@query(S.with_items("SELECT count(DISTINCT doc_code) AS codes, avg(confidence) AS mean, min(confidence) AS low, max(confidence) AS high FROM items"))
def a07_summary(spark, d):
    return _items(spark, d).agg(F.count_distinct("doc_code").alias("codes"), F.avg("confidence").alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


@query(S.with_items(f"SELECT doc_code, {KINDS_SQL}, avg(confidence) AS mean FROM items GROUP BY 1"))
def a08_by_code(spark, d):
    i = _items(spark, d)
    kind = lambda k: F.count_if(F.col("item_type") == k)
    return i.groupBy("doc_code").agg(F.count(F.lit(1)).alias("total"), kind("knowledge").alias("knowledge"), kind("skill").alias("skills"), kind("ability").alias("abilities"), F.count_if(I.has_id("esco_id")).alias("aligned"), F.avg("confidence").alias("mean"))


@query(S.with_items("SELECT coalesce(avg(confidence), 0) AS mean, coalesce(avg(confidence) FILTER (source = 'extractor-a'), 0) AS extracted, coalesce(avg(confidence) FILTER (source = 'llm-b'), 0) AS generated FROM items"))
def a09_mean_by_source(spark, d):
    m = lambda s: F.coalesce(F.avg(F.when(F.col("source") == s, F.col("confidence"))), F.lit(0.0))
    return _items(spark, d).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean"), m("extractor-a").alias("extracted"), m("llm-b").alias("generated"))


@query(S.with_items("SELECT doc_code, count(*) AS n FROM items GROUP BY 1 HAVING count(*) < 3"))
def a10_few(spark, d):
    return _items(spark, d).groupBy("doc_code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < 3)


def _described(c: str) -> str:
    v = f"(CASE WHEN NOT isnan({c}) THEN {c} END)"
    return f"SELECT '{c}' AS name, count({v}) AS n, avg({v}) AS mean, stddev_samp({v}) AS std, min({v}) AS min, quantile_cont({v}, 0.25) AS q25, quantile_cont({v}, 0.5) AS q50, quantile_cont({v}, 0.75) AS q75, max({v}) AS max FROM laiser_similarity_validation"


@query(f"{_described('sim_skill_evidence')} UNION ALL {_described('sim_skill_esco')}")
def a11_described(spark, d):
    return A.described(_checks(spark, d), ["sim_skill_evidence", "sim_skill_esco"])


@query("SELECT corr(sim_skill_evidence, sim_skill_esco) AS r FROM laiser_similarity_validation WHERE NOT isnan(sim_skill_evidence) AND NOT isnan(sim_skill_esco)")
def a12_correlation(spark, d):
    return _checks(spark, d).where(~F.isnan("sim_skill_evidence") & ~F.isnan("sim_skill_esco")).agg(F.corr("sim_skill_evidence", "sim_skill_esco").alias("r"))


@query(f"SELECT t AS threshold, avg((sim_skill_esco >= t)::INT) * 100 AS pct FROM laiser_similarity_validation, (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in A.SWEEP)}]) AS t) WHERE NOT isnan(sim_skill_esco) GROUP BY 1")
def a13_sweep(spark, d):
    return A.sweep(_checks(spark, d), "sim_skill_esco")


@query(S.with_items("SELECT doc_code, count(*) AS n FROM items GROUP BY 1 ORDER BY n DESC, doc_code LIMIT 10"))
def a14_most_edges(spark, d):
    return _items(spark, d).groupBy("doc_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "doc_code").limit(10)


@query("SELECT type, avg(length(name)) AS mean_len, max(length(name)) AS max_len FROM ksa_item GROUP BY 1")
def a15_lengths(spark, d):
    return table(spark, d, "ksa_item").groupBy("type").agg(F.avg(F.length("name")).alias("mean_len"), F.max(F.length("name")).alias("max_len"))


@query(S.with_items("SELECT ord, left(text, 60) AS text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_code ORDER BY ord) AS k FROM items) WHERE k <= 5"))
def a17_sample_rows(spark, d):
    return I.top_rows(_items(spark, d).select("doc_code", "ord", F.left("text", F.lit(60)).alias("text"), "confidence"), ["doc_code"], [F.col("ord")], 5).select("ord", "text", "confidence")


@query(S.with_items("SELECT count(*) AS n_documents, sum(n) AS n_items, avg(n) AS mean_items FROM (SELECT doc_code, count(*) AS n FROM items GROUP BY 1)"))
def a18_batch_totals(spark, d):
    return _items(spark, d).groupBy("doc_code").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_items"), F.avg("n").alias("mean_items"))


@query(S.with_items("""SELECT 'confidence_out_of_range' AS check_name, count(*) AS n FROM items WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT 'blank_text', count(*) FROM items WHERE trim(text) = ''
    UNION ALL SELECT 'confidence_missing', count(*) FROM items WHERE confidence IS NULL UNION ALL SELECT 'documents_under_three', count(*) FROM (SELECT doc_code FROM items GROUP BY 1 HAVING count(*) < 3)"""))
def a20_issues(spark, d):
    return A.issues(_items(spark, d))


@query(f"""WITH t(term) AS (VALUES {', '.join(f"('{x}')" for x in I.GENERIC_TERMS)}), i AS (SELECT afsc_code AS doc_code, lower(name) AS s FROM ksa_item WHERE type = 'knowledge')
    SELECT doc_code, term, count(*) AS n FROM i, t WHERE contains(s, term) GROUP BY 1, 2""")
def a21_generic_terms(spark, d):
    return A.generic_counts(table(spark, d, "ksa_item").select(F.col("afsc_code").alias("doc_code"), F.col("name").alias("text"), F.col("type").alias("item_type")))


@query(S.with_items("SELECT avg((coalesce(evidence, '') <> '')::INT) AS coverage FROM items"))
def a22_evidence_coverage(spark, d):
    return _items(spark, d).agg(F.avg((F.coalesce("evidence", F.lit("")) != "").cast("int")).alias("coverage"))


# order, sets, shaping


@query(S.with_items("SELECT ord, CAST(row_number() OVER (PARTITION BY doc_code ORDER BY item_type, confidence DESC NULLS LAST, text, ord) AS INTEGER) AS place FROM items"))
def o01_sorted(spark, d):
    order = [F.col("item_type"), F.col("confidence").desc_nulls_last(), F.col("text"), F.col("ord")]
    return I.numbered(_items(spark, d).select("doc_code", "ord", "item_type", "confidence", "text"), ["doc_code"], order).select("ord", F.col("place").cast("int").alias("place"))


@query("SELECT afsc_code AS code, name AS text, NULL AS label FROM ksa_item UNION ALL SELECT afsc, text_norm, label FROM ksa_candidates_v0_raw")
def o04_union(spark, d):
    a = table(spark, d, "ksa_item").select(F.col("afsc_code").alias("code"), F.col("name").alias("text"))
    b = table(spark, d, "ksa_candidates_v0_raw").select(F.col("afsc").alias("code"), F.col("text_norm").alias("text"), "label")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT source_pdf FROM afsc_doc")
def o07_distinct(spark, d):
    return table(spark, d, "afsc_doc").select("source_pdf").distinct()


@query("""SELECT item_id, CASE WHEN coalesce(esco_id, '') <> '' THEN esco_id WHEN coalesce(canonical_key, '') <> '' THEN canonical_key ELSE nullif(name, '') END AS best, coalesce(nullif(CASE WHEN NOT isnan(confidence) THEN confidence END, 0), 0.5) AS score FROM ksa_item""")
def x07_first_filled(spark, d):
    return table(spark, d, "ksa_item").select("item_id", first_filled("esco_id", "canonical_key", "name").alias("best"), F.coalesce(F.nullif(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.0)), F.lit(0.5)).alias("score"))


@query("""SELECT rel_id, lower(coalesce(item_type, 'skill')) AS item_type, coalesce(least(greatest(CASE WHEN NOT isnan(confidence) THEN confidence END, 0), 1), 0.5) AS confidence, coalesce(evidence, '') AS evidence, coalesce(esco_id, '') AS esco_id,
    CASE WHEN coalesce(least(greatest(CASE WHEN NOT isnan(confidence) THEN confidence END, 0), 1), 0.5) >= 0.8 THEN 'auto' ELSE 'needs_review' END AS review_status FROM rels_requires""")
def r01_bounds(spark, d):
    r = table(spark, d, "rels_requires").select("rel_id", "item_type", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "evidence", "esco_id")
    return I.with_bounds(r)


@query("SELECT code, CASE WHEN coalesce(name, '') <> '' THEN code || ' - ' || name ELSE code END AS label FROM nodes_afsc")
def r08_j14_labels(spark, d):
    return table(spark, d, "nodes_afsc").select("code", F.when(F.coalesce("name", F.lit("")) != "", F.concat_ws(" - ", "code", "name")).otherwise(F.col("code")).alias("label"))


@query("SELECT rel_id, left(md5(item_name), 16) AS sig, left(md5(item_name), 8) AS short_sig, epoch_ms(observed_at) AS ms, strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM rels_requires WHERE item_name IS NOT NULL")
def n01_hash_and_time(spark, d):
    return table(spark, d, "rels_requires").where(F.col("item_name").isNotNull()).select("rel_id", md5_left(F.col("item_name"), 16).alias("sig"), md5_left(F.col("item_name"), 8).alias("short_sig"), F.unix_millis("observed_at").alias("ms"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def n02_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# joins


@query("SELECT c.candidate_id, d.title, d.category FROM ksa_candidates_v0_raw c LEFT JOIN afsc_doc d USING (afsc_doc_id)")
def j01_with_document(spark, d):
    return table(spark, d, "ksa_candidates_v0_raw").select("candidate_id", "afsc_doc_id").join(table(spark, d, "afsc_doc").select("afsc_doc_id", "title", "category"), "afsc_doc_id", "left").drop("afsc_doc_id")


@query("""SELECT k.item_id, x.title FROM ksa_item k LEFT JOIN (SELECT code, title FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY loaded_at DESC, afsc_doc_id DESC) AS n FROM afsc_doc) WHERE n = 1) x ON k.afsc_code = x.code""")
def j02_last_document(spark, d):
    last = table(spark, d, "afsc_doc").groupBy("code").agg(F.max_by("title", F.struct("loaded_at", "afsc_doc_id")).alias("title"))
    return table(spark, d, "ksa_item").select("item_id", F.col("afsc_code").alias("code")).join(last, "code", "left").drop("code")


# similarity


@query(f"""WITH p AS (SELECT validation_id, {S.match_form('text')} AS a, {S.match_form('esco_export')} AS b FROM laiser_similarity_validation) SELECT validation_id, {S.jaccard('a', 'b')} AS j FROM p""")
def m01_jaccard(spark, d):
    p = _checks(spark, d).select("validation_id", match_form("text").alias("a"), match_form("esco_export").alias("b"))
    return p.select("validation_id", M.jaccard("a", "b").alias("j"))


@query(f"""WITH RECURSIVE p AS (SELECT validation_id, {S.match_form('text')} AS a, {S.match_form('esco_export')} AS b FROM laiser_similarity_validation), {S.ratios('p')}
    SELECT validation_id, ratio, 0.6 * ({S.jaccard('a', 'b')}) + 0.4 * ratio AS hybrid FROM p JOIN ratios USING (a, b)""")
def m02_m03_hybrid(spark, d):
    p = _checks(spark, d).select("validation_id", match_form("text").alias("a"), match_form("esco_export").alias("b"))
    return p.select("validation_id", M.char_ratio("a", "b").alias("ratio"), M.hybrid("a", "b").alias("hybrid"))


#: Near duplicates of the items ``once`` (k = 1): the pairs of one group that are like each other, and each group's leaders in order.
CLUSTER_SQL = f"""it AS (SELECT *, coalesce(doc_code, '') || chr(1) || coalesce(item_type, '') AS g, {S.match_form('text')} AS form,
      row_number() OVER (PARTITION BY doc_code, item_type ORDER BY (trim(coalesce(esco_id, '')) <> '') DESC, coalesce(confidence, 0) DESC, length(text) DESC, ord) AS place FROM once WHERE k = 1),
    word AS (SELECT g, place, text, form, {S.words('form')} AS ws FROM it), each_word AS (SELECT g, place, unnest(ws) AS w FROM word),
    met AS (SELECT x.g, x.place AS u, y.place AS v, count(*) AS n FROM each_word x JOIN each_word y ON x.g = y.g AND x.w = y.w AND x.place < y.place GROUP BY 1, 2, 3
      UNION ALL SELECT x.g, x.place, y.place, 0 FROM word x JOIN word y ON x.g = y.g AND len(x.ws) = 0 AND len(y.ws) = 0 AND x.place < y.place),
    near AS (SELECT m.g, u, v, y.form AS a, x.form AS b, CASE WHEN len(x.ws) = 0 THEN 1.0 ELSE n / (len(x.ws) + len(y.ws) - n) END AS j FROM met m JOIN word x ON x.g = m.g AND x.place = u JOIN word y ON y.g = m.g AND y.place = v
      WHERE length(y.text) >= 4 AND (len(x.ws) = 0 OR n / (len(x.ws) + len(y.ws) - n) >= {M.least_jaccard(M.SAME)} - 1e-9)),
    {S.ratios('near')},
    liked AS (SELECT g, v, list(u ORDER BY u) AS us FROM near JOIN ratios USING (a, b) WHERE 0.6 * j + 0.4 * ratio >= {M.SAME} GROUP BY 1, 2),
    todo AS (SELECT g, v, us, row_number() OVER (PARTITION BY g ORDER BY v) AS step FROM liked),
    walk AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS members, CAST(NULL AS BIGINT) AS v, CAST(NULL AS BIGINT) AS led FROM todo
      UNION ALL SELECT g, step, CASE WHEN led IS NULL THEN members ELSE list_append(members, v) END, v, led FROM
        (SELECT w.g, t.step, w.members, t.v, list_filter(t.us, lambda u: NOT list_contains(w.members, u))[1] AS led FROM walk w JOIN todo t ON t.g = w.g AND t.step = w.step + 1)),
    joined AS (SELECT it.*, l.ord AS leader_ord FROM it LEFT JOIN (SELECT g, v, led FROM walk WHERE led IS NOT NULL) j ON j.g = it.g AND j.v = it.place JOIN it l ON l.g = it.g AND l.place = coalesce(j.led, it.place))"""
_LIFTED = "(arg_min(struct_pack(v := esco_id), ord) FILTER (trim(coalesce(esco_id, '')) <> '')).v"


@query(_quality(False, False).replace("WITH ", "WITH RECURSIVE ", 1).rsplit("SELECT doc_code, ord", 1)[0].rstrip() + f""",
    {CLUSTER_SQL} SELECT doc_code, item_type, leader_ord, max(CASE WHEN ord = leader_ord THEN text END) AS text, {_LIFTED} AS esco_id, count(*) AS n_members FROM joined GROUP BY 1, 2, 3""")
def m04_m06_canonical_items(spark, d):
    return M.canonical_items(I.quality_filter(_items(spark, d)))


_MINED_ITEMS = f"""names AS (SELECT afsc_doc_id, concat_ws('-', code, CAST(afsc_doc_id AS VARCHAR)) AS doc_code FROM afsc_doc),
    every_item AS (SELECT afsc_doc_id, ord, text, confidence, source, 'skill' AS item_type FROM mined
      UNION ALL SELECT afsc_doc_id, 300000 + n, 'Ability to ' || lower(left(text, 1)) || substr(text, 2), 0.55, 'llm-heuristic', 'ability' FROM fit WHERE n <= 2
      UNION ALL SELECT afsc_doc_id, 400000 + n, 'Knowledge of ' || topic, 0.55, 'llm-heuristic', 'knowledge' FROM topics WHERE n <= 3),
    items AS (SELECT doc_code, ord, text, item_type, confidence, source, CAST(NULL AS VARCHAR) AS esco_id FROM every_item JOIN names USING (afsc_doc_id))"""
#: Summary rows of the pipeline over all documents.
PIPELINE_SQL = f"""WITH RECURSIVE {of_cleaned(HEURISTIC_SQL)}, {_MINED_ITEMS}, {_quality(False, False).split(', canon AS', 1)[1].join(['canon AS', '']).rsplit('SELECT doc_code, ord', 1)[0].rstrip()}, {CLUSTER_SQL},
    final AS (SELECT * FROM joined WHERE ord = leader_ord), n_raw AS (SELECT doc_code, count(*) AS n FROM mined JOIN names USING (afsc_doc_id) GROUP BY 1),
    n_good AS (SELECT doc_code, count(*) AS n FROM it GROUP BY 1),
    n_kept AS (SELECT doc_code, count(*) AS n, count(*) FILTER (item_type = 'knowledge') AS k, count(*) FILTER (item_type = 'skill') AS s, count(*) FILTER (item_type = 'ability') AS a FROM final GROUP BY 1)
    SELECT doc_code, CASE WHEN n_good.n IS NULL THEN 0 ELSE n_raw.n END AS n_items_raw, coalesce(n_good.n, 0) AS n_items_after_filters, coalesce(n_kept.n, 0) AS n_items_after_dedupe, coalesce(k, 0) AS knowledge, coalesce(s, 0) AS skills, coalesce(a, 0) AS abilities, 0 AS aligned
    FROM names LEFT JOIN n_raw USING (doc_code) LEFT JOIN n_good USING (doc_code) LEFT JOIN n_kept USING (doc_code)"""


def _ksa(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ksa_item").where(F.col("name").isNotNull()).select(F.col("item_id").alias("ord"), F.col("name").alias("text"), F.col("type").alias("item_type"), "esco_id")


_NEED = "CASE item_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.THRESHOLDS.items()) + " ELSE 0.90 END"
_BARE = r"CASE type WHEN 'knowledge' THEN regexp_replace(name, '(?i)^\s*knowledge of\s+', '') WHEN 'ability' THEN regexp_replace(name, '(?i)^\s*ability to\s+', '') ELSE name END"
ALIGN_SQL = f"""i AS (SELECT item_id AS ord, type AS item_type, {S.match_form(_BARE)} AS a FROM ksa_item WHERE name IS NOT NULL AND trim(coalesce(esco_id, '')) = ''),
    q AS (SELECT DISTINCT a FROM i WHERE length(a) >= 3),
    alts AS (SELECT esco_id, label, list_filter(list_transform(string_split(coalesce(alt_labels, ''), ';'), lambda x: trim(x)), lambda x: x <> '')[1:8] AS alts FROM esco_catalog WHERE trim(coalesce(esco_id, '')) <> '' AND coalesce(label, '') <> ''),
    raw AS (SELECT esco_id, unnest(list_prepend(label, alts)) AS c, generate_subscripts(list_prepend(label, alts), 1) - 1 AS alt_no FROM alts),
    c AS (SELECT esco_id, alt_no, {S.match_form('c')} AS b FROM raw),
    qw AS (SELECT a, unnest({S.words('a')}) AS w FROM q), cw AS (SELECT b, unnest({S.words('b')}) AS w FROM (SELECT DISTINCT b FROM c WHERE b <> '')),
    close AS (SELECT a, b, {S.jaccard('a', 'b')} AS j FROM (SELECT DISTINCT a, b FROM qw JOIN cw USING (w)) WHERE {S.jaccard('a', 'b')} >= {M.least_jaccard(0.90)} - 1e-9),
    {S.ratios('close')},
    scored AS (SELECT ord, esco_id, alt_no, 0.6 * j + 0.4 * ratio AS score FROM i JOIN close USING (a) JOIN ratios USING (a, b) JOIN c USING (b) WHERE 0.6 * j + 0.4 * ratio >= {_NEED}),
    best AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, alt_no, esco_id) AS k FROM scored)"""


@query(f"WITH RECURSIVE {ALIGN_SQL} SELECT ord, esco_id, score FROM best WHERE k = 1")
def m07_alignment(spark, d):
    return M.align(_ksa(spark, d).where(~I.has_id("esco_id")), table(spark, d, "esco_catalog"))


@query(f"WITH RECURSIVE {ALIGN_SQL} SELECT item_id AS ord, coalesce(nullif(k.esco_id, ''), b.esco_id) AS esco_id FROM ksa_item k LEFT JOIN (SELECT ord, esco_id FROM best WHERE k = 1) b ON b.ord = k.item_id WHERE name IS NOT NULL")
def m08_mapped_ids(spark, d):
    i = _ksa(spark, d)
    best = M.align(i.where(~I.has_id("esco_id")), table(spark, d, "esco_catalog")).withColumnRenamed("esco_id", "found")
    return i.join(best, "ord", "left").select("ord", first_filled("esco_id", "found").alias("esco_id"))


# model boundary

LINES = """lines AS (SELECT rel_id AS ord, coalesce(afsc_code, '') AS doc_code, '- ' || coalesce(item_name, '') || CASE WHEN rel_id % 3 = 0 THEN '.' ELSE '' END AS reply FROM rels_requires)"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rels_requires").select(F.col("rel_id").alias("reply_id"), F.concat(F.lit("- "), F.coalesce("item_name", F.lit("")), F.when(F.col("rel_id") % 3 == 0, F.lit(".")).otherwise(F.lit(""))).alias("reply"))


LINE_SQL = rf"""{LINES}, ok AS (SELECT ord, {S.strip('reply')} AS l FROM lines), st AS (SELECT ord, regexp_replace(l, '\s*[.;:,!?]\s*$', '') AS l FROM ok WHERE regexp_matches(l, '(?i)^\s*-\s*(Knowledge of|Ability to)\s.+$')),
  re AS (SELECT ord AS reply_id, regexp_replace(regexp_replace(l, '(?i)^\s*-\s*knowledge of', '- Knowledge of'), '(?i)^\s*-\s*ability to', '- Ability to') AS line FROM st)"""


@query(f"WITH {LINE_SQL} SELECT reply_id, line FROM re WHERE length(line) - 2 <= 120")
def l11_sanitized(spark, d):
    return P.sanitized(_replies(spark, d), "reply_id", "reply").drop("ord")


@query(f"WITH {LINE_SQL} SELECT reply_id, CASE WHEN starts_with(lower(line), '- knowledge') THEN 'knowledge' ELSE 'ability' END AS item_type, substr(line, 3) AS text FROM re WHERE length(line) - 2 <= 120")
def l13_parsed(spark, d):
    return P.parsed(P.sanitized(_replies(spark, d), "reply_id", "reply")).select("reply_id", "item_type", "text")


@query(f"""WITH k AS (SELECT afsc_code, item_id, {_form} AS f FROM ksa_item WHERE name IS NOT NULL AND afsc_code IS NOT NULL),
    e AS (SELECT DISTINCT afsc AS afsc_code, {_form.replace('name', 'text')} AS e FROM laiser_similarity_validation WHERE text IS NOT NULL)
    SELECT item_id FROM k WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.afsc_code = k.afsc_code AND e.e <> '' AND (contains(k.f, e.e) OR contains(e.e, k.f)))""")
def l12_j09_new_only(spark, d):
    k = table(spark, d, "ksa_item").where(F.col("name").isNotNull() & F.col("afsc_code").isNotNull()).select(F.col("afsc_code").alias("doc_code"), "item_id", F.col("name").alias("line"))
    e = _checks(spark, d).where(F.col("text").isNotNull()).select(F.col("afsc").alias("doc_code"), "text")
    return P.new_only(k, e).select("item_id")


HINT_SQL = f"CASE WHEN k = 0 AND a = 0 THEN '{P.HINTS['none']}' WHEN k = 0 THEN '{P.HINTS['no_knowledge']}' WHEN a = 0 THEN '{P.HINTS['no_ability']}' WHEN k < 2 THEN '{P.HINTS['few_knowledge']}' WHEN a < 2 THEN '{P.HINTS['few_ability']}' ELSE '{P.HINTS['even']}' END"


@query(S.with_items(f"SELECT doc_code, {HINT_SQL} AS hint FROM (SELECT doc_code, count(*) FILTER (item_type = 'knowledge') AS k, count(*) FILTER (item_type = 'ability') AS a FROM items GROUP BY 1)"))
def l09_balance_hint(spark, d):
    n = lambda k: F.count_if(F.col("item_type") == k)
    return _items(spark, d).groupBy("doc_code").agg(P.balance_hint(n("knowledge"), n("ability")).alias("hint"))


MODELS = ("Mistral-7B", "zephyr-beta", " Meta-LLAMA-3", "phi-2")
_TEMPLATE_SQL = " ".join(f"WHEN {i} THEN '{b}' || trim(code) || '{a}'" for i, (b, a) in enumerate(P.TEMPLATES[m] for m in ("mistral", "zephyr", "llama"))).replace("\n", "' || chr(10) || '")


@query(f"SELECT code, CASE length(code) % 4 {_TEMPLATE_SQL} ELSE trim(code) END AS prompt FROM nodes_afsc")
def l08_chat_template(spark, d):
    """Prompts for a model of each family in turn."""
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.length("code") % 4 + 1).cast("int"))
    return table(spark, d, "nodes_afsc").select("code", P.chat_template(model, F.col("code")).alias("prompt"))


@query(S.with_items(f"""SELECT doc_code, 'Text:' || chr(10) || left({S.strip("coalesce(t.text, '')")}, 5000) || chr(10) || chr(10) || 'Known items:' || chr(10) || coalesce(e.l, '- (none)') || chr(10) || chr(10) || '{P.HINTS["even"]}' AS prompt
    FROM (SELECT code AS doc_code, arg_max(struct_pack(v := coalesce(clean_text, raw_text)), struct_pack(a := loaded_at, b := afsc_doc_id)).v AS text FROM afsc_doc GROUP BY 1) t
    LEFT JOIN (SELECT doc_code, string_agg('- [' || upper(left(item_type, 1)) || substr(item_type, 2) || '] ' || text, chr(10) ORDER BY ord) AS l FROM items GROUP BY 1) e USING (doc_code)"""))
def l10_prompts(spark, d):
    """Prompts of all documents with everything that is known of them."""
    text = table(spark, d, "afsc_doc").groupBy(F.col("code").alias("doc_code")).agg(F.max_by(F.coalesce("clean_text", "raw_text"), F.struct("loaded_at", "afsc_doc_id")).alias("text"))
    known = text.join(P.existing_block(_items(spark, d)), "doc_code", "left")
    return known.select("doc_code", P.prompt_of(F.coalesce("text", F.lit("")), F.col("existing"), F.lit(P.HINTS["even"])).alias("prompt"))


@query("SELECT afsc_doc_id, 'k_' || code || '_' || left(md5(left(raw_text, 500)), 8) AS key FROM afsc_doc WHERE raw_text IS NOT NULL AND code IS NOT NULL")
def l15_cache_key(spark, d):
    return table(spark, d, "afsc_doc").where(F.col("raw_text").isNotNull() & F.col("code").isNotNull()).select("afsc_doc_id", P.cache_key("k", F.col("code"), F.col("raw_text")).alias("key"))


_GOOD = _quality(False, False).rsplit("SELECT doc_code, ord", 1)[0].rstrip()
_KIND = "count(*) FILTER (item_type = '{}')"


@query(rf"""{_GOOD}, good AS (SELECT * FROM once WHERE k = 1),
    txt AS (SELECT code AS doc_code, arg_max(struct_pack(v := coalesce(clean_text, raw_text)), struct_pack(a := loaded_at, b := afsc_doc_id)).v AS text FROM afsc_doc GROUP BY 1),
    have AS (SELECT doc_code, string_agg('- [' || upper(left(item_type, 1)) || substr(item_type, 2) || '] ' || text, chr(10) ORDER BY ord) AS l, {_KIND.format('knowledge')} AS k, {_KIND.format('ability')} AS a FROM good GROUP BY 1),
    asked AS (SELECT doc_code, 'Text:' || chr(10) || left({S.strip("coalesce(t.text, '')")}, 5000) || chr(10) || chr(10) || 'Known items:' || chr(10) || coalesce(l, '- (none)') || chr(10) || chr(10) || coalesce({HINT_SQL}, '{P.HINTS["none"]}') AS p FROM txt t LEFT JOIN have USING (doc_code)),
    line AS (SELECT doc_code, unnest(string_split({stub_sql('p')}, chr(10))) AS name FROM asked), form AS (SELECT doc_code, name, {_form} AS f FROM line),
    e AS (SELECT DISTINCT doc_code, {_form.replace('name', 'text')} AS e FROM good)
    SELECT doc_code, CASE WHEN starts_with(name, '- K') THEN 'knowledge' ELSE 'ability' END AS item_type, substr(name, 3) AS text, 0.7::DOUBLE AS confidence, 'llm-openai' AS source FROM form
    WHERE length(name) - 2 <= 120 AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_code = form.doc_code AND e.e <> '' AND (contains(f, e.e) OR contains(e.e, f)))""")
def l01_l14_enhanced(spark, d):
    """Prompts of all documents with items, put to the stub, its replies read and held against what is there; heuristics where it gives none."""
    text = table(spark, d, "afsc_doc").groupBy(F.col("code").alias("doc_code")).agg(F.max_by(F.coalesce("clean_text", "raw_text"), F.struct("loaded_at", "afsc_doc_id")).alias("text"))
    return P.enhanced(text, I.quality_filter(_items(spark, d)), {"openai": P.stub}, "openai")


@query(S.with_items(r"""SELECT doc_code, trim(trim(l, ' -•*')) AS text, 'knowledge' AS item_type, 0.45::DOUBLE AS confidence, 'skill_inferred' AS source, 'Inferred from skills: ' || array_to_string(parents[1:2], ', ') AS evidence, array_to_string(parents, '|') AS parents
  FROM (SELECT doc_code, parents, unnest(['- Knowledge of ' || w[1] || ' ' || w[2], '- Ability to ' || w[3] || ' ' || w[4]]) AS l FROM
    (SELECT doc_code, parents, list_filter(regexp_split_to_array('skills: ' || lower(array_to_string(parents, ' - ')), '[\s\x{85}\p{Z}]+'), lambda x: regexp_full_match(x, '\p{L}+') AND length(x) > 3)[1:4] AS w FROM
      (SELECT doc_code, list(text ORDER BY k) AS parents FROM (SELECT *, row_number() OVER (PARTITION BY doc_code ORDER BY coalesce(confidence, 0) DESC, ord) AS k FROM items WHERE item_type = 'skill') WHERE k <= 5 GROUP BY 1)
     WHERE doc_code NOT IN (SELECT doc_code FROM items WHERE item_type = 'knowledge' GROUP BY 1 HAVING count(*) >= 2)) WHERE len(w) = 4)
  WHERE NOT contains(upper(array_to_string(parents, ' ')), 'NONE') AND length(trim(trim(l, ' -•*'))) > 5 AND length(trim(trim(l, ' -•*'))) < 100"""))
def x14_inferred_items(spark, d):
    """Knowledge inferred by the stub for documents with skills and fewer than two knowledge items."""
    i = _items(spark, d)
    got = P.inferred(i, i.where(F.col("item_type") == "knowledge"), {"openai": P.stub}, "openai")
    return got.withColumn("parents", F.array_join("parents", "|"))


@query(r"""SELECT candidate_id, t AS text FROM (SELECT candidate_id, trim(l, ' -•*') AS t FROM (SELECT candidate_id, unnest(string_split(text_norm, chr(10))) AS l FROM ksa_candidates_v0_raw)) WHERE length(t) > 5 AND length(t) < 100 AND NOT contains(t, 'NONE')""")
def x13_model_lines(spark, d):
    """Lines of a reply without their marks, of sound length, and none that says there is none."""
    c = table(spark, d, "ksa_candidates_v0_raw").select("candidate_id", F.explode(F.split("text_norm", "\n")).alias("l")).select("candidate_id", F.btrim("l", F.lit(" -•*")).alias("text"))
    return c.where((F.length("text") > 5) & (F.length("text") < 100) & ~F.col("text").contains("NONE"))


@query(f"""WITH {of_cleaned(MINED_SQL)}, m AS (SELECT afsc_doc_id, string_agg(text, chr(10) ORDER BY ord) AS mined, arg_min(source, ord) AS source FROM mined GROUP BY 1),
    r AS (SELECT afsc_doc_id, {stub_sql('text')} AS reply FROM docs)
    SELECT afsc_doc_id, 'x_' || coalesce(code, '') || '_' || md5(raw_text) AS key, coalesce(reply, mined) AS reply, CASE WHEN reply IS NULL THEN source ELSE 'provider' END AS source FROM afsc_doc JOIN r USING (afsc_doc_id) JOIN m USING (afsc_doc_id) WHERE raw_text IS NOT NULL""")
def x06_s12_provider_with_cache(spark, d):
    """Every document's whole cleaned text put to a provider, whose replies go to a cache that the second call finds full.

    The key is of the whole text, so that no document gets the reply to another that only begins as it does. Where the
    provider gives none, items mined from the text stand in; these aren't kept in the cache.
    """
    key = F.concat_ws("_", F.lit("x"), F.coalesce("code", F.lit("")), F.md5("raw_text"))
    docs = table(spark, d, "afsc_doc").where(F.col("raw_text").isNotNull()).select("afsc_doc_id", key.alias("key"), clean_text("raw_text").alias("prompt"))
    empty = spark.createDataFrame([], "key string, reply string")
    ask = lambda df: P.asked(df, "prompt", {"openai": P.stub}, "openai")
    _, cache = P.with_cache(docs, empty, "key", ask)
    replies, _ = P.with_cache(docs, cache, "key", ask)
    return P.or_mined(replies, "prompt").select("afsc_doc_id", "key", "reply", "source")


EXTRACTED_SQL = r"""docs AS (SELECT afsc_doc_id, coalesce(raw_text, '') AS t FROM afsc_doc WHERE length(coalesce(raw_text, '')) % 3 <> 0 AND trim(left(coalesce(raw_text, ''), 40), ' ') <> '')"""


def _extractor(texts: list[str]) -> list[list[dict[str, str]] | None]:
    """A stand-in for an external extractor: two rows a text under different column names, nothing for every third."""
    return [[{"Taxonomy Skill": "", "Description": t[:40], "score": "0", "confidence": "0.8", "Skill Tag": "nan"}, {"Raw Skill": t[:9].upper(), "Correlation Coefficient": "high", "ESCO ID": f"E{len(t)}"}] if len(t) % 3 else None for t in texts]


@query(f"""WITH {EXTRACTED_SQL} SELECT afsc_doc_id, 0 AS ord, trim(left(t, 40), ' ') AS text, 0.8::DOUBLE AS confidence, NULL AS esco_id FROM docs
    UNION ALL SELECT afsc_doc_id, 1, trim(upper(left(t, 9)), ' '), 0.5, 'E' || length(t) FROM docs WHERE trim(left(t, 9), ' ') <> ''""")
def x06_x07_extracted(spark, d):
    """Rows of an extractor read by whatever columns it has; documents it fails on are mined, which x03_x04 shows."""
    docs = table(spark, d, "afsc_doc").select("afsc_doc_id", "raw_text")
    return P.extracted(docs, "afsc_doc_id", "raw_text", _extractor).where(F.col("source") == "extractor").select("afsc_doc_id", "ord", "text", "confidence", "esco_id")


# vectors


def _embed(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: length and two letter counts."""
    return [[float(len(t)), float(t.count("a")), float(t.count("e"))] for t in texts]


@query("""SELECT validation_id, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, CASE WHEN x = 0 THEN 1.0 ELSE sqrt(x * x + y * y + z * z) END AS n FROM
    (SELECT validation_id, length(t)::DOUBLE AS x, (length(t) - length(replace(t, 'a', '')))::DOUBLE AS y, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS z FROM
      (SELECT validation_id, CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE 'passage: ' || text END AS t FROM laiser_similarity_validation)))""")
def v01_embedded(spark, d):
    v = P.embedded(_checks(spark, d).select("validation_id", "text"), "text", _embed)
    return v.select("validation_id", *[F.col("vector")[i].alias(c) for i, c in enumerate("xyz")])


@query("SELECT source, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(esco_id, '')) <> '' THEN 'mapped' ELSE 'open' END AS source FROM ksa_item) GROUP BY 1")
def v04_bars(spark, d):
    """The frame behind a bar chart: rows by whether an entry is known."""
    return table(spark, d, "ksa_item").groupBy(F.when(I.has_id("esco_id"), "mapped").otherwise("open").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings")
def v04_points(spark, d):
    """The frame behind a scatter plot: points by group."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 2 OFFSET 1")
def s14_rows_between(spark, d):
    """The second and third row of a table in order."""
    return readers.rows_between(table(spark, d, "events").select("event_id"), [F.col("event_id")], 1, 3)


@query("SELECT item_id, name AS text, coalesce(type, '') AS kind, '' AS section FROM ksa_item")
def r02_r03_shaped(spark, d):
    """A table by the names that are wanted, missing ones empty."""
    df = table(spark, d, "ksa_item").select("item_id", "name", F.coalesce("type", F.lit("")).alias("type"))
    df = readers.first_existing(readers.first_existing(df, ["text", "name"], "text"), ["kind", "type"], "kind")
    return readers.with_missing(df, ["kind", "section"])


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), c AS (SELECT label, list(s ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS s FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY 1, 2) GROUP BY 1)
    SELECT vec_id, list_cosine_similarity(v, m) AS cos FROM e JOIN c USING (label)""")
def v02_cosine(spark, d):
    """Each vector against the mean of its label."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m"))
    return e.join(mean.select("label", F.col("m.x").alias("m")), "label").select("vec_id", A.cosine(F.col("embedding"), F.col("m")).alias("cos"))


@query()
def v03_projection(spark, d):
    """Two principal components, their largest loadings positive."""
    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(e)
    sign = [1.0 if max(column, key=abs) > 0 else -1.0 for column in model.pc.toArray().T.tolist()]
    p = model.transform(e).select("vec_id", vector_to_array("p").alias("p"))
    return p.select("vec_id", (F.col("p")[0] * sign[0]).alias("x"), (F.col("p")[1] * sign[1]).alias("y"))
