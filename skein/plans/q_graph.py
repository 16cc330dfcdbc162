"""Queries over the graph: upserts, counters, constraints, lookups, deletes, exports, sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import strip
from skein.operators import graph as G
from skein.operators import items as I
from skein.plans import pipeline
from skein.plans import sql as S
from skein.plans.q_items import PIPELINE_SQL
from skein.sources import readers, sinks
from skein.session import shared_folder
from skein.sources.tables import table

QUERIES = {}
SQL: dict[str, str] = {}
NOW = 1_700_000_000_000
LATER = NOW + 1000
#: Codes that the lookups and deletes are shown with.
CHOSEN = ("1N0X1", "1Z7X2-5GQSF", "4F0X1-TNFVR")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _items(spark: SparkSession, d: str) -> DataFrame:
    return I.items_of(table(spark, d, "rels_requires"))


def _graph(spark: SparkSession, d: str) -> G.Graph:
    """The graph after the items sent in two batches, those of an even id first."""
    i = _items(spark, d)
    g = G.upsert(G.empty_graph(spark), i.where(F.col("ord") % 2 == 0), NOW)
    return G.upsert(g, i.where(F.col("ord") % 2 == 1), LATER)


def _codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CHOSEN], "doc_code string")


SIG = "left(md5(text), 16)"
TIMES = f"CASE WHEN count(*) FILTER (ord % 2 = 0) > 0 THEN {NOW} ELSE {LATER} END"
SEEN = f"CASE WHEN count(*) FILTER (ord % 2 = 1) > 0 THEN {LATER} ELSE {NOW} END"


def _first(v: str) -> str:
    """The first row's value of the batch that made the key."""
    return f"(CASE WHEN count(*) FILTER (ord % 2 = 0) > 0 THEN arg_min(struct_pack(v := {v}), ord) FILTER (ord % 2 = 0) ELSE arg_min(struct_pack(v := {v}), ord) END).v"


def _last(v: str) -> str:
    """The last row's value of the last batch that has one which isn't null."""
    a = f"(arg_max(struct_pack(v := {v}), ord) FILTER (ord % 2 = 1)).v"
    b = f"(arg_max(struct_pack(v := {v}), ord) FILTER (ord % 2 = 0)).v"
    return f"coalesce({a}, {b})"


@query(S.with_items(f"SELECT doc_code, doc_code || ' Specialty' AS title, 'Unknown' AS family, {TIMES} AS created_at, {SEEN} AS updated_at FROM items GROUP BY 1"))
def g02_codes(spark, d):
    return _graph(spark, d).code


@query(S.with_items(f"SELECT 'AFOCD_' || doc_code || '_2024' AS source_title, '2024-01-15' AS doc_date, {TIMES} AS created_at FROM items GROUP BY doc_code"))
def g03_sources(spark, d):
    return _graph(spark, d).source


@query(S.with_items(f"SELECT {SIG} AS content_sig, {_last('text')} AS text, {_last('item_type')} AS item_type, {_last('source')} AS source, {_last('confidence')} AS confidence, {TIMES} AS first_seen, {SEEN} AS last_seen FROM items GROUP BY 1"))
def g01_g04_statements(spark, d):
    return _graph(spark, d).statement


@query(S.with_items(f"SELECT doc_code, {SIG} AS content_sig, {_first('confidence')} AS confidence, {_first('item_type')} AS item_type, {TIMES} AS first_seen, {SEEN} AS last_seen FROM items GROUP BY 1, 2"))
def g05_requires(spark, d):
    return _graph(spark, d).requires


@query(S.with_items(f"SELECT {SIG} AS content_sig, 'AFOCD_' || doc_code || '_2024' AS source_title, left({_first('text')}, 100) || '...' AS evidence, 'TBD' AS section, {TIMES} AS created_at FROM items GROUP BY 1, doc_code"))
def g06_extracted_from(spark, d):
    return _graph(spark, d).extracted_from


@query(S.with_items(f"SELECT esco_id, {_first('text')} AS label, {TIMES} AS created_at FROM items WHERE trim(coalesce(esco_id, '')) <> '' GROUP BY 1"))
def g07_entries(spark, d):
    return _graph(spark, d).entry


@query(S.with_items(f"SELECT {SIG} AS content_sig, esco_id, {_first('confidence')} AS score, {TIMES} AS created_at FROM items WHERE trim(coalesce(esco_id, '')) <> '' GROUP BY 1, 2"))
def g07_aligned(spark, d):
    return _graph(spark, d).aligns_to


_N = "(SELECT count(DISTINCT doc_code) FROM {i}) * 2 + (SELECT count(DISTINCT text) FROM {i}) + (SELECT count(DISTINCT esco_id) FROM {i} WHERE trim(coalesce(esco_id, '')) <> '')"
_E = "(SELECT count(*) FROM (SELECT DISTINCT doc_code, text FROM {i})) * 2 + (SELECT count(*) FROM (SELECT DISTINCT text, esco_id FROM {i} WHERE trim(coalesce(esco_id, '')) <> ''))"


_P = """5 * (SELECT count(DISTINCT doc_code) FROM odd) - 4 * (SELECT count(DISTINCT doc_code) FROM odd WHERE doc_code IN (SELECT doc_code FROM even))
    + 3 * (SELECT count(DISTINCT doc_code) FROM odd WHERE doc_code NOT IN (SELECT doc_code FROM even)) + 6 * (SELECT count(DISTINCT text) FROM odd WHERE text NOT IN (SELECT text FROM even)) + 6 * (SELECT count(*) FROM odd)
    + 6 * (SELECT count(*) FROM (SELECT DISTINCT doc_code, text FROM odd EXCEPT SELECT doc_code, text FROM even))
    + 3 * (SELECT count(*) FROM (SELECT DISTINCT esco_id FROM odd WHERE trim(coalesce(esco_id, '')) <> '' EXCEPT SELECT esco_id FROM even))
    + 2 * (SELECT count(*) FROM (SELECT DISTINCT text, esco_id FROM odd WHERE trim(coalesce(esco_id, '')) <> '' EXCEPT SELECT text, esco_id FROM even))"""


@query(S.with_items(f"SELECT {_N.format(i='items')} - ({_N.format(i='even')}) AS nodes_created, {_E.format(i='items')} - ({_E.format(i='even')}) AS relationships_created, {_P} AS properties_set", "even AS (SELECT * FROM items WHERE ord % 2 = 0), odd AS (SELECT * FROM items WHERE ord % 2 = 1)"))
def g08_counters(spark, d):
    i = _items(spark, d)
    return G.upsert_counters(G.upsert(G.empty_graph(spark), i.where(F.col("ord") % 2 == 0), NOW), i.where(F.col("ord") % 2 == 1))


@query(S.with_items(f"SELECT doc_code, {SIG} AS content_sig, {_first('confidence')} AS confidence, {_first('item_type')} AS item_type, {TIMES} AS first_seen, {SEEN} AS last_seen FROM items GROUP BY 1, 2"))
def k06_stored_requires(spark, d):
    """The graph stored after each of two batches, read back for the next, and read once more."""
    path, i = _folder(spark), _items(spark, d)
    for version, (odd, now) in enumerate(((0, NOW), (1, LATER))):
        G.store(G.upsert(G.stored(spark, path, version), i.where(F.col("ord") % 2 == odd), now), path, version + 1)
    return G.stored(spark, path, 2).requires


@query("SELECT 'item_name' AS constraint_name, item_name AS key, count(*) AS n FROM rels_requires WHERE item_name IS NOT NULL GROUP BY item_name HAVING count(*) > 1")
def g09_g10_violations(spark, d):
    return G.violations(table(spark, d, "rels_requires").where(F.col("item_name").isNotNull()), ["item_name"], "item_name")


@query(S.with_items("""SELECT 'code' AS constraint_name, doc_code AS key, n FROM (SELECT doc_code, count(*) AS n FROM items GROUP BY 1) WHERE false"""))
def g09_constraints(spark, d):
    """The four keys of the graph's nodes, checked on the graph as it is: upserts leave each key once."""
    g = _graph(spark, d)
    return reduce(DataFrame.unionByName, [G.violations(getattr(g, t), G.KEYS[t], t) for t in G.NODES])


_IN = ", ".join(f"'{c}'" for c in CHOSEN)


@query(S.with_items(f"SELECT DISTINCT doc_code, {SIG} AS content_sig FROM items WHERE doc_code NOT IN ({_IN})"))
def g11_j11_requires_left(spark, d):
    return G.delete_codes(_graph(spark, d), _codes(spark)).requires.select("doc_code", "content_sig")


@query(S.with_items(f"""SELECT count(DISTINCT doc_code) FILTER (doc_code IN ({_IN})) AS codes_deleted,
    (SELECT count(DISTINCT text) FROM items WHERE doc_code IN ({_IN}) AND text NOT IN (SELECT text FROM items WHERE doc_code NOT IN ({_IN}))) AS statements_deleted FROM items"""))
def g11_delete_counts(spark, d):
    return G.delete_counts(_graph(spark, d), _codes(spark))


@query(S.with_items(f"SELECT DISTINCT {SIG} AS content_sig FROM items WHERE doc_code IN ({_IN}) AND text NOT IN (SELECT text FROM items WHERE doc_code NOT IN ({_IN}))"))
def j10_orphans(spark, d):
    g = _graph(spark, d)
    return g.statement.join(G.delete_codes(g, _codes(spark)).statement, "content_sig", "left_anti").select("content_sig")


@query("SELECT afsc_doc_id, unnest(list_filter(regexp_split_to_array(upper(coalesce(code, '') || ', ' || coalesce(category, '')), '[,\\s]+'), lambda x: x <> '')) AS code FROM afsc_doc")
def j13_parsed_codes(spark, d):
    typed = F.concat(F.coalesce("code", F.lit("")), F.lit(", "), F.coalesce("category", F.lit("")))
    return table(spark, d, "afsc_doc").select("afsc_doc_id", F.explode(G.parsed_codes(typed)).alias("code"))


STATE = f"""st AS (SELECT {SIG} AS sig, {_last('text')} AS text, {_last('item_type')} AS item_type, {_last('confidence')} AS confidence FROM items GROUP BY 1),
  rq AS (SELECT DISTINCT doc_code, {SIG} AS sig FROM items), al AS (SELECT DISTINCT {SIG} AS sig, esco_id FROM items WHERE trim(coalesce(esco_id, '')) <> '')"""


@query(S.with_items(f"SELECT doc_code, text, item_type, coalesce(confidence, 0) AS confidence, coalesce(esco_id, '') AS esco_id FROM rq JOIN st USING (sig) LEFT JOIN al USING (sig) WHERE doc_code IN ({_IN})", STATE))
def j03_items_of_code(spark, d):
    return G.items_of_code(_graph(spark, d), _codes(spark))


@query(S.with_items(f"""SELECT text, esco_id, CAST(len(c) AS INTEGER) AS n_codes, array_to_string(list_sort(c), ', ') AS codes FROM
    (SELECT text, coalesce(esco_id, '') AS esco_id, list(DISTINCT doc_code) AS c FROM rq JOIN st USING (sig) LEFT JOIN al USING (sig) GROUP BY 1, 2) WHERE len(c) >= 2""", STATE))
def j04_a02_overlap(spark, d):
    g = _graph(spark, d)
    return G.overlap(g, g.code.select("doc_code"))


@query(S.with_items("""SELECT count(DISTINCT doc_code) AS codes, count(DISTINCT text) AS statements, count(DISTINCT CASE WHEN item_type = 'skill' THEN text END) AS skills,
    count(DISTINCT CASE WHEN item_type = 'knowledge' THEN text END) AS knowledge FROM items"""))
def j05_a01_totals(spark, d):
    i = _items(spark, d)
    kind = lambda k: F.count_distinct(F.when(F.col("item_type") == k, F.col("text")))
    return i.agg(F.count_distinct("doc_code").alias("codes"), F.count_distinct("text").alias("statements"), kind("skill").alias("skills"), kind("knowledge").alias("knowledge"))


@query("SELECT code, coalesce(name, '') AS title FROM nodes_afsc")
def j06_code_list(spark, d):
    return table(spark, d, "nodes_afsc").select("code", F.coalesce("name", F.lit("")).alias("title"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes_afsc").select(F.upper(strip("code")).alias("doc_code"), "name")


SLUG = "item_type || '_' || left(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), 50)"


@query(S.with_items(f"""SELECT DISTINCT doc_code AS id, 'AFSC' AS type, coalesce(name, '') AS label FROM items LEFT JOIN nodes_afsc n ON upper(trim(n.code)) = doc_code
    UNION ALL SELECT {SLUG}, upper((arg_min(struct_pack(v := item_type), ord)).v), arg_min(text, ord) FROM items GROUP BY {SLUG}"""))
def g12_export_nodes(spark, d):
    return G.export_shared(_items(spark, d), _names(spark, d))[0]


@query(S.with_items(f"SELECT doc_code AS src, {SLUG} AS dst, 'REQUIRES_' || upper(item_type) AS relationship, confidence, left(coalesce(evidence, ''), 200) AS evidence FROM items"))
def g12_export_edges(spark, d):
    return G.export_shared(_items(spark, d), _names(spark, d))[1]


OWN = "item_type || '_' || left(md5(doc_code || '_' || text), 12)"
_OWN_FIRST = "(arg_min(struct_pack(v := {}), ord)).v"


@query(S.with_items(f"""SELECT DISTINCT doc_code AS id, 'AFSC' AS type, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS source_method, CAST(NULL AS VARCHAR) AS tag, coalesce(name, '') AS title
    FROM items LEFT JOIN nodes_afsc n ON upper(trim(n.code)) = doc_code
    UNION ALL SELECT {OWN}, upper(min(item_type)), min(text), {_OWN_FIRST.format('confidence')}, {_OWN_FIRST.format('source')}, coalesce({_OWN_FIRST.format('esco_id')}, ''), NULL FROM items GROUP BY {OWN}"""))
def g13_own_nodes(spark, d):
    return G.export_own(_items(spark, d), _names(spark, d))[0]


@query(S.with_items(f"SELECT doc_code AS src, {OWN} AS dst, 'REQUIRES_' || upper(item_type) AS relationship, source AS source_method, coalesce(esco_id, '') AS tag, confidence, left(coalesce(evidence, ''), 200) AS evidence FROM items"))
def g13_own_edges(spark, d):
    return G.export_own(_items(spark, d))[1]


@query(S.with_items(f"""SELECT count(DISTINCT doc_code) + count(DISTINCT {OWN}) AS total_nodes, count(*) AS total_edges, count(DISTINCT doc_code) AS codes, count(DISTINCT {OWN}) FILTER (item_type = 'knowledge') AS knowledge,
    count(DISTINCT {OWN}) FILTER (item_type = 'skill') AS skills, count(DISTINCT {OWN}) FILTER (item_type = 'ability') AS abilities FROM items"""))
def g13_a16_metadata(spark, d):
    return G.export_own(_items(spark, d))[2]


# sources and sinks: written to a folder that all executors share and read back


def _folder(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints."""
    return f"{shared_folder(spark)}/skein-{uuid.uuid4()}"


@query("SELECT candidate_id, text_norm, evidence FROM ksa_candidates_v0_raw")
def k01_s05_csv(spark, d):
    """Cells with line breaks, quotes and nulls through CSV and back; null is told from empty by a mark."""
    path = _folder(spark)
    df = table(spark, d, "ksa_candidates_v0_raw").select("candidate_id", "text_norm", "evidence")
    marked = df.select("candidate_id", *[F.coalesce(F.concat(F.lit("="), c), F.lit("-")).alias(c) for c in ("text_norm", "evidence")])
    sinks.csv(marked, path)
    back = readers.csv(spark, path, "candidate_id long, text_norm string, evidence string")
    return back.select("candidate_id", *[F.when(F.col(c) != "-", F.substring(c, 2, 1 << 30)).alias(c) for c in ("text_norm", "evidence")])


@query("SELECT afsc_doc_id, title, page_start FROM afsc_doc")
def k02_s03_json_lines(spark, d):
    path = _folder(spark)
    sinks.json_lines(table(spark, d, "afsc_doc").select("afsc_doc_id", "title", "page_start"), path)
    return readers.json_lines(spark, path, "afsc_doc_id long, title string, page_start int")


@query("SELECT upper(code) AS code, count(*) AS n_lines FROM (SELECT code, unnest(string_split(coalesce(name, ''), chr(10))) FROM nodes_afsc) GROUP BY 1")
def k03_s01_sections(spark, d):
    """The name of each code in a file of its own, read as text files."""
    path = _folder(spark)
    sinks.sections(table(spark, d, "nodes_afsc").select("code", F.coalesce("name", F.lit("")).alias("text")), path)
    back = spark.read.text(path)
    return back.select(F.upper(F.col("code").cast("string")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_lines"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN raw_text IS NULL THEN 'failed' ELSE 'ok' END AS status FROM afsc_doc) GROUP BY 1")
def k04_audit_log(spark, d):
    path = _folder(spark)
    doc = table(spark, d, "afsc_doc")
    sinks.audit(doc.select(F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("code").alias("afsc"), F.lit("bulk").alias("mode"), F.when(F.col("raw_text").isNull(), "failed").otherwise("ok").alias("status"), F.create_map(F.lit("chars"), F.length("raw_text")).alias("metrics"), F.lit(None).cast("string").alias("error")), path)
    back = spark.read.schema("timestamp string, afsc string, mode string, status string, metrics map<string,long>, error string").json(path)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def k07_vectors(spark, d):
    path = _folder(spark)
    table(spark, d, "embeddings").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def _bulk(spark: SparkSession, d: str) -> str:
    sims = ("sim_skill_evidence", "sim_skill_esco")
    rels = table(spark, d, "rels_requires").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in sims})
    path = _folder(spark)
    sinks.bulk_import(I.items_of(rels, *sims), table(spark, d, "nodes_afsc"), path)
    return path


@query(S.with_items("""SELECT doc_code AS afsc_code, text AS item_name, i.item_type, coalesce(i.evidence, '') AS evidence, coalesce(i.esco_id, '') AS esco_id, i.confidence, CASE WHEN NOT isnan(sim_skill_evidence) THEN sim_skill_evidence END AS sim_skill_evidence,
    CASE WHEN NOT isnan(sim_skill_esco) THEN sim_skill_esco END AS sim_skill_esco FROM items i JOIN rels_requires r ON r.rel_id = i.ord"""))
def k08_bulk_rels(spark, d):
    """All eight columns of the relationships, written and read back; null and empty are one in CSV."""
    schema = "afsc_code string, item_name string, item_type string, evidence string, esco_id string, confidence double, sim_skill_evidence double, sim_skill_esco double"
    back = readers.csv(spark, f"{_bulk(spark, d)}/rels_requires", schema)
    return back.withColumns({c: F.coalesce(c, F.lit("")) for c in ("evidence", "esco_id")})


@query(S.with_items("SELECT text AS name, item_type AS type, arg_min(source, ord) AS source, coalesce((arg_min(struct_pack(v := esco_id), ord) FILTER (trim(coalesce(esco_id, '')) <> '')).v, '') AS esco_id FROM items GROUP BY 1, 2"))
def k08_bulk_items(spark, d):
    """Item nodes of the bulk import: of equal ones the first source and the first id that is set."""
    back = readers.csv(spark, f"{_bulk(spark, d)}/nodes_item", "name string, type string, source string, esco_id string")
    return back.withColumn("esco_id", F.coalesce("esco_id", F.lit("")))


@query("SELECT trim(code) AS afsc, coalesce(nullif(raw_text, ''), '{}') AS text, '' AS reason FROM afsc_doc WHERE trim(coalesce(code, '')) <> '' UNION ALL SELECT NULL, NULL, 'missing afsc' FROM afsc_doc WHERE trim(coalesce(code, '')) = ''")
def s04_bulk_lines(spark, d):
    path = _folder(spark)
    table(spark, d, "afsc_doc").select(F.to_json(F.struct(F.col("code").alias("afsc"), F.col("raw_text").alias("md"))).alias("value")).write.text(path)
    good, bad = readers.bulk_lines(spark, path)
    none = F.lit(None).cast("string")
    return good.select("afsc", "text", F.lit("").alias("reason")).unionByName(bad.select(none.alias("afsc"), none.alias("text"), "reason"))


@query("SELECT trim(esco_id) AS esco_id, trim(label) AS label, CAST(least(8, len(list_filter(list_transform(string_split(coalesce(alt_labels, ''), ';'), lambda x: trim(x)), lambda x: x <> ''))) AS INTEGER) AS n_alts FROM esco_catalog")
def s06_taxonomy(spark, d):
    path = _folder(spark)
    sinks.csv(table(spark, d, "esco_catalog").toDF("ESCO_ID", "Label", "Alt_Labels"), path)
    return readers.taxonomy(spark, path).select("esco_id", "label", F.size("alts").alias("n_alts"))


@query("SELECT page, text, count(*) AS n FROM (SELECT generate_subscripts(p, 1) AS page, unnest(p) AS text FROM (SELECT string_split(raw_text, chr(12)) AS p FROM afsc_doc WHERE raw_text IS NOT NULL)) GROUP BY 1, 2")
def s07_pages(spark, d):
    """Texts as binary files with form feeds between pages, one file a text, by a plain-text parser: pages with their numbers."""
    path = _folder(spark)
    docs = table(spark, d, "afsc_doc").where(F.col("raw_text").isNotNull())
    docs.select(F.col("afsc_doc_id").alias("id"), F.to_json(F.struct("raw_text")).alias("value")).write.partitionBy("id").text(path)

    def parser(content: bytes) -> list[str]:
        import json

        return json.loads(content)["raw_text"].split("\f")

    return readers.pages(spark, f"{path}/*/*.txt", parser).groupBy(F.col("page"), "text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT replace(raw_text, chr(12), chr(10) || chr(10)) AS text, count(*) AS n FROM afsc_doc WHERE raw_text IS NOT NULL GROUP BY 1")
def s08_page_texts(spark, d):
    """The same files, the pages of each joined again."""
    path = _folder(spark)
    docs = table(spark, d, "afsc_doc").where(F.col("raw_text").isNotNull())
    docs.select(F.col("afsc_doc_id").alias("id"), F.to_json(F.struct("raw_text")).alias("value")).write.partitionBy("id").text(path)

    def parser(content: bytes) -> list[str]:
        import json

        return json.loads(content)["raw_text"].split("\f")

    return readers.page_texts(readers.pages(spark, f"{path}/*/*.txt", parser)).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _graph_json(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An export written as one graph a code, read back by the reader."""
    path = _folder(spark)
    nodes, edges = G.export_shared(_items(spark, d), _names(spark, d))
    one = edges.select("src", F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relationship", F.create_map(F.lit("evidence"), F.col("evidence")).alias("properties")).alias("e"))
    per = one.groupBy("src").agg(F.collect_list("e").alias("edges"))
    node = F.struct("id", "type", F.create_map(F.lit("label"), F.col("label")).alias("properties"))
    graph = nodes.select("id", F.array(node).alias("nodes")).join(per.withColumnRenamed("src", "id"), "id", "left").select("nodes", F.coalesce("edges", F.expr("cast(array() as array<struct<source:string,target:string,relationship:string,properties:map<string,string>>>)")).alias("edges"))
    sinks.documents(graph, path)
    return readers.graph_json(spark, path, lines=True)


@query(S.with_items(f"""SELECT DISTINCT doc_code AS id, 'AFSC' AS type, coalesce(name, '') AS label FROM items LEFT JOIN nodes_afsc n ON upper(trim(n.code)) = doc_code
    UNION ALL SELECT {SLUG}, upper((arg_min(struct_pack(v := item_type), ord)).v), arg_min(text, ord) FROM items GROUP BY {SLUG}"""))
def s11_k02_graph_nodes(spark, d):
    return _graph_json(spark, d)[0].select("id", "type", F.col("properties")["label"].alias("label"))


@query(S.with_items(f"SELECT doc_code AS source, {SLUG} AS target, 'REQUIRES_' || upper(item_type) AS relationship, left(coalesce(evidence, ''), 200) AS evidence FROM items"))
def s11_k02_graph_edges(spark, d):
    return _graph_json(spark, d)[1].select("source", "target", "relationship", F.col("properties")["evidence"].alias("evidence"))


@query("SELECT coalesce(afsc_code, '') AS key, min(item_name) AS reply FROM rels_requires WHERE item_name IS NOT NULL GROUP BY 1")
def k09_cache(spark, d):
    """Replies written through a cache table in two rounds, the second for keys the first lacks."""
    path = _folder(spark)
    rows = table(spark, d, "rels_requires").where(F.col("item_name").isNotNull()).select(F.coalesce("afsc_code", F.lit("")).alias("key"), F.col("item_name").alias("reply"))
    sinks.cache(rows.where(F.length("key") % 2 == 0), path, "key")
    sinks.cache(rows.join(spark.read.parquet(path).select("key"), "key", "left_anti"), path, "key")
    return spark.read.parquet(path).select("key", "reply")


@query(PIPELINE_SQL)
def pipeline_documents(spark, d):
    """The whole run over all documents: a summary row each."""
    docs = table(spark, d, "afsc_doc").select(F.concat_ws("-", "code", F.col("afsc_doc_id").cast("string")).alias("doc_code"), "raw_text")
    return pipeline.run(docs, pipeline.Config(enhance=True))[1]
