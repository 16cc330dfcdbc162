"""A property graph as node and edge tables: upserts, queries, deletes, exports.

Upserts are full outer joins on the key between what is stored and one collapsed batch, so the same batch twice changes
nothing but the times; ``now_ms`` is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import md5_left, slug
from skein.operators.items import has_id

# What is not said in the items themselves.
TITLE, FAMILY, DOC_DATE, SECTION = " Specialty", "Unknown", "2024-01-15", "TBD"


@dataclass(frozen=True)
class Graph:
    """Node tables code, statement, source, entry; edge tables requires, extracted_from, aligns_to."""

    code: DataFrame
    statement: DataFrame
    source: DataFrame
    entry: DataFrame
    requires: DataFrame
    extracted_from: DataFrame
    aligns_to: DataFrame


def source_title() -> Column:
    """Fixed form of a source document's title."""
    return F.concat(F.lit("AFOCD_"), "doc_code", F.lit("_2024"))


def signature(text: Column) -> Column:
    """Key of a statement; its type is no part of it."""
    return md5_left(text, 16)


def batch_statements(items: DataFrame) -> DataFrame:
    """One row a signature; the last item of the batch wins."""
    return items.groupBy(signature(F.col("text")).alias("content_sig")).agg(F.max_by(F.struct("text", "item_type", "source", "confidence"), "ord").alias("b")).select("content_sig", "b.*")


def batch_requires(items: DataFrame) -> DataFrame:
    """One row a code and signature; the first item of the batch wins."""
    return items.groupBy("doc_code", signature(F.col("text")).alias("content_sig")).agg(F.min_by(F.struct("confidence", "item_type"), "ord").alias("b")).select("doc_code", "content_sig", "b.*")


def batch_evidence(items: DataFrame) -> DataFrame:
    """One row a signature and source document, with the start of the text as evidence; first wins."""
    keyed = items.select(signature(F.col("text")).alias("content_sig"), source_title().alias("source_title"), "text", "ord")
    return keyed.groupBy("content_sig", "source_title").agg(F.min_by("text", "ord").alias("t")).select("content_sig", "source_title", F.concat(F.left("t", F.lit(100)), F.lit("...")).alias("evidence"), F.lit(SECTION).alias("section"))


def batch_entries(items: DataFrame) -> DataFrame:
    """One row for each id that isn't blank, labelled by the first text."""
    return items.where(has_id("esco_id")).groupBy("esco_id").agg(F.min_by("text", "ord").alias("label"))


def batch_aligned(items: DataFrame) -> DataFrame:
    """One row a signature and id, scored by the first confidence."""
    return items.where(has_id("esco_id")).groupBy(signature(F.col("text")).alias("content_sig"), "esco_id").agg(F.min_by("confidence", "ord").alias("score"))


def merge(old: DataFrame, new: DataFrame, keys: list[str], on_create: dict[str, Column], always: list[str], stamp: str | None, now_ms: int, created: str) -> DataFrame:
    """``old`` with the rows of ``new``: what ``on_create`` gives is kept once set, ``always`` takes new values that aren't null.

    ``created`` is set when a row is made, ``stamp`` whenever it is met. The row count that is new is where ``created`` is now.
    """
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in always], *[v.alias(f"_n_{k}") for k, v in on_create.items()], F.lit(True).alias("_met"))
    o = old.withColumn("_was", F.lit(True))
    j = o.join(n, keys, "full_outer")
    was = F.coalesce("_was", F.lit(False))
    cols = [F.col(k) for k in keys]
    cols += [F.coalesce(f"_n_{c}", F.col(c)).alias(c) for c in always]
    cols += [F.when(was, F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c) for c in on_create]
    cols.append(F.when(was, F.col(created)).otherwise(F.lit(now_ms).cast("long")).alias(created))
    if stamp:
        cols.append(F.when(F.col("_met"), F.lit(now_ms).cast("long")).otherwise(F.col(stamp)).alias(stamp))
    return j.select(*cols)


SCHEMAS = {
    "code": "doc_code string, title string, family string, created_at long, updated_at long",
    "statement": "content_sig string, text string, item_type string, source string, confidence double, first_seen long, last_seen long",
    "source": "source_title string, doc_date string, created_at long",
    "entry": "esco_id string, label string, created_at long",
    "requires": "doc_code string, content_sig string, confidence double, item_type string, first_seen long, last_seen long",
    "extracted_from": "content_sig string, source_title string, evidence string, section string, created_at long",
    "aligns_to": "content_sig string, esco_id string, score double, created_at long",
}


def empty_graph(spark) -> Graph:
    return Graph(**{k: spark.createDataFrame([], v) for k, v in SCHEMAS.items()})


def upsert(g: Graph, items: DataFrame, now_ms: int) -> Graph:
    """The graph after one batch of items: doc_code, ord, text, item_type, confidence, source, esco_id."""
    codes = items.select("doc_code").distinct()
    title = F.concat("doc_code", F.lit(TITLE))
    ev, st, rq = batch_evidence(items), batch_statements(items), batch_requires(items)
    en, al = batch_entries(items), batch_aligned(items)
    return Graph(
        code=merge(g.code, codes, ["doc_code"], {"title": title, "family": F.lit(FAMILY)}, [], "updated_at", now_ms, "created_at"),
        statement=merge(g.statement, st, ["content_sig"], {}, ["text", "item_type", "source", "confidence"], "last_seen", now_ms, "first_seen"),
        source=merge(g.source, codes.select(source_title().alias("source_title")), ["source_title"], {"doc_date": F.lit(DOC_DATE)}, [], None, now_ms, "created_at"),
        entry=merge(g.entry, en, ["esco_id"], {"label": F.col("label")}, [], None, now_ms, "created_at"),
        requires=merge(g.requires, rq, ["doc_code", "content_sig"], {"confidence": F.col("confidence"), "item_type": F.col("item_type")}, [], "last_seen", now_ms, "first_seen"),
        extracted_from=merge(g.extracted_from, ev, ["content_sig", "source_title"], {"evidence": F.col("evidence"), "section": F.col("section")}, [], None, now_ms, "created_at"),
        aligns_to=merge(g.aligns_to, al, ["content_sig", "esco_id"], {"score": F.col("score")}, [], None, now_ms, "created_at"),
    )


#: Properties that are set on a row's creation (its key among them), and whenever an item meets it.
SETS = {"code": (4, 1), "statement": (6, 5), "source": (3, 0), "entry": (3, 0), "requires": (3, 1), "extracted_from": (3, 0), "aligns_to": (2, 0)}
KEYS = {"code": ["doc_code"], "statement": ["content_sig"], "source": ["source_title"], "entry": ["esco_id"], "requires": ["doc_code", "content_sig"], "extracted_from": ["content_sig", "source_title"], "aligns_to": ["content_sig", "esco_id"]}
NODES = ("code", "statement", "source", "entry")


def upsert_counters(before: Graph, items: DataFrame) -> DataFrame:
    """What an upsert of ``items`` into ``before`` does: one row of nodes_created, relationships_created, properties_set.

    Rows are new where the join with what is stored finds none. Every assignment counts as a property set, of null too: for
    statements and requirements one round an item, for codes one a code.
    """
    sig = signature(F.col("text"))
    met = {
        "code": items.groupBy("doc_code").agg(F.lit(1).cast("long").alias("n")), "statement": items.groupBy(sig.alias("content_sig")).agg(F.count(F.lit(1)).alias("n")),
        "source": items.select(source_title().alias("source_title")).distinct(), "entry": items.where(has_id("esco_id")).select("esco_id").distinct(),
        "requires": items.groupBy("doc_code", sig.alias("content_sig")).agg(F.count(F.lit(1)).alias("n")),
        "extracted_from": items.select(sig.alias("content_sig"), source_title().alias("source_title")).distinct(), "aligns_to": items.where(has_id("esco_id")).select(sig.alias("content_sig"), "esco_id").distinct(),
    }
    parts = []
    for t, new in met.items():
        j = new.join(getattr(before, t).select(*KEYS[t], F.lit(True).alias("_was")), KEYS[t], "left")
        made = F.count_if(F.col("_was").isNull())
        on_make, always = SETS[t]
        again = F.coalesce(F.sum("n"), F.lit(0)) * always if "n" in new.columns else F.lit(0)
        zero = F.lit(0).cast("long")
        parts.append(j.agg((made if t in NODES else zero).alias("a"), (zero if t in NODES else made).alias("b"), (made * on_make + again).alias("c")))
    return reduce(DataFrame.unionByName, parts).agg(F.sum("a").alias("nodes_created"), F.sum("b").alias("relationships_created"), F.sum("c").alias("properties_set"))


def stored(spark: SparkSession, path: str, version: int) -> Graph:
    """The graph written as ``version``; an empty one for version 0."""
    return empty_graph(spark) if version == 0 else Graph(**{t: spark.read.schema(s).parquet(f"{path}/v{version}/{t}") for t, s in SCHEMAS.items()})


def store(g: Graph, path: str, version: int) -> None:
    for t in SCHEMAS:
        getattr(g, t).write.mode("overwrite").parquet(f"{path}/v{version}/{t}")


def violations(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys that are there more than once: the check of a uniqueness constraint."""
    return df.groupBy(*keys).count().where(F.col("count") > 1).select(F.lit(name).alias("constraint_name"), F.concat_ws("|", *keys).alias("key"), F.col("count").alias("n"))


def parsed_codes(c: Column) -> Column:
    """Codes of a typed list, divided by commas and blanks, in upper case."""
    return F.filter(F.split(F.upper(c), r"[,\s]+"), lambda x: x != "")


def delete_codes(g: Graph, codes: DataFrame) -> Graph:
    """Without the given codes (doc_code) and the statements that no code requires any more; sources and entries stay."""
    left = g.requires.join(codes, "doc_code", "left_anti")
    kept = g.statement.join(left.select("content_sig").distinct(), "content_sig", "left_semi")
    edge = lambda e: e.join(kept.select("content_sig"), "content_sig", "left_semi")
    return Graph(g.code.join(codes, "doc_code", "left_anti"), kept, g.source, g.entry, left, edge(g.extracted_from), edge(g.aligns_to))


def delete_counts(g: Graph, codes: DataFrame) -> DataFrame:
    """What :func:`delete_codes` takes out: one row of codes_deleted and statements_deleted."""
    left = delete_codes(g, codes)
    gone = g.code.join(codes, "doc_code", "left_semi").select(F.lit(1).alias("c"), F.lit(0).alias("s"))
    orphans = g.statement.join(left.statement, "content_sig", "left_anti").select(F.lit(0).alias("c"), F.lit(1).alias("s"))
    return gone.unionByName(orphans).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("codes_deleted"), F.coalesce(F.sum("s"), F.lit(0)).alias("statements_deleted"))


def items_of_code(g: Graph, codes: DataFrame) -> DataFrame:
    """Statements required by each of the given codes, with their alignments (two make two rows)."""
    r = g.requires.join(codes, "doc_code", "left_semi").select("doc_code", "content_sig")
    s = g.statement.select("content_sig", "text", "item_type", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return r.join(s, "content_sig").join(g.aligns_to.select("content_sig", "esco_id"), "content_sig", "left").select("doc_code", "text", "item_type", "confidence", F.coalesce("esco_id", F.lit("")).alias("esco_id"))


def overlap(g: Graph, codes: DataFrame, least: int = 2) -> DataFrame:
    """Statements that ``least`` of the given codes or more require, with these codes."""
    r = g.requires.join(codes, "doc_code", "left_semi").join(g.statement.select("content_sig", "text"), "content_sig").join(g.aligns_to.select("content_sig", "esco_id"), "content_sig", "left")
    got = r.groupBy("text", F.coalesce("esco_id", F.lit("")).alias("esco_id")).agg(F.array_sort(F.collect_set("doc_code")).alias("codes"))
    return got.where(F.size("codes") >= least).select("text", "esco_id", F.size("codes").alias("n_codes"), F.array_join("codes", ", ").alias("codes"))


def export_shared(items: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a file export in which codes share statements: node ids are slugs of type and text."""
    node_id = slug(F.col("item_type"), "text")
    code = items.select("doc_code").distinct().join(names, "doc_code", "left").select(F.col("doc_code").alias("id"), F.lit("AFSC").alias("type"), F.coalesce("name", F.lit("")).alias("label"))
    item = items.groupBy(node_id.alias("id")).agg(F.min_by(F.struct("item_type", "text"), "ord").alias("b")).select("id", F.upper("b.item_type").alias("type"), F.col("b.text").alias("label"))
    edges = items.select(F.col("doc_code").alias("src"), node_id.alias("dst"), F.concat(F.lit("REQUIRES_"), F.upper("item_type")).alias("relationship"), "confidence", F.left(F.coalesce("evidence", F.lit("")), F.lit(200)).alias("evidence"))
    return code.unionByName(item), edges


def export_own(items: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, type, text, confidence, source_method, tag, title), edges and one row of counts of an export in which each code has statements of its own.

    Of equal statements of a code the first gives the node; ``names`` (doc_code, name) the titles of codes.
    """
    node_id = F.concat("item_type", F.lit("_"), md5_left(F.concat_ws("_", "doc_code", "text"), 12))
    tag = F.coalesce("esco_id", F.lit(""))
    none = F.lit(None).cast("string")
    code = items.select("doc_code").distinct()
    code = code.join(names, "doc_code", "left") if names is not None else code.withColumn("name", none)
    code = code.select(F.col("doc_code").alias("id"), F.lit("AFSC").alias("type"), none.alias("text"), F.lit(None).cast("double").alias("confidence"), none.alias("source_method"), none.alias("tag"), F.coalesce("name", F.lit("")).alias("title"))
    item = items.groupBy(node_id.alias("id")).agg(F.min_by(F.struct(F.upper("item_type").alias("type"), "text", "confidence", F.col("source").alias("source_method"), tag.alias("tag")), "ord").alias("b")).select("id", "b.*", none.alias("title"))
    edges = items.select(
        F.col("doc_code").alias("src"), node_id.alias("dst"), F.concat(F.lit("REQUIRES_"), F.upper("item_type")).alias("relationship"), F.col("source").alias("source_method"), tag.alias("tag"), "confidence",
        F.left(F.coalesce("evidence", F.lit("")), F.lit(200)).alias("evidence"),
    )
    nodes = code.unionByName(item)
    kinds = nodes.select("type", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit("").alias("type"), F.lit(0).alias("n"), F.lit(1).alias("e")))
    n = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0))
    counts = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("total_edges"), n("AFSC").alias("codes"), n("KNOWLEDGE").alias("knowledge"), n("SKILL").alias("skills"), n("ABILITY").alias("abilities"))
    return nodes, edges, counts
