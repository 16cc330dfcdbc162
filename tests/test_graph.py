from pyspark.sql import functions as F

from skein.operators import graph as G

ITEM = "doc_code string, ord long, text string, item_type string, confidence double, source string, esco_id string, evidence string"


def items(spark, rows):
    return spark.createDataFrame([(d, o, t, k, c, "s", e, None) for d, o, t, k, c, e in rows], ITEM)


ROWS = [("A", 1, "run radar", "skill", 0.5, "E1"), ("A", 2, "run radar", "knowledge", None, None), ("B", 3, "run radar", "skill", 0.7, " "), ("B", 4, "paint", "skill", 0.2, "E2")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_last_wins_nodes_first_wins_edges(spark):
    g = G.upsert(G.empty_graph(spark), items(spark, ROWS), 1)
    st = {r.text: r for r in g.statement.collect()}
    assert len(st) == 2 and st["run radar"].item_type == "skill" and st["run radar"].confidence == 0.7
    rq = {(r.doc_code, r.content_sig): r for r in g.requires.collect()}
    assert rq[("A", st["run radar"].content_sig)].confidence == 0.5 and len(rq) == 3
    assert {r.esco_id for r in g.entry.collect()} == {"E1", "E2"}


def test_same_batch_twice_changes_only_times(spark):
    i = items(spark, ROWS)
    a = G.upsert(G.empty_graph(spark), i, 1)
    b = G.upsert(a, i, 2)
    assert G.upsert_counters(G.empty_graph(spark), i).first() == (2 + 2 + 2 + 2, 3 + 3 + 2, 2 * 5 + 2 * 3 + 2 * 6 + 2 * 3 + 3 * 3 + 3 * 3 + 2 * 2 + 4 * 5 + 4)
    assert G.upsert_counters(a, i).first() == (0, 0, 2 + 4 * 5 + 4)
    assert G.upsert_counters(G.empty_graph(spark), i.limit(0)).first() == (0, 0, 0)
    for t, stamp in (("code", "updated_at"), ("statement", "last_seen"), ("requires", "last_seen")):
        assert rows(getattr(a, t).drop(stamp)) == rows(getattr(b, t).drop(stamp))
        assert {r[0] for r in getattr(b, t).select(stamp).collect()} == {2}


def test_null_keeps_old_value(spark):
    g = G.upsert(G.empty_graph(spark), items(spark, [("A", 1, "x y", "skill", 0.4, None)]), 1)
    g = G.upsert(g, items(spark, [("A", 2, "x y", "ability", None, None)]), 2)
    r = g.statement.first()
    assert (r.confidence, r.item_type, r.first_seen, r.last_seen) == (0.4, "ability", 1, 2)
    assert g.requires.first().item_type == "skill"


def test_delete_keeps_shared_statements(spark):
    g = G.upsert(G.empty_graph(spark), items(spark, ROWS), 1)
    codes = spark.range(1).select(F.explode(G.parsed_codes(F.lit("b, zz\n"))).alias("doc_code"))
    left = G.delete_codes(g, codes)
    assert [r.doc_code for r in left.code.collect()] == ["A"] and [r.text for r in left.statement.collect()] == ["run radar"]
    assert left.entry.count() == 2 and left.source.count() == 2
    assert G.delete_counts(g, codes).first() == (1, 1)


def test_violations_and_overlap(spark):
    g = G.upsert(G.empty_graph(spark), items(spark, ROWS), 1)
    assert G.violations(g.statement, ["content_sig"], "statement").count() == 0
    got = [(r.text, r.n_codes, r.codes) for r in G.overlap(g, g.code.select("doc_code")).collect()]
    assert got == [("run radar", 2, "A, B")]


def test_exports(spark):
    i = items(spark, ROWS)
    nodes, edges = G.export_shared(i, spark.createDataFrame([("A", "Alpha")], "doc_code string, name string"))
    assert nodes.count() == 2 + 3 and edges.count() == 4
    own, own_edges, counts = G.export_own(i)
    assert own.count() == 2 + 4 and own_edges.count() == 4 and counts.first() == (6, 4, 2, 1, 3, 0)


def test_stored_batches(spark, tmp_path):
    from skein.plans import pipeline

    docs = spark.createDataFrame([("A", "They analyze enemy radar signals daily and brief results."), ("B", "They analyze enemy radar signals daily."), ("C", None)], "doc_code string, raw_text string")
    path = str(tmp_path / "graph")
    summary, would = pipeline.ingest(docs, path, 0, 5, write=False)
    assert not (tmp_path / "graph").exists()
    _, did = pipeline.ingest(docs, path, 0, 5)
    assert did.first() == would.first() and did.first().nodes_created > 0 and {r.doc_code for r in summary.collect()} == {"A", "B", "C"}
    g = G.stored(spark, path, 1)
    assert {r.doc_code for r in g.code.collect()} == {"A", "B", "C"} and g.requires.where("doc_code = 'A'").count() > 0
    _, again = pipeline.ingest(docs, path, 1, 9)
    assert again.first()[:2] == (0, 0) and {r.last_seen for r in G.stored(spark, path, 2).statement.collect()} == {9}
    assert spark.read.json(f"{path}/audit").count() == 6


def test_shared_folder_of_a_cluster_must_be_named(spark):
    import types

    import pytest

    from skein import session

    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: types.SimpleNamespace(get=lambda k: None))
    with pytest.raises(RuntimeError):
        session.shared_folder(types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d: None)))
