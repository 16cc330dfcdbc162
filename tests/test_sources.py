import json

import pytest
from pyspark.sql import functions as F

from skein.plans import pipeline
from skein.sources import readers, sinks
from skein.streaming import ingest


def test_text_files_with_missing(spark, tmp_path):
    (tmp_path / "A1.txt").write_text("one\ntwo")
    wanted = spark.createDataFrame([("A1", "x"), ("B2", "y")], "code string, title string")
    got = {r.code: r for r in readers.text_files(spark, str(tmp_path), wanted).collect()}
    assert got["A1"].text == "one\ntwo" and not got["A1"].missing and got["B2"].missing


def test_bulk_lines(spark, tmp_path):
    lines = ['{"afsc": "A", "md": "text"}', '{"afsc": "B", "sections": {"k": [1]}}', '{"afsc": "C"}', '{"md": "x"}', "{broken"]
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    good, bad = readers.bulk_lines(spark, str(tmp_path / "b.jsonl"))
    assert {(r.afsc, r.text) for r in good.collect()} == {("A", "text"), ("B", '{"k":[1]}'), ("C", "{}")}
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "missing afsc"]


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.csv").write_text('ESCO_ID,Label,ALTS\nE1,one,"a;; b ;c;d;e;f;g;h;i"\n,none,\nE3,,x\n')
    got = readers.taxonomy(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.esco_id, r.label, r.alts) for r in got] == [("E1", "one", list("abcdefgh"))]
    assert readers.taxonomy(spark, str(tmp_path / "nothing.csv")).count() == 0


def test_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"p1|p2")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    pages = readers.pages(spark, str(tmp_path / "*.bin"), lambda b: b.decode().split("|"))
    assert sorted((r.page, r.text) for r in pages.collect()) == [(1, ""), (1, "p1"), (2, "p2")]
    assert {r.text for r in readers.page_texts(pages).collect()} == {"p1\n\np2", ""}


def test_index_graph_and_audit(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "n.md").write_text("#")
    assert [(r.stem, r.folder) for r in readers.file_index(spark, str(tmp_path)).collect()] == [("n", "x")]
    g = {"nodes": [{"id": "1", "type": "T", "properties": {"a": "b"}}], "edges": [{"source": "1", "target": "2", "relationship": "R", "properties": {}}]}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    nodes, edges = readers.graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.first().properties == {"a": "b"} and edges.first().relationship == "R"
    row = spark.createDataFrame([("t", "A", "m", "ok", {"n": 1}, "e" * 6000)], "timestamp string, afsc string, mode string, status string, metrics map<string,int>, error string")
    for _ in range(2):
        sinks.audit(row, str(tmp_path / "log"))
    assert [len(r.error) for r in spark.read.json(str(tmp_path / "log")).collect()] == [5000, 5000]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "q"\nline ,x'), (2, "")], "i long, t string")
    sinks.csv(df, str(tmp_path / "c"))
    assert {r.i: r.t for r in readers.csv(spark, str(tmp_path / "c"), "i long, t string").collect()}[1] == ' a "q"\nline ,x'


def test_pipeline(spark):
    docs = spark.createDataFrame([("A", "They analyze complex radar data sets.\nPlans large joint training events"), ("B", None), ("C", "")], "doc_code string, raw_text string")
    items, summary = pipeline.run(docs, pipeline.Config(enhance=True))
    got = {r.doc_code: r for r in summary.collect()}
    assert set(got) == {"A", "B", "C"} and got["A"].n_items_after_dedupe == got["A"].total if "total" in summary.columns else got["A"].n_items_after_dedupe >= 2
    assert items.where((F.col("doc_code") == "A") & F.col("text").contains("radar")).count() >= 1


def test_stream_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_code":"A","ord":1,"text":"run radar","item_type":"skill","confidence":0.5,"source":"s","esco_id":"E1"}\n')
    stream = spark.readStream.schema("doc_code string, ord long, text string, item_type string, confidence double, source string, esco_id string").json(str(tmp_path / "in"))
    q = ingest.ingest(stream, lambda b: b, str(tmp_path / "g"), str(tmp_path / "c"), lambda n: n + 1)
    q.awaitTermination(60)
    assert ingest.stored(spark, str(tmp_path / "g"), 1).statement.first().text == "run radar"


def test_given_text_and_shaping(spark, tmp_path):
    import io

    (tmp_path / "t.txt").write_text("from a file")
    given = lambda **k: readers.given_text(spark, **k).first().text
    assert given(text="x", path=str(tmp_path / "t.txt")) == "x" and given(text=" ", path=str(tmp_path / "t.txt")) == "from a file"
    assert given(stream=io.StringIO("typed")) == "typed" and given(stream=io.StringIO(" "), placeholder="p") == "p" and given(placeholder="p") == "p"
    df = spark.createDataFrame([(i, "v") for i in range(9)], "i long, b string")
    assert [r.i for r in readers.rows_between(df, [df.i.desc()], 2, 5).collect()] == [6, 5, 4]
    assert readers.with_missing(df, ["b", "c"]).columns == ["i", "b", "c"] and readers.first_existing(df, ["a", "b", "i"], "x").columns == ["i", "x"] and readers.first_existing(df, ["q"], "x").columns == ["i", "b"]
    assert readers.require_columns(df, {"i"}) is df
    with pytest.raises(ValueError, match="z"):
        readers.require_columns(df, {"i", "z"})
