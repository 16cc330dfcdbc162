import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.llm import copies, topn

REL = "rel_id long, afsc_code string, item_name string, item_type string, confidence double, ingested_at timestamp"


def test_top_n_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([0.1, 0.2, 0.3, None]), "extra") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, score double, rank_no string").repartition(7)
    got = topn.top_n(df, ["g"], [F.col("score").desc_nulls_last(), F.col("id")], 4)
    groups = defaultdict(list)
    for i, g, s, _ in rows:
        groups[g].append((-(s if s is not None else -9), i))
    want = {(g, k, i) for g, xs in groups.items() for k, (_, i) in enumerate(sorted(xs)[:4], 1)}
    assert {(r.g, r.rank_no, r.id) for r in got.collect()} == want


def test_top_n_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1)], "g string, i long")
        got = sorted((r.g, r.rank_no, r.i) for r in topn.top_n(df, ["g"], [F.col("i").desc()], 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [("a", k, 20 - k) for k in range(1, 6)] + [("b", 1, 1)]


def test_best_requirements(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (1, " a1 ", "x", "Skill", 0.5, t), (2, "A1", "x", "skill ", 0.9, t + timedelta(1)), (3, "A1", "x", "skill", 0.1, t + timedelta(1)),  # the last of the latest stays
        (4, "A1", "y", "skill", 0.1, t), (5, "A1", "z", "skill", float("nan"), t), (6, "A1", "z", "skill", 1.5, t), (7, "A1", None, "skill", 0.5, t), (8, None, "z", "skill", 0.5, t), (9, "A1", "w", None, 0.5, t), (10, "A1", "v", "skill", None, t), (11, "A1", "u", "skill", 1.0, None),
    ]
    got = [tuple(r) for r in topn.best_requirements(spark.createDataFrame(rows, REL)).orderBy("rank_no").collect()]
    assert got == [("A1", "skill", 1, 11), ("A1", "skill", 2, 3), ("A1", "skill", 3, 4)]
    assert topn.best_requirements(spark.createDataFrame([], REL)).count() == 0


def test_hot_and_cold_keys_agree(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 400)}", i) for i in range(4000)] + [(None, 5)]
    df = spark.createDataFrame(rows, "key string, id long").repartition(5)
    coded = df.select(F.encode("key", "utf-8").alias("key")).where("key is not null")
    assert [bytes(r.key) for r in copies.hot_keys(coded, "key", 0.1).collect()] == [b"hot"]
    want = defaultdict(list)
    for k, i in rows:
        if k is not None:
            want[k].append(i)
    assert {bytes(r.key).decode() for r in copies.hot_keys(coded, "key", 0.003).collect()} == {k for k, v in want.items() if len(v) >= 0.003 * 4000}
    assert copies.hot_keys(coded, "key", 0.9) is None
    keyed = df.select(F.encode("key", "utf-8").alias("key"), "id")
    for share in (0.9, 0.1, 0.003, 1e-9):
        got = {(r.keep_id, r.n_copies) for r in copies.collapse(keyed, "key", "id", share).collect()}
        assert got == {(min(v), len(v)) for v in want.values()}


def test_hot_sets_of_the_tables_are_salted(spark):
    """At every size of the test tables some sets hold a thousandth of the rows, so the two-level branch is what runs."""
    from pathlib import Path

    from skein.llm import queries

    data = "/root/testdata/sf0.01"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    plan = queries.p5_found(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "LeftSemi" in plan and "LeftAnti" in plan


def test_canonical_fields(spark):
    same = [
        "action=install | object=Radar sets | level=7 | setting=in the field", '{"level": "7", "object": "radar  sets", "setting": "In the field", "action": "install"}',
        "ACTION:INSTALL;SETTING:in-the-field;OBJECT:RADAR SETS;LEVEL:7", "Object = Radar sets; Ac­tion = Install; Level = 7; Setting = In the field.",
    ]
    other = ["action=radar sets | object=install | level=7 | setting=in the field", "action=install | object=radar sets | setting=in the field", "install radar sets in the field, level: 7", "action=install | object=radar sets2 | level=7 | setting=in the field"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(same + other)], "i long, t string")
    got = [r[0] for r in df.orderBy("i").select(copies.canonical_fields(F.col("t"))).collect()]
    assert len(set(got[:4])) == 1 and len(set(got)) == 5


def test_copy_sets(spark):
    item = "item_id long, afsc_code string, name string, type string, meta map<string,string>, extra string"
    rows = [
        (3, "A", "Run  Radar-sets", "s", {"a": "x", "b": "Y "}, "1"), (2, "A", "run radar sets.", "s", {"b": "y", "a": "X"}, "2"), (4, "A", "run radar sets", "s", {"a": "x"}, ""), (5, "B", "run radar sets", "s", {"a": "x", "b": "y"}, ""),
        (6, None, "q", "s", None, ""), (7, None, "q", "s", None, ""), (8, "", "q", "s", None, ""), (9, "A", None, "s", None, ""), (10, "A", " ​", "s", None, ""), (11, "A", " ", "s", None, ""),
    ]
    cand = "candidate_id long, afsc string, label string, source_doc string, text_norm string"
    cands = [(1, "A", "S", "f", "a b"), (2, "A", "S", "f", "A, B"), (3, "A", "S", "f", "A, B"), (4, "A", "S", None, "ab"), (5, "A", "S", "f", None)]
    got = {tuple(r) for r in copies.copy_sets(spark.createDataFrame(rows, item), spark.createDataFrame(cands, cand)).collect()}
    assert got == {("ksa_item", 2, 2), ("ksa_item", 6, 2), ("ksa_candidates_v0_raw", 1, 3)}
    assert copies.copy_sets(spark.createDataFrame([], item), spark.createDataFrame([], cand)).count() == 0
