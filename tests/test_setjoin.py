import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from skein.operators import setjoin


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_similarity_join_against_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    make = lambda n: [(i, rng.sample("abcdefghijklmnop", rng.randint(0, 9))) for i in range(n)]
    left, right = make(120) + [(500, None)], make(90)
    lf, rf = spark.createDataFrame(left, "lid long, tokens array<string>"), spark.createDataFrame(right, "rid long, tokens array<string>")
    for t, bound in product((0.3, 0.6, 1.0), (10**6, 3)):
        monkeypatch.setattr(setjoin, "RANKS_BY_BROADCAST", bound)
        want = {(i, j): jaccard(a, b) for i, a in left if a for j, b in right if b if jaccard(a, b) >= t - 1e-9}
        got = [(r.lid, r.rid, r.jaccard) for r in setjoin.similarity_join(lf, rf, t).collect()]
        assert len(got) == len(want) and all(abs(want[i, j] - x) < 1e-9 for i, j, x in got)
    with pytest.raises(ValueError):
        setjoin.similarity_join(lf, rf, 0)


def test_self_join_within_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["g", "h", None]), i, rng.sample("abcdefgh", rng.randint(0, 6))) for i in range(150)]
    want = {(g, i, j) for g, i, a in rows for h, j, b in rows if g and g == h and i < j and a and b and jaccard(a, b) >= 0.5}
    got = [(r.g, r.lid, r.rid) for r in setjoin.similarity_join(spark.createDataFrame(rows, "g string, lid long, tokens array<string>"), None, 0.5, "g").collect()]
    assert len(got) == len(want) and set(got) == want


def test_ranks_by_shuffle_are_unique_and_in_order(spark):
    counts = [(f"t{i:05}", i % 3 + 1) for i in range(5000)]  # thousands of tokens of each count
    ranks = {r.token: r["_r"] for r in setjoin.rank_rows(spark.createDataFrame(counts, "token string, n long").repartition(7)).collect()}
    assert len(set(ranks.values())) == len(counts)
    assert sorted(ranks, key=ranks.get) == [t for t, _ in sorted(counts, key=lambda x: (x[1], x[0]))]


def test_tokens_of_equal_count_stay_apart(spark, monkeypatch):
    """All tokens are of one count, so nothing but the tokens themselves can tell them."""
    monkeypatch.setattr(setjoin, "RANKS_BY_BROADCAST", 0)
    sets = [(i, [f"w{i}a", f"w{i}b", f"w{i}c"]) for i in range(400)]
    lf = spark.createDataFrame(sets, "lid long, tokens array<string>")
    got = setjoin.similarity_join(lf, lf.withColumnRenamed("lid", "rid"), 0.1).collect()
    assert len(got) == 400 and all(r.lid == r.rid and r.jaccard == 1 for r in got)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "lid long, tokens array<string>")
    some = spark.createDataFrame([(1, ["a"])], "rid long, tokens array<string>")
    assert setjoin.similarity_join(none, some, 0.5).count() == 0 and setjoin.similarity_join(none, None, 0.5).count() == 0
    assert setjoin.similarity_join(some.select(F.col("rid").alias("lid"), "tokens"), none.withColumnRenamed("lid", "rid"), 0.5).count() == 0
