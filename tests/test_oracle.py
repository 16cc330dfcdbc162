"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from skein.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    x = x.item() if hasattr(x, "item") else x
    return f"{round(x, 6):.6g}" if isinstance(x, float) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name == "v03_projection":  # SQL can't say it
        vectors = np.stack(pd.read_parquet(f"{DATA}/embeddings.parquet").sort_values("vec_id").embedding).astype(float)
        _, _, axes = np.linalg.svd(vectors - vectors.mean(axis=0), full_matrices=False)
        axes = axes[:2] * np.sign(axes[[0, 1], np.abs(axes[:2]).argmax(axis=1)])[:, None]
        assert np.allclose(got.sort_values("vec_id")[["x", "y"]], vectors @ axes.T, atol=1e-6)
        return
    want = duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
