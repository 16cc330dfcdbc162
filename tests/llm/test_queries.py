"""The queries over the smallest tables: against their SQL, or against what must hold of their rows."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from skein.llm import queries, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def read(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def got(spark):
    return {name: q(spark, DATA).toPandas() for name, q in queries.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(got, duck, name):
    want = duck.sql(queries.SQL[name]).df()
    assert sorted(got[name].columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got[name]) == rows(want)


def test_scans(got):
    docs = read("afsc_doc")
    scanned = docs[docs.clean_text.isna() & docs.raw_text.notna()].set_index("afsc_doc_id")
    found = got["p1_found"]
    assert not found.duplicated().any() and set(found.kind) == {"head", "page", "hyphen", "misread"} and set(found.afsc_doc_id) <= set(scanned.index)
    assert ((found.word == "") == found.kind.isin(["head", "page"])).all() and (found.word == found.word.str.lower()).all()
    for r in found.itertuples():
        line = scanned.raw_text[r.afsc_doc_id].split("\n")[r.line_no - 1]
        assert line.strip() and (r.kind != "hyphen" or line.rstrip()[-1] in "-¬­‐‑")
    repaired = got["p1_repaired"].set_index("afsc_doc_id")
    assert set(repaired.index) == set(scanned.index) and (repaired.n_repairs == found.groupby("afsc_doc_id").size().reindex(repaired.index, fill_value=0)).all()


def test_values(got):
    items, checks = read("ksa_item"), read("laiser_similarity_validation")
    blank = lambda c: c.isna() | (c.str.strip() == "")
    found = got["p3_found"]
    assert not found.duplicated(["src", "row_id"]).any() and set(found.esco_id) <= set(read("esco_catalog").esco_id) | {"none"}
    assert set(found[found.src == "ksa_item"].row_id) == set(items[~blank(items.name) & blank(items.esco_id)].item_id)
    assert set(found[found.src != "ksa_item"].row_id) == set(checks[~blank(checks.esco_export)].validation_id)
    n = got["p3_unmatched"].set_index("src")
    assert n.n_rows.to_dict() == found.groupby("src").size().to_dict() and n.n_unmatched.sum() == (found.esco_id == "none").sum()


def test_containers_and_shares(got):
    docs, targets = read("documents"), read("mix_target").set_index("source")
    count = tokens.encoder(Path(tokens.VOCABULARY).read_bytes())
    sizes = docs.text.map(lambda t: count(t) if isinstance(t, str) else 0)
    held = got["p6_containers"]
    assert held.tokens.sum() == sizes.sum() and held.fullest.max() <= 4096 and sizes.sum() / (4096 * held.containers.sum()) > 0.95
    shares = got["p7_shares"].set_index("source")
    available = sizes.groupby(docs.source).sum().reindex(targets.index, fill_value=0)
    wanted = targets.target_share * available.sum()
    assert set(shares.index) == set(targets.index) and (shares.available.sort_index() == available.sort_index()).all()
    goal = pd.concat([wanted, available * targets.max_uses], axis=1).min(axis=1)
    assert ((shares.reached - goal).abs() <= sizes.groupby(docs.source).max().reindex(targets.index, fill_value=0)).all() and abs(shares.share.sum() - 1) < 1e-9


def test_kinds(got):
    docs = read("documents")
    filled = docs[docs.text.notna() & (docs.text.fillna("").str.replace("[\\s\u00ad\u200b-\u200f\u2060-\u2064\ufeff]", "", regex=True) != "")]
    figures = got["p8_figures"].set_index("doc_id")
    assert set(figures.index) == set(filled.doc_id) and figures.index.is_unique and set(figures.kind) <= {"prose", "list", "table", "junk"}
    assert (figures.n_chars.sort_index() == filled.set_index("doc_id").text.str.len().sort_index()).all()
    found = got["p8_found"].set_index("doc_id").kind.to_dict()
    assert found == figures[figures.kind != "prose"].kind.to_dict()


def test_inspected_documents(got):
    """Documents whose beginnings were read, by id: what kind of text each is."""
    kinds = got["p8_figures"].set_index("doc_id").kind
    assert {i: kinds[i] for i in INSPECTED} == INSPECTED


#: Labelled by their first hundred characters, before looking at what the operator says.
INSPECTED = {i: kind for kind, ids in {
    "junk": [3, 11, 12, 18, 37, 59, 81],
    "list": [6, 9, 34, 50, 78, 82, 91],
    "table": [7, 19, 20, 43, 51, 64],
    "prose": [1, 2, 4, 5, 8, 10, 13, 14, 15, 16, 17, 22, 23, 28, 33, 35, 38, 39, 41, 42, 44, 45, 46, 48, 52, 55, 61, 71, 74, 80, 88, 96, 97, 99],
}.items() for i in ids}
