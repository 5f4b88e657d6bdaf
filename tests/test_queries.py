"""Every registered query against its SQL form on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from terrapanel.plans import load_queries, model_queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"gbt_fit"}  # 500 trees; the same code runs below with fewer


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "~"
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(load_queries()) - SLOW))
def test_matches_sql(spark, duck, name):
    query = load_queries()[name]
    got = query.spark(spark, SF_DIR).toPandas()
    expected = duck.execute(query.oracle()).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("name, weights, options", [("gbt", "ratio", {"maxIter": 5}), ("random_forest", "balanced", {"numTrees": 10, "maxDepth": 8}), ("svm", "balanced", {"maxIter": 20}), ("mlp", "none", {"maxIter": 20})])
def test_learners_against_sql(spark, duck, name, weights, options):
    found = model_queries._record(spark, SF_DIR, name, weights, **options)
    expected = duck.execute(model_queries._record_sql(weights)).df()
    row = found.first()
    assert all(row[c] == pytest.approx(expected[c][0]) for c in expected.columns)


def test_driver_contract(spark):
    # Corpus queries may be missing or have no SQL; all others have one.
    assert set(load_queries()) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).limit(1).count() == 1
