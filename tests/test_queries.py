"""Every registered query with SQL gives DuckDB's rows."""

import os

import duckdb
import pandas as pd
import pytest

from stratablock.plans import dataset_queries, mesh_queries, model_queries, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLANS = (mesh_queries, dataset_queries, model_queries)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return str(v) if isinstance(v, str) or not hasattr(v, "__float__") else float(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    """These have a plain version in test_reconstruction_queries.py."""
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
