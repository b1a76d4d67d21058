"""Every registered query against the SQL that DuckDB answers on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from tapeloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    if hasattr(x, "dtype") and x.dtype.kind in "iuf" or isinstance(x, int | float) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return str(x).replace(" 00:00:00", "")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
