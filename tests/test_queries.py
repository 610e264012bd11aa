"""Every core query with SQL gives the same rows in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return round(float(value), 6) if type(value).__name__ == "Decimal" else value


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    result = con.sql(registry.oracle_sql()[name])
    names = list(result.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=key)
    assert sorted(names) == columns and rows == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = registry.queries()[name](spark, DIR).collect()
    assert len(set(map(str, rows))) == len(rows)
