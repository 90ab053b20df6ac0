"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidevec import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if hasattr(x, "replace") and hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
    if name not in ("filter_no_terms",):
        assert got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0
