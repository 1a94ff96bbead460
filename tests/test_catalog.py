"""Every catalogued query against its SQL on the smallest tables."""

import os

import pytest

from sectiva.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
