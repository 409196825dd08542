"""Every registered log query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from patternloom.plans import catalog, incidents

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries() | incidents.queries(), catalog.oracle_sql() | incidents.oracle_sql()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name in SQL:
        want = duck.sql(SQL[name])
        assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())
    spark.catalog.clearCache()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
