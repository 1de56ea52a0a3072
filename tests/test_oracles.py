"""Every query with a SQL counterpart gives the same rows in DuckDB; the others give rows of a stable schema."""

import math

import duckdb
import pytest

from loomscan import catalog
from loomscan.sources.views import TABLES

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return [norm(y) for y in x]
    return repr(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = sorted(str([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in ORACLE:
        q = duck.sql(ORACLE[name])
        cols = q.columns
        assert sorted(cols) == sorted(df.columns)
        assert got == sorted(str([norm(r[cols.index(c)]) for c in sorted(cols)]) for r in q.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
