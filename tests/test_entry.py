"""The queries run on small tables; where SQL is given, DuckDB finds the same rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as e
from girder.plans import catalog


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{small}/{f}')")
    return c


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_names_of_sql_are_names_of_queries():
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    rows = catalog.QUERIES[name](spark, small)
    cols = sorted(rows.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in rows.collect())
    if name in catalog.SQL:
        r = duck.execute(catalog.SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert sorted(tuple(norm(x[k]) for k in at) for x in r.fetchall()) == got
