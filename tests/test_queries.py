"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from clipframe import queries

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, abs_tol=2e-4) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    sql = queries.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    kinds = dict(df.dtypes)
    assert [TYPES[kinds[c]] for c in rel.columns] == [str(t) for t in rel.types]
    exact = [c for c in rel.columns if kinds[c] != "double"] + [c for c in rel.columns if kinds[c] == "double"]
    order = lambda r: [(v is None, v) for v in r]
    got = sorted(([r[c] for c in exact] for r in rows), key=order)
    want = sorted(([r[rel.columns.index(c)] for c in exact] for r in rel.fetchall()), key=order)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
