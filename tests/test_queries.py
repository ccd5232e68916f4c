"""Every registered query that SQL can express, against the SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    out = [tuple(value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    expected = sql.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    got = [tuple(r) for r in df.collect()]
    assert got or name == "b12_null_audit"
    assert normal(got, df.columns) == normal(expected.fetchall(), expected.columns)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
