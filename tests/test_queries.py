"""Every registered query against its SQL, over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tessera.plans import queries as core

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return connection


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, data, sql, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    result = sql.execute(entry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    theirs = sorted(str([plain(row[order.index(c)]) for c in columns]) for row in result.fetchall())
    assert sorted(str([plain(row[c]) for c in columns]) for row in df.collect()) == theirs


def test_entry_and_names(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(core.QUERIES) > 80
