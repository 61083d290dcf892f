"""Every registered query of the library itself against DuckDB on the same files."""

from __future__ import annotations

import os
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registered._own_queries(), registered._own_oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in registered.TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, datetime) or not isinstance(value, date):
        return value
    return datetime(value.year, value.month, value.day)


def key(row):
    return [(v is not None, str(type(v)), v) for v in row]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    found = [tuple(plain(v) for v in row) for row in frame.select(*columns).collect()]
    result = database.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(plain(row[i]) for i in order) for row in result.fetchall()]
    assert found, "a query without rows checks nothing"
    assert len(found) == len(expected)
    for mine, other in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert [type(v) for v in mine] == [type(v) for v in other]
        assert mine == other


def test_flagship(spark):
    frame = registered.entry(spark)
    assert frame.columns == ["bucket", "value_avg"] and frame.count() > 0
