"""Registered queries of the operators: all run, and those with SQL agree with DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from conftest import TESTDATA

from tidemark.llm import registered

TABLES = ("documents", "embeddings")


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_agrees_with_sql(spark, name):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TESTDATA}/{table}.parquet')"
        )
    frame = registered.queries()[name](spark, TESTDATA)
    columns = sorted(frame.columns)
    found = [plain(r) for r in frame.select(*columns).collect()]
    result = database.execute(registered.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [plain(row[i] for i in order) for row in result.fetchall()]
    assert found and sorted(found, key=str) == sorted(expected, key=str)


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registered.queries())
    assert numbers == list(range(1, 14))
