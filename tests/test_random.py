"""Random queries against DuckDB."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from tidemark import Source, Workspace
from tidemark.functions.instants import to_micros

TESTDATA = "/root/testdata/sf0.001"
TABLES = {
    "events": ("ts", ["value", "user_id", "event_id"], ["event_type", "user_id"]),
    "orders": ("o_orderdate", ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]),
    "lineitem": (
        "l_shipdate",
        ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"],
        ["l_returnflag", "l_linestatus", "l_linenumber"],
    ),
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{TESTDATA}/{table}.parquet')"
        )
    return connection


@pytest.mark.parametrize("seed", range(20))
def test_random_query(spark, database, seed):
    pick = random.Random(seed)
    table = pick.choice(list(TABLES))
    time, values, keys = TABLES[table]
    low, high = database.execute(f"SELECT min({time}), max({time}) FROM {table}").fetchone()
    span = (high - low) // timedelta(microseconds=1)
    start, end = sorted(low + timedelta(microseconds=pick.randrange(-span // 10, span)) for _ in "ab")
    columns = pick.sample(values, pick.randint(0, len(values)))
    aggregation = pick.choice(["avg", "sum", "min", "max", "count"])
    unit = pick.choice(["minute", "hour", "day", "week", "month"])
    width = f"{pick.randint(1, 50)} {unit}s"
    filters = {}
    for key in pick.sample(keys, pick.choice([0, 0, 1, 2])):
        filters[key] = pick.choice(database.execute(f"SELECT DISTINCT {key} FROM {table} ORDER BY 1").fetchall())[0]

    space = Workspace(spark, Source(table, f"{TESTDATA}/{table}.parquet"))
    rows = space.query_timeseries(
        table, columns, start, end, aggregation, width, filters, row_limit=100_000
    )["rows"]

    bucket = f"time_bucket(INTERVAL '{width}', {time})"
    selected = "".join(f", {aggregation}({c})" for c in columns)
    where = "".join(f" AND {key} = ?" for key in filters)
    expected = database.execute(
        f"SELECT {bucket}{selected} FROM {table} WHERE {time} BETWEEN ? AND ?{where} "
        f"GROUP BY {bucket} ORDER BY {bucket}",
        [start, end, *filters.values()],
    ).fetchall()
    assert [to_micros(r["bucket"]) for r in rows] == [to_micros(r[0]) for r in expected]
    for mine, other in zip(rows, expected, strict=True):
        assert [k for k in mine if k != "bucket"] == [f"{c}_{aggregation}" for c in columns]
        assert [v for k, v in mine.items() if k != "bucket"] == pytest.approx(list(other[1:]))
    assert datetime.fromisoformat(rows[0]["bucket"]).tzinfo is not None if rows else True
