"""The streaming rollup against the batch one."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import (
    Source,
    Workspace,
    absorb,
    create_rollup,
    full_refresh,
    refresh_window,
    store_by_day,
    stream_rollup,
)
from tidemark.functions.instants import literal, to_micros
from tidemark.operators.refresh import coverage

START = datetime(2024, 5, 1)


def readings(spark, minutes, kind="timestamp"):
    rows = [(START + timedelta(minutes=m), "ab"[m % 2], float(m)) for m in minutes]
    return spark.createDataFrame(rows, f"time {kind}, k string, v double")


def run(spark, raw, rollup, path, **options):
    query = stream_rollup(spark, raw, rollup, path("landing"), path("state"), **options)
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture(params=["UTC", "Asia/Kolkata"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_closed_hours_equal_the_batch_rollup(spark, path, kind, zone):
    where, landing, state = path("raw"), path("landing"), path("state")
    places = {"landing": landing, "state": state}

    def micros(hours):
        return to_micros(START + timedelta(hours=hours))

    raw = Source("r", where)
    readings(spark, range(0, 300), kind).write.parquet(where)
    stream = create_rollup(spark, raw, path("s"), dims=("k",), values=("v",))
    batch = create_rollup(spark, raw, path("b"), dims=("k",), values=("v",))

    run(spark, raw, stream, places.get)
    assert absorb(spark, stream, landing) == [(micros(0), micros(4))]
    # Rows up to 04:59 have closed the hours before four o'clock.
    assert stream.read(spark).count() == 4 * 2
    # A second run goes on where the first stopped, and closes the hour it left open.
    readings(spark, range(300, 550), kind).write.mode("append").parquet(where)
    run(spark, raw, stream, places.get)
    assert absorb(spark, stream, landing) == [(micros(4), micros(9))]
    assert absorb(spark, stream, landing) == []

    full_refresh(spark, raw, batch)
    stored = batch.read(spark)
    end = literal(to_micros(START + timedelta(hours=9)), stored.schema["bucket"].dataType)
    closed = stored.filter(F.col("bucket") < end)
    assert sorted(map(tuple, stream.read(spark).collect())) == sorted(map(tuple, closed.collect()))
    assert coverage(spark, stream) == coverage(spark, batch)


def test_stream_follows_a_batch_refresh(spark, path):
    where = path("raw")
    store_by_day(readings(spark, range(0, 600)), where, "time")
    raw = Source("r", where, date_column="date")
    rollup = create_rollup(spark, raw, path("r"), dims=("k",), values=("v",))
    end = START + timedelta(hours=6)
    refresh_window(spark, raw, rollup, START, end)
    landing, state = path("landing"), path("state")
    run(spark, raw, rollup, {"landing": landing, "state": state}.get, start=end)
    absorb(spark, rollup, landing)
    assert coverage(spark, rollup) == [(to_micros(START), to_micros(START + timedelta(hours=9)))]
    space = Workspace(spark, raw, rollup)
    call = ("r", ["v"], START + timedelta(minutes=7), START + timedelta(days=1), "sum", "3 hours")
    exact, never = space.query_timeseries(*call), space.query_timeseries(*call, rollup="never")
    assert exact["table_used"] == "r_1h" and exact["rows"] == never["rows"]


def test_absorb_keeps_covered_hours(spark, path):
    where, landing = path("raw"), path("landing")
    raw = Source("r", where)
    readings(spark, range(0, 500)).write.parquet(where)
    rollup = create_rollup(spark, raw, path("r"), dims=("k",), values=("v",))
    run(spark, raw, rollup, {"landing": landing, "state": path("state")}.get)
    hour = timedelta(hours=1)
    refresh_window(spark, raw, rollup, START + 2 * hour, START + 4 * hour)
    assert absorb(spark, rollup, landing) == [
        (to_micros(START), to_micros(START + 2 * hour)),
        (to_micros(START + 4 * hour), to_micros(START + 8 * hour)),
    ]
    assert coverage(spark, rollup) == [(to_micros(START), to_micros(START + 8 * hour))]
    assert rollup.read(spark).agg(F.sum("samples"), F.count("*")).first() == (480, 16)


def test_late_rows_need_a_windowed_refresh(spark, path):
    where, landing, state = path("raw"), path("landing"), path("state")
    raw = Source("r", where)
    readings(spark, range(0, 300)).write.parquet(where)
    rollup = create_rollup(spark, raw, path("r"), values=("v",))
    places = {"landing": landing, "state": state}.get
    run(spark, raw, rollup, places)
    readings(spark, [30, 31, 400]).write.mode("append").parquet(where)
    run(spark, raw, rollup, places)
    absorb(spark, rollup, landing)
    first = rollup.read(spark).filter(F.hour("bucket") == 0)
    assert first.first()["samples"] == 60
    refresh_window(spark, raw, rollup, START, START + timedelta(hours=1))
    assert first.sparkSession.read.parquet(rollup.location).filter(
        F.hour("bucket") == 0
    ).first()["samples"] == 62




def test_batches_of_files_in_order(spark, path):
    raw = Source("r", path("raw"))
    for first in (0, 200, 400):
        readings(spark, range(first, first + 200)).coalesce(1).write.mode("append").parquet(raw.location)
    rollup = create_rollup(spark, raw, path("r"), values=("v",))
    places = {"landing": path("landing"), "state": path("state")}
    query = stream_rollup(spark, raw, rollup, *places.values(), max_files=1)
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [200, 200, 200]
    absorb(spark, rollup, places["landing"])
    counts = rollup.read(spark).groupBy("samples").count().collect()
    assert [tuple(r) for r in counts] == [(60, 9)]


def test_stream_of_a_catalog_table(spark, path):
    spark.sql("CREATE DATABASE IF NOT EXISTS streamed")
    readings(spark, range(0, 300)).write.saveAsTable("streamed.r")
    raw = Source("r", "streamed.r", format="table")
    rollup = create_rollup(spark, raw, path("r"), dims=("k",), values=("v",))
    landing, state = path("landing"), path("state")
    run(spark, raw, rollup, {"landing": landing, "state": state}.get)
    absorb(spark, rollup, landing)
    assert rollup.read(spark).agg(F.sum("samples")).first()[0] == 240
