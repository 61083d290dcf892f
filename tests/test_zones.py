"""Zone maps, late files of plain folders, and rows that the stream drops."""

from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import (
    Registry,
    Source,
    Workspace,
    absorb,
    create_rollup,
    full_refresh,
    publish_rollup,
    refresh_policy,
    refresh_window,
    stream_rollup,
    update_zones,
)
from tidemark.functions.instants import to_micros
from tidemark.operators.describe import (
    json_key_profile,
    latest,
    rows_by_hour,
    source_inventory,
    source_time_range,
    time_range,
)
from tidemark.operators.refresh import changed_spans, coverage, rollup_state
from tidemark.operators.zones import zones

START = datetime(2024, 5, 1)
HOUR = 3_600_000_000


def readings(spark, minutes, kind="timestamp", value=1.0):
    rows = [(START + timedelta(minutes=m), value, f'{{"k{m % 7}":1}}') for m in minutes]
    return spark.createDataFrame(rows, f"time {kind}, v double, raw string").coalesce(1)


def hour(n):
    return to_micros(START) + n * HOUR


def spoil(file: Path):
    """Another content of the same size and time: whoever opens the file fails."""
    state = file.stat()
    file.write_bytes(b"x" * state.st_size)
    os.utime(file, ns=(state.st_atime_ns, state.st_mtime_ns))


def data_files(folder):
    return sorted(Path(folder).glob("part-*"), key=lambda f: f.stat().st_mtime_ns)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_noted_files_are_not_opened(spark, path, kind):
    where = path("raw with blank%20")
    raw = Source("r", where, json_columns=("raw",), zones=path("zones"))
    readings(spark, range(0, 600), kind).write.parquet(where)
    raw = raw.resolved(spark)
    whole = time_range(raw.read(spark), "time").collect()
    assert source_time_range(spark, raw).collect() == whole  # no map yet
    update_zones(spark, raw, raw.zones)
    update_zones(spark, raw, raw.zones)
    assert zones(spark, raw, raw.zones).count() == 10
    for file in data_files(where):
        spoil(file)
    assert source_time_range(spark, raw).collect() == whole
    # New files are read, and the map takes them in.
    readings(spark, range(700, 900), kind).write.mode("append").parquet(where)
    ends = source_time_range(spark, raw).first()
    assert ends["max"] - ends["min"] == timedelta(minutes=899)
    update_zones(spark, raw, raw.zones)
    for file in data_files(where):
        if file.read_bytes()[:4] == b"PAR1":
            spoil(file)
    listed = source_inventory(spark, Registry(raw)).first()
    assert (listed["time_min"], listed["time_max"]) == (
        "2024-05-01T00:00:00+00:00", "2024-05-01T14:59:00+00:00",
    )
    assert rows_by_hour(spark, raw).agg(F.sum("rows")).first()[0] == 800


def test_files_that_change_or_go(spark, path):
    where = path("raw")
    raw = Source("r", where, zones=path("zones")).resolved
    readings(spark, range(0, 60)).write.parquet(where)
    readings(spark, range(600, 660)).write.mode("append").parquet(where)
    raw = Source("r", where, zones=path("zones")).resolved(spark)
    update_zones(spark, raw, raw.zones)
    data_files(where)[-1].unlink()
    assert source_time_range(spark, raw).first()["max"].minute == 59
    assert zones(spark, raw, raw.zones).count() == 1
    readings(spark, range(120, 240)).write.mode("overwrite").parquet(where)
    assert {r["hour_us"] for r in zones(spark, raw, raw.zones).collect()} == {hour(2), hour(3)}
    readings(spark, []).write.mode("overwrite").parquet(where)
    assert list(source_time_range(spark, raw).first()) == [None, None]


def test_rows_without_a_time(spark, path):
    where = path("raw")
    raw = Source("r", where, zones=path("zones"))
    rows = spark.createDataFrame([(None, 1.0), (START, 2.0)], "time timestamp, v double")
    rows.coalesce(1).write.parquet(where)
    raw = raw.resolved(spark)
    update_zones(spark, raw, raw.zones)
    assert source_time_range(spark, raw).first()["max"] == START
    frame = raw.read(spark)
    found = latest(frame, frame.schema["time"], 5, by_hour=rows_by_hour(spark, raw)).collect()
    assert [r["v"] for r in found] == [2.0, 1.0]


@pytest.mark.parametrize("sample", [1, 30, 200, 5000])
def test_newest_rows_and_keys_by_zone_map(spark, path, sample):
    raw = Source("r", path("raw"), json_columns=("raw",), zones=path("zones"))
    for first in (0, 400, 350):
        readings(spark, range(first, first + 400)).write.mode("append").parquet(raw.location)
    raw = raw.resolved(spark)
    update_zones(spark, raw, raw.zones)
    readings(spark, [90_000]).write.mode("append").parquet(raw.location)
    frame, by_hour = raw.read(spark), rows_by_hour(spark, raw)
    time = frame.schema["time"]
    expected = frame.orderBy(F.desc("time"), "raw").limit(sample).collect()
    assert latest(frame, time, sample, "raw", by_hour=by_hour).collect() == expected
    assert json_key_profile(frame, "raw", time, sample, by_hour=by_hour).collect() == (
        json_key_profile(frame, "raw", time, sample).collect()
    )


def test_keys_are_looked_for_in_older_rows(spark):
    """The newest rows hold no keys at all; payloads are looked at in four steps."""
    rows = [(START + timedelta(minutes=m), '{"a":1}' if m < 50 else "[]") for m in range(500)]
    frame = spark.createDataFrame([*rows, (None, '{"b":1}')], "time timestamp, raw string")
    profile = json_key_profile(frame, "raw", frame.schema["time"], sample=10).collect()
    assert [tuple(r) for r in profile] == [("a", 10)]
    profile = json_key_profile(frame, "raw", frame.schema["time"], sample=60).collect()
    assert [tuple(r) for r in profile] == [("a", 50), ("b", 1)]


def counts(space, mode="exact", width="1 hour"):
    return space.frame("r", ["v"], None, None, "count", width, rollup=mode).collect()


def held_rows(spark, rollup):
    return rollup.read(spark).agg(F.sum("samples")).first()[0]


def test_late_files_of_a_plain_folder(spark, path):
    raw = Source("r", path("raw"))
    readings(spark, range(0, 60 * 48)).write.parquet(raw.location)
    rollup = create_rollup(spark, raw, path("r_1h"), values=("v",))
    full_refresh(spark, raw, rollup)
    space = Workspace(spark, raw, rollup)
    window = (hour(0), hour(48))
    assert changed_spans(spark, raw, rollup, window) == []
    held = [r["state"] for r in rollup_state(spark, raw, rollup).collect()]
    assert held == ["held"]

    readings(spark, [61, 62, 60 * 30]).write.mode("append").parquet(raw.location)
    assert changed_spans(spark, raw, rollup, window) == [(hour(1), hour(2)), (hour(30), hour(31))]
    state = rollup_state(spark, raw, rollup).collect()
    assert [(r["state"], r["hours"]) for r in state] == [
        ("held", 1), ("stale", 1), ("held", 28), ("stale", 1), ("held", 16),
    ]
    assert counts(space) == counts(space, "never") and held_rows(spark, rollup) == 60 * 48
    # A window takes in its hours only.
    refresh_window(spark, raw, rollup, START, START + timedelta(hours=5))
    assert changed_spans(spark, raw, rollup, window) == [(hour(30), hour(31))]
    assert counts(space) == counts(space, "never")
    now = datetime(2024, 5, 3, 0, 4, tzinfo=timezone.utc)
    day = timedelta(hours=24)
    assert refresh_policy(spark, raw, rollup, now, day) == [(hour(30), hour(31))]
    assert refresh_policy(spark, raw, rollup, now, day) == []
    assert counts(space) == counts(space, "never")

    # A file goes, and takes the rows of its hours with it.
    data_files(raw.location)[-1].unlink()
    assert changed_spans(spark, raw, rollup, window) == [(hour(1), hour(2)), (hour(30), hour(31))]
    assert counts(space) == counts(space, "never")
    assert refresh_policy(spark, raw, rollup, now, None) == [
        (hour(1), hour(2)), (hour(30), hour(31)),
    ]
    assert changed_spans(spark, raw, rollup, window) == []
    assert space.query_timeseries("r", ["v"], START, START + day, "sum", "1 day")["table_used"] == "r_1h"


def test_all_rows_of_an_hour_go(spark, path):
    raw = Source("r", path("raw"))
    readings(spark, range(0, 600)).write.parquet(raw.location)
    readings(spark, range(1200, 1260)).write.mode("append").parquet(raw.location)
    readings(spark, range(1800, 1860)).write.mode("append").parquet(raw.location)
    rollup = create_rollup(spark, raw, path("r_1h"), values=("v",))
    full_refresh(spark, raw, rollup)
    data_files(raw.location)[1].unlink()
    space = Workspace(spark, raw, rollup)
    assert counts(space) == counts(space, "never")
    now = datetime(2024, 5, 3, tzinfo=timezone.utc)
    assert (hour(20), hour(21)) in refresh_policy(spark, raw, rollup, now, timedelta(days=3))
    assert counts(space) == counts(space, "never")
    assert held_rows(spark, rollup) == 660
    assert refresh_policy(spark, raw, rollup, now, timedelta(days=3)) == []


def stream(spark, raw, rollup, landing, state):
    stream_rollup(spark, raw, rollup, landing, state).awaitTermination()


def test_rows_that_the_stream_drops(spark, path):
    raw = Source("r", path("raw"))
    landing, state = path("landing"), path("state")
    readings(spark, range(0, 600)).write.parquet(raw.location)
    rollup = create_rollup(spark, raw, path("r_1h"), values=("v",))
    stream(spark, raw, rollup, landing, state)
    readings(spark, [125, 126, *range(600, 800)]).write.mode("append").parquet(raw.location)
    stream(spark, raw, rollup, landing, state)
    assert absorb(spark, rollup, landing, raw) == [(hour(0), hour(2)), (hour(3), hour(13))]
    assert coverage(spark, rollup) == [(hour(0), hour(2)), (hour(3), hour(13))]
    space = Workspace(spark, raw, rollup)
    assert counts(space) == counts(space, "never") and held_rows(spark, rollup) == 12 * 60
    answer = space.query_timeseries("r", ["v"], START, START + timedelta(hours=2), "count", "1 hour")
    assert answer["table_used"] == "r_1h"
    # Late rows of an hour that is covered by now.
    readings(spark, [5]).write.mode("append").parquet(raw.location)
    stream(spark, raw, rollup, landing, state)
    assert absorb(spark, rollup, landing, raw) == []
    assert counts(space) == counts(space, "never")
    now = datetime(2024, 5, 1, 13, 5, tzinfo=timezone.utc)
    assert refresh_policy(spark, raw, rollup, now, timedelta(hours=13, minutes=5)) == [
        (hour(0), hour(1)), (hour(2), hour(3)),
    ]
    assert counts(space) == counts(space, "never")
    assert held_rows(spark, rollup) == 13 * 60 + 3


def test_open_bounds_keep_all_times(spark, path):
    far = [datetime(1, 1, 1), datetime(1850, 6, 1), START, datetime(9999, 12, 31, 23)]
    rows = spark.createDataFrame([(t, 1.0) for t in [*far, None]], "time timestamp_ntz, v double")
    rows.write.parquet(where := path("raw"))
    space = Workspace(spark, Source("r", where))

    def days(start, end):
        return [r[1] for r in space.frame("r", ["v"], start, end, "count", "1 day").collect()]

    assert days(None, None) == [1, 1, 1, 1]
    assert days("1900-01-01", None) == [1, 1] and days(None, "1900-01-01") == [1, 1]


def test_a_published_rollup_answers_exact_queries(spark, path):
    spark.sql("CREATE DATABASE IF NOT EXISTS published")
    readings(spark, range(0, 3000)).write.option("path", path("raw")).saveAsTable("published.r")
    raw = Source("r", "published.r", format="table")
    rollup = create_rollup(
        spark, raw, path("it's"), values=("v",), description="Hours of 'r'"
    )
    full_refresh(spark, raw, rollup)
    publish_rollup(spark, rollup, "published.r_1h")
    publish_rollup(spark, rollup, "published.r_1h")
    assert spark.table("published.r_1h").agg(F.sum("samples")).first()[0] == 3000
    space = Workspace.of_database(spark, "published", json_columns={"r": ["raw"]})
    found = space.registry.get("r_1h")
    assert (found.dims, found.values, found.description) == ((), ("v",), "Hours of 'r'")
    answer = space.query_timeseries("r", ["v"], START, START + timedelta(days=2), "avg", "1 day")
    assert answer["table_used"] == "r_1h"
    assert counts(space) == counts(space, "never")
    assert space.get_schema("r")["jsonb_top_keys"]["raw"]
    # Hours that a refresh adds are found without publishing again.
    readings(spark, range(3000, 3600)).write.mode("append").insertInto("published.r")
    refresh_window(spark, raw, rollup, START, START + timedelta(days=5))
    assert counts(Workspace.of_database(spark, "published")) == counts(space, "never")
    with pytest.raises(ValueError, match="rollup_mismatch"):
        other = create_rollup(spark, raw, path("other"), values=("v",))
        publish_rollup(spark, other, "published.r_1h")
