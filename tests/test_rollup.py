"""Rollups: contents, refreshes, coverage, and exact answers at random ranges."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark import Source, Workspace, create_rollup, full_refresh, refresh_policy, refresh_window
from tidemark.functions.instants import to_micros
from tidemark.functions.spans import merge, subtract
from tidemark.operators.refresh import coverage, replace_hours
from tidemark.plans import timeseries
from tidemark.sources.storage import store_by_day

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("events")
    raw = Source("events", EVENTS, json_columns=("props",))
    rollup = create_rollup(
        spark, raw, str(root / "events_1h"), dims=("event_type",), values=("value", "user_id")
    )
    full_refresh(spark, raw, rollup)
    return Workspace(spark, raw, rollup)


def rows_of(space, **call):
    return space.query_timeseries("events", **call)


def agree(one, other):
    assert one["row_count"] == other["row_count"]
    for a, b in zip(one["rows"], other["rows"], strict=True):
        assert a.pop("bucket") == b.pop("bucket")
        assert a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("seed", range(12))
def test_exact_answers_equal_raw_ones(events, seed):
    pick = random.Random(seed)
    start = datetime(2023, 12, 31, 20) + timedelta(seconds=pick.randrange(20 * 86_400))
    end = start + timedelta(seconds=pick.choice([0, 1800, 7200, 90_000, 40 * 86_400]))
    if pick.random() < 0.3:
        end = end.replace(minute=59, second=59, microsecond=999_999)
    call = {
        "columns": pick.choice([["value"], ["value", "user_id"], []]),
        "from_ts": start,
        "to_ts": end,
        "aggregation": ["avg", "sum", "min", "max", "count"][seed % 5],
        "bucket": pick.choice(["1 hour", "7 hours", "1 day", "5 days", "1 week", "1 month"]),
        "filters": pick.choice([None, {"event_type": "error"}, {"event_type": None}]),
    }
    exact = rows_of(events, **call)
    raw = rows_of(events, **call, rollup="never")
    agree(exact, raw)
    types = [events.frame("events", *call.values(), rollup=m).dtypes for m in ("exact", "never")]
    assert types[0] == types[1]


def test_an_aligned_range_reads_no_raw_rows(events):
    frame = events.frame("events", ["value"], "2024-01-02", "2024-01-04T23:59:59.999999", bucket="1 day")
    scans = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "events_1h" in str(frame.inputFiles()) and "ts#" not in scans
    assert not any("events.parquet" in f for f in frame.inputFiles())


def test_contents(spark, events):
    rollup = events.registry.get("events_1h").read(spark)
    assert rollup.columns[:5] == ["bucket", "event_type", "value", "user_id", "samples"]
    raw = spark.read.parquet(EVENTS)
    assert rollup.agg(F.sum("samples")).first()[0] == raw.count()
    off = rollup.filter(F.abs(F.col("value") - F.col("value__sum") / F.col("value__count")) > 1e-9)
    assert off.count() == 0


def test_the_open_hour_is_stored_but_not_covered(spark, events):
    rollup = events.registry.get("events_1h")
    last = spark.read.parquet(EVENTS).agg(F.max("ts")).first()[0]
    open_hour = last.replace(minute=0, second=0, microsecond=0)
    assert rollup.read(spark).filter(F.col("bucket") == F.lit(str(open_hour)).cast("timestamp_ntz")).count()
    assert coverage(spark, rollup)[-1][1] == to_micros(open_hour)


def test_empty_at_creation(spark, path):
    raw = Source("events", EVENTS)
    rollup = create_rollup(spark, raw, path(), dims=("event_type",), values=("value",))
    space = Workspace(spark, raw, rollup)
    call = {"columns": ["value"], "from_ts": "2024-01-01", "to_ts": "2024-03-01", "bucket": "1 day"}
    exact = rows_of(space, **call)
    assert exact["table_used"] == "events" and exact["row_count"] == 30
    stored = rows_of(space, **call, rollup="stored")
    assert stored["table_used"] == "events_1h" and stored["row_count"] == 0
    assert space.list_data_sources()[1]["time_range"] == {"min": None, "max": None}
    # Creating it again keeps what is there.
    full_refresh(spark, raw, rollup)
    create_rollup(spark, raw, rollup.location, dims=("event_type",), values=("value",))
    assert rollup.read(spark).count() > 0


def day_rows(spark, start, minutes, value):
    rows = [(start + timedelta(minutes=m), "a" if m % 3 else None, value) for m in minutes]
    return spark.createDataFrame(rows, "time timestamp_ntz, k string, v int")


def test_windowed_refresh_keeps_other_hours(spark, path):
    start = datetime(2024, 5, 1)
    first = day_rows(spark, start, range(0, 4 * 1440, 10), 1)
    where = path("raw")
    store_by_day(first, where, "time")
    raw = Source("r", where, date_column="date")
    rollup = create_rollup(spark, raw, path("r_1h"), dims=("k",), values=("v",))
    full_refresh(spark, raw, rollup)
    covered = coverage(spark, rollup)
    # Late rows everywhere; only the hours of the window take notice.
    store_by_day(day_rows(spark, start, range(5, 4 * 1440, 10), 3), where, "time", mode="append")
    span = refresh_window(spark, raw, rollup, "2024-05-02T05:30", "2024-05-03T02:10")
    assert span == (to_micros("2024-05-02T06:00"), to_micros("2024-05-03T02:00"))
    sums = {
        r["bucket"]: (r["s"], r["n"])
        for r in rollup.read(spark).groupBy("bucket").agg(
            F.sum("v__sum").alias("s"), F.sum("samples").alias("n")
        ).collect()
    }
    assert len(sums) == 96
    inside = [start.replace(day=2, hour=6) + timedelta(hours=h) for h in range(20)]
    for hour, got in sums.items():
        assert got == ((24, 12) if hour in inside else (6, 6)), hour
    assert coverage(spark, rollup) == covered
    # Running it again changes nothing.
    refresh_window(spark, raw, rollup, "2024-05-02T05:30", "2024-05-03T02:10")
    assert rollup.read(spark).agg(F.sum("samples")).first()[0] == 20 * 12 + 76 * 6


def test_refresh_drops_hours_whose_rows_are_gone(spark, path):
    start = datetime(2024, 5, 1)
    both = day_rows(spark, start, range(0, 3 * 1440, 10), 1)
    old, new = path("old"), path("new")
    store_by_day(both, old, "time")
    rollup = create_rollup(spark, Source("r", old, date_column="date"), path("r_1h"), values=("v",))
    full_refresh(spark, Source("r", old, date_column="date"), rollup)
    store_by_day(both.filter(F.dayofmonth("time") != 2), new, "time")
    raw = Source("r", new, date_column="date")
    refresh_window(spark, raw, rollup, "2024-05-01T12:00", "2024-05-03T06:00")
    days = rollup.read(spark).groupBy("date").count().orderBy("date").collect()
    assert [(r[0], r[1]) for r in days] == [(date(2024, 5, 1), 24), (date(2024, 5, 3), 24)]
    space = Workspace(spark, raw, rollup)
    call = {"columns": ["v"], "from_ts": "2024-05-01", "to_ts": "2024-05-04", "aggregation": "sum"}
    agree(
        space.query_timeseries("r", **call), space.query_timeseries("r", **call, rollup="never")
    )


def test_refresh_windows_leave_gaps_to_raw_rows(spark, path):
    where = path("raw")
    store_by_day(day_rows(spark, datetime(2024, 5, 1), range(0, 6 * 1440, 7), 2), where, "time")
    raw = Source("r", where, date_column="date")
    rollup = create_rollup(spark, raw, path("r_1h"), values=("v",))
    assert refresh_window(spark, raw, rollup, "2024-05-01T01:10", "2024-05-01T01:50") is None
    refresh_window(spark, raw, rollup, "2024-05-01T00:00", "2024-05-02T06:00")
    now = datetime(2024, 5, 5, 3, 4, tzinfo=timezone.utc)
    span = refresh_policy(spark, raw, rollup, now, timedelta(days=1), timedelta(minutes=5))
    assert span == [(to_micros("2024-05-04T04:00"), to_micros("2024-05-05T02:00"))]
    assert coverage(spark, rollup) == [
        (to_micros("2024-05-01"), to_micros("2024-05-02T06:00")), *span,
    ]
    space = Workspace(spark, raw, rollup)
    for aggregation in ("sum", "avg", "count"):
        for bucket in ("1 hour", "1 day"):
            call = {
                "columns": ["v"], "from_ts": "2024-05-01T00:01", "to_ts": "2024-05-06T10:00",
                "aggregation": aggregation, "bucket": bucket,
            }
            exact = space.query_timeseries("r", **call)
            assert exact["table_used"] == "r_1h"
            agree(exact, space.query_timeseries("r", **call, rollup="never"))


def test_scheduled_refresh_recomputes_what_changed(spark, path):
    start, where = datetime(2024, 5, 1), path("raw")
    add = lambda minutes: store_by_day(
        day_rows(spark, start, minutes, 1), where, "time", mode="append"
    )
    add(range(0, 4 * 1440 + 200, 10))
    raw = Source("r", where, date_column="date")
    rollup = create_rollup(spark, raw, path("r_1h"), dims=("k",), values=("v",))
    full_refresh(spark, raw, rollup)

    def run(hour):
        now = datetime(2024, 5, 5, hour, 10, tzinfo=timezone.utc)
        spans = refresh_policy(spark, raw, rollup, now, start_offset=timedelta(days=3))
        return [tuple((t - to_micros(start)) // (3600 * 10**6) for t in span) for span in spans]

    # All is covered up to the last hour, which has begun to fill.
    assert run(4) == [(99, 100)]
    assert run(4) == []
    # New rows today and late rows on the third day, hours 48 to 72.
    add(range(4 * 1440 + 205, 4 * 1440 + 300, 10))
    add([2 * 1440 + 3])
    assert run(5) == [(48, 72), (96, 101)]
    assert run(5) == []
    assert run(6) == [(101, 102)]
    # The window begins within the second day, whose covered hours are all taken in.
    add([1440 + 3, 1440 + 423])
    assert run(6) == [(24, 48)]
    assert run(6) == []
    hours = rollup.read(spark).groupBy("bucket").agg(F.sum("samples").alias("n")).collect()
    counts = {(r["bucket"] - start) // timedelta(hours=1): r["n"] for r in hours}
    assert counts[24] == 7 and counts[31] == 7 and counts[48] == 7 and counts[99] == 6
    assert sum(counts.values()) == raw.read(spark).count()


def test_late_rows_are_counted_before_and_after_their_refresh(spark, path):
    where = path("raw")
    start = datetime(2024, 5, 1)
    store_by_day(day_rows(spark, start, range(0, 12 * 1440, 7), 2), where, "time")
    raw = Source("r", where, date_column="date")
    rollup = create_rollup(spark, raw, path("r_1h"), values=("v",))
    full_refresh(spark, raw, rollup)
    space = Workspace(spark, raw, rollup)

    def counts(mode):
        call = (["v"], "2024-05-01", "2024-05-12", "count", "1 day")
        return space.frame("r", *call, rollup=mode).collect()

    assert counts("exact") == counts("never")
    late = day_rows(spark, start, range(1, 1440, 30), 2)
    store_by_day(late, where, "time", mode="append")
    assert counts("exact") == counts("never") != counts("stored")
    now = datetime(2024, 5, 12, 20, 4, tzinfo=timezone.utc)
    assert refresh_policy(spark, raw, rollup, now, start_offset=timedelta(days=7)) == []
    assert counts("exact") == counts("never")
    day = (to_micros("2024-05-01"), to_micros("2024-05-02"))
    assert refresh_policy(spark, raw, rollup, now, start_offset=None) == [day]
    answer = space.query_timeseries("r", ["v"], "2024-05-01", "2024-05-02", "count", "1 day")
    assert answer["table_used"] == "r_1h"
    assert counts("exact") == counts("never")


def test_scheduled_refresh_without_files(spark, path):
    raw = Source("events", EVENTS)
    rollup = create_rollup(spark, raw, path(), values=("value",))
    now = datetime(2024, 1, 10, 0, 4, tzinfo=timezone.utc)
    whole = [(to_micros("2024-01-03T01:00"), to_micros("2024-01-09T23:00"))]
    assert refresh_policy(spark, raw, rollup, now) == whole
    assert refresh_policy(spark, raw, rollup, now) == []


def test_lost_coverage_is_made_good_by_raw_rows(spark, path):
    """What a job that died while replacing days leaves behind."""
    where = path("raw")
    store_by_day(day_rows(spark, datetime(2024, 5, 1), range(0, 2 * 1440, 7), 2), where, "time")
    raw = Source("r", where, date_column="date")
    rollup = create_rollup(spark, raw, path("r_1h"), values=("v",))
    full_refresh(spark, raw, rollup)

    class Lost(Exception):
        pass

    class Dying:
        """Stands for fresh hours whose computation fails."""

        def unionByName(self, other):
            raise Lost

    with pytest.raises(Lost):
        replace_hours(spark, rollup, Dying(), (to_micros("2024-05-01T03:00"), to_micros("2024-05-01T05:00")))
    assert coverage(spark, rollup) == [(to_micros("2024-05-02"), to_micros("2024-05-02T23:00"))]


def test_a_refresh_during_planning_sends_the_query_to_raw_rows(spark, path, monkeypatch):
    where = path("raw")
    store_by_day(day_rows(spark, datetime(2024, 5, 1), range(0, 2 * 1440, 7), 2), where, "time")
    raw = Source("r", where, date_column="date")
    rollup = create_rollup(spark, raw, path("r_1h"), values=("v",))
    full_refresh(spark, raw, rollup)
    space = Workspace(spark, raw, rollup)
    call = {"columns": ["v"], "from_ts": "2024-05-01", "to_ts": "2024-05-03", "bucket": "1 day"}
    before = space.query_timeseries("r", **call)
    assert before["table_used"] == "r_1h"
    merged = timeseries.merged_aggregate

    def interrupted(*args):
        refresh_window(spark, raw, rollup, "2024-05-01", "2024-05-01T05:00")
        return merged(*args)

    monkeypatch.setattr(timeseries, "merged_aggregate", interrupted)
    during = space.query_timeseries("r", **call)
    assert during["table_used"] == "r"
    agree(before, during)


def test_reserved_and_non_numeric_columns(spark, path):
    raw = Source("events", EVENTS)
    with pytest.raises(ValueError, match="unknown_columns"):
        create_rollup(spark, raw, path(), dims=("nothing",))
    with pytest.raises(ValueError, match="invalid_column_type"):
        create_rollup(spark, raw, path(), values=("props",))
    odd = spark.read.parquet(EVENTS).withColumnRenamed("user_id", "samples")
    odd.createOrReplaceTempView("odd_events")
    with pytest.raises(ValueError, match="reserved_columns"):
        create_rollup(spark, Source("o", "odd_events", format="table"), path(), values=("samples",))


def test_decimal_and_float_columns(spark, path):
    frame = spark.range(1000).select(
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("time"),
        (F.col("id") / 7).cast("decimal(12,3)").alias("d"),
        F.when(F.col("id") % 5 > 0, (F.col("id") / 8).cast("float")).alias("f"),
        F.lit(None).cast("smallint").alias("none"),
    )
    where = path("raw")
    store_by_day(frame, where, "time")
    raw = Source("r", where, date_column="date")
    rollup = create_rollup(spark, raw, path("r_1h"), values=("d", "f", "none"))
    full_refresh(spark, raw, rollup)
    space = Workspace(spark, raw, rollup)
    for aggregation in ("avg", "sum", "min", "max", "count"):
        call = (["d", "f", "none"], "2023-11-14", "2023-11-16", aggregation, "1 day")
        exact, never = space.frame("r", *call), space.frame("r", *call, rollup="never")
        assert exact.dtypes == never.dtypes
        for a, b in zip(exact.collect(), never.collect(), strict=True):
            assert a["bucket"] == b["bucket"]
            assert a[1:] == pytest.approx(b[1:])


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_exact_answers_in_other_session_zones(spark, path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.range(5000).select(
            # Across the change of clocks in New York.
            F.timestamp_seconds(F.lit(1_709_900_000) + F.col("id") * 97).alias("time"),
            F.col("id").alias("v"),
        )
        where = path("raw")
        store_by_day(frame, where, "time")
        raw = Source("r", where, date_column="date")
        rollup = create_rollup(spark, raw, path("r_1h"), values=("v",))
        full_refresh(spark, raw, rollup)
        space = Workspace(spark, raw, rollup)
        by_second = {}
        for i in range(5000):
            day = (1_709_900_000 + i * 97) // 86_400
            by_second[day] = by_second.get(day, 0) + i
        call = {"columns": ["v"], "from_ts": "2024-03-01", "to_ts": "2024-04-01",
                "aggregation": "sum", "bucket": "1 day"}
        exact = space.query_timeseries("r", **call)
        assert exact["table_used"] == "r_1h"
        assert [r["v_sum"] for r in exact["rows"]] == list(by_second.values())
        assert all(r["bucket"].endswith("T00:00:00+00:00") for r in exact["rows"])
        call |= {"from_ts": "2024-03-09T04:44:44", "to_ts": "2024-03-11T03:03:03", "bucket": "1 hour"}
        agree(space.query_timeseries("r", **call), space.query_timeseries("r", **call, rollup="never"))
        source = space.list_data_sources()[0]["time_range"]
        assert source["min"] == "2024-03-08T12:13:20+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_names_with_dots_and_blanks(spark, path):
    frame = spark.range(500).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("at.time"),
        (F.col("id") % 3).alias("the key"),
        F.col("id").cast("double").alias("flow.temp"),
        F.lit('{"x.y": 2}').alias("raw.json"),
    )
    where = path("raw")
    store_by_day(frame, where, "at.time")
    raw = Source("r", where, date_column="date", json_columns=("raw.json",))
    rollup = create_rollup(spark, raw, path("r_1h"), ("the key",), ("flow.temp",))
    full_refresh(spark, raw, rollup)
    space = Workspace(spark, raw, rollup)
    call = {
        "columns": ["flow.temp"], "from_ts": "2023-11-14T22:30", "to_ts": "2023-11-16",
        "aggregation": "sum", "bucket": "2 hours", "filters": {"the key": 1},
    }
    exact = space.query_timeseries("r", **call)
    assert exact["table_used"] == "r_1h" and list(exact["rows"][0]) == ["bucket", "flow.temp_sum"]
    agree(exact, space.query_timeseries("r", **call, rollup="never"))
    assert space.get_schema("r")["jsonb_top_keys"] == {"raw.json": [{"key": "x.y", "occurrences": 500}]}
    assert space.list_data_sources()[0]["time_column"] == "at.time"


def test_a_rollup_keeps_its_definition(spark, path):
    raw, where = Source("events", EVENTS), path()
    create_rollup(spark, raw, where, ("event_type",), ("value",))
    for dims, values in [((), ("value",)), (("event_type",), ("value", "user_id"))]:
        with pytest.raises(ValueError, match="rollup_mismatch"):
            create_rollup(spark, raw, where, dims, values)


def test_spans():
    assert subtract([(0, 10)], [(3, 5)]) == [(0, 3), (5, 10)]
    assert subtract([(0, 10), (20, 30)], [(5, 25)]) == [(0, 5), (25, 30)]
    assert subtract([(0, 10)], [(0, 10)]) == []
    assert subtract([(0, 10)], [(12, 13)]) == [(0, 10)]
    assert merge([(5, 8), (0, 3), (3, 4), (7, 9)]) == [(0, 4), (5, 9)]
