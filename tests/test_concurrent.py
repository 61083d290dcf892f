"""Numbered notes, refreshes that run at once, and runs of absorb that follow each other."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import (
    Source,
    Workspace,
    absorb,
    create_rollup,
    refresh_window,
    retire_landed,
    store_by_day,
    stream_rollup,
)
from tidemark.functions.instants import to_micros
from tidemark.functions.local import columns
from tidemark.operators import refresh
from tidemark.operators.notes import notes_version, read_notes, update_notes, write_notes_after
from tidemark.operators.refresh import claimed, coverage

START = datetime(2024, 5, 1)
NUMBERS = columns(n="long", day="date")


def readings(spark, minutes):
    rows = [(START + timedelta(minutes=m), "ab"[m % 2], float(m % 97)) for m in minutes]
    return spark.createDataFrame(rows, "time timestamp, k string, v double")


def hours(low, high):
    return to_micros(START + timedelta(hours=low)), to_micros(START + timedelta(hours=high))


def equal_to_raw(spark, raw, rollup):
    space = Workspace(spark, raw, rollup)
    call = ("r", ["v"], START, START + timedelta(days=9), "sum", "3 hours")
    exact, never = space.query_timeseries(*call), space.query_timeseries(*call, rollup="never")
    assert exact["rows"] == never["rows"] and never["rows"]
    return exact["table_used"]


@pytest.fixture
def table(spark, path):
    raw = Source("r", path("raw"), date_column="date")
    store_by_day(readings(spark, range(0, 3 * 1440, 11)), raw.location, "time")
    return raw, create_rollup(spark, raw, path("r"), dims=("k",), values=("v",))


def test_a_version_is_written_once(spark, path):
    where = path()
    assert notes_version(spark, where, "x") == 0 and read_notes(spark, where, "x", NUMBERS) == []
    assert write_notes_after(spark, where, "x", NUMBERS, [(1, START.date())], 0)
    assert not write_notes_after(spark, where, "x", NUMBERS, [(2, None)], 0)
    assert [tuple(r) for r in read_notes(spark, where, "x", NUMBERS)] == [(1, START.date())]

    def add(n):
        update_notes(spark, where, "x", NUMBERS, lambda rows: [*map(tuple, rows), (n, None)])

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(2, 14)))
    assert sorted(r["n"] for r in read_notes(spark, where, "x", NUMBERS)) == list(range(1, 14))
    assert notes_version(spark, where, "x") == 13


def test_a_claimed_day_is_left_alone(spark, table):
    raw, rollup = table
    refresh_window(spark, raw, rollup, START, START + timedelta(days=1))
    with claimed(spark, rollup, [hours(3, 5)]) as claim:
        assert claim.held == [hours(0, 24)] and coverage(spark, rollup) == []
        with pytest.raises(ValueError, match="refresh_in_progress"):
            refresh_window(spark, raw, rollup, START + timedelta(hours=20), START + timedelta(days=2))
        assert coverage(spark, rollup) == []
        refresh_window(spark, raw, rollup, START + timedelta(days=1), START + timedelta(days=2))
        assert coverage(spark, rollup) == [hours(24, 48)]
    assert coverage(spark, rollup) == [hours(0, 48)]
    with pytest.raises(ZeroDivisionError), claimed(spark, rollup, [hours(3, 5)]):
        raise ZeroDivisionError
    assert coverage(spark, rollup) == [hours(24, 48)]
    assert equal_to_raw(spark, raw, rollup) == "r_1h"


def test_a_job_that_comes_back_too_late_declares_nothing(spark, table, monkeypatch):
    raw, rollup = table
    with pytest.raises(ValueError, match="refresh_overtaken"):
        with claimed(spark, rollup, [hours(0, 48)]) as claim:
            monkeypatch.setattr(refresh, "CLAIM_LIMIT", timedelta(0))
            refresh_window(spark, raw, rollup, START, START + timedelta(hours=7))
            monkeypatch.undo()
            claim.done.append(hours(0, 48))
    assert coverage(spark, rollup) == [hours(0, 7)]
    equal_to_raw(spark, raw, rollup)


def test_refreshes_at_once(spark, table):
    raw, rollup = table
    windows = [(0, 30), (20, 50), (48, 72), (5, 9)]

    def run(window):
        try:
            return refresh_window(spark, raw, rollup, *(START + timedelta(hours=h) for h in window))
        except ValueError as error:
            assert str(error).startswith("refresh_in_progress")
            return None

    with ThreadPoolExecutor(len(windows)) as pool:
        done = [span for span in pool.map(run, windows) if span is not None]
    assert done
    held = refresh.merge(done)
    assert coverage(spark, rollup) == held
    bucket = F.unix_micros("bucket")
    stored = rollup.read(spark).select(bucket.alias("at"), "samples").collect()
    assert {r["at"] for r in stored} == {h for a, b in held for h in range(a, b, 3_600_000_000)}
    equal_to_raw(spark, raw, rollup)


def test_absorb_reads_days_that_landed_since(spark, path):
    raw = Source("r", path("raw"))
    readings(spark, []).write.parquet(raw.location)
    rollup = create_rollup(spark, raw, path("r"), dims=("k",), values=("v",))
    landing, state = path("landing"), path("state")

    def run(minutes):
        readings(spark, minutes).write.mode("append").parquet(raw.location)
        stream_rollup(spark, raw, rollup, landing, state, retention="30d").awaitTermination()
        return absorb(spark, rollup, landing)

    assert run(range(0, 2 * 1440 + 200, 7)) == [hours(0, 51)]
    assert absorb(spark, rollup, landing) == []
    with pytest.raises(ValueError, match="invalid_keep"):
        retire_landed(spark, rollup, landing, timedelta(hours=1))
    # The first day is closed and taken in; the next runs do without its files.
    assert retire_landed(spark, rollup, landing, timedelta(days=1)) == [START.date()]
    assert retire_landed(spark, rollup, landing, timedelta(days=1)) == []
    # Hours that no reading fell into pass as complete.
    assert run(range(2 * 1440 + 600, 3 * 1440, 7)) == [hours(51, 71)]
    assert coverage(spark, rollup) == [hours(0, 71)]
    assert equal_to_raw(spark, raw, rollup) == "r_1h"
    # What a refresh withdrew is not declared again from days that are not read.
    with pytest.raises(ZeroDivisionError), claimed(spark, rollup, [hours(3, 5)]):
        raise ZeroDivisionError
    assert run(range(3 * 1440, 3 * 1440 + 130, 7)) == [hours(71, 74)]
    assert coverage(spark, rollup) == [hours(24, 74)]
    equal_to_raw(spark, raw, rollup)
