"""Bucket starts against DuckDB, for both time types and any session zone."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.buckets import Width, bucket_start, parse_width
from tidemark.functions.instants import collected_micros, iso_text, to_micros, utc_date

WIDTHS = [
    "1 second", "7 seconds", "90 seconds", "15 minutes", "1 hour", "7 hours", "1 day", "5 days",
    "1 week", "2 weeks", "1 month", "3 months", "5 months", "12 months",
]


def moments():
    pick = random.Random(7)
    start = datetime(1900, 1, 1)
    found = [start + timedelta(microseconds=pick.randrange(150 * 365 * 86_400 * 10**6)) for _ in range(300)]
    edges = [datetime(y, m, 1) for y in (1969, 1970, 1999, 2000, 2024) for m in (1, 3, 11)]
    # Hours at which clocks change in Berlin and New York.
    edges += [datetime(2024, 3, 31, 1), datetime(2024, 10, 27, 0, 30), datetime(2024, 10, 27, 1, 30),
              datetime(2024, 11, 3, 5, 30), datetime(2024, 11, 3, 6, 30)]
    return found + edges + [e - timedelta(microseconds=1) for e in edges]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_buckets_agree_with_duckdb(spark, zone, kind):
    times = moments()
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t(i INTEGER, ts TIMESTAMP)")
    connection.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(times)))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        micros = spark.createDataFrame(
            [(i, to_micros(t)) for i, t in enumerate(times)], "i int, us long"
        )
        if kind == "timestamp":
            dtype = T.TimestampType()
            rows = micros.select("i", F.timestamp_micros("us").alias("ts"))
        else:
            dtype = T.TimestampNTZType()
            rows = spark.createDataFrame(list(enumerate(times)), "i int, ts timestamp_ntz")
        starts = rows.select(
            "i",
            iso_text(F.col("ts"), dtype).alias("iso"),
            utc_date(F.col("ts"), dtype).alias("day"),
            "ts",
        )
        for w in WIDTHS:
            starts = starts.withColumn(w, bucket_start(F.col("ts"), dtype, parse_width(w)))
            assert starts.schema[w].dataType == dtype
        got = {r["i"]: r for r in starts.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for i, t in enumerate(times):
        assert got[i]["iso"] == t.replace(tzinfo=timezone.utc).isoformat()
        assert got[i]["day"] == t.date()
    for w in WIDTHS:
        expected = connection.execute(
            f"SELECT i, time_bucket(INTERVAL '{w}', ts) FROM t"
        ).fetchall()
        for i, start in expected:
            assert collected_micros(got[i][w], dtype) == to_micros(start), (w, times[i])


@pytest.mark.parametrize(
    "text, width",
    [
        ("15 minutes", Width(seconds=900)),
        (" 1hour ", Width(seconds=3600)),
        ("2 Weeks", Width(seconds=1_209_600)),
        ("3 months", Width(months=3)),
    ],
)
def test_widths(text, width):
    assert parse_width(text) == width


@pytest.mark.parametrize(
    "text",
    ["", "hour", "-1 hour", "1.5 hours", "1 hour 30 minutes", "1 year", "0 days", "1 hour; --",
     "99999999999999 weeks", "3000000000 months", None, 5],
)
def test_widths_refused(text):
    with pytest.raises(ValueError, match="invalid_bucket_interval"):
        parse_width(text)


@pytest.mark.parametrize(
    "text, whole", [("90 minutes", False), ("120 minutes", True), ("30 minutes", False),
                    ("1 day", True), ("1 month", True), ("3601 seconds", False)],
)
def test_whole_hours(text, whole):
    assert parse_width(text).holds_whole_hours() is whole
