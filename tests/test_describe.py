"""Time ranges, JSON keys, storage by day, and tables of a catalog."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import Registry, Source, Workspace, create_rollup, full_refresh, store_by_day
from tidemark.functions.json_fields import json_fields, split_field
from tidemark.operators.describe import (
    json_key_profile,
    latest,
    newest_part,
    source_description,
    source_inventory,
    time_range,
)
from tidemark.sources.registry import time_column

EVENTS = "/root/testdata/sf0.001/events.parquet"
NTZ = T.StructField("time", T.TimestampNTZType())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def field(name, dtype=None):
    return T.StructField(name, dtype or T.TimestampType())


def test_time_column():
    assert time_column([field("a"), field("bucket"), field("time")]).name == "time"
    assert time_column([field("a"), field("bucket")]).name == "bucket"
    assert time_column([field("n", T.LongType()), field("b"), field("a")]).name == "b"
    assert time_column([field("a", T.TimestampNTZType())]).name == "a"
    assert time_column([field("time", T.DateType()), field("bucket", T.StringType())]) is None


PAYLOADS = [
    '{"a": 1, "b": 2}', '{"a": 1, "a": 2}', '[{"a": 1}]', "5", '"a"', "not json", '{"a": 1', "{}", None,
    '{"a": null, "c.d": "x"}', '{"a": {"b": 1}}', ' {"it\'s": true}',
]


def payload_frame(spark, payloads=PAYLOADS):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=i), p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "time timestamp_ntz, raw string")


def test_keys_of_objects_only(spark):
    profile = json_key_profile(payload_frame(spark), "raw", NTZ).collect()
    assert [(r["key"], r["occurrences"]) for r in profile] == [
        ("a", 4), ("b", 1), ("c.d", 1), ("it's", 1),
    ]


def test_fields(spark):
    def read(key):
        field = json_fields(F.col("raw"), [key]).getField(key)
        return [r[0] for r in payload_frame(spark).select(field).collect()]

    assert read("a") == ["1", "2", None, None, None, None, None, None, None, None, '{"b":1}', None]
    assert read("c.d")[9] == "x"
    assert read("it's")[11] == "true"
    assert split_field("raw->>'it''s'") == ("raw", "it's")
    assert split_field(" raw ->> 'c.d' ") == ("raw", "c.d")
    assert split_field("raw") is None and split_field("raw->>x") is None


def test_payloads_are_parsed_once(spark, path):
    where = path("t")
    rows = payload_frame(spark, ['{"a": 1, "A": 5, "b": 2}', '{"b": 4, "A": 7}', '[{"a": 9}]'])
    rows.withColumn("other", F.lit('{"a": 30}')).write.parquet(where)
    space = Workspace(spark, Source("t", where, json_columns=("raw", "other")))
    columns = ["raw->>'a'", "raw->>'b'", "raw->>'A'", "other->>'a'"]
    frame = space.frame("t", columns[:2], "2024-01-01", "2024-01-02", "sum", "1 day")
    assert plan(frame).count("from_json") == 1
    frame = space.frame("t", columns, "2024-01-01", "2024-01-02", "sum", "1 day")
    # Names that differ only in case would be ambiguous in a result.
    assert tuple(frame.collect()[0])[1:] == (1.0, 6.0, 12.0, 90.0)


@pytest.mark.parametrize("unit", ["keys", "rows"])
@pytest.mark.parametrize("sample", [1, 7, 50, 1000, 100_000])
def test_samples_are_the_newest(spark, unit, sample):
    """Against a count in Python, with rows of one, two or three keys and equal times."""
    start = datetime(2024, 1, 1)
    payloads = ['{"a":1}', '{"a":1,"b":2}', '{"b":1,"c":2,"d":3}', "7"]
    rows = [(start + timedelta(hours=i // 3), payloads[i * 7 % 4 if i % 50 else 3]) for i in range(2000)]
    frame = spark.createDataFrame(rows, "time timestamp_ntz, raw string").repartition(5)
    keys = {payloads[0]: "a", payloads[1]: "ab", payloads[2]: "bcd", payloads[3]: ""}
    if unit == "rows":
        newest = sorted(rows, key=lambda r: (-r[0].timestamp(), r[1]))[:sample]
        expected = Counter(k for _, p in newest for k in keys[p])
    else:
        found = sorted((-t.timestamp(), k) for t, p in rows for k in keys[p])
        expected = Counter(k for _, k in found[:sample])
    got = json_key_profile(frame, "raw", NTZ, sample=sample, sample_unit=unit).collect()
    assert {r["key"]: r["occurrences"] for r in got} == dict(expected)


def test_at_most_thirty_keys(spark):
    rows = [f'{{"k{i:02d}": 1, "all": 2}}' for i in range(40)]
    profile = json_key_profile(payload_frame(spark, rows), "raw", NTZ).collect()
    assert [r["key"] for r in profile] == ["all"] + [f"k{i:02d}" for i in range(29)]
    assert json_key_profile(payload_frame(spark, rows), "raw", NTZ, top=3).count() == 3


def test_variant_payloads(spark):
    frame = payload_frame(spark, ['{"a": 1, "b": "x"}', '{"a": 2}'])
    frame = frame.withColumn("raw", F.parse_json("raw"))
    assert Source("v", "unused", columns=frame.schema).payloads() == ["raw"]
    profile = json_key_profile(frame, "raw", NTZ).collect()
    assert [(r["key"], r["occurrences"]) for r in profile] == [("a", 2), ("b", 1)]


def test_newest_part_reads_the_end(spark):
    rows = spark.range(100_000).select(F.timestamp_seconds(F.col("id")).alias("time"))
    part = newest_part(rows, field("time"), 100)
    low = part.agg(F.min(F.unix_seconds("time"))).first()[0]
    assert low == 99_900
    assert newest_part(rows.limit(0), field("time"), 100).count() == 0
    assert newest_part(rows, field("time"), 10**6).count() == 100_000
    # A stray row far ahead, and a crowd within a second and at one instant.
    stray = rows.union(spark.sql("SELECT timestamp'9999-12-31T23:00:00Z'"))
    assert newest_part(stray, field("time"), 100).count() == 100
    crowd = spark.range(50_000).select(F.timestamp_micros(F.col("id") * 7).alias("time"))
    assert newest_part(crowd, field("time"), 100).count() == 100
    same = rows.unionByName(spark.range(9000).selectExpr("timestamp_seconds(200000) AS time"))
    assert newest_part(same, field("time"), 100).count() == 9000
    assert newest_part(same, field("time"), 9050).count() == 9000 + 2800  # the last whole hour


def test_latest(spark):
    rows = payload_frame(spark)
    assert [r["raw"] for r in latest(rows, NTZ, 2).collect()] == PAYLOADS[:-3:-1]


def test_storage_by_day(spark, path):
    where = path("events")
    raw = spark.read.parquet(EVENTS)
    store_by_day(raw, where, "ts")
    stored = Source("events", where, json_columns=("props",), date_column="date")
    frame = stored.read(spark)
    assert frame.drop("date").exceptAll(raw).count() == 0 and frame.count() == raw.count()
    assert [f.name for f in stored.resolved(spark).fields()] == raw.columns
    space = Workspace(spark, stored)
    bound = ("2024-01-03T12:00", "2024-01-05T11:00")
    query = space.frame("events", ["value"], *bound, bucket="15 minutes")
    scan = next(line for line in plan(query).splitlines() if "FileScan" in line)
    assert "date" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in scan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in scan
    assert query.collect() == Workspace(spark, Source("events", EVENTS)).frame(
        "events", ["value"], *bound, bucket="15 minutes"
    ).collect()


def test_queries_list_the_days_they_read(spark, path):
    where = path("events")
    store_by_day(spark.read.parquet(EVENTS), where, "ts")
    space = Workspace(spark, Source("events", where, date_column="date"))
    everything = space.registry.get("events").read(spark)

    def days(frame):
        return {f.split("date=")[1][:10] for f in frame.inputFiles()}

    def frame(start, end):
        return space.frame("events", ["value"], start, end, "count", "1 day")

    assert len(days(everything)) == 30
    few = frame("2024-01-03T12:00", "2024-01-05T00:00")
    assert days(few) == {"2024-01-03", "2024-01-04", "2024-01-05"}
    # Days without files, at an end of the range or all through it.
    assert days(frame("2023-12-20", "2024-01-01T05:00")) == {"2024-01-01"}
    assert frame("2021-01-01", "2021-02-01").collect() == []
    assert len(frame("2024-01-01", "2024-12-31").collect()) == 30
    assert len(frame("1900-01-01", "2100-01-01").collect()) == 30
    assert frame("2024-02-01", "2024-01-01").collect() == []


def test_time_range_of_storage_by_day_scans_two_days(spark, path):
    where = path("events")
    raw = spark.read.parquet(EVENTS)
    store_by_day(raw, where, "ts")
    stored = spark.read.parquet(where)
    ends = time_range(stored, "ts", "date")
    assert ends.collect() == time_range(raw, "ts").collect()
    scans = [line for line in plan(ends).splitlines() if "FileScan" in line]
    assert any("ReadSchema: struct<ts:" in s and "PartitionFilters: [((date" in s for s in scans)
    assert all("ts:" in s or "ReadSchema: struct<>" in s for s in scans)
    assert list(time_range(stored.limit(0), "ts", "date").first()) == [None, None]


def test_rows_without_a_time(spark, path):
    where = path("t")
    rows = spark.createDataFrame(
        [(datetime(2024, 1, 1), 1.0), (None, 5.0)], "time timestamp_ntz, v double"
    )
    store_by_day(rows, where, "time")
    space = Workspace(spark, Source("t", where, date_column="date"))
    answer = space.query_timeseries("t", ["v"], "2000-01-01", "2100-01-01", "sum", "1 day")
    assert answer["rows"] == [{"bucket": "2024-01-01T00:00:00+00:00", "v_sum": 1.0}]
    assert space.list_data_sources()[0]["time_range"]["max"] == "2024-01-01T00:00:00+00:00"


def test_declared_columns_keep_not_null(spark):
    columns = spark.read.parquet(EVENTS).schema
    columns["ts"].nullable = False
    space = Workspace(spark, Source("events", EVENTS, columns=columns))
    nullable = {c["name"]: c["nullable"] for c in space.get_schema("events")["columns"]}
    assert nullable["ts"] is False and nullable["value"] is True


def test_description_rows(spark):
    rows = source_description(spark, Source("events", EVENTS, json_columns=("props",))).collect()
    assert [(r["position"], r["name"], r["key"], r["occurrences"]) for r in rows][-2:] == [
        (6, "props", None, None), (6, "props", "k", 1000),
    ]
    assert [r["name"] for r in rows if r["is_time"]] == ["ts"]


def test_both_ends_of_an_exact_answer_prune_partitions(spark, path):
    """In a catalog table, where the days are not picked by path."""
    spark.sql("CREATE DATABASE IF NOT EXISTS edges")
    events = spark.read.parquet(EVENTS)
    dated = events.withColumn("day", F.to_date("ts"))
    dated.write.partitionBy("day").saveAsTable("edges.events")
    raw = Source("events", "edges.events", format="table", date_column="day")
    rollup = create_rollup(spark, raw, path("events_1h"), values=("value",))
    full_refresh(spark, raw, rollup)
    space = Workspace(spark, raw, rollup)
    call = ("events", ["value"], "2024-01-03T10:20", "2024-01-20T11:40", "sum", "1 day")
    exact = space.frame(*call)
    scan = next(s for s in plan(exact).splitlines() if "FileScan" in s and "[ts#" in s)
    filters = scan.split("PartitionFilters:")[1].split("], PushedFilters")[0]
    assert "OR" in filters and "2024-01-03" in filters and "2024-01-20" in filters
    totals = [r["value_sum"] for r in exact.collect()]
    raw_totals = [r["value_sum"] for r in space.frame(*call, rollup="never").collect()]
    assert totals == pytest.approx(raw_totals)


def test_an_empty_registry(spark):
    assert source_inventory(spark, Registry()).collect() == []


def test_tables_of_a_database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS home")
    spark.sql(
        "CREATE TABLE home.meter (time TIMESTAMP, kwh DOUBLE, day DATE) USING parquet "
        "PARTITIONED BY (day) COMMENT 'Smart meter'"
    )
    spark.sql(
        "INSERT INTO home.meter SELECT timestamp_seconds(1704067200 + id * 600), id, "
        "date_add(DATE'2024-01-01', CAST(id DIV 144 AS INT)) FROM range(432)"
    )
    spark.sql(
        "CREATE TABLE home.meter_1h USING parquet AS SELECT date_trunc('HOUR', time) AS bucket, "
        "avg(kwh) AS kwh, count(*) AS samples FROM home.meter GROUP BY 1"
    )
    spark.sql("CREATE TABLE home.loose_1h USING parquet AS SELECT 1 AS bucket")
    space = Workspace.of_database(spark, "home", {"meter": "day"})
    records = space.list_data_sources()
    assert [(r["schema"], r["name"], r["kind"]) for r in records] == [
        ("home", "loose_1h", "hypertable"),
        ("home", "meter", "hypertable"),
        ("home", "meter_1h", "continuous_aggregate"),
    ]
    assert records[1]["description"] == "Smart meter"
    assert [c["name"] for c in space.get_schema("meter")["columns"]] == ["time", "kwh"]
    call = ("meter", ["kwh"], "2024-01-01", "2024-01-02T23:59:59", "max", "1 day")
    assert [r["kwh_max"] for r in space.query_timeseries(*call)["rows"]] == [143, 287]
    assert "PartitionFilters: [isnotnull(day" in plan(space.frame(*call))
    unasked = Workspace.of_database(spark, "home")
    assert unasked.frame(*call).collect() == space.frame(*call).collect()
    assert "PartitionFilters: []" in plan(unasked.frame(*call))
    stored = space.query_timeseries(*call, rollup="stored")
    assert stored["table_used"] == "meter_1h"
    assert [r["kwh_max"] for r in stored["rows"]] == [140.5, 284.5]


@pytest.mark.parametrize("kind", ["orc", "json", "csv"])
def test_other_formats(spark, path, kind):
    where = path("events")
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.format(kind).save(where)
    source = Source("events", where, format=kind, columns=events.schema)
    call = ("events", ["value", "user_id"], "2024-01-01", "2024-02-01", "max", "1 week")
    expected = Workspace(spark, Source("events", EVENTS)).query_timeseries(*call)
    assert Workspace(spark, source).query_timeseries(*call) == expected
