"""The three questions over a small home, end to end."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from conftest import END, MINUTES

from tidemark import Registry, Source, Workspace, plan_timeseries

FROM, TO = "2024-03-10T07:40:00+00:00", "2024-03-10T11:41:00+00:00"
LAST = datetime.fromisoformat(END)


def readings():
    """Time and value of the bus readings, computed without Spark."""
    first = LAST - timedelta(minutes=MINUTES - 1)
    return [
        (first + timedelta(minutes=i), f"zone-{i // 3 % 4}", 5.5 + 7 * i % 16 / 4)
        for i in range(MINUTES)
    ]


def bucketed(minutes, keep=lambda t, zone: True):
    groups = defaultdict(list)
    for at, zone, value in readings():
        if keep(at, zone):
            seconds = int(at.timestamp()) // (minutes * 60) * minutes * 60
            groups[datetime.fromtimestamp(seconds, timezone.utc).isoformat()].append(value)
    return dict(sorted(groups.items()))


def test_sources(home):
    records = home.list_data_sources()
    assert [(r["name"], r["kind"], r["time_column"]) for r in records] == [
        ("boiler", "hypertable", "time"),
        ("bus", "hypertable", "time"),
        ("bus_1h", "continuous_aggregate", "bucket"),
    ]
    assert records[1]["time_range"] == {"min": "2024-03-10T08:00:00+00:00", "max": END}
    assert records[2]["time_range"]["max"] == "2024-03-10T11:00:00+00:00"
    assert records[1]["description"] == "Bus telegrams" and records[0]["description"] is None
    assert set(records[0]) == {
        "name", "schema", "kind", "description", "time_column", "time_range",
    }


def test_schema(home):
    record = home.get_schema("boiler")
    assert record["time_column"] == "time"
    assert [c["name"] for c in record["columns"]] == ["time", "device", "raw"]
    assert record["columns"][0] == {"name": "time", "type": "timestamp", "nullable": True}
    assert {k["key"]: k["occurrences"] for k in record["jsonb_top_keys"]["raw"]} == {
        "speed": 221, "load": 221, "alarm": 221,
    }
    assert record["hint"] is None
    assert "elsewhere" in home.get_schema("bus")["hint"]
    assert home.get_schema("bus_1h")["jsonb_top_keys"] == {}


def test_schema_of_unknown_table(home):
    with pytest.raises(ValueError, match="unknown_table: nothing"):
        home.get_schema("nothing")


def test_minute_buckets_read_raw_rows(home):
    result = home.query_timeseries("bus", ["value"], FROM, TO, "avg", "5 minutes")
    assert (result["table_requested"], result["table_used"]) == ("bus", "bus")
    assert result["kind_used"] == "hypertable"
    expected = bucketed(5)
    assert result["row_count"] == len(expected) == 45
    assert {r["bucket"]: r["value_avg"] for r in result["rows"]} == pytest.approx(
        {k: sum(v) / len(v) for k, v in expected.items()}
    )
    assert [r["bucket"] for r in result["rows"]] == sorted(expected)


@pytest.mark.parametrize("bucket", ["1 hour", "60 minutes", "3600 seconds", "1hour ", "1 HOURS"])
def test_hour_buckets_use_the_rollup(home, bucket):
    result = home.query_timeseries("bus", ["value"], FROM, TO, "avg", bucket)
    assert result["table_used"] == "bus_1h"
    assert result["kind_used"] == "continuous_aggregate"
    assert {r["bucket"]: r["value_avg"] for r in result["rows"]} == pytest.approx(
        {k: sum(v) / len(v) for k, v in bucketed(60).items()}
    )


@pytest.mark.parametrize(
    "aggregation, fold",
    [("sum", sum), ("min", min), ("max", max), ("count", len), ("avg", lambda v: sum(v) / len(v))],
)
def test_aggregates_agree_in_both_ways(home, aggregation, fold):
    expected = {k: fold(v) for k, v in bucketed(60, lambda t, zone: zone == "zone-3").items()}
    for mode in ("exact", "never"):
        result = home.query_timeseries(
            "bus", ["value"], FROM, TO, aggregation, "1 hour", {"zone": "zone-3"}, rollup=mode
        )
        got = {r["bucket"]: r[f"value_{aggregation}"] for r in result["rows"]}
        assert got == pytest.approx(expected)


def test_stored_mode_aggregates_the_stored_columns(home):
    result = home.query_timeseries(
        "bus", ["value", "samples"], FROM, TO, "sum", "1 day", rollup="stored"
    )
    groups = defaultdict(list)
    for at, zone, value in readings():
        groups[at.replace(minute=0), zone].append(value)
    assert result["table_used"] == "bus_1h"
    assert result["row_count"] == 1
    row = result["rows"][0]
    assert row["bucket"] == "2024-03-10T00:00:00+00:00"
    assert row["samples_sum"] == MINUTES
    assert row["value_sum"] == pytest.approx(sum(sum(v) / len(v) for v in groups.values()))


def test_stored_mode_checks_columns_of_the_rollup(home):
    with pytest.raises(ValueError, match="unknown_columns"):
        home.query_timeseries("bus", ["unit"], FROM, TO, "count", "1 hour", rollup="stored")
    result = home.query_timeseries("bus", ["unit"], FROM, TO, "count", "1 hour")
    assert result["table_used"] == "bus"
    assert sum(r["unit_count"] for r in result["rows"]) == MINUTES


def test_columns_of_the_rollup_alone_are_read_as_stored(home):
    result = home.query_timeseries("bus", ["samples"], FROM, TO, "sum", "1 hour", {"zone": "zone-1"})
    assert result["table_used"] == "bus_1h"
    assert [r["samples_sum"] for r in result["rows"]] == [len(v) for v in bucketed(60, lambda t, zone: zone == "zone-1").values()]
    for refused in ({"bucket": "5 minutes"}, {"columns": ["samples", "unit"]}, {"rollup": "never"}):
        call = {"table": "bus", "columns": ["samples"], "from_ts": FROM, "to_ts": TO, **refused}
        with pytest.raises(ValueError, match=r"unknown_columns: \['samples'\]"):
            home.query_timeseries(**call)


def test_rollup_can_be_asked_for(home):
    result = home.query_timeseries("bus_1h", ["samples"], FROM, TO, "sum", "30 minutes")
    assert result["table_used"] == "bus_1h"
    assert [r["samples_sum"] for r in result["rows"]] == [60, 60, 60, 41]


def test_a_short_range_is_read_from_raw_rows(home):
    result = home.query_timeseries(
        "bus", ["value"], "2024-03-10T09:05Z", "2024-03-10T09:55Z", "count", "1 hour"
    )
    assert result["table_used"] == "bus"
    assert [r["value_count"] for r in result["rows"]] == [51]


def test_json_fields_are_measures(home):
    result = home.query_timeseries(
        "boiler", ["raw->>'speed'", "raw->>'nothing'"], FROM, TO, "max", "1 day"
    )
    assert result["rows"][0]["raw_speed_max"] == 1100.0
    assert result["rows"][0]["raw_nothing_max"] is None


def test_without_columns_the_buckets_are_listed(home):
    for mode in ("exact", "never"):
        result = home.query_timeseries("bus", [], FROM, TO, rollup=mode)
        assert result["rows"] == [{"bucket": b} for b in bucketed(60)]


def test_the_cap_is_a_top_n_without_a_full_sort(spark, home):
    answer = plan_timeseries(
        spark, home.registry, "bus", ["value"], FROM, TO, "avg", "1 minute", {"zone": "zone-3"}
    )
    plan = answer.capped(10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=11" in plan and "rangepartitioning" not in plan
    assert plan.count("Exchange") == 1 and "partial_avg" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "EqualTo(zone,zone-3)" in scan and "GreaterThanOrEqual(time" in scan
    assert "ReadSchema: struct<time:timestamp,zone:string,value:double>" in scan


def test_bounds_are_inclusive_and_may_be_reversed(home):
    at = "2024-03-10T09:00:00+00:00"
    for mode in ("exact", "never"):
        one = home.query_timeseries("bus", ["value"], at, at, "count", rollup=mode)
        assert [r["value_count"] for r in one["rows"]] == [1]
        two = home.query_timeseries(
            "bus", ["value"], "2024-03-10T09:00Z", "2024-03-10T10:00Z", "count", rollup=mode
        )
        assert [r["value_count"] for r in two["rows"]] == [60, 1]
        none = home.query_timeseries("bus", ["value"], TO, FROM, rollup=mode)
        assert none["row_count"] == 0


def test_bounds_with_an_offset(home):
    result = home.query_timeseries(
        "bus", ["value"], "2024-03-10T11:00:00+02:00", "2024-03-10T11:59:00+02:00", "count"
    )
    assert [(r["bucket"], r["value_count"]) for r in result["rows"]] == [
        ("2024-03-10T09:00:00+00:00", 60)
    ]


def test_filters(home):
    def count(**filters):
        rows = home.query_timeseries("bus", ["value"], FROM, TO, "count", "1 day", filters)["rows"]
        return sum(r["value_count"] for r in rows)

    assert count(zone="zone-1") == sum(z == "zone-1" for _, z, _ in readings())
    low = sum((z, v) == ("zone-1", 8.5) for _, z, v in readings())
    assert count(zone="zone-1", value=8.5) == low > 0
    assert count(zone="zone-1", value="8.50") == low
    assert count(zone="zone-2", value=21) == 0
    assert count(time="2024-03-10T13:40:00+02:00") == 1
    assert count(zone=None) == 0
    assert count(unit="C") == MINUTES


@pytest.mark.parametrize("filters", [{"zone": 5}, {"value": "warm"}, {"value": True}])
def test_filter_values_must_fit(home, filters):
    with pytest.raises(ValueError, match="invalid_filter_value"):
        home.query_timeseries("bus", ["value"], FROM, TO, filters=filters)


def test_filter_values_of_every_type(spark, path):
    where = path("t")
    spark.sql(
        "SELECT timestamp'2024-01-01T00:00:00Z' AS time, 1 AS i, 1.5D AS d, 2.25BD AS n, true AS b, "
        "date'2024-02-03' AS day, 'x' AS s, 9223372036854775807 AS big"
    ).write.parquet(where)
    space = Workspace(spark, Source("t", where))

    def found(**filters):
        call = ("t", ["s"], "2024-01-01", "2024-01-01", "count", "1 day", filters)
        return space.query_timeseries(*call)["row_count"]

    for column, values in {
        "i": [1, "1", "1.0", 1.0], "d": [1.5, "1.5"], "n": ["2.25", 2.25, "2.250"],
        "b": [True, "true", "T"], "day": ["2024-02-03", LAST.replace(month=2, day=3)],
        "s": ["x"], "big": [2**63 - 1, str(2**63 - 1)],
    }.items():
        for value in values:
            assert found(**{column: value}) == 1, (column, value)
    for column, values in {
        "i": [2, 1.5, 2**70], "d": ["nan", 0], "n": [2, "1e-30"], "b": ["f"], "day": ["2024-02-04"],
        "s": ["X"], "big": [2**63],
    }.items():
        for value in values:
            assert found(**{column: value}) == 0, (column, value)
    for column, value in [("i", "1.5"), ("i", "nan"), ("d", "x"), ("b", 1), ("day", "soon"), ("n", 10**40)]:
        with pytest.raises(ValueError, match="invalid_filter_value"):
            found(**{column: value})


def test_row_limit(home):
    with pytest.raises(ValueError, match="row_limit_exceeded"):
        home.query_timeseries("bus", ["value"], FROM, TO, "avg", "1 minute", row_limit=2)
    kept = home.query_timeseries("bus", ["value"], FROM, TO, "avg", "1 minute", row_limit=MINUTES)
    assert kept["row_count"] == MINUTES


@pytest.mark.parametrize(
    "change, code",
    [
        ({"table": "not_a_table"}, "unknown_table"),
        ({"columns": ["value", "does_not_exist"]}, r"unknown_columns: \['does_not_exist'\]"),
        ({"columns": ["zone->>'x'"]}, "unknown_columns"),
        ({"columns": ["date"]}, "unknown_columns"),
        ({"bucket": "DROP TABLE bus"}, "invalid_bucket_interval"),
        ({"bucket": "0 hours"}, "invalid_bucket_interval"),
        ({"bucket": "1 year"}, "invalid_bucket_interval"),
        ({"aggregation": "median"}, "invalid_aggregation"),
        ({"filters": {"nothing": 1}}, r"unknown_filter_columns: \['nothing'\]"),
        ({"columns": ["zone"]}, "invalid_column_type"),
        ({"columns": ["raw"], "aggregation": "max"}, "invalid_column_type"),
        ({"from_ts": "yesterday"}, "invalid_timestamp"),
        ({"rollup": "sometimes"}, "invalid_rollup_mode"),
        # The first check that fails decides.
        ({"aggregation": "median", "bucket": "x", "table": "y"}, "invalid_aggregation"),
        ({"bucket": "x", "table": "y"}, "invalid_bucket_interval"),
        ({"table": "y", "columns": ["z"]}, "unknown_table"),
        ({"columns": ["z"], "filters": {"z": 1}}, "unknown_columns"),
    ],
)
def test_refusals(home, change, code):
    call = {"table": "bus", "columns": ["value"], "from_ts": FROM, "to_ts": TO, **change}
    with pytest.raises(ValueError, match=code):
        home.query_timeseries(**call)


def test_repeated_columns_collapse(home):
    result = home.query_timeseries("bus", ["value", "value"], FROM, TO, bucket="1 day")
    assert list(result["rows"][0]) == ["bucket", "value_avg"]


def test_min_and_max_of_text_and_time(home):
    result = home.query_timeseries("bus", ["zone", "time"], FROM, TO, "max", "1 day")
    assert result["rows"] == [
        {"bucket": "2024-03-10T00:00:00+00:00", "zone_max": "zone-3", "time_max": END}
    ]


def test_a_like_named_raw_table_is_no_rollup(spark, home):
    bus, rollup = home.registry.get("bus"), home.registry.get("bus_1h")
    other = Source("bus_1h", rollup.location, date_column="date")
    result = Workspace(spark, bus, other).query_timeseries("bus", ["value"], FROM, TO)
    assert result["table_used"] == "bus"


def test_names_are_unique(home):
    with pytest.raises(ValueError, match="duplicate_source"):
        Registry(Source("a", "x"), Source("a", "y"))


def test_no_time_column(spark):
    space = Workspace(spark, Source("region", "/root/testdata/sf0.001/region.parquet"))
    assert space.list_data_sources()[0]["time_range"] == {"min": None, "max": None}
    assert space.get_schema("region")["time_column"] is None
    with pytest.raises(ValueError, match="no_time_column_detected"):
        space.query_timeseries("region", ["r_regionkey"], FROM, TO)


def test_capped_rows_beyond_the_cap_are_an_error(spark, home):
    answer = plan_timeseries(spark, home.registry, "bus", ["value"], FROM, TO, "avg", "1 minute")
    assert answer.capped(MINUTES).count() == MINUTES
    with pytest.raises(Exception, match="row_limit_exceeded"):
        answer.capped(MINUTES - 1).collect()
