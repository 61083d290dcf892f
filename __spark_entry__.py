
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import (
    Registry,
    Source,
    Workspace,
    absorb,
    create_rollup,
    full_refresh,
    key_profile,
    publish_rollup,
    refresh_policy,
    refresh_window,
    retire_landed,
    store_by_day,
    stream_rollup,
    update_key_counts,
    update_zones,
)
from tidemark.operators.describe import (
    json_key_profile,
    latest,
    rows_by_hour,
    source_description,
    source_inventory,
    source_time_range,
    time_range,
)
from tidemark.plans.timeseries import plan_timeseries
from tidemark.sources.registry import time_column
from tidemark.sources.storage import shared_folder

# A part of its own, which may be absent, but for a folder without modules; its own errors show.
_part = find_spec("tidemark.llm")
if _part and _part.origin and find_spec("corpus_pipeline"):
    import corpus_pipeline
    from tidemark.llm import registered as llm
else:
    llm = corpus_pipeline = None

ALWAYS = (None, None)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Ranges that start and end inside an hour.
UNALIGNED = ("2024-01-02T10:17:31.5+00:00", "2024-01-28T21:44:03.25+02:00")
LATE_WINDOW = ("2024-01-05T08:20:00", "2024-01-19T17:40:00")

_DIMS = ("event_type",)
_VALUES = ("value", "user_id")
_rollups: dict[tuple[str, str], Source] = {}


def _source(sf_dir: str, table: str) -> Source:
    payloads = ("props",) if table == "events" else ()
    return Source(table, f"{sf_dir}/{table}.parquet", json_columns=payloads)


def _rollup(spark: SparkSession, sf_dir: str) -> Source:
    """The hourly rollup of events, built once per application and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _rollups:
        _rollups[key] = _built_rollup(spark, _source(sf_dir, "events"))
    return _rollups[key]


def _built_rollup(spark: SparkSession, raw: Source) -> Source:
    rollup = create_rollup(spark, raw, shared_folder(spark, "events_1h"), _DIMS, _VALUES)
    full_refresh(spark, raw, rollup)
    return rollup


def _rounded(frame: DataFrame) -> DataFrame:
    """Averages and sums of doubles to four digits: their last digits depend on the order
    of addition. The odd offset keeps short decimals such as x.xxxx5 off the edge between
    two results."""
    return frame.select(
        *[
            (F.floor(F.col(f.name) * 1e4 + 0.3141592) / 1e4).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and not f.name.endswith(("_min", "_max"))
            else f.name
            for f in frame.schema.fields
        ]
    )


def _raw(table: str, columns: list[str], aggregation: str, bucket: str, **options):
    """A query over raw rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        space = Workspace(spark, _source(sf_dir, table))
        span = options.get("span", ALWAYS)
        return _rounded(
            space.frame(table, columns, *span, aggregation, bucket, options.get("filters"))
        )

    return run


def _routed(columns: list[str], aggregation: str, bucket: str, mode: str = "exact", **options):
    """A query over events that its rollup may answer."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        space = Workspace(spark, _source(sf_dir, "events"), _rollup(spark, sf_dir))
        span = options.get("span", ALWAYS)
        return _rounded(
            space.frame(
                "events", columns, *span, aggregation, bucket, options.get("filters"), rollup=mode
            )
        )

    return run


def _row_cap_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry(_source(sf_dir, "orders"))
    columns = ["o_totalprice"]
    return plan_timeseries(spark, registry, "orders", columns, *ALWAYS, "max", "1 day").capped(5000)


def _time_range(table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = _source(sf_dir, table).read(spark)
        return time_range(frame, time_column(frame.schema.fields).name)

    return run


def _time_range_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_by_day(spark, sf_dir)
    return time_range(stored.read(spark), "ts", stored.date_column)


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry(*[_source(sf_dir, t) for t in TABLES], _rollup(spark, sf_dir))
    return source_inventory(spark, registry)


def _description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_description(spark, _source(sf_dir, "events"))


def _key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _source(sf_dir, "events").read(spark)
    return json_key_profile(frame, "props", frame.schema["ts"])


def _key_profile_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a payload that differs from row to row, in the newest 50,000 keys."""
    lines = _source(sf_dir, "lineitem").read(spark)
    payload = F.to_json(
        F.struct(
            F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("returned"),
            F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"),
            F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("tax"),
            F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("open_line"),
        )
    )
    lines = lines.select("l_shipdate", payload.alias("payload"))
    return json_key_profile(lines, "payload", lines.schema["l_shipdate"], sample=50_000)


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _source(sf_dir, "events").read(spark)
    return latest(frame, frame.schema["ts"], 1000, "event_id")


def _contents(rollup: Source, spark: SparkSession) -> DataFrame:
    return _rounded(rollup.read(spark).drop(rollup.date_column))


def _rollup_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(_built_rollup(spark, _source(sf_dir, "events")), spark)


def _rollup_windowed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors arrive after the rollup was built; the hours of a window are refreshed."""
    events = _source(sf_dir, "events").read(spark)
    raw = Source("events", shared_folder(spark, "events_late"), date_column="date")
    store_by_day(events.filter(F.col("event_type") != "error"), raw.location, "ts")
    rollup = _built_rollup(spark, raw)
    store_by_day(events.filter(F.col("event_type") == "error"), raw.location, "ts", mode="append")
    refresh_window(spark, raw, rollup, *LATE_WINDOW)
    return _contents(rollup, spark)


def _rollup_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old errors arrive late, beyond the window of the scheduled run that follows."""
    events = _source(sf_dir, "events").read(spark)
    late = (F.col("event_type") == "error") & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    raw = Source("events", shared_folder(spark, "events_late"), date_column="date")
    store_by_day(events.filter(~late), raw.location, "ts")
    rollup = _built_rollup(spark, raw)
    store_by_day(events.filter(late), raw.location, "ts", mode="append")
    refresh_policy(spark, raw, rollup, datetime(2024, 1, 30, tzinfo=timezone.utc))
    space = Workspace(spark, raw, rollup)
    return _rounded(space.frame("events", ["value"], *ALWAYS, "sum", "1 day"))


def _parts(spark: SparkSession, sf_dir: str, late: str) -> tuple[Source, DataFrame]:
    """Events in a plain folder, without those that come late, and the late ones."""
    events = _source(sf_dir, "events").read(spark)
    root = shared_folder(spark, "events_plain")
    events.where(f"NOT ({late})").write.parquet(f"{root}/raw")
    raw = Source("events", f"{root}/raw", json_columns=("props",), zones=f"{root}/zones")
    return raw, events.where(late)


def _rollup_late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old errors arrive late in a plain folder of files, beyond the window of the run after."""
    raw, late = _parts(spark, sf_dir, "event_type = 'error' AND ts < timestamp_ntz'2024-01-20'")
    rollup = _built_rollup(spark, raw)
    late.write.mode("append").parquet(raw.location)
    refresh_policy(spark, raw, rollup, datetime(2024, 1, 30, tzinfo=timezone.utc))
    space = Workspace(spark, raw, rollup)
    return _rounded(space.frame("events", ["value"], *ALWAYS, "sum", "1 day"))


def _rollup_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old errors arrive after the stream has closed their hours, which drops them."""
    raw, late = _parts(spark, sf_dir, "event_type = 'error' AND ts < timestamp_ntz'2024-01-20'")
    root = shared_folder(spark, "events_stream")
    rollup = create_rollup(spark, raw, f"{root}/rollup", _DIMS, _VALUES)
    for arriving in (None, late):
        if arriving is not None:
            arriving.write.mode("append").parquet(raw.location)
        query = stream_rollup(spark, raw, rollup, f"{root}/landing", f"{root}/checkpoint")
        query.awaitTermination()
    absorb(spark, rollup, f"{root}/landing", raw)
    space = Workspace(spark, raw, rollup)
    return _rounded(space.frame("events", ["value"], *ALWAYS, "sum", "1 day"))


def _rollup_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the stream; landed days that the first one brought are deleted in between."""
    raw, later = _parts(spark, sf_dir, "ts >= timestamp_ntz'2024-01-20'")
    root = shared_folder(spark, "events_stream")
    rollup = create_rollup(spark, raw, f"{root}/rollup", _DIMS, _VALUES)
    for arriving in (None, later):
        if arriving is not None:
            retire_landed(spark, rollup, f"{root}/landing", timedelta(days=1))
            arriving.write.mode("append").parquet(raw.location)
        query = stream_rollup(spark, raw, rollup, f"{root}/landing", f"{root}/checkpoint")
        query.awaitTermination()
        absorb(spark, rollup, f"{root}/landing", raw)
    space = Workspace(spark, raw, rollup)
    return _rounded(space.frame("events", ["value"], *ALWAYS, "sum", "1 day"))


def _rollup_refreshed_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshes of overlapping windows run at once; one that meets another's days gives way."""
    raw = _stored_by_day(spark, sf_dir)
    rollup = create_rollup(spark, raw, shared_folder(spark, "events_1h"), _DIMS, _VALUES)
    windows = [("2024-01-02", "2024-01-09T05:00"), ("2024-01-08", "2024-01-15"), LATE_WINDOW]

    def refresh(window: tuple[str, str]) -> None:
        try:
            refresh_window(spark, raw, rollup, *window)
        except ValueError as error:
            if not str(error).startswith("refresh_in_progress"):
                raise

    with ThreadPoolExecutor(len(windows)) as pool:
        list(pool.map(refresh, windows))
    space = Workspace(spark, raw, rollup)
    return _rounded(space.frame("events", ["value"], *ALWAYS, "sum", "1 day"))


def _rollup_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and its rollup found in the catalog; the rollup answers by itself."""
    place = shared_folder(spark, "home")
    database = "home_" + place[-32:]
    spark.sql(f"CREATE DATABASE {database}")
    events = _source(sf_dir, "events").read(spark)
    events.write.option("path", f"{place}/events").saveAsTable(f"{database}.events")
    raw = Source("events", f"{database}.events", format="table")
    rollup = create_rollup(spark, raw, f"{place}/events_1h", _DIMS, _VALUES)
    full_refresh(spark, raw, rollup)
    publish_rollup(spark, rollup, f"{database}.events_1h")
    space = Workspace.of_database(spark, database)
    return _rounded(space.frame("events", ["value", "user_id"], *ALWAYS, "avg", "1 day"))


def _rollup_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup just created holds nothing, and the answer comes from raw rows."""
    raw = _source(sf_dir, "events")
    rollup = create_rollup(spark, raw, shared_folder(spark, "events_1h"), _DIMS, _VALUES)
    space = Workspace(spark, raw, rollup)
    return _rounded(space.frame("events", ["value"], *ALWAYS, "avg", "1 day"))


def _zoned(spark: SparkSession, sf_dir: str) -> Source:
    """Events with a zone map that does not know the newest files yet."""
    raw, late = _parts(spark, sf_dir, "ts >= timestamp_ntz'2024-01-28'")
    update_zones(spark, raw, raw.zones)
    late.write.mode("append").parquet(raw.location)
    return raw.resolved(spark)


def _time_range_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_time_range(spark, _zoned(spark, sf_dir))


def _inventory_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_inventory(spark, Registry(_zoned(spark, sf_dir)))


def _latest_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _zoned(spark, sf_dir)
    frame = raw.read(spark)
    return latest(frame, frame.schema["ts"], 1000, "event_id", by_hour=rows_by_hour(spark, raw))


def _description_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_description(spark, _zoned(spark, sf_dir))


def _rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours closed by the watermark. The glob lets a single file be read as a stream."""
    raw = Source("events", f"{sf_dir}/events.parque[t]")
    root = shared_folder(spark, "events_stream")
    rollup = create_rollup(spark, raw, f"{root}/rollup", _DIMS, _VALUES)
    query = stream_rollup(spark, raw, rollup, f"{root}/landing", f"{root}/checkpoint")
    query.awaitTermination()
    absorb(spark, rollup, f"{root}/landing")
    return _contents(rollup, spark)


def _stored_by_day(spark: SparkSession, sf_dir: str) -> Source:
    stored = Source("events", shared_folder(spark, "events_by_day"), date_column="date")
    store_by_day(_source(sf_dir, "events").read(spark), stored.location, "ts")
    return stored


def _storage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, _stored_by_day(spark, sf_dir))
    return _rounded(space.frame("events", ["value"], *UNALIGNED, "avg", "30 minutes"))


def _key_profile_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of a range that cuts days, from counts kept by day; errors arrived after the counts."""
    events = _source(sf_dir, "events").read(spark)
    raw = Source("events", shared_folder(spark, "events_keys"), date_column="date")
    late = (F.col("event_type") == "error") & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    counts = shared_folder(spark, "key_counts")
    store_by_day(events.filter(~late), raw.location, "ts")
    update_key_counts(spark, raw, "props", counts)
    store_by_day(events.filter(late), raw.location, "ts", mode="append")
    return key_profile(spark, raw, "props", counts, *UNALIGNED)


def entry(spark: SparkSession) -> DataFrame:
    """Hourly average of the error events."""
    space = Workspace(spark, _source("/root/testdata/sf0.001", "events"))
    return space.frame("events", ["value"], *ALWAYS, "avg", "1 hour", {"event_type": "error"})


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_ERROR = {"event_type": "error"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if llm is None:
        return _own_queries()
    return _own_queries() | llm.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _own_oracle_sql() | (llm.oracle_sql() if llm else {})


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "bucket_avg_15m": _raw("events", ["value"], "avg", "15 minutes"),
        "bucket_sum_1h": _raw("events", ["value", "user_id"], "sum", "1 hour"),
        "bucket_min_7h": _raw("events", ["value"], "min", "7 hours"),
        "bucket_max_1d": _raw("orders", ["o_totalprice"], "max", "1 day"),
        "bucket_count_1w": _raw("orders", ["o_orderkey"], "count", "1 week"),
        "bucket_count_7s": _raw("events", ["event_id"], "count", "7 seconds"),
        "bucket_avg_1mo": _raw("orders", ["o_totalprice"], "avg", "1 month"),
        "bucket_avg_3mo": _raw("lineitem", ["l_extendedprice"], "avg", "3 months"),
        "bucket_multi_col": _raw("lineitem", _LINE_COLUMNS, "sum", "2 weeks"),
        "bucket_distinct": _raw("events", [], "avg", "5 minutes"),
        "bucket_text_max": _raw("events", ["event_type", "ts"], "max", "6 hours"),
        "filter_time_range": _raw("events", ["value"], "count", "45 minutes", span=UNALIGNED),
        "filter_eq": _raw("events", ["value"], "sum", "4 hours", filters=_ERROR),
        "filter_eq_two": _raw(
            "lineitem",
            ["l_quantity"],
            "avg",
            "1 month",
            filters={"l_returnflag": "R", "l_linenumber": 1},
        ),
        "row_cap_within": _row_cap_within,
        "json_field_avg": _raw("events", ["props->>'k'"], "avg", "1 day"),
        "json_field_count": _raw("events", ["props->>'k'", "props->>'none'"], "count", "1 week"),
        "time_range": _time_range("events"),
        "time_range_lineitem": _time_range("lineitem"),
        "time_range_by_day": _time_range_by_day,
        "source_inventory": _inventory,
        "source_description": _description,
        "json_key_profile": _key_profile,
        "json_key_profile_many": _key_profile_many,
        "json_key_profile_by_day": _key_profile_by_day,
        "latest_rows": _latest,
        "storage_by_day": _storage_by_day,
        "rollup_1h_build": _rollup_build,
        "rollup_stored_1d": _routed(["value", "samples"], "avg", "1 day", "stored"),
        "rollup_stored_sum_unaligned": _routed(
            ["value"], "sum", "1 week", "stored", span=UNALIGNED
        ),
        "rollup_exact_1d": _routed(["value"], "avg", "1 day"),
        "rollup_exact_1w_sum": _routed(["value", "user_id"], "sum", "1 week"),
        "rollup_exact_1mo_max": _routed(["value", "user_id"], "max", "1 month"),
        "rollup_exact_5d_min": _routed(["value"], "min", "5 days", filters=_ERROR),
        "rollup_exact_unaligned": _routed(["value"], "avg", "7 hours", span=UNALIGNED),
        "rollup_exact_unaligned_count": _routed(
            ["value", "user_id"], "count", "1 hour", span=UNALIGNED, filters=_ERROR
        ),
        "rollup_exact_distinct": _routed([], "avg", "1 hour"),
        "rollup_fallback_raw": _routed(["event_id"], "max", "1 day"),
        "rollup_exact_late_rows": _rollup_late_rows,
        "rollup_windowed_refresh": _rollup_windowed_refresh,
        "rollup_stream_1h": _rollup_stream,
        "rollup_exact_late_files": _rollup_late_files,
        "rollup_stream_late_rows": _rollup_stream_late,
        "rollup_stream_absorbed": _rollup_absorbed,
        "rollup_exact_refreshed_at_once": _rollup_refreshed_at_once,
        "rollup_exact_empty": _rollup_empty,
        "rollup_exact_catalog": _rollup_catalog,
        "time_range_zones": _time_range_zones,
        "source_inventory_zones": _inventory_zones,
        "latest_rows_zones": _latest_zones,
        "source_description_zones": _description_zones,
    }


def _bucket_sql(
    table: str, time: str, columns: dict[str, str], width: str, where: str = "true"
) -> str:
    """``columns`` maps a result name to its aggregate expression."""
    start = f"time_bucket(INTERVAL '{width}', {time})"
    selected = "".join(f", {expression} AS {name}" for name, expression in columns.items())
    return f"SELECT {start} AS bucket{selected} FROM {table} WHERE {where} GROUP BY {start}"


def _digits(expression: str) -> str:
    """See ``_rounded``."""
    return f"floor({expression} * 1e4 + 0.3141592) / 1e4"


def _avg(column: str) -> str:
    return _digits(f"avg({column})")


def _sum(column: str) -> str:
    return _digits(f"sum({column})")


def _whole_sum(column: str) -> str:
    return f"CAST(sum({column}) AS BIGINT)"


_IN_UNALIGNED = (
    "ts BETWEEN TIMESTAMP '2024-01-02 10:17:31.5' AND TIMESTAMP '2024-01-28 19:44:03.25'"
)


def _hourly_sql(events: str, type_filter: str = "true") -> str:
    hour = "time_bucket(INTERVAL '1 hour', ts)"
    return f"""
        SELECT {hour} AS bucket, event_type, {_avg('value')} AS value,
            {_avg('user_id')} AS user_id, count(*) AS samples,
            {_sum('value')} AS value__sum, count(value) AS value__count,
            min(value) AS value__min, max(value) AS value__max,
            CAST(sum(user_id) AS BIGINT) AS user_id__sum, count(user_id) AS user_id__count,
            min(user_id) AS user_id__min, max(user_id) AS user_id__max
        FROM {events} WHERE {type_filter} GROUP BY {hour}, event_type"""


def _iso_sql(expression: str) -> str:
    text = f"strftime({expression}, '%Y-%m-%dT%H:%M:%S.%f')"
    return f"regexp_replace({text}, '\\.000000$', '') || '+00:00'"


def _inventory_sql(*tables: str) -> str:
    times = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    rows = []
    for table in tables or TABLES:
        time = times.get(table)
        low = _iso_sql(f"min({time})") if time else "CAST(NULL AS VARCHAR)"
        high = _iso_sql(f"max({time})") if time else "CAST(NULL AS VARCHAR)"
        named = f"'{time}'" if time else "CAST(NULL AS VARCHAR)"
        source = f"FROM {table}" if time else ""
        rows.append(
            f"SELECT '{table}' AS name, 'public' AS schema, 'hypertable' AS kind, "
            f"CAST(NULL AS VARCHAR) AS description, {named} AS time_column, "
            f"{low} AS time_min, {high} AS time_max {source}"
        )
    if tables:
        return " UNION ALL ".join(rows)
    hour = "time_bucket(INTERVAL '1 hour', ts)"
    rows.append(
        "SELECT 'events_1h', 'public', 'continuous_aggregate', CAST(NULL AS VARCHAR), 'bucket', "
        f"{_iso_sql(f'min({hour})')}, {_iso_sql(f'max({hour})')} FROM events"
    )
    return " UNION ALL ".join(rows)


_DESCRIPTION_SQL = """
    WITH described AS (
        SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name AS name,
            CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
                WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
                ELSE lower(column_type) END AS type
        FROM (DESCRIBE events)),
    sampled AS (
        SELECT key FROM (SELECT ts, unnest(json_keys(props)) AS key FROM events)
        ORDER BY ts DESC, key LIMIT 1000),
    profile AS (
        SELECT key, count(*) AS occurrences FROM sampled GROUP BY key
        ORDER BY occurrences DESC, key LIMIT 30)
    SELECT position, name, type, true AS nullable, name = 'ts' AS is_time,
        CAST(NULL AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS occurrences FROM described
    UNION ALL
    SELECT position, name, type, true, false, key, occurrences
    FROM described, profile WHERE name = 'props'"""

_PROFILE_SQL = """
    SELECT key, count(*) AS occurrences FROM (
        SELECT key FROM (SELECT ts, unnest(json_keys(props)) AS key FROM events)
        ORDER BY ts DESC, key LIMIT 1000)
    GROUP BY key ORDER BY occurrences DESC, key LIMIT 30"""

_PROFILE_BY_DAY_SQL = f"""
    SELECT key, count(*) AS occurrences
    FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE {_IN_UNALIGNED})
    GROUP BY key ORDER BY occurrences DESC, key"""

_PROFILE_MANY_SQL = """
    WITH keys AS (
        SELECT l_shipdate, 'returned' AS key FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT l_shipdate, 'discount' FROM lineitem WHERE l_discount > 0.05
        UNION ALL SELECT l_shipdate, 'tax' FROM lineitem WHERE l_tax > 0.02
        UNION ALL SELECT l_shipdate, 'open_line' FROM lineitem WHERE l_linestatus = 'O')
    SELECT key, count(*) AS occurrences
    FROM (SELECT key FROM keys ORDER BY l_shipdate DESC, key LIMIT 50000)
    GROUP BY key ORDER BY occurrences DESC, key LIMIT 30"""

_WINDOWED_SQL = f"""
    {_hourly_sql("events", '''event_type <> 'error' ''')}
    UNION ALL
    {_hourly_sql("events", '''event_type = 'error'
        AND ts >= TIMESTAMP '2024-01-05 09:00:00' AND ts < TIMESTAMP '2024-01-19 17:00:00' ''')}"""

_STREAM_SQL = _hourly_sql(
    "events",
    "time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' "
    "<= (SELECT max(ts) - INTERVAL '5 minutes' FROM events)",
)


def _stored_sql(columns: dict[str, str], width: str, where: str = "true") -> str:
    hours = (
        "(SELECT time_bucket(INTERVAL '1 hour', ts) AS h, event_type, avg(value) AS value, "
        "count(*) AS samples FROM events GROUP BY 1, 2)"
    )
    return _bucket_sql(hours, "h", columns, width, where)


def _own_oracle_sql() -> dict[str, str]:
    def events(columns: dict[str, str], width: str, where: str = "true") -> str:
        return _bucket_sql("events", "ts", columns, width, where)

    def orders(columns: dict[str, str], width: str) -> str:
        return _bucket_sql("orders", "o_orderdate", columns, width)

    def lines(columns: dict[str, str], width: str, where: str = "true") -> str:
        return _bucket_sql("lineitem", "l_shipdate", columns, width, where)

    error = "event_type = 'error'"
    multi = {f"{c}_sum": _sum(c) for c in _LINE_COLUMNS}
    multi["l_linenumber_sum"] = _whole_sum("l_linenumber")
    return {
        "bucket_avg_15m": events({"value_avg": _avg("value")}, "15 minutes"),
        "bucket_sum_1h": events(
            {"value_sum": _sum("value"), "user_id_sum": _whole_sum("user_id")}, "1 hour"
        ),
        "bucket_min_7h": events({"value_min": "min(value)"}, "7 hours"),
        "bucket_max_1d": orders({"o_totalprice_max": "max(o_totalprice)"}, "1 day"),
        "bucket_count_1w": orders({"o_orderkey_count": "count(o_orderkey)"}, "1 week"),
        "bucket_count_7s": events({"event_id_count": "count(event_id)"}, "7 seconds"),
        "bucket_avg_1mo": orders({"o_totalprice_avg": _avg("o_totalprice")}, "1 month"),
        "bucket_avg_3mo": lines({"l_extendedprice_avg": _avg("l_extendedprice")}, "3 months"),
        "bucket_multi_col": lines(multi, "2 weeks"),
        "bucket_distinct": events({}, "5 minutes"),
        "bucket_text_max": events(
            {"event_type_max": "max(event_type)", "ts_max": "max(ts)"}, "6 hours"
        ),
        "filter_time_range": events({"value_count": "count(value)"}, "45 minutes", _IN_UNALIGNED),
        "filter_eq": events({"value_sum": _sum("value")}, "4 hours", error),
        "filter_eq_two": lines(
            {"l_quantity_avg": _avg("l_quantity")},
            "1 month",
            "l_returnflag = 'R' AND l_linenumber = 1",
        ),
        "row_cap_within": orders({"o_totalprice_max": "max(o_totalprice)"}, "1 day"),
        "json_field_avg": events(
            {"props_k_avg": _avg("CAST(props ->> '$.k' AS DOUBLE)")}, "1 day"
        ),
        "json_field_count": events(
            {
                "props_k_count": "count(props ->> '$.k')",
                "props_none_count": "count(props ->> '$.none')",
            },
            "1 week",
        ),
        "time_range": "SELECT min(ts) AS min, max(ts) AS max FROM events",
        "time_range_lineitem": (
            "SELECT min(l_shipdate) AS min, max(l_shipdate) AS max FROM lineitem"
        ),
        "time_range_by_day": "SELECT min(ts) AS min, max(ts) AS max FROM events",
        "source_inventory": _inventory_sql(),
        "source_description": _DESCRIPTION_SQL,
        "json_key_profile": _PROFILE_SQL,
        "json_key_profile_many": _PROFILE_MANY_SQL,
        "json_key_profile_by_day": _PROFILE_BY_DAY_SQL,
        "latest_rows": "SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 1000",
        "storage_by_day": events({"value_avg": _avg("value")}, "30 minutes", _IN_UNALIGNED),
        "rollup_1h_build": _hourly_sql("events"),
        "rollup_stored_1d": _stored_sql(
            {"value_avg": _avg("value"), "samples_avg": _avg("samples")}, "1 day"
        ),
        "rollup_stored_sum_unaligned": _stored_sql(
            {"value_sum": _sum("value")}, "1 week", _IN_UNALIGNED.replace("ts ", "h ", 1)
        ),
        "rollup_exact_1d": events({"value_avg": _avg("value")}, "1 day"),
        "rollup_exact_late_rows": events({"value_sum": _sum("value")}, "1 day"),
        "rollup_exact_1w_sum": events(
            {"value_sum": _sum("value"), "user_id_sum": _whole_sum("user_id")}, "1 week"
        ),
        "rollup_exact_1mo_max": events(
            {"value_max": "max(value)", "user_id_max": "max(user_id)"}, "1 month"
        ),
        "rollup_exact_5d_min": events({"value_min": "min(value)"}, "5 days", error),
        "rollup_exact_unaligned": events({"value_avg": _avg("value")}, "7 hours", _IN_UNALIGNED),
        "rollup_exact_unaligned_count": events(
            {"value_count": "count(value)", "user_id_count": "count(user_id)"},
            "1 hour",
            f"{_IN_UNALIGNED} AND {error}",
        ),
        "rollup_exact_distinct": events({}, "1 hour"),
        "rollup_fallback_raw": events({"event_id_max": "max(event_id)"}, "1 day"),
        "rollup_windowed_refresh": _WINDOWED_SQL,
        "rollup_stream_1h": _STREAM_SQL,
        "rollup_exact_late_files": events({"value_sum": _sum("value")}, "1 day"),
        "rollup_stream_late_rows": events({"value_sum": _sum("value")}, "1 day"),
        "rollup_stream_absorbed": events({"value_sum": _sum("value")}, "1 day"),
        "rollup_exact_refreshed_at_once": events({"value_sum": _sum("value")}, "1 day"),
        "rollup_exact_empty": events({"value_avg": _avg("value")}, "1 day"),
        "rollup_exact_catalog": events(
            {"value_avg": _avg("value"), "user_id_avg": _avg("user_id")}, "1 day"
        ),
        "time_range_zones": "SELECT min(ts) AS min, max(ts) AS max FROM events",
        "source_inventory_zones": _inventory_sql("events"),
        "latest_rows_zones": "SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 1000",
        "source_description_zones": _DESCRIPTION_SQL,
    }
