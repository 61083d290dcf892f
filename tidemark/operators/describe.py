"""Inventory of sources, their time ranges, columns and JSON keys."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import HOUR
from ..functions.instants import ALWAYS, MICROS, iso_text, utc_instant
from ..functions.json_fields import json_keys, json_text
from ..functions.local import columns, rows_of
from ..functions.names import column
from ..sources.registry import Registry, Source
from .filters import within
from .zones import has_files, hours_of, instant_of, zones

# How much is sampled and how many keys are reported.
KEY_SAMPLE = 1000
TOP_KEYS = 30


def time_range(frame: DataFrame, time: str, date_column: str | None = None) -> DataFrame:
    """``min`` and ``max`` of the time column, both NULL for an empty table.

    Storage by day confines the scan to the first and last day; finding those two takes
    only the row counts in the file footers.
    """
    if date_column is not None:
        day = column(date_column)
        days = frame.select(day)
        first, last = days.agg(F.min(day)).scalar(), days.agg(F.max(day)).scalar()
        frame = frame.filter((day == first) | (day == last))
    return frame.agg(F.min(column(time)).alias("min"), F.max(column(time)).alias("max"))


def source_time_range(spark: SparkSession, source: Source) -> DataFrame:
    """``time_range`` of a resolved source. With a zone map only files that it does not know are
    opened."""
    time = source.time()
    if not (source.zones and has_files(source)):
        return time_range(source.read(spark), time.name, source.date_column)
    ends = zones(spark, source, source.zones).agg(
        F.min("low_us").alias("low"), F.max("high_us").alias("high")
    )
    return ends.select(
        instant_of(F.col("low"), time.dataType).alias("min"),
        instant_of(F.col("high"), time.dataType).alias("max"),
    )


def rows_by_hour(spark: SparkSession, source: Source) -> DataFrame | None:
    """``start_us`` and ``rows`` of the hours of a source with a zone map, else None."""
    if not (source.zones and has_files(source)):
        return None
    return hours_of(zones(spark, source, source.zones)).select(
        F.col("hour_us").alias("start_us"), "rows"
    )


def source_inventory(spark: SparkSession, registry: Registry) -> DataFrame:
    """One row per source: raw tables by name, then rollups by name. One Spark job.

    Every source with a time column gives one aggregate row, so the rows fit one task.
    """
    rows, timeless = [], []
    for position, source in enumerate(registry):
        source = source.resolved(spark)
        time = source.time()
        known = (position, source.name, source.schema, source.kind, source.description)
        if time is None:
            timeless.append((*known, None, None, None))
            continue
        ends = source_time_range(spark, source)
        rows.append(
            ends.select(
                *[F.lit(value).alias(name) for name, value in zip(_KNOWN, known, strict=True)],
                F.lit(time.name).alias("time_column"),
                iso_text(F.col("min"), time.dataType).alias("time_min"),
                iso_text(F.col("max"), time.dataType).alias("time_max"),
            )
        )
    rows.append(rows_of(spark, timeless, _INVENTORY))
    listed = reduce(DataFrame.unionByName, rows)
    return listed.coalesce(1).sortWithinPartitions("position").drop("position")


_KNOWN = ("position", "name", "schema", "kind", "description")
_INVENTORY = columns(
    position="integer",
    name="string",
    schema="string",
    kind="string",
    description="string",
    time_column="string",
    time_min="string",
    time_max="string",
)
_PROFILE = columns(key="string", occurrences="long")
_COLUMNS = columns(position="integer", name="string", type="string", nullable="boolean")


def latest(
    frame: DataFrame,
    time: T.StructField,
    n: int,
    *ties: str,
    date_column: str | None = None,
    by_hour: DataFrame | None = None,
) -> DataFrame:
    """The newest ``n`` rows; ``ties`` orders rows of the same time.

    ``by_hour`` is what ``rows_by_hour`` gives, if the source has a zone map."""
    newest = newest_part(frame, time, n, date_column, by_hour)
    return newest.orderBy(column(time.name).desc(), *[column(t) for t in ties]).limit(n)


def newest_from(
    frame: DataFrame,
    time: T.StructField,
    n: int,
    date_column: str | None = None,
    by_hour: DataFrame | None = None,
    before: int | None = None,
) -> int | None:
    """An instant with at least ``n`` rows from it on (and before ``before``); None if all rows
    are fewer.

    Selection by histogram: rows per hour, from the zone map or one pass over the time column,
    combined before its shuffle. Of those only the newest ``n`` non-empty hours can matter. The
    hour where the count is reached is divided again, by seconds and then by microseconds,
    while it holds far more rows than asked for. A stray row far from the rest is one more hour.
    """
    counts = by_hour if by_hour is not None else _histogram(frame, time, HOUR)
    if before is not None:
        counts = counts.where(F.col("start_us") < before)
    missing = n
    for width, finer in ((HOUR, MICROS), (MICROS, 1), (1, 0)):
        reached = None
        for start, rows in counts.orderBy(F.desc("start_us")).limit(missing).collect():
            if rows >= missing:
                reached = start
                break
            missing -= rows
        if reached is None:
            return None
        if not finer or rows <= 4 * n:
            return reached
        inside = within(time, [(reached, min(reached + width, before or ALWAYS[1]))], date_column)
        counts = _histogram(frame.filter(inside), time, finer)
    return reached


def _histogram(frame: DataFrame, time: T.StructField, width: int) -> DataFrame:
    at = F.unix_micros(utc_instant(column(time.name), time.dataType))
    starts = frame.where(column(time.name).isNotNull()).select(
        (at - F.pmod(at, F.lit(width))).alias("start_us")
    )
    return starts.groupBy("start_us").agg(F.count("*").alias("rows"))


def newest_part(
    frame: DataFrame,
    time: T.StructField,
    n: int,
    date_column: str | None = None,
    by_hour: DataFrame | None = None,
) -> DataFrame:
    """The newest stretch of a table that holds at least ``n`` rows; all of it, rows without a
    time too, if it has fewer."""
    start = newest_from(frame, time, n, date_column, by_hour)
    return _part(frame, time, date_column, start, None)


def _part(
    frame: DataFrame,
    time: T.StructField,
    date_column: str | None,
    start: int | None,
    before: int | None,
) -> DataFrame:
    """Rows between two instants; without the first, rows without a time too."""
    if start is None and before is None:
        return frame
    low = ALWAYS[0] if start is None else start
    high = ALWAYS[1] + 1 if before is None else before
    inside = within(time, [(low, high)], date_column)
    return frame.filter(inside | column(time.name).isNull() if start is None else inside)


def json_key_profile(
    frame: DataFrame,
    payload: str,
    time: T.StructField,
    sample: int = KEY_SAMPLE,
    top: int = TOP_KEYS,
    sample_unit: str = "keys",
    date_column: str | None = None,
    by_hour: DataFrame | None = None,
) -> DataFrame:
    """The most common top-level keys in the newest data, with their occurrences.

    The sample is the newest ``sample`` keys, or with ``sample_unit='rows'`` the keys of
    the newest ``sample`` rows. Rows whose payload is not a JSON object have no keys.
    Ties at the end of the sample go by key (or payload), so the counts are stable.

    Payloads are parsed once: the newest rows first and, while they hold too few keys, four
    times as many before them. Counts of at most ``sample`` keys come to the driver.
    """
    if sample_unit not in ("keys", "rows"):
        raise ValueError(f"invalid_sample_unit: {sample_unit!r}")
    text = json_text(column(payload), frame.schema[payload].dataType)
    at = column(time.name).alias("at")
    if sample_unit == "rows":
        newest = newest_part(frame, time, sample, date_column, by_hour)
        rows = newest.select(at, text.alias("text")).orderBy(F.desc("at"), "text").limit(sample)
        keys = rows.select(F.explode(json_keys(F.col("text"))).alias("key"))
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"))
        return counts.orderBy(F.desc("occurrences"), "key").limit(top)
    found: Counter[str] = Counter()
    missing, asked, before = sample, sample, None
    while missing > 0:
        start = newest_from(frame, time, asked, date_column, by_hour, before)
        part = _part(frame, time, date_column, start, before)
        keys = part.select(at, F.explode(json_keys(text)).alias("key"))
        newest = keys.orderBy(F.desc("at"), "key").limit(missing)
        counts = newest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()
        found.update({r["key"]: r["n"] for r in counts})
        missing -= sum(r["n"] for r in counts)
        if start is None:
            break
        asked, before = 4 * asked, start
    ranked = sorted(found.items(), key=lambda item: (-item[1], item[0].encode()))[:top]
    return rows_of(frame.sparkSession, ranked, _PROFILE)


def column_rows(spark: SparkSession, source: Source) -> DataFrame:
    """``position, name, type, nullable`` of each column, from metadata alone."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(source.fields(), start=1)
    ]
    return rows_of(spark, rows, _COLUMNS)


def source_description(
    spark: SparkSession, source: Source, sample: int = KEY_SAMPLE
) -> DataFrame:
    """Columns in order, each JSON column followed by its most common keys.

    Rows for a column have NULL ``key`` and ``occurrences``.
    """
    source = source.resolved(spark)
    time = source.time()
    is_time = F.col("name") == time.name if time else F.lit(False)
    rows = [
        column_rows(spark, source).select(
            "position",
            "name",
            "type",
            "nullable",
            is_time.alias("is_time"),
            F.lit(None).cast("string").alias("key"),
            F.lit(None).cast("long").alias("occurrences"),
        )
    ]
    for position, field in enumerate(source.fields(), start=1):
        if time is not None and field.name in source.payloads():
            keys = json_key_profile(
                source.read(spark),
                field.name,
                time,
                sample,
                date_column=source.date_column,
                by_hour=rows_by_hour(spark, source),
            )
            rows.append(
                keys.select(
                    F.lit(position).alias("position"),
                    F.lit(field.name).alias("name"),
                    F.lit(field.dataType.simpleString()).alias("type"),
                    F.lit(field.nullable).alias("nullable"),
                    F.lit(False).alias("is_time"),
                    "key",
                    "occurrences",
                )
            )
    described = reduce(DataFrame.unionByName, rows)
    return described.orderBy("position", F.desc_nulls_first("occurrences"), "key")
