"""Rollups kept up by Structured Streaming.

Each run reads the raw files that are new, aggregates them by hour and dimension, and
appends the hours that the watermark has closed to a landing table; hours still open
stay in the state of the checkpoint. ``absorb`` then moves landed hours into the rollup.

``<rollup>_absorbed`` notes the files of each landed day that a run has taken in, so the next run
reads days with other files only. ``retire_landed`` deletes days that were taken in; ``retention``
makes the landing table forget their names, too.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from hashlib import sha256

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.buckets import HOUR
from ..functions.instants import (
    ALWAYS,
    DAY,
    date_literal,
    literal,
    to_micros,
    utc_instant,
    utc_wall_clock,
)
from ..functions.local import columns
from ..functions.names import column, quoted
from ..functions.spans import Span, intersect, merge, subtract
from ..operators.filters import within
from ..operators.notes import delete_folder, read_notes, update_notes
from ..operators.refresh import (
    among,
    claimed,
    coverage,
    present_hours,
    take_in_hours,
    write_hours,
)
from ..operators.rollup import DATE, hourly, stored_range, time_of
from ..sources.registry import Source

_ABSORBED = columns(landing="string", day="date", files="long", hash="string", end_us="long")


def stream_rollup(
    spark: SparkSession,
    raw: Source,
    rollup: Source,
    landing: str,
    checkpoint: str,
    delay: str = "5 minutes",
    start: str | datetime | None = None,
    max_files: int | None = None,
    retention: str | None = None,
) -> StreamingQuery:
    """Start one scheduled run; it ends by itself when the present input is consumed.

    ``start`` leaves older rows to a batch refresh, so that a first run over a long
    history need not hold all its hours in state. ``max_files`` splits the input into
    several batches, oldest files first, and suits files that arrive in order of time.
    ``retention`` ("30d") is how long the landing table lists a file; absorb more often.
    Rows more than ``delay`` behind the newest one of earlier batches may be dropped here;
    ``absorb`` finds their hours by the number of rows, and a refresh fills them.
    """
    raw = raw.resolved(spark)
    time = time_of(raw)
    if raw.format == "table":
        rows = spark.readStream.table(raw.location)
    else:
        reader = spark.readStream.format(raw.format).options(**raw.options).schema(raw.columns)
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        rows = reader.load(raw.location)
    if start is not None:
        first_hour = to_micros(start) // HOUR * HOUR
        rows = rows.filter(column(time.name) >= literal(first_hour, time.dataType))
        if raw.date_column is not None:
            rows = rows.filter(column(raw.date_column) >= date_literal(first_hour))
    # Watermarks need the type ``timestamp``; the hours go back to the type of the input.
    rows = rows.withColumn(time.name, utc_instant(column(time.name), time.dataType))
    rows = rows.withWatermark(quoted(time.name), delay)
    closed = hourly(rows, time.name, rollup.dims, rollup.values)
    if isinstance(time.dataType, T.TimestampNTZType):
        hour = utc_wall_clock(column("bucket"), T.TimestampType())
        closed = closed.withColumn("bucket", hour)
    writer = closed.writeStream.format("parquet").outputMode("append").partitionBy(DATE)
    if retention is not None:
        writer = writer.option("retention", retention)
    return (
        writer
        .option("path", landing)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def absorb(
    spark: SparkSession, rollup: Source, landing: str, raw: Source | None = None
) -> list[Span]:
    """Move landed hours that the rollup does not cover into it; return their spans.

    Hours are closed in order, so all from the first to the last landed one are complete, but
    for rows that came behind the watermark. With ``raw``, the rows that landed in each hour
    are counted against those of the raw files, which the zone map knows: an hour that lacks
    some stays uncovered, so exact answers read it from raw rows until a refresh fills it.

    Only days whose landed files are others than at the run before are read. Hours of other days
    that were left or have become uncovered since are for a refresh.
    """
    landed = spark.read.schema(rollup.columns).parquet(landing)
    present = _landed_days(landed)
    noted = {r["day"]: r for r in _absorbed(spark, rollup, landing)}
    days = {d for d, files in present.items() if _state_of(noted.get(d)) != files}
    if not days:
        return []
    fresh = landed.filter(within(landed.schema["bucket"], _spans_of(days), DATE))
    first, last = stored_range(fresh)
    if first is None:
        return []
    # Hours without rows between two runs are complete as well.
    upto = max((r["end_us"] for r in noted.values()), default=first)
    passed = intersect(_spans_of(present.keys() - days), (ALWAYS[0], upto))
    spans = subtract([(min(first, upto), last + HOUR)], [*coverage(spark, rollup), *passed])
    hours = present_hours(spark, raw, rollup, note=True) if raw is not None and spans else None
    if hours is not None:
        spans = subtract(spans, _incomplete(fresh, hours, spans))
    moved: list[Span] = []
    if spans:
        with claimed(spark, rollup, spans) as claim:
            moved = subtract(spans, claim.held)  # a refresh may have filled some
            if moved:
                rows = fresh.filter(within(landed.schema["bucket"], moved, DATE))
                write_hours(spark, rollup, rows, moved, claim)
    if hours is not None and moved and not raw.stored_by_day():
        take_in_hours(spark, rollup, hours, moved)
    _note_absorbed(spark, rollup, landing, present, days, last + HOUR)
    return moved


def retire_landed(
    spark: SparkSession, rollup: Source, landing: str, keep: timedelta = timedelta(days=7)
) -> list[date]:
    """Delete landed days that were taken in, but for ``keep`` before the newest; return them.

    ``keep`` is a day at least: older days are closed, as the stream lands hours in order.
    """
    if keep < timedelta(days=1):
        raise ValueError("invalid_keep: a day at least")
    present = _landed_days(spark.read.schema(rollup.columns).parquet(landing))
    noted = {r["day"]: _state_of(r) for r in _absorbed(spark, rollup, landing)}
    done = [d for d, files in present.items() if noted.get(d) == files and d < max(present) - keep]
    root = landing.rstrip("/")
    return [d for d in sorted(done) if delete_folder(spark, f"{root}/{DATE}={d}")]


def _landed_days(landed: DataFrame) -> dict[date, tuple[int, str]]:
    """Number and digest of the names of each day's files, as the sink's log lists them. Their
    names are unique and their contents never change, so none is opened."""
    names: dict[date, list[str]] = {}
    for path in landed.inputFiles():
        found = re.search(rf"/{DATE}=(\d{{4}}-\d\d-\d\d)/([^/]+)$", path)
        if found:
            names.setdefault(date.fromisoformat(found[1]), []).append(found[2])
    return {d: (len(n), sha256("/".join(sorted(n)).encode()).hexdigest()) for d, n in names.items()}


def _absorbed(spark: SparkSession, rollup: Source, landing: str) -> list[Row]:
    rows = read_notes(spark, rollup.location, "absorbed", _ABSORBED)
    return [r for r in rows if r["landing"] == landing]


def _state_of(noted: Row | None) -> tuple[int, str] | None:
    return (noted["files"], noted["hash"]) if noted is not None else None


def _note_absorbed(
    spark: SparkSession,
    rollup: Source,
    landing: str,
    present: dict[date, tuple[int, str]],
    days: set[date],
    end_us: int,
) -> None:
    def change(rows: list[Row]) -> list[tuple]:
        # Days that the landing table has forgotten go, those of this run come.
        kept = [r for r in rows if r["landing"] != landing or r["day"] in present.keys() - days]
        return [*map(tuple, kept), *((landing, d, *present[d], end_us) for d in sorted(days))]

    update_notes(spark, rollup.location, "absorbed", _ABSORBED, change)


def _spans_of(days: set[date]) -> list[Span]:
    return merge([(to_micros(d), to_micros(d) + DAY) for d in days])


def _incomplete(landed: DataFrame, hours: DataFrame, spans: list[Span]) -> list[Span]:
    """Hours of which other rows landed than the raw files hold; one row per day is collected."""
    bucket = landed.schema["bucket"]
    start = F.unix_micros(utc_instant(column("bucket"), bucket.dataType))
    arrived = landed.filter(within(bucket, spans, DATE)).groupBy(start.alias("hour_us"))
    both = arrived.agg(F.sum("samples").alias("arrived")).join(
        among(hours, spans).select("hour_us", "rows"), "hour_us", "full_outer"
    )
    wrong = both.where(~F.col("arrived").eqNullSafe(F.col("rows")))
    days = wrong.groupBy(F.floor(F.col("hour_us") / DAY)).agg(F.collect_list("hour_us").alias("h"))
    return merge([(h, h + HOUR) for r in days.collect() for h in r["h"]])
