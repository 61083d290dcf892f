"""Keys of JSON payloads counted by day and kept, so that profiles parse only what is new.

The counts of a raw table stored by day lie in a Parquet table of day, key and occurrences, one
directory per update (``version``). ``<place>_days`` notes for each day the files that were counted and
the version that holds the counts. A version counts for a day once it is noted, and none is
overwritten: an update that dies leaves a version that nothing refers to, and queries planned
before an update go on reading theirs.

A profile of any range adds up the counts of days that lie wholly in it and whose files are those
noted, and parses the rows of all others: days whose files changed, and days cut by a bound. So
it equals the profile of all rows, whether or not the counts are up to date.

Defined cases: payloads that are null or no objects have no keys; a key that a payload repeats
counts once. Rows without time belong to no day and are not counted. A table without days has no keys.
"""

from __future__ import annotations

from datetime import date, datetime
from time import time_ns

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import ALWAYS, DAY, to_micros
from ..functions.json_fields import json_keys, json_text
from ..functions.local import columns, no_rows, rows_of
from ..functions.names import column
from ..functions.spans import Span, intersect, merge
from ..sources.registry import Source
from .filters import within
from .notes import read_notes, write_notes
from .refresh import Files, raw_files
from .rollup import time_of

_DAYS = columns(
    day="date", files="long", bytes="long", newest_us="long", hash="long", version="long"
)
_NOTED = columns(day="date", version="long")
_COUNTS = columns(day="date", key="string", occurrences="long", version="long")
_NOTES = "days"


def update_key_counts(spark: SparkSession, source: Source, payload: str, place: str) -> list[date]:
    """Count the keys of the days whose files came or went since they were counted; return these.

    Lists the files of all days and reads those of changed days only. One job at a time.
    """
    present = _present(spark, source)
    noted = _noted(spark, place)
    fresh = {day: files for day, files in present.items() if noted.get(day, (None,))[0] != files}
    gone = noted.keys() - present.keys()
    if not fresh and not gone:
        return []
    version = time_ns()
    if fresh:
        rows = _rows(spark, source, [_span_of(day) for day in fresh])
        counts = _counted(rows, source, payload, "day")
        counts.withColumn("version", F.lit(version)).hint("rebalance").write.mode("append").partitionBy(
            "version"
        ).parquet(place)
    noted = {day: known for day, known in noted.items() if day in present}
    noted |= {day: (files, version) for day, files in fresh.items()}
    write_notes(
        spark, place, _NOTES, _DAYS, [(d, *files, v) for d, (files, v) in sorted(noted.items())]
    )
    return sorted({*fresh, *gone})


def key_profile(
    spark: SparkSession,
    source: Source,
    payload: str,
    place: str,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    top: int | None = None,
) -> DataFrame:
    """``key`` and ``occurrences`` of all rows of a range, both ends included, most common first.

    Bounds may be open; ``top`` keeps that many keys. ``place`` is what ``update_key_counts`` keeps.
    """
    window = (
        to_micros(start) if start is not None else ALWAYS[0],
        to_micros(end) + 1 if end is not None else ALWAYS[1],
    )
    noted = _noted(spark, place)
    held, others = [], []
    for day, files in _present(spark, source, window).items():
        inside = intersect([_span_of(day)], window)
        if inside == [_span_of(day)] and noted.get(day, (None,))[0] == files:
            held.append((day, noted[day][1]))
        else:
            others += inside
    parts = [no_rows(spark, _COUNTS).select("key", "occurrences")]
    if held:
        versions = sorted({version for _, version in held})
        kept = spark.read.schema(_COUNTS).parquet(place).where(F.col("version").isin(versions))
        # One small row per day of the range.
        days = F.broadcast(rows_of(spark, held, _NOTED))
        parts.append(kept.join(days, ["day", "version"], "left_semi").select("key", "occurrences"))
    if others:
        parts.append(_counted(_rows(spark, source, merge(others)), source, payload))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    profile = union.groupBy("key").agg(F.sum("occurrences").alias("occurrences"))
    profile = profile.orderBy(F.desc("occurrences"), "key")
    return profile.limit(top) if top is not None else profile


def _present(
    spark: SparkSession, source: Source, window: Span = ALWAYS
) -> dict[date, Files]:
    present = raw_files(spark, source, window if window != ALWAYS else None)
    if present is None:
        raise ValueError(f"not_stored_by_day: {source.name}")
    return present


def _noted(spark: SparkSession, place: str) -> dict[date, tuple[Files, int]]:
    rows = read_notes(spark, place, _NOTES, _DAYS)
    return {r["day"]: ((r["files"], r["bytes"], r["newest_us"], r["hash"]), r["version"]) for r in rows}


def _rows(spark: SparkSession, source: Source, spans: list[Span]) -> DataFrame:
    spans = merge(spans)
    time = time_of(source.resolved(spark))
    return source.read(spark, spans).filter(within(time, spans, source.date_column))


def _counted(rows: DataFrame, source: Source, payload: str, *by: str) -> DataFrame:
    """Occurrences of keys, by day if asked for; combined before the shuffle."""
    text = json_text(column(payload), rows.schema[payload].dataType)
    day = column(source.date_column).cast("date")
    keys = rows.select(day.alias("day"), F.explode(json_keys(text)).alias("key"))
    return keys.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("occurrences"))


def _span_of(day: date) -> Span:
    start = to_micros(day)
    return start, start + DAY
