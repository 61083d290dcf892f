"""Filling rollups: full, windowed and scheduled refresh.

Two small tables next to a rollup say what it holds. ``<location>_coverage`` lists the
spans of time whose hours are complete. It shrinks before data is replaced and grows
after, so a job that dies in between leaves hours uncovered, never wrongly covered;
queries then read those from the raw table. ``<location>_seen`` notes, per day, the raw
files a refresh has taken in, so that a scheduled refresh recomputes only days for which
files came or went, and an exact answer reads such days from the raw table until then.

For raw files that are not stored by day the same is known by the hour: a zone map says which
hours each file holds, and ``<location>_hours`` is a log of the files that each hour was
computed from. An hour whose present files are others is stale. ``<location>_listing`` holds a
digest of the files as they were when no hour was stale; while it fits, none can be. It goes
before any hour is computed anew.

Refreshes may run at once. Each claims the days that it rewrites before it reads raw rows, in the
same numbered notes that hold the coverage. A refresh that meets the claim of another one on its
days fails with ``refresh_in_progress`` and changes nothing; refreshes of other days go on beside
it. A refresh that fails gives its claim back and leaves its days uncovered. The claim of a driver that
was lost ends after ``CLAIM_LIMIT``; should its job come back after that, it fails with
``refresh_overtaken`` and declares nothing. No refresh may take longer than that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta, timezone
from time import time_ns

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import HOUR
from ..functions.instants import ALWAYS, DAY, date_literal, from_micros, to_micros
from ..functions.local import columns, no_rows, rows_of
from ..functions.names import column
from ..functions.spans import Span, dates_of, intersect, merge, subtract, whole_hours
from ..sources.registry import Source
from .filters import within
from .notes import notes_version, read_notes, update_notes, write_notes, write_notes_after
from .rollup import DATE, hourly, stored_range, time_of
from .zones import files, has_files, hours_of, listing_digest, update_zones, zones

# The default policy refreshes from seven days to five minutes ago.
START_OFFSET = timedelta(days=7)
END_OFFSET = timedelta(minutes=5)
#: How long the claim of a refresh stands that neither ended nor failed.
CLAIM_LIMIT = timedelta(hours=12)

# Number of files, their total size, when the newest was written, and a hash of all their
# paths, sizes and times.
Files = tuple[int, int, int, int]


def full_refresh(spark: SparkSession, raw: Source, rollup: Source) -> None:
    """Rebuild the whole rollup. The hour of the newest row may still be filling: it is
    stored but not covered."""
    seen = raw_files(spark, raw)
    by_hour = seen is None and has_files(raw)
    if by_hour:  # before the rows are read: a file that comes in between counts as new
        listing = _open_hours(spark, raw, rollup)
        present = present_hours(spark, raw, rollup, note=True)
    with claimed(spark, rollup, [ALWAYS]) as claim:
        claim.held.clear()
        time = time_of(raw.resolved(spark))
        (
            hourly(raw.read(spark), time.name, rollup.dims, rollup.values)
            .hint("rebalance", DATE)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(DATE)
            .parquet(rollup.location)
        )
        first, last = stored_range(rollup.read(spark))
        if first is not None and last > first:
            claim.done.append((first, last))
        if seen is not None:
            write_notes(spark, rollup.location, "seen", _SEEN, _seen_rows(seen))
        if by_hour:
            _log_hours(rollup, present.withColumn("version", F.lit(time_ns())), "overwrite")
    if by_hour:
        _close_hours(spark, raw, rollup, present, listing)


def refresh_window(
    spark: SparkSession,
    raw: Source,
    rollup: Source,
    start: str | datetime,
    end: str | datetime,
) -> Span | None:
    """Recompute the hours that lie wholly in ``[start, end)`` and keep all others.

    Reads the raw rows of the window only. Returns the refreshed span, or None if the
    window holds no whole hour.
    """
    span = whole_hours(to_micros(start), to_micros(end))
    if span[0] >= span[1]:
        return None
    present = raw_files(spark, raw, span)
    by_hour = present is None and has_files(raw)
    if by_hour:
        listing = _open_hours(spark, raw, rollup)
        hours = present_hours(spark, raw, rollup, note=True)
    others = subtract(_recompute(spark, raw, rollup, [span]), [span])
    if by_hour:
        take_in_hours(spark, rollup, hours, [span])
        _close_hours(spark, raw, rollup, hours, listing)
    if present is not None:
        # A day counts only if no hour of it stays as it was.
        days = {d for d in dates_of([span]) if not intersect(others, _span_of(d))}
        _take_in(spark, rollup, present, days)
    return span


def refresh_policy(
    spark: SparkSession,
    raw: Source,
    rollup: Source,
    now: datetime | None = None,
    start_offset: timedelta | None = START_OFFSET,
    end_offset: timedelta = END_OFFSET,
) -> list[Span]:
    """One scheduled run over the window from ``now - start_offset`` to ``now - end_offset``.

    Recomputes the hours not yet covered and, for a raw table stored by day in files, those
    of days whose files changed since they were last taken in, with their covered hours
    outside the window; for other files the hours whose files changed; for tables of the
    catalog the whole window. Without a ``start_offset`` files are listed whole and
    changes of any age are taken in. Returns the recomputed spans.
    """
    now = now or datetime.now(timezone.utc)
    end = to_micros(now - end_offset)
    if start_offset is not None:
        window = whole_hours(to_micros(now - start_offset), end)
        if window[0] >= window[1]:
            return []
        present = raw_files(spark, raw, window)
        days = dates_of([window])
        seen = _seen(spark, rollup)
    elif not has_files(raw):
        raise ValueError(f"not_stored_in_files: {raw.name} needs a start_offset")
    elif not raw.stored_by_day():
        present, window = None, (ALWAYS[0], whole_hours(0, end)[1])
    else:
        present = raw_files(spark, raw)
        seen = _seen(spark, rollup)
        days = {d for d in {*present, *seen} if to_micros(d) < end}
        window = whole_hours(min(map(to_micros, days), default=end), end)
        if window[0] >= window[1]:
            return []
    hours = present_hours(spark, raw, rollup, note=True) if present is None else None
    if hours is not None:
        known = coverage(spark, rollup)
        stale = _stale_hours(spark, rollup, hours, window)
        if window[0] == ALWAYS[0]:
            first = hours.agg(F.min("hour_us")).first()[0]
            window = (min([window[1], *[a for a, _ in [*stale, *known]], first or window[1]]), window[1])
        spans = merge([*stale, *subtract([window], known)])
    elif present is None:
        spans = [window]
    else:
        known = coverage(spark, rollup)
        changed = [_span_of(d) for d in days if present.get(d) != seen.get(d)]
        stale = [part for day in changed for part in intersect([*known, window], day)]
        spans = merge([*stale, *subtract([window], known)])
    if hours is not None and spans:
        listing = _open_hours(spark, raw, rollup)
    held = _recompute(spark, raw, rollup, spans) if spans else []
    if hours is not None and spans:
        take_in_hours(spark, rollup, hours, spans)
        _close_hours(spark, raw, rollup, hours, listing)
    if present is not None:
        # Hours that another refresh filled meanwhile, maybe from fewer files than listed here.
        others = dates_of(subtract(held, [*known, *spans]))
        _take_in(spark, rollup, present, days - others)
    return spans


def changed_spans(spark: SparkSession, raw: Source, rollup: Source, window: Span) -> list[Span]:
    """The parts of a window whose raw files are not those that a refresh took in.

    Whole days of a raw table stored by day, and hours of other files. Nothing is known of the
    files of a catalog table, nor of a rollup that was never refreshed from files: none are given.
    """
    present = raw_files(spark, raw, window)
    if present is not None:
        seen = _seen(spark, rollup)
        return [_span_of(d) for d in sorted(dates_of([window])) if present.get(d) != seen.get(d)]
    if not has_files(raw) or _hour_log(spark, rollup) is None:
        return []
    noted = read_notes(spark, rollup.location, "listing", _LISTING)
    if noted and tuple(noted[0]) == listing_digest(files(spark, raw)):
        return []
    return _stale_hours(spark, rollup, present_hours(spark, raw, rollup), window)


def present_hours(
    spark: SparkSession, raw: Source, rollup: Source, note: bool = False
) -> DataFrame | None:
    """``hour_us``, ``files``, ``rows``, ``hash`` per hour of raw files; None for other tables.

    Files that the zone map does not know are read, their time column only, and with ``note``
    put on it."""
    if not has_files(raw):
        return None
    location = raw.zones or f"{rollup.location.rstrip('/')}_zones"
    if note:
        update_zones(spark, raw, location)
    return hours_of(zones(spark, raw, location))


def _open_hours(spark: SparkSession, raw: Source, rollup: Source) -> tuple:
    """Withdraw the digest of the files before hours are computed anew; returns the present one."""
    withdraw_digest(spark, rollup)
    return listing_digest(files(spark, raw))


def withdraw_digest(spark: SparkSession, rollup: Source) -> None:
    write_notes(spark, rollup.location, "listing", _LISTING, [])


def _close_hours(
    spark: SparkSession, raw: Source, rollup: Source, hours: DataFrame, listing: tuple
) -> None:
    """Note the digest again if no file came or went meanwhile, no hour is stale and no other
    refresh is under way. One that begins meanwhile withdraws the digest, so that it is not written."""
    version = notes_version(spark, rollup.location, "listing")
    if listing == listing_digest(files(spark, raw)) and not _claims(_state(spark, rollup)):
        known = coverage(spark, rollup)
        if not (known and _stale_hours(spark, rollup, hours, (known[0][0], known[-1][1]))):
            write_notes_after(spark, rollup.location, "listing", _LISTING, [listing], version)


def _hour_log(spark: SparkSession, rollup: Source) -> DataFrame | None:
    """The files that each hour was last computed from, ``files`` 0 where its rows are gone."""
    if not has_files(rollup):
        return None
    try:
        log = spark.read.schema(_HOURS).parquet(f"{rollup.location.rstrip('/')}_hours")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    state = F.struct("version", "files", "rows", "hash")
    return log.groupBy("hour_us").agg(F.max(state).alias("state")).select("hour_us", "state.*")


def _log_hours(rollup: Source, hours: DataFrame, mode: str) -> None:
    rows = hours.select(*[F.col(f.name).cast(f.dataType) for f in _HOURS.fields])
    rows.coalesce(1).write.mode(mode).parquet(f"{rollup.location.rstrip('/')}_hours")


def take_in_hours(
    spark: SparkSession, rollup: Source, hours: DataFrame, spans: list[Span]
) -> None:
    """Log the files of hours that were computed from them, listed before they were read."""
    chosen = among(hours, spans)
    log = _hour_log(spark, rollup)
    if log is not None:
        gone = among(log, spans).where("files > 0").select("hour_us")
        gone = gone.join(chosen.select("hour_us"), "hour_us", "left_anti")
        zero = F.lit(0).cast("long")
        chosen = chosen.unionByName(
            gone.select("hour_us", *[zero.alias(c) for c in ("files", "rows", "hash")])
        )
    _log_hours(rollup, chosen.withColumn("version", F.lit(time_ns())), "append")


def _stale_hours(
    spark: SparkSession, rollup: Source, hours: DataFrame, window: Span
) -> list[Span]:
    """Hours of a window whose present files are not those that they were computed from, as
    spans within days: the driver gets one row per day that changed."""
    log = _hour_log(spark, rollup)
    now = among(hours, [window]).select("hour_us", F.struct("files", "hash").alias("now"))
    if log is None:
        changed = now
    else:
        then = among(log, [window]).where("files > 0")
        then = then.select("hour_us", F.struct("files", "hash").alias("then"))
        changed = now.join(then, "hour_us", "full_outer").where(~F.col("now").eqNullSafe(F.col("then")))
    day = F.col("hour_us") - F.pmod("hour_us", F.lit(DAY))
    rows = changed.groupBy(day.alias("day")).agg(F.sort_array(F.collect_list("hour_us")).alias("hours"))
    return merge([(h, h + HOUR) for r in rows.collect() for h in r["hours"]])


def among(hours: DataFrame, spans: list[Span]) -> DataFrame:
    inside: Column = F.lit(False)
    for low, high in spans:
        inside |= (F.col("hour_us") >= low) & (F.col("hour_us") < high)
    return hours.where(inside)


def _take_in(
    spark: SparkSession, rollup: Source, present: dict[date, Files], days: set[date]
) -> None:
    """Note the files, listed before they were read, of days that a refresh has taken in."""

    def change(rows: list[Row]) -> list[tuple]:
        kept = {r["day"]: _files(r) for r in rows if r["day"] not in days}
        return _seen_rows(kept | {d: f for d, f in present.items() if d in days})

    update_notes(spark, rollup.location, "seen", _SEEN, change)


@dataclass
class Claim:
    """What was covered of the days that one refresh may rewrite, and what it has done."""

    writer: str
    held: list[Span] = field(default_factory=list)
    done: list[Span] = field(default_factory=list)


@contextmanager
def claimed(spark: SparkSession, rollup: Source, spans: list[Span]) -> Iterator[Claim]:
    """Withdraw the days of some spans from the coverage and keep other refreshes off them.

    At the end, what was held and done is covered; after a failure nothing of these days is."""
    days = _whole_days(spans)
    claim = Claim(uuid.uuid4().hex)

    def begin(rows: list[Row]) -> list[tuple]:
        now = time_ns() // 1000
        oldest = now - CLAIM_LIMIT // timedelta(microseconds=1)
        others = [r for r in _claims(rows) if r["since_us"] >= oldest]
        for r in others:
            if _shared(days, [(r["start_us"], r["end_us"])]):
                raise ValueError(f"refresh_in_progress: {rollup.name} {r['start']} to {r['end']}")
        known = _spans(rows)
        claim.held = _shared(known, days)
        mine = [_note(d, claim.writer, now) for d in days]
        return [*map(_note, subtract(known, days)), *map(tuple, others), *mine]

    def end(rows: list[Row]) -> list[tuple]:
        claims = _claims(rows)
        if claim.writer not in {r["writer"] for r in claims}:
            raise ValueError(f"refresh_overtaken: {rollup.name} took over {CLAIM_LIMIT}")
        others = [tuple(r) for r in claims if r["writer"] != claim.writer]
        return [*map(_note, merge([*_spans(rows), *covered])), *others]

    covered: list[Span] = []
    update_notes(spark, rollup.location, "coverage", _COVERAGE, begin)
    try:
        if notes_version(spark, rollup.location, "listing"):
            withdraw_digest(spark, rollup)
        yield claim
        covered = [*claim.held, *claim.done]
    finally:
        update_notes(spark, rollup.location, "coverage", _COVERAGE, end)


def _whole_days(spans: list[Span]) -> list[Span]:
    return merge([(a // DAY * DAY, min(-(-b // DAY) * DAY, ALWAYS[1])) for a, b in spans])


def _shared(some: list[Span], others: list[Span]) -> list[Span]:
    return [part for other in others for part in intersect(some, other)]


def _recompute(spark: SparkSession, raw: Source, rollup: Source, spans: list[Span]) -> list[Span]:
    """Returns what was covered of the days that the spans touch."""
    time = time_of(raw.resolved(spark))
    with claimed(spark, rollup, spans) as claim:  # before files are listed for reading
        rows = raw.read(spark, spans).filter(within(time, spans, raw.date_column))
        fresh = hourly(rows, time.name, rollup.dims, rollup.values)
        write_hours(spark, rollup, fresh, spans, claim)
    return claim.held


def replace_hours(spark: SparkSession, rollup: Source, fresh: DataFrame, span: Span) -> None:
    """Put ``fresh`` in place of the stored hours of a span, rewriting the days it touches.

    Running it again with the same input gives the same table.
    """
    with claimed(spark, rollup, [span]) as claim:
        write_hours(spark, rollup, fresh, [span], claim)


def write_hours(
    spark: SparkSession, rollup: Source, fresh: DataFrame, spans: list[Span], claim: Claim
) -> None:
    """The same for some spans in one job, under a claim on their days."""
    days = _whole_days(spans)
    stored = rollup.read(spark, days)
    bucket = stored.schema["bucket"]
    in_days: Column = F.lit(False)
    for low, high in days:
        in_days |= F.col(DATE).between(date_literal(low), date_literal(high - 1))
    touched = stored.filter(in_days)
    before = _files_by_day(stored, days)
    (
        fresh.unionByName(touched.filter(~within(bucket, spans)))
        .hint("rebalance", DATE)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE)
        .parquet(rollup.location)
    )
    # Dynamic overwrite leaves a day alone for which nothing was written: one whose raw
    # rows are gone. Its old files are still there.
    nothing = no_rows(spark, stored.drop(DATE).schema)
    for day in {day for day, _ in before & _files_by_day(rollup.read(spark, days), days)}:
        nothing.write.mode("overwrite").parquet(f"{rollup.location}/{DATE}={day}")
    claim.done += spans


def _files_by_day(frame: DataFrame, days: list[Span]) -> set[tuple[date, str]]:
    """Day and path of the files a rollup frame would read for some days."""
    wanted = dates_of(days)
    paths = [(path.rsplit(f"/{DATE}=", 1)[1][:10], path) for path in frame.inputFiles()]
    files = {(date.fromisoformat(day), path) for day, path in paths}
    return {(day, path) for day, path in files if day in wanted}


def coverage(spark: SparkSession, rollup: Source) -> list[Span]:
    """Spans of time for which the rollup holds every hour; a few rows of metadata."""
    if rollup.format == "table":
        return []
    return _spans(_state(spark, rollup))


def _state(spark: SparkSession, rollup: Source) -> list[Row]:
    return read_notes(spark, rollup.location, "coverage", _COVERAGE)


def _spans(rows: list[Row]) -> list[Span]:
    return sorted((r["start_us"], r["end_us"]) for r in rows if r["writer"] is None)


def _claims(rows: list[Row]) -> list[Row]:
    return [r for r in rows if r["writer"] is not None]


def rollup_state(spark: SparkSession, raw: Source, rollup: Source) -> DataFrame:
    """What a rollup holds, in order of time: ``start``, ``end`` (timestamps), ``hours``, ``state``.

    ``held`` hours answer queries; ``stale`` ones are stored, but their raw files changed, so
    that exact answers read raw rows until a refresh. Hours in no row are not covered; of a rollup
    without data there are no rows. One row per stretch, from metadata."""
    known = coverage(spark, rollup)
    changed = changed_spans(spark, raw, rollup, (known[0][0], known[-1][1])) if known else []
    stale = [part for span in changed for part in intersect(known, span)]
    spans = [(*s, "held") for s in subtract(known, stale)] + [(*s, "stale") for s in merge(stale)]
    rows = [(a, b, (b - a) // HOUR, state) for a, b, state in sorted(spans)]
    shape = columns(start_us="long", end_us="long", hours="long", state="string")
    return rows_of(spark, rows, shape).select(
        F.timestamp_micros("start_us").alias("start"),
        F.timestamp_micros("end_us").alias("end"),
        "hours",
        "state",
    )


def coverage_version(spark: SparkSession, rollup: Source) -> int:
    """Differs after any change of the coverage, and once a refresh has begun."""
    return notes_version(spark, rollup.location, "coverage")


def raw_files(
    spark: SparkSession, raw: Source, window: Span | None = None
) -> dict[date, Files] | None:
    """The files of each day of a raw table stored by day, or None for other tables.

    Lists files, one row each, without opening them; of a window, only its days.
    """
    if not raw.stored_by_day():
        return None
    files = replace(raw, format="binaryFile", options={}, columns=None)
    listing = files.read(spark, [window] if window is not None else None)
    if raw.date_column not in listing.columns:
        return None
    day = column(raw.date_column)
    if window is not None:
        listing = listing.filter(day.between(date_literal(window[0]), date_literal(window[1] - 1)))
    days = (
        listing.filter(day.isNotNull())
        .groupBy(day.cast("date").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.max(F.unix_micros("modificationTime")).alias("newest_us"),
            F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("hash"),
        )
    )
    return {r["day"]: _files(r) for r in days.collect()}


def _files(row: Row) -> Files:
    return row["files"], row["bytes"], row["newest_us"], row["hash"]


_COVERAGE = columns(
    start_us="long", end_us="long", start="string", end="string", writer="string", since_us="long"
)
_LISTING = columns(files="long", bytes="long", hash="long")
_HOURS = columns(hour_us="long", files="long", rows="long", hash="long", version="long")
_SEEN = columns(day="date", files="long", bytes="long", newest_us="long", hash="long")


def _note(span: Span, writer: str | None = None, since_us: int | None = None) -> tuple:
    """A span that is covered, or claimed by a writer."""
    start, end = (from_micros(at).isoformat() for at in span)
    return *span, start, end, writer, since_us


def _seen(spark: SparkSession, rollup: Source) -> dict[date, Files]:
    rows = read_notes(spark, rollup.location, "seen", _SEEN)
    return {r["day"]: _files(r) for r in rows}


def _seen_rows(seen: dict[date, Files]) -> list[tuple]:
    return [(d, *f) for d, f in sorted(seen.items())]


def _span_of(day: date) -> Span:
    start = to_micros(day)
    return start, start + DAY
