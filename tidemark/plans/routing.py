"""Which stored data answers a bucketed query: raw rows, a rollup, or both."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.buckets import Width, bucket_start
from ..functions.names import column
from ..functions.spans import Span, intersect, subtract, whole_hours
from ..operators.aggregates import (
    PARTIALS,
    Measure,
    merge_partials,
    partial_columns,
    partial_name,
)
from ..operators.filters import equal_to, within
from ..operators.refresh import changed_spans, coverage, coverage_version
from ..sources.registry import RAW, Registry, Source

MODES = ("exact", "stored", "never")


@dataclass(frozen=True)
class Split:
    """A range answered from whole hours of a rollup and raw rows for the rest, as of a
    version of the rollup's coverage."""

    rolled: list[Span]
    raw: list[Span]
    version: int


def candidate(registry: Registry, source: Source, width: Width) -> Source | None:
    """The rollup of a raw source, if every bucket is made of whole hours."""
    if source.kind != RAW or not width.holds_whole_hours():
        return None
    return registry.rollup_of(source.name)


def split_range(spark: SparkSession, rollup: Source, raw: Source, span: Span) -> Split:
    """Covered hours go to the rollup, but for those whose raw files changed since."""
    version = coverage_version(spark, rollup)
    rolled = intersect(coverage(spark, rollup), whole_hours(*span))
    if rolled:
        within_days = (rolled[0][0], rolled[-1][1])
        rolled = subtract(rolled, changed_spans(spark, raw, rollup, within_days))
    return Split(rolled, subtract([span], rolled) if span[0] < span[1] else [], version)


def still_holds(spark: SparkSession, rollup: Source, split: Split) -> bool:
    """Whether no refresh changed the coverage since the split.

    Asked after the rollup's files are listed: else the listing may fall between the
    removal of a day's old files and the arrival of its new ones.
    """
    return coverage_version(spark, rollup) == split.version


def can_merge(rollup: Source, measures: list[Measure], filters: Mapping[str, Any]) -> bool:
    """Whether the rollup stores partials of every measure and every filter column."""
    return all(m.key is None and m.column in rollup.values for m in measures) and all(
        name in rollup.dims for name in filters
    )


def merged_aggregate(
    spark: SparkSession,
    rollup: Source,
    raw: Source,
    split: Split,
    width: Width,
    measures: list[Measure],
    aggregation: str,
    filters: Mapping[str, Any],
) -> DataFrame:
    """The answer over raw rows, with the hours in ``split.rolled`` taken from the rollup.

    Both sides become rows of partials of the same shape, so one aggregation, combined
    before its only shuffle, finishes them.
    """
    time = raw.time()
    conditions = equal_to(filters, {f.name: f for f in raw.fields()})

    def selected(source: Source, at: T.StructField, spans: list[Span]) -> DataFrame:
        rows = source.read(spark, spans).filter(within(at, spans, source.date_column))
        return reduce(DataFrame.filter, conditions, rows)

    start = rollup.time()
    parts = selected(rollup, start, split.rolled).select(
        bucket_start(column(start.name), start.dataType, width).alias("bucket"),
        *[column(partial_name(m.column, p)) for m in measures for p in PARTIALS[aggregation]],
    )
    if split.raw:
        parts = parts.unionByName(
            selected(raw, time, split.raw).select(
                bucket_start(column(time.name), time.dataType, width).alias("bucket"),
                *[c for m in measures for c in partial_columns(m, aggregation)],
            )
        )
    return merge_partials(parts, measures, aggregation)
