"""The bucketed aggregate query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.buckets import bucket_start, parse_width
from ..functions.instants import ALWAYS, isoformat, to_micros
from ..functions.json_fields import split_field
from ..functions.names import column
from ..operators.aggregates import AGGREGATES, Measure, aggregate
from ..operators.filters import equal_to, within
from ..sources.registry import Registry, Source
from .routing import MODES, can_merge, candidate, merged_aggregate, split_range, still_holds

# Fixed value: the default cap on result rows.
ROW_LIMIT = 5000


def _over(row_limit: int) -> str:
    return f"row_limit_exceeded: the answer has over {row_limit} buckets, ask for fewer"


@dataclass(frozen=True)
class Answer:
    """A planned query. ``frame`` is lazy, sorted by bucket and not capped."""

    table_requested: str
    table_used: str
    kind_used: str
    bucket: str
    aggregation: str
    frame: DataFrame

    def capped(self, row_limit: int = ROW_LIMIT) -> DataFrame:
        """The rows, lazily; reading them fails if there are more than ``row_limit``."""
        first = self.frame.limit(row_limit + 1)  # a row too many tells that there are more
        number = F.row_number().over(Window.orderBy("bucket"))
        excess = F.raise_error(F.lit(_over(row_limit))).cast("boolean")
        fits = F.when(F.col("_number") > row_limit, excess).otherwise(F.lit(True))
        return first.withColumn("_number", number).where(fits).drop("_number")

    def record(self, row_limit: int = ROW_LIMIT) -> dict[str, Any]:
        """The result as a dict with rows of plain values; an error beyond the cap."""
        rows = self.frame.limit(row_limit + 1).collect()
        if len(rows) > row_limit:
            raise ValueError(_over(row_limit))
        types = {f.name: f.dataType for f in self.frame.schema.fields}
        return {
            "table_requested": self.table_requested,
            "table_used": self.table_used,
            "kind_used": self.kind_used,
            "bucket": self.bucket,
            "aggregation": self.aggregation,
            "row_count": len(rows),
            "rows": [
                {
                    name: isoformat(v, types[name]) if isinstance(v, datetime) else v
                    for name, v in row.asDict().items()
                }
                for row in rows
            ],
        }


def plan_timeseries(
    spark: SparkSession,
    registry: Registry,
    table: str,
    columns: Sequence[str],
    from_ts: str | datetime | None,
    to_ts: str | datetime | None,
    aggregation: str = "avg",
    bucket: str = "1 hour",
    filters: Mapping[str, Any] | None = None,
    rollup: str = "exact",
) -> Answer:
    """Aggregate ``columns`` per time bucket between two instants, both inclusive; None leaves
    an end open.

    ``rollup`` says how an hourly rollup may be used when buckets are made of whole
    hours: ``exact`` takes covered hours from it and the rest from raw rows, giving the
    answer over raw rows; ``stored`` aggregates the rollup's own columns instead of the
    raw table, as does ``exact`` for columns that only the rollup has; ``never`` reads
    raw rows. Planning reads metadata only.
    """
    if aggregation not in AGGREGATES:
        raise ValueError(f"invalid_aggregation: {aggregation!r}")
    if rollup not in MODES:
        raise ValueError(f"invalid_rollup_mode: {rollup!r}")
    width = parse_width(bucket)
    source = registry.get(table)
    wanted = dict(filters or {})
    routed = candidate(registry, source, width) if rollup != "never" else None
    source = source.resolved(spark)
    if routed is not None:
        routed = routed.resolved(spark)
        if rollup == "stored" or _known_to_rollup_only(routed, source, {*columns, *wanted}):
            source, routed = routed, None
    fields = {f.name: f for f in source.fields()}
    time = source.time()
    if time is None:
        raise ValueError(f"no_time_column_detected: {source.name}")
    measures = _measures(source, columns)
    unknown = [name for name in wanted if name not in fields]
    if unknown:
        raise ValueError(f"unknown_filter_columns: {unknown}")
    for m in measures:
        m.check(aggregation, payload=m.column in source.json_columns)
    conditions = equal_to(wanted, fields)
    span = (
        ALWAYS[0] if from_ts is None else to_micros(from_ts),
        (ALWAYS[1] if to_ts is None else to_micros(to_ts)) + 1,
    )

    used, result = source, None
    if routed is not None and can_merge(routed, measures, wanted):
        split = split_range(spark, routed, source, span)
        if split.rolled:
            merged = merged_aggregate(
                spark, routed, source, split, width, measures, aggregation, wanted
            )
            if still_holds(spark, routed, split):
                used, result = routed, merged
    if result is None:
        selected = source.read(spark, [span]).filter(within(time, [span], source.date_column))
        selected = reduce(DataFrame.filter, conditions, selected)
        start = bucket_start(column(time.name), time.dataType, width)
        result = aggregate(selected, start, measures, aggregation)
    return Answer(table, used.name, used.kind, bucket, aggregation, result.orderBy("bucket"))


def _known_to_rollup_only(rollup: Source, raw: Source, names: set[str]) -> bool:
    """Whether some names, such as ``samples``, are columns of the rollup but not of its
    raw table, and the rollup has all the others too."""
    if names <= {f.name for f in raw.fields()}:
        return False
    return names <= {f.name for f in rollup.fields()}


def _measures(source: Source, columns: Sequence[str]) -> list[Measure]:
    """Distinct measures, each a column or ``payload->>'key'`` of a JSON column."""
    fields = {f.name: f for f in source.fields()}
    payloads = source.payloads()
    found, unknown = {}, []
    for text in columns:
        field = split_field(text)
        if text in fields:
            measure = Measure(text, fields[text].dataType)
        elif field is not None and field[0] in payloads:
            measure = Measure(field[0], fields[field[0]].dataType, field[1])
        else:
            unknown.append(text)
            continue
        if found.setdefault(measure.label, measure) != measure:
            raise ValueError(f"ambiguous_columns: {measure.label}")
    if unknown:
        raise ValueError(f"unknown_columns: {unknown}")
    return list(found.values())
