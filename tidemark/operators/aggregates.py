"""The five aggregates over time buckets, directly and from mergeable partials."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_fields import json_fields, json_text
from ..functions.names import column

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}

# The partials each aggregate is merged from, and how one partial merges with another.
PARTIALS = {
    "avg": ("sum", "count"),
    "sum": ("sum",),
    "min": ("min",),
    "max": ("max",),
    "count": ("count",),
}
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """One aggregated expression: a column, or a key of a JSON column."""

    column: str
    dtype: T.DataType
    key: str | None = None

    @property
    def label(self) -> str:
        return self.column if self.key is None else f"{self.column}_{self.key}"

    def check(self, aggregation: str, payload: bool) -> None:
        """Refuse what would otherwise fail only while the job runs."""
        if self.key is not None or aggregation == "count":
            return
        if aggregation in ("avg", "sum"):
            fits = isinstance(self.dtype, (T.NumericType, T.DayTimeIntervalType))
        else:
            fits = not payload and not isinstance(
                self.dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)
            )
        if not fits:
            raise ValueError(
                f"invalid_column_type: {aggregation}({self.column}) "
                f"on {self.dtype.simpleString()}"
            )


def mean(total: Column, count: Column, dtype: T.DataType) -> Column:
    """Average from a sum and a count, typed as Spark's ``avg`` of a ``dtype`` column."""
    if isinstance(dtype, T.DecimalType):
        result = T.DecimalType(min(dtype.precision + 4, 38), min(dtype.scale + 4, 38))
        return F.try_divide(total, count).cast(result)
    return F.try_divide(total.cast("double"), count)


def aggregate(
    frame: DataFrame, bucket: Column, measures: list[Measure], aggregation: str
) -> DataFrame:
    """One row per non-empty bucket; without measures, the list of those buckets."""
    function = AGGREGATES[aggregation]
    kept = _values(frame, bucket, measures, aggregation)
    if not measures:
        return kept.distinct()
    return kept.groupBy("bucket").agg(
        *[function(F.col(f"m{i}")).alias(f"{m.label}_{aggregation}") for i, m in enumerate(measures)]
    )


def _values(
    frame: DataFrame, bucket: Column, measures: list[Measure], aggregation: str
) -> DataFrame:
    """The bucket and the value ``m0, m1, ...`` of each measure.

    Fields of one payload are read together, so each payload is parsed once.
    """
    parses: list[tuple[str, dict[str, str]]] = []
    plain, fields = [], []
    for i, m in enumerate(measures):
        if m.key is None:
            plain.append(column(m.column).alias(f"m{i}"))
            fields.append(F.col(f"m{i}"))
            continue
        folded = m.key.lower()
        fitting = [p for p, (c, keys) in enumerate(parses) if c == m.column and folded not in keys]
        place = fitting[0] if fitting else len(parses)
        if not fitting:
            parses.append((m.column, {}))
        parses[place][1][folded] = m.key
        text = F.col(f"p{place}").getField(m.key)
        fields.append((text if aggregation == "count" else text.cast("double")).alias(f"m{i}"))
    structs = [
        json_fields(json_text(column(c), frame.schema[c].dataType), keys.values()).alias(f"p{p}")
        for p, (c, keys) in enumerate(parses)
    ]
    return frame.select(bucket.alias("bucket"), *plain, *structs).select("bucket", *fields)


def partial_columns(measure: Measure, aggregation: str) -> list[Column]:
    """Partials of a single raw row, shaped like those stored in a rollup."""
    value = column(measure.column)
    single = {
        "sum": value.cast(sum_type(measure.dtype)),
        "count": F.when(value.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"),
        "min": value,
        "max": value,
    }
    return [single[p].alias(partial_name(measure.column, p)) for p in PARTIALS[aggregation]]


def merge_partials(frame: DataFrame, measures: list[Measure], aggregation: str) -> DataFrame:
    """Final aggregates from rows of partials, grouped by their ``bucket`` column."""
    if not measures:
        return frame.select("bucket").distinct()
    merged = frame.groupBy("bucket").agg(
        *[
            _MERGE[p](column(partial_name(m.column, p))).alias(partial_name(m.column, p))
            for m in measures
            for p in PARTIALS[aggregation]
        ]
    )
    results = []
    for m in measures:
        parts = [column(partial_name(m.column, p)) for p in PARTIALS[aggregation]]
        if aggregation == "avg":
            result = mean(*parts, m.dtype)
        elif aggregation == "sum":
            result = parts[0].cast(sum_type(m.dtype))
        else:
            result = parts[0]
        results.append(result.alias(f"{m.label}_{aggregation}"))
    return merged.select("bucket", *results)


def partial_name(value: str, partial: str) -> str:
    return f"{value}__{partial}"


def sum_type(dtype: T.DataType) -> T.DataType:
    """Type of Spark's ``sum`` over a numeric column."""
    if isinstance(dtype, T.DecimalType):
        return T.DecimalType(min(dtype.precision + 10, 38), dtype.scale)
    return T.DoubleType() if isinstance(dtype, T.FractionalType) else T.LongType()
