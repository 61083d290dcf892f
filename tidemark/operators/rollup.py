"""Hourly rollups: their definition and shape.

A rollup is a Parquet table partitioned by UTC date with one row per hour and
combination of dimensions. Next to the average of each value column, under the column's
own name, and the number of ``samples``, it stores the sum, count, minimum and maximum,
from which coarser buckets are merged exactly.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.instants import collected_micros, utc_date
from ..functions.local import columns, no_rows
from ..functions.names import column, quoted
from ..sources.registry import ROLLUP, ROLLUP_PROPERTY, ROLLUP_SUFFIX, Source, table_facts
from .aggregates import mean, partial_name
from .describe import time_range
from .notes import read_notes, write_notes

DATE = "date"

_DEFINITION = columns(rollup_of="string", columns="string")


def hourly(frame: DataFrame, time: str, dims: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Hourly partial aggregates of a batch or streaming frame, by dimension."""
    partials = [partial_name(v, p) for v in values for p in ("sum", "count", "min", "max")]
    clash = {"bucket", "samples", "window", DATE, *partials} & {*dims, *values}
    if clash:
        raise ValueError(f"reserved_columns: {sorted(clash)}")
    wrong = [v for v in values if not isinstance(frame.schema[v].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"invalid_column_type: {wrong} are not numeric")
    by = [column(d) for d in dims]
    measured = [f(column(v)) for v in values for f in (F.sum, F.count, F.min, F.max)]
    grouped = (
        frame.select(column(time), *by, *[column(v) for v in values])
        .groupBy(F.window(column(time), "1 hour"), *by)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            *[m.alias(name) for m, name in zip(measured, partials, strict=True)],
        )
    )
    means = [
        mean(
            column(partial_name(v, "sum")),
            column(partial_name(v, "count")),
            frame.schema[v].dataType,
        ).alias(v)
        for v in values
    ]
    start = F.col("window.start")
    date = utc_date(start, frame.schema[time].dataType).alias(DATE)
    return grouped.select(
        start.alias("bucket"), *by, *means, "samples", *[column(p) for p in partials], date
    )


def create_rollup(
    spark: SparkSession,
    raw: Source,
    path: str,
    dims: tuple[str, ...] = (),
    values: tuple[str, ...] = (),
    name: str | None = None,
    description: str | None = None,
) -> Source:
    """Define the hourly rollup of a raw source, without data.

    A rollup that is already at the path is kept, and must have the same definition.
    """
    raw = raw.resolved(spark)
    time = time_of(raw)
    unknown = [c for c in (*dims, *values) if c not in {f.name for f in raw.fields()}]
    if unknown:
        raise ValueError(f"unknown_columns: {unknown}")
    used = [f for f in raw.fields() if f.name in {time.name, *dims, *values}]
    shape = hourly(no_rows(spark, T.StructType(used)), time.name, tuple(dims), tuple(values))
    stored = T.StructType([T.StructField(f.name, f.dataType) for f in shape.schema.fields])
    definition = (raw.name, stored.json())
    known = read_notes(spark, path, "definition", _DEFINITION)
    if known and tuple(known[0]) != definition:
        raise ValueError(f"rollup_mismatch: {path} holds a rollup with another definition")
    if not known:
        no_rows(spark, stored).write.partitionBy(DATE).parquet(path)
        write_notes(spark, path, "definition", _DEFINITION, [definition])
    return Source(
        name=name or raw.name + ROLLUP_SUFFIX,
        location=path,
        kind=ROLLUP,
        schema=raw.schema,
        description=description,
        columns=stored,
        date_column=DATE,
        rollup_of=raw.name,
        dims=tuple(dims),
        values=tuple(values),
    )


def publish_rollup(spark: SparkSession, rollup: Source, table: str) -> None:
    """Put a rollup in the catalog, as an external table over its files.

    Its definition goes into the table's properties, from which ``discover`` makes the same
    source again, coverage and all. Publishing again takes new days into a catalog that keeps
    partitions, and refuses a table that holds anything else.
    """
    location = rollup.location.rstrip("/")
    if not spark.catalog.tableExists(table):
        definition = {"rollup_of": rollup.rollup_of, "dims": rollup.dims, "values": rollup.values}
        fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rollup.columns)
        spark.sql(
            f"CREATE TABLE {table} ({fields}) USING parquet PARTITIONED BY ({quoted(DATE)}) "
            f"LOCATION {_text(location)} COMMENT {_text(rollup.description or '')} "
            f"TBLPROPERTIES ({_text(ROLLUP_PROPERTY)} = {_text(json.dumps(definition))})"
        )
    about = table_facts(spark, table)
    if about.get("Location", "").split(":", 1)[-1].lstrip("/") != location.split(":", 1)[-1].lstrip("/"):
        raise ValueError(f"rollup_mismatch: {table} lies elsewhere")
    if about.get("Partition Provider") == "Catalog":
        spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def time_of(source: Source) -> T.StructField:
    """The time column of a resolved source that must have one."""
    time = source.time()
    if time is None:
        raise ValueError(f"no_time_column_detected: {source.name}")
    return time


def stored_range(frame: DataFrame) -> tuple[int | None, int | None]:
    """First and last hour of a rollup frame."""
    dtype = frame.schema["bucket"].dataType
    row = time_range(frame, "bucket", DATE).first()
    return collected_micros(row["min"], dtype), collected_micros(row["max"], dtype)
