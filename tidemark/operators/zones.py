"""Zone maps: what each file of a raw table holds, hour by hour.

A zone map is a Parquet table with a row per file and hour of its time column: how many rows, the
first and the last instant. A file goes by path, size and time of writing, as Spark's hidden
``_metadata`` columns give them; a noted file that still has all three need not be opened again,
and one that does not is read anew. Rows without a time count under a null hour.

Only the time column of new files is read to keep a map up. Noting a file is one row group of one
data file of the map, so a job that dies leaves whole files noted or not noted. Files noted
twice by jobs that ran at once count once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import HOUR
from ..functions.instants import utc_instant, utc_wall_clock
from ..functions.names import column
from ..sources.registry import Source

FILE = ["path", "length", "modified_us"]
#: Files that a scan may name one by one; beyond that it reads the table and joins.
MOST_NAMED = 2000
_LISTING_OPTIONS = ("pathGlobFilter", "recursiveFileLookup", "modifiedBefore", "modifiedAfter")


def has_files(source: Source) -> bool:
    return bool(source.location) and source.format not in ("table", "jdbc")


def files(spark: SparkSession, source: Source) -> DataFrame:
    """``path``, ``length`` and ``modified_us`` of every file of a source, none of them opened."""
    kept = {k: v for k, v in source.options.items() if k in _LISTING_OPTIONS}
    listing = replace(source, format="binaryFile", options=kept, columns=None).read(spark)
    return listing.select(*_file_columns())


def _file_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("length"),
        F.unix_micros("_metadata.file_modification_time").alias("modified_us"),
    ]


def listing_digest(listed: DataFrame) -> tuple:
    """Number, size and a hash of all files of a listing."""
    row = listed.agg(
        F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.bit_xor(F.xxhash64(*FILE))
    ).first()
    return tuple(row)


def _measured(frame: DataFrame, time: T.StructField) -> DataFrame:
    at = F.unix_micros(utc_instant(column(time.name), time.dataType)).alias("at_us")
    hour = (F.col("at_us") - F.pmod("at_us", F.lit(HOUR))).alias("hour_us")
    return (
        frame.select(*_file_columns(), at)
        .groupBy(*FILE, hour)
        .agg(
            F.count("*").alias("rows"),
            F.min("at_us").alias("low_us"),
            F.max("at_us").alias("high_us"),
        )
    )


def _noted(spark: SparkSession, location: str) -> DataFrame | None:
    try:
        return spark.read.parquet(location).dropDuplicates([*FILE, "hour_us"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _unknown(
    spark: SparkSession, source: Source, time: T.StructField, listed: DataFrame, known: DataFrame | None
) -> DataFrame | None:
    """Zones of the files that are not noted, read from those files; None if there are none."""
    if known is None:
        return _measured(source.read(spark), time)
    fresh = listed.join(known.select(*FILE).distinct(), FILE, "left_anti")
    names = [r["path"] for r in fresh.select("path").limit(MOST_NAMED + 1).collect()]
    if not names:
        return None
    if len(names) <= MOST_NAMED:  # Spark skips the files that are not named
        return _measured(source.read(spark).where(F.col("_metadata.file_path").isin(names)), time)
    return _measured(source.read(spark), time).join(fresh, FILE, "left_semi")


def update_zones(spark: SparkSession, source: Source, location: str) -> None:
    """Note the files of a source that are not in its zone map yet."""
    source = source.resolved(spark)
    time = source.time()
    if time is None:
        raise ValueError(f"no_time_column_detected: {source.name}")
    fresh = _unknown(spark, source, time, files(spark, source), _noted(spark, location))
    if fresh is not None:
        fresh.repartition("path").write.mode("append").parquet(location)


def zones(spark: SparkSession, source: Source, location: str) -> DataFrame:
    """The zones of all present files: noted ones from the map, others from their time column."""
    source = source.resolved(spark)
    listed, known = files(spark, source), _noted(spark, location)
    fresh = _unknown(spark, source, source.time(), listed, known)
    if known is None:
        return fresh
    present = known.join(listed, FILE, "left_semi")
    return present if fresh is None else present.unionByName(fresh)


def hours_of(zoned: DataFrame) -> DataFrame:
    """Per hour with rows: ``files``, ``rows`` and a ``hash`` of its files."""
    return (
        zoned.where(F.col("hour_us").isNotNull())
        .groupBy("hour_us")
        .agg(
            F.count("*").alias("files"),
            F.sum("rows").alias("rows"),
            F.bit_xor(F.xxhash64(*FILE)).alias("hash"),
        )
    )


def instant_of(micros: Column, dtype: T.DataType) -> Column:
    """Microseconds as a value of a time column's type."""
    instant = F.timestamp_micros(micros)
    if isinstance(dtype, T.TimestampNTZType):
        return utc_wall_clock(instant, T.TimestampType())
    return instant
