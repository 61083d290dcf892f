"""Raw tables stored by UTC day, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.instants import utc_date
from ..functions.names import column


def store_by_day(
    frame: DataFrame,
    path: str,
    time_column: str,
    date_column: str = "date",
    mode: str = "errorifexists",
    rebalance: bool = True,
) -> None:
    """Write a raw table partitioned by the UTC date of its time column.

    Rebalancing gives each day few files and lets adaptive execution split a day that
    is far larger than the rest. Input that already arrives day by day can skip that
    shuffle. Rows are sorted by time within files, so row-group statistics also prune
    ranges inside a day.
    """
    dtype = frame.schema[time_column].dataType
    dated = frame.withColumn(date_column, utc_date(column(time_column), dtype))
    if rebalance:
        dated = dated.hint("rebalance", date_column)
    ordered = dated.sortWithinPartitions(column(date_column), column(time_column))
    ordered.write.mode(mode).partitionBy(date_column).parquet(path)


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new path under the cluster's ``spark.checkpoint.dir``.

    Where that is unset, only a local session may fall back to a temporary folder, as
    no other machine would see it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
