"""Frames of a few known rows. Unlike ``createDataFrame`` on a list they need no Python
worker, which matters where a job has little else to do."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns(**types: str) -> T.StructType:
    """A schema from names and simple types."""
    shape = T.StructType()
    for name, dtype in types.items():
        shape.add(name, dtype)
    return shape


def rows_of(spark: SparkSession, rows: Iterable[tuple], shape: T.StructType) -> DataFrame:
    """Rows of numbers, text, booleans and dates."""
    named = [dict(zip(shape.names, row, strict=True)) for row in rows]
    text = F.lit(json.dumps(named, default=str))
    one = spark.range(0, 1, 1, numPartitions=1)
    return one.select(F.inline(F.from_json(text, T.ArrayType(shape))))


def no_rows(spark: SparkSession, shape: T.StructType) -> DataFrame:
    return spark.range(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields]
    )
