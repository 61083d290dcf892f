"""Time buckets: widths and the column expression that assigns a row to its bucket."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .instants import MICROS, utc_date

HOUR = 3_600 * MICROS

# Seconds per unit, and the bucket origins, Monday 2000-01-03 UTC for
# widths up to weeks and 2000-01-01 for months.
_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800}
_ORIGIN_SECONDS = 946_857_600
_ORIGIN_YEAR = 2000
_ORIGIN_DATE = "2000-01-01"

_WIDTH = re.compile(r"(\d+)\s*(second|minute|hour|day|week|month)s?", re.IGNORECASE | re.ASCII)


@dataclass(frozen=True)
class Width:
    """A bucket width: either a fixed number of seconds or a number of calendar months."""

    seconds: int = 0
    months: int = 0

    def holds_whole_hours(self) -> bool:
        return self.months > 0 or self.seconds % 3_600 == 0


def parse_width(text: str) -> Width:
    match = _WIDTH.fullmatch(text.strip()) if isinstance(text, str) else None
    if match is None:
        raise ValueError(f"invalid_bucket_interval: {text!r}")
    count, unit = int(match[1]), match[2].lower()
    if unit == "month":
        width = Width(months=count)
    else:
        width = Width(seconds=count * _UNIT_SECONDS[unit])
    if count == 0 or width.months >= 2**31 or width.seconds * MICROS >= 2**63:
        raise ValueError(f"invalid_bucket_interval: {text!r}")
    return width


def bucket_start(column: Column, dtype: T.DataType, width: Width) -> Column:
    """Start of the bucket holding each value, in the type of the column."""
    if width.months:
        return _month_start(column, dtype, width.months)
    offset = _ORIGIN_SECONDS % width.seconds
    return F.window(column, f"{width.seconds} seconds", startTime=f"{offset} seconds")["start"]


def _month_start(column: Column, dtype: T.DataType, months: int) -> Column:
    day = utc_date(column, dtype)
    since_origin = (F.year(day) - _ORIGIN_YEAR) * 12 + F.month(day) - 1
    first = F.add_months(
        F.lit(_ORIGIN_DATE).cast("date"), since_origin - F.pmod(since_origin, F.lit(months))
    )
    if isinstance(dtype, T.TimestampNTZType):
        return first.cast(dtype)
    return F.timestamp_seconds(F.unix_date(first).cast("long") * 86_400)
