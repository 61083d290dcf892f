"""Instants and UTC calendar days, independent of the session time zone.

Instants travel through planning as integer microseconds since 1970-01-01 UTC.
A column of type ``timestamp`` holds such an instant; ``timestamp_ntz`` is taken
to hold UTC wall-clock time.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000
DAY = 86_400 * MICROS
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: First instant of year 1 and last of year 9999, as microseconds.
ALWAYS = (-62_135_596_800 * MICROS, 253_402_300_800 * MICROS - 1)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))


def to_micros(value: str | datetime | date) -> int:
    """Read ISO-8601 text, a datetime or a date; without an offset it is UTC."""
    try:
        if isinstance(value, str):
            value = datetime.fromisoformat(value.strip())
        elif not isinstance(value, datetime):
            value = datetime(value.year, value.month, value.day)
    except (ValueError, AttributeError):
        raise ValueError(f"invalid_timestamp: {value!r}") from None
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return (value - _EPOCH) // timedelta(microseconds=1)


def from_micros(micros: int) -> datetime:
    try:
        return _EPOCH + timedelta(microseconds=micros)
    except OverflowError:
        raise ValueError(f"invalid_timestamp: {micros} microseconds") from None


def collected_micros(value: datetime | None, dtype: T.DataType) -> int | None:
    """Instant of a collected value: Spark returns ``timestamp`` as naive local time."""
    if value is None:
        return None
    return to_micros(value.astimezone(timezone.utc) if isinstance(dtype, T.TimestampType) else value)


def isoformat(value: datetime, dtype: T.DataType) -> str:
    return from_micros(collected_micros(value, dtype)).isoformat()


def literal(micros: int, dtype: T.DataType) -> Column:
    """Literal of the column's own type, so that comparisons reach the scan uncast."""
    text = from_micros(micros).isoformat(sep=" ")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(text.removesuffix("+00:00")).cast(T.TimestampNTZType())
    return F.lit(text).cast(T.TimestampType())


def utc_date(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.to_date(column)
    seconds = F.unix_seconds(column)
    days = (seconds - F.pmod(seconds, F.lit(86_400))) / F.lit(86_400)
    return F.date_from_unix_date(days.cast("int"))


def date_literal(micros: int) -> Column:
    return F.lit(from_micros(micros).date())


def utc_wall_clock(column: Column, dtype: T.DataType) -> Column:
    """A ``timestamp_ntz`` of the UTC wall clock."""
    if isinstance(dtype, T.TimestampNTZType):
        return column
    seconds = F.unix_micros(column).cast("decimal(20,0)") / F.lit(MICROS).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType())
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def utc_instant(column: Column, dtype: T.DataType) -> Column:
    """A ``timestamp`` from UTC wall-clock time."""
    if isinstance(dtype, T.TimestampType):
        return column
    return F.make_timestamp_ltz(
        F.year(column),
        F.month(column),
        F.dayofmonth(column),
        F.hour(column),
        F.minute(column),
        F.date_part(F.lit("SECOND"), column),
        F.lit("UTC"),
    )


def iso_text(column: Column, dtype: T.DataType) -> Column:
    """ISO-8601 text in UTC; the fraction is left out when it is zero."""
    text = F.date_format(utc_wall_clock(column, dtype), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))
