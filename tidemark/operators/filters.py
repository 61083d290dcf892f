"""Time-range and equality filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.instants import ALWAYS, date_literal, from_micros, is_time, literal, to_micros
from ..functions.names import column
from ..functions.spans import Span


def within(
    time: T.StructField, spans: Iterable[Span], date_column: str | None = None
) -> Column:
    """Rows whose time lies in one of the half-open spans ``[from, through)``.

    Storage is partitioned by a date derived from the time, which Catalyst cannot see,
    so the matching date range is stated as well and prunes partitions. A span that begins
    or ends with ``ALWAYS`` is open there: it holds instants that no literal can name, too.
    """
    parts = []
    for start, end in spans:
        at, part = column(time.name), column(time.name).isNotNull()
        if start > ALWAYS[0]:
            part &= at >= literal(start, time.dataType)
            if date_column is not None:
                part &= column(date_column) >= date_literal(start)
        if end <= ALWAYS[1]:
            part &= at <= literal(end - 1, time.dataType)
            if date_column is not None:
                part &= column(date_column) <= date_literal(end - 1)
        parts.append(part)
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def equal_to(filters: Mapping[str, Any], fields: Mapping[str, T.StructField]) -> list[Column]:
    """``column = value`` per entry; a None matches nothing, as ``= NULL`` does in SQL."""
    return [column(name) == _typed(value, fields[name]) for name, value in filters.items()]


def _typed(value: Any, field: T.StructField) -> Column:
    dtype = field.dataType
    if value is None:
        return F.lit(None).cast(dtype)
    if is_time(dtype):
        return literal(to_micros(value), dtype)
    if isinstance(dtype, T.NumericType):
        return F.lit(_number(value, field))
    if isinstance(dtype, T.BooleanType):
        return F.lit(_boolean(value, field))
    if isinstance(dtype, T.DateType):
        return F.lit(_date(value, field))
    if isinstance(dtype, T.StringType) and not isinstance(value, str):
        raise _mismatch(value, field)
    return F.lit(value).cast(dtype)


def _date(value: Any, field: T.StructField) -> date:
    try:
        return from_micros(to_micros(value)).date()
    except ValueError:
        raise _mismatch(value, field) from None


def _number(value: Any, field: T.StructField) -> int | float | Decimal:
    if isinstance(value, str):
        try:
            exact = Decimal(value.strip())
            if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
                return float(exact)
            whole = not isinstance(field.dataType, T.DecimalType)
            if whole and exact != int(exact):
                raise _mismatch(value, field)
            value = int(exact) if whole else exact
        except (InvalidOperation, ValueError, OverflowError):
            raise _mismatch(value, field) from None
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        raise _mismatch(value, field)
    if isinstance(value, int) and not -(2**63) <= value < 2**63:
        value = Decimal(value)
    if isinstance(value, Decimal) and len(value.as_tuple().digits) > 38:
        raise _mismatch(value, field)
    return value


def _boolean(value: Any, field: T.StructField) -> bool:
    words = {"true": True, "t": True, "false": False, "f": False}
    if isinstance(value, str):
        value = words.get(value.strip().lower())
    if isinstance(value, bool):
        return value
    raise _mismatch(value, field)


def _mismatch(value: Any, field: T.StructField) -> ValueError:
    return ValueError(
        f"invalid_filter_value: {value!r} for {field.name} of type {field.dataType.simpleString()}"
    )
