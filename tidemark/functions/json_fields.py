"""Top-level keys and fields of JSON payloads held as text or as variant."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELD = re.compile(r"\s*(.+?)\s*->>\s*'((?:[^']|'')+)'\s*")


def split_field(text: str) -> tuple[str, str] | None:
    """``payload->>'key'`` as (payload, key), or None for a plain column name."""
    match = _FIELD.fullmatch(text)
    return (match[1], match[2].replace("''", "'")) if match else None


def json_text(column: Column, dtype: T.DataType) -> Column:
    return F.to_json(column) if isinstance(dtype, T.VariantType) else column


def json_keys(text: Column) -> Column:
    """Distinct top-level keys; NULL where the text is not a JSON object."""
    return F.array_distinct(F.json_object_keys(text))


def json_fields(text: Column, keys: Iterable[str]) -> Column:
    """A struct with the text of several top-level fields, in one pass over the payload.

    Of duplicate keys the last counts; a value that is not an object has no fields. Keys
    that differ only in case cannot share a struct.
    """
    wanted = T.StructType([T.StructField(key, T.StringType()) for key in keys])
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, wanted))
