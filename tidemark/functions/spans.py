"""Half-open spans of time ``(start, end)`` in microseconds."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from .buckets import HOUR
from .instants import DAY, from_micros

Span = tuple[int, int]


def whole_hours(start: int, end: int) -> Span:
    """The hours that lie wholly in ``[start, end)``; empty if the end is not after the start."""
    return -(-start // HOUR) * HOUR, end // HOUR * HOUR


def days_in(spans: Iterable[Span]) -> int:
    """How many days the spans touch; one that two of them share counts twice."""
    return sum((end - 1) // DAY - start // DAY + 1 for start, end in spans if start < end)


def dates_of(spans: Iterable[Span]) -> set[date]:
    """The UTC days that the spans touch."""
    days = set()
    for start, end in spans:
        if start < end:
            first, last = from_micros(start).date(), from_micros(end - 1).date()
            days |= {first + timedelta(days=i) for i in range((last - first).days + 1)}
    return days


def subtract(spans: list[Span], holes: list[Span]) -> list[Span]:
    for low, high in holes:
        pieces = [p for a, b in spans for p in ((a, min(b, low)), (max(a, high), b))]
        spans = [(a, b) for a, b in pieces if a < b]
    return sorted(spans)


def intersect(spans: list[Span], limit: Span) -> list[Span]:
    clipped = [(max(a, limit[0]), min(b, limit[1])) for a, b in spans]
    return [(a, b) for a, b in clipped if a < b]


def merge(spans: list[Span]) -> list[Span]:
    merged: list[Span] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged
