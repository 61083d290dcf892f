"""Keys counted by day: equal to a count over all rows, parsed only where files changed."""

from __future__ import annotations

import json
from collections import Counter
from datetime import date, datetime, timedelta

import pytest

from tidemark import Source, key_profile, store_by_day, update_key_counts

START = datetime(2024, 6, 1)


def _payload(i):
    if i % 11 == 0:
        return None
    if i % 13 == 0:
        return "[1, 2]" if i % 2 else "no json"
    return json.dumps({f"k{i % 4}": i, "all": {"inner": 1}, **({"odd key": 0} if i % 2 else {})})


def _rows(low, high):
    return [(START + timedelta(hours=i), _payload(i)) for i in range(low, high)]


def _expected(rows, start=datetime.min, end=datetime.max):
    counts = Counter()
    for at, text in rows:
        if at is not None and start <= at <= end and text and text.startswith("{"):
            counts.update(json.loads(text).keys())
    return sorted(counts.items(), key=lambda r: (-r[1], r[0]))


def _got(profile):
    return [(r["key"], r["occurrences"]) for r in profile.collect()]


def test_profiles_of_kept_changed_and_cut_days(spark, tmp_path):
    shape = "time timestamp_ntz, raw string"
    source = Source("bus", str(tmp_path / "bus"), json_columns=("raw",), date_column="date")
    place = str(tmp_path / "counts")
    rows = [*_rows(0, 240), (None, '{"lost": 1}')]
    store_by_day(spark.createDataFrame(rows, shape), source.location, "time")
    assert _got(key_profile(spark, source, "raw", place)) == _expected(rows)  # nothing counted yet
    first = START.date()
    assert update_key_counts(spark, source, "raw", place) == [first + timedelta(i) for i in range(10)]
    assert update_key_counts(spark, source, "raw", place) == []
    kept = key_profile(spark, source, "raw", place)
    assert _got(kept) == _expected(rows)
    assert not [f for f in kept.inputFiles() if "/bus/" in f]

    late = [(START + timedelta(days=3, minutes=7), '{"late": 1, "k1": 2, "k1": 3}')]
    store_by_day(spark.createDataFrame(late, shape), source.location, "time", mode="append")
    rows += late
    stale = key_profile(spark, source, "raw", place)
    assert _got(stale) == _expected(rows)
    assert {f.split("date=")[1][:10] for f in stale.inputFiles() if "/bus/" in f} == {"2024-06-04"}
    for low, high in ((START + timedelta(hours=30), START + timedelta(hours=150)), (START, START)):
        assert _got(key_profile(spark, source, "raw", place, low, high)) == _expected(rows, low, high)
    assert _got(key_profile(spark, source, "raw", place, top=2)) == _expected(rows)[:2]
    assert _got(key_profile(spark, source, "raw", place, start=datetime(2030, 1, 1))) == []

    assert update_key_counts(spark, source, "raw", place) == [date(2024, 6, 4)]
    assert _got(key_profile(spark, source, "raw", place)) == _expected(rows)
    # A profile planned before an update still reads what it planned.
    assert _got(kept) == _expected(rows[:-1])


def test_sources_not_stored_by_day_are_refused(spark, tmp_path):
    source = Source("bus", str(tmp_path / "bus"))
    with pytest.raises(ValueError, match="not_stored_by_day"):
        update_key_counts(spark, source, "raw", str(tmp_path / "counts"))
