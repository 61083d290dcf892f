from __future__ import annotations

import os
import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark import Source, Workspace, create_rollup, full_refresh, store_by_day  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"
END = "2024-03-10T11:40:00+00:00"
MINUTES = 221  # of readings, from 08:00 to END


def bus_readings(spark):
    """Levels of four zones, three minutes of each in turn."""
    return spark.sql(
        f"""SELECT time, zone, 'C' AS unit, value, to_json(struct(value, zone)) AS raw FROM (
            SELECT timestamp'2024-03-10T08:00:00Z' + make_dt_interval(0, 0, CAST(id AS INT)) AS time,
                'zone-' || (id DIV 3) % 4 AS zone, CAST(5.5 + (7 * id) % 16 / 4 AS DOUBLE) AS value
            FROM range({MINUTES}))"""
    )


def boiler_readings(spark):
    """Numbers in a JSON payload only."""
    return spark.sql(
        f"""SELECT timestamp'2024-03-10T08:00:00Z' + make_dt_interval(0, 0, CAST(id AS INT)) AS time,
                'pump' AS device,
                to_json(struct(900 + 25 * (id % 9) AS speed, id * id % 31 AS load, id % 50 = 0 AS alarm))
                    AS raw
            FROM range({MINUTES})"""
    )


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tidemark-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", os.environ.get("TEST_ZONE", "UTC"))
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .config("spark.checkpoint.dir", str(root / "checkpoints"))
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def path(tmp_path):
    """A new path for each call."""
    return lambda name="t": str(tmp_path / f"{name}-{uuid.uuid4().hex[:8]}")


@pytest.fixture(scope="session")
def home(spark, tmp_path_factory):
    """Two raw tables, stored by day, and the hourly rollup of one of them."""
    root = tmp_path_factory.mktemp("home")
    for name, frame in (("bus", bus_readings(spark)), ("boiler", boiler_readings(spark))):
        store_by_day(frame, str(root / name), "time")
    bus = Source(
        "bus",
        str(root / "bus"),
        description="Bus telegrams",
        hint="names of zones are kept elsewhere",
        json_columns=("raw",),
        date_column="date",
    )
    boiler = Source("boiler", str(root / "boiler"), json_columns=("raw",), date_column="date")
    rollup = create_rollup(spark, bus, str(root / "bus_1h"), dims=("zone",), values=("value",))
    full_refresh(spark, bus, rollup)
    return Workspace(spark, rollup, bus, boiler)
