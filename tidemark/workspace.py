"""The three questions a caller can ask, answered as plain Python records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators.describe import (
    KEY_SAMPLE,
    TOP_KEYS,
    json_key_profile,
    rows_by_hour,
    source_inventory,
)
from .plans.timeseries import ROW_LIMIT, plan_timeseries
from .sources.registry import Registry, Source, discover


class Workspace:
    """A Spark session and the sources registered with it."""

    def __init__(self, spark: SparkSession, *sources: Source) -> None:
        self.spark = spark
        self.registry = Registry()
        for source in sources:
            self.register(source)

    @classmethod
    def of_database(
        cls,
        spark: SparkSession,
        database: str,
        date_columns: Mapping[str, str] | None = None,
        json_columns: Mapping[str, Sequence[str]] | None = None,
    ) -> Workspace:
        """Every table of a catalog database; see ``discover``."""
        return cls(spark, *discover(spark, database, date_columns, json_columns))

    def register(self, source: Source) -> Source:
        """Add a source. The columns of one stored by day are looked up now, so that its
        queries need to list no more than the days they read."""
        return self.registry.add(source.resolved(self.spark) if source.stored_by_day() else source)

    def list_data_sources(self) -> list[dict[str, Any]]:
        """Raw tables, then rollups, with their time ranges."""
        records = []
        for row in source_inventory(self.spark, self.registry).collect():
            record = row.asDict()
            low, high = record.pop("time_min"), record.pop("time_max")
            records.append({**record, "time_range": {"min": low, "max": high}})
        return records

    def get_schema(
        self, table: str, jsonb_sample_size: int = KEY_SAMPLE, top_keys: int = TOP_KEYS
    ) -> dict[str, Any]:
        """Columns, types, time column and the most common keys of JSON columns."""
        source = self.registry.get(table).resolved(self.spark)
        time = source.time()
        keys = {}
        if time is not None:
            by_hour = rows_by_hour(self.spark, source) if source.payloads() else None
            for payload in source.payloads():
                profile = json_key_profile(
                    source.read(self.spark),
                    payload,
                    time,
                    sample=jsonb_sample_size,
                    top=top_keys,
                    date_column=source.date_column,
                    by_hour=by_hour,
                )
                keys[payload] = [row.asDict() for row in profile.collect()]
        columns = [
            {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable}
            for f in source.fields()
        ]
        return {
            "name": source.name,
            "schema": source.schema,
            "kind": source.kind,
            "time_column": time.name if time else None,
            "columns": columns,
            "jsonb_top_keys": keys,
            "hint": source.hint,
        }

    def query_timeseries(
        self,
        table: str,
        columns: Sequence[str],
        from_ts: str | datetime | None,
        to_ts: str | datetime | None,
        aggregation: str = "avg",
        bucket: str = "1 hour",
        filters: Mapping[str, Any] | None = None,
        row_limit: int = ROW_LIMIT,
        rollup: str = "exact",
    ) -> dict[str, Any]:
        """Bucketed aggregate with at most ``row_limit`` rows."""
        answer = plan_timeseries(
            self.spark,
            self.registry,
            table,
            columns,
            from_ts,
            to_ts,
            aggregation,
            bucket,
            filters,
            rollup,
        )
        return answer.record(row_limit)

    def frame(self, table: str, columns: Sequence[str], *args: Any, **kwargs: Any) -> DataFrame:
        """The same query as a lazy, uncapped DataFrame."""
        return plan_timeseries(
            self.spark, self.registry, table, columns, *args, **kwargs
        ).frame
