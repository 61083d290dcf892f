"""Registered time-series sources."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.instants import is_time
from ..functions.spans import Span, dates_of, days_in

# The kind of a source as reported to callers, and the suffix that links
# an hourly rollup to its raw table.
RAW = "hypertable"
ROLLUP = "continuous_aggregate"
ROLLUP_SUFFIX = "_1h"

#: The table property that holds the definition of a published rollup, as JSON.
ROLLUP_PROPERTY = "tidemark.rollup"

# Beyond this many days the whole table is listed.
_LISTED_DAYS = 400


@dataclass(frozen=True)
class Source:
    """Where a source is read from and what is known about it without reading data.

    ``columns`` declares the schema, which spares Spark from inferring it from files and
    keeps NOT NULL. ``date_column`` names a storage partition column that holds the UTC
    date of the time column, and nothing else; it prunes scans and is not shown to
    callers. ``zones`` is where the zone map of the source is kept, if it has one. ``dims`` and ``values`` are set on rollups that carry mergeable partial
    aggregates.
    """

    name: str
    location: str
    kind: str = RAW
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    schema: str = "public"
    description: str | None = None
    hint: str | None = None
    columns: T.StructType | None = None
    json_columns: tuple[str, ...] = ()
    date_column: str | None = None
    zones: str | None = None
    rollup_of: str | None = None
    dims: tuple[str, ...] = ()
    values: tuple[str, ...] = ()

    def read(self, spark: SparkSession, spans: Sequence[Span] | None = None) -> DataFrame:
        """The source; given spans of time, at least its rows in those.

        Files are listed when a path is read. With spans, a source stored by day has only
        the directories of their days listed, if those are few.
        """
        if self.format == "table":
            return spark.table(self.location)
        reader = spark.read.format(self.format).options(**self.options)
        if self.columns is not None:
            reader = reader.schema(self.columns)
        if not (self.stored_by_day() and 0 < days_in(spans or ()) <= _LISTED_DAYS):
            return reader.load(self.location) if self.location else reader.load()
        root = self.location.rstrip("/")
        names = ",".join(f"{self.date_column}={day}" for day in sorted(dates_of(spans)))
        try:
            return reader.option("basePath", root).load(f"{root}/{{{names}}}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return reader.load(self.location).filter(F.lit(False))

    def stored_by_day(self) -> bool:
        """Whether the files lie in one directory per day."""
        return bool(self.date_column and self.location and self.format != "table")

    def resolved(self, spark: SparkSession) -> Source:
        """The source with its columns, found by reading it where they are not declared."""
        if self.columns is not None:
            return self
        return replace(self, columns=self.read(spark).schema)

    def fields(self) -> list[T.StructField]:
        """The columns callers see, of a resolved source."""
        return [f for f in self.columns.fields if f.name != self.date_column]

    def time(self) -> T.StructField | None:
        """The time column of a resolved source."""
        return time_column(self.fields())

    def payloads(self) -> list[str]:
        """JSON columns: the declared ones and every variant column, in table order."""
        return [
            f.name
            for f in self.fields()
            if f.name in self.json_columns or isinstance(f.dataType, T.VariantType)
        ]


def time_column(fields: list[T.StructField]) -> T.StructField | None:
    """The timestamp column named ``time``, else ``bucket``, else the first one."""
    times = [f for f in fields if is_time(f.dataType)]
    named = {f.name: f for f in times}
    return named.get("time") or named.get("bucket") or (times[0] if times else None)


class Registry:
    """Sources by unique name."""

    def __init__(self, *sources: Source) -> None:
        self._sources: dict[str, Source] = {}
        for source in sources:
            self.add(source)

    def add(self, source: Source) -> Source:
        if source.name in self._sources:
            raise ValueError(f"duplicate_source: {source.name}")
        self._sources[source.name] = source
        return source

    def get(self, name: str) -> Source:
        if name not in self._sources:
            raise ValueError(f"unknown_table: {name}")
        return self._sources[name]

    def rollup_of(self, name: str) -> Source | None:
        """The registered rollup of a raw source; a like-named raw table is none."""
        for source in self._sources.values():
            if source.kind == ROLLUP and source.rollup_of == name:
                return source
        return None

    def __iter__(self) -> Iterator[Source]:
        """Raw sources by name, then rollups by name."""
        return iter(sorted(self._sources.values(), key=lambda s: (s.kind != RAW, s.name)))


def table_facts(spark: SparkSession, table: str) -> dict[str, str]:
    """What the catalog says of a table besides its columns."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    facts = [r["col_name"] for r in rows].index("# Detailed Table Information")
    return {r["col_name"]: r["data_type"] for r in rows[facts:]}


def _published(spark: SparkSession, database: str, name: str, description: str | None) -> Source | None:
    """The rollup that a table was published from, if any: the files with the definition."""
    table = f"`{database}`.`{name}`"
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if ROLLUP_PROPERTY not in properties:
        return None
    definition = json.loads(properties[ROLLUP_PROPERTY])
    shape = spark.table(table).schema
    return Source(
        name=name,
        location=table_facts(spark, table)["Location"],
        kind=ROLLUP,
        schema=database,
        description=description or None,
        columns=T.StructType([T.StructField(f.name, f.dataType) for f in shape.fields]),
        date_column=spark.catalog.listColumns(table)[-1].name,
        rollup_of=definition["rollup_of"],
        dims=tuple(definition["dims"]),
        values=tuple(definition["values"]),
    )


def discover(
    spark: SparkSession,
    database: str,
    date_columns: Mapping[str, str] | None = None,
    json_columns: Mapping[str, Sequence[str]] | None = None,
) -> list[Source]:
    """Every table of a catalog database, with its comment.

    A table that a rollup was published as is that rollup, with its stored partials and coverage,
    and answers exact queries. ``json_columns`` names text columns that hold JSON, per table.
    ``<table>_1h`` counts as the rollup of ``<table>`` when it has a column named
    ``bucket``. ``date_columns`` names, per table, a partition column that holds the UTC
    date of the time column; no partition column is taken to be one unasked, as a date
    of another zone or of arrival would prune rows that belong to the answer.
    """
    tables = {t.name: t for t in spark.catalog.listTables(database) if not t.isTemporary}
    found = []
    for name, table in sorted(tables.items()):
        qualified = f"`{database}`.`{name}`"
        published = _published(spark, database, name, table.description)
        if published is not None:
            found.append(published)
            continue
        base = name.removesuffix(ROLLUP_SUFFIX)
        is_rollup = base != name and base in tables and "bucket" in spark.table(qualified).columns
        found.append(
            Source(
                name=name,
                location=qualified,
                kind=ROLLUP if is_rollup else RAW,
                format="table",
                schema=database,
                description=table.description,
                json_columns=tuple((json_columns or {}).get(name, ())),
                date_column=(date_columns or {}).get(name),
                rollup_of=base if is_rollup else None,
            )
        )
    return found
