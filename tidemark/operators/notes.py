"""Small tables of metadata next to a rollup, ``<location>_<kind>``, in numbered versions.

Every write adds a file of JSON lines whose name is the next number, and readers take the highest.
A number can be given once only: of two writers that read the same version, one gets the next
number and the other starts again from what the first one wrote (``update_notes``) or is told so
(``write_notes_after``). So no write is lost, and none is seen by halves.

The file is put in place by a rename that refuses to replace, as streaming checkpoints do. This is
atomic on HDFS and on stores with its semantics. On a local disk it is between the threads of one
driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from datetime import date
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T

#: Versions that stay, for readers that listed them before newer ones came.
KEPT = 16
_TRIES = 100
_LOCK = Lock()


def read_notes(spark: SparkSession, location: str, kind: str, columns: T.StructType) -> list[Row]:
    return _read(spark, location, kind, columns)[1]


def notes_version(spark: SparkSession, location: str, kind: str) -> int:
    """The number of the newest version, which differs after any write; 0 before the first."""
    folder = _path(spark, location, kind)
    files = _file_system(spark, folder)
    if not files.exists(folder):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)


def write_notes(
    spark: SparkSession, location: str, kind: str, columns: T.StructType, rows: Iterable[tuple]
) -> None:
    """Put rows in place of whatever is there."""
    rows = list(rows)
    update_notes(spark, location, kind, columns, lambda _: rows)


def update_notes(
    spark: SparkSession,
    location: str,
    kind: str,
    columns: T.StructType,
    change: Callable[[list[Row]], Iterable[tuple]],
) -> None:
    """Put ``change(rows)`` in place of the rows. It is called again if another write came first."""
    for _ in range(_TRIES):
        version, rows = _read(spark, location, kind, columns)
        if write_notes_after(spark, location, kind, columns, change(rows), version):
            return
    raise ValueError(f"notes_contended: {location} {kind}")


def write_notes_after(
    spark: SparkSession,
    location: str,
    kind: str,
    columns: T.StructType,
    rows: Iterable[tuple],
    version: int,
) -> bool:
    """Write the version after a given one, unless there is one already."""
    lines = [json.dumps(dict(zip(columns.names, row, strict=True)), default=str) for row in rows]
    folder = _path(spark, location, kind)
    files = _file_system(spark, folder)
    fresh = _path(spark, location, kind, f".{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write("\n".join(lines).encode())
    out.close()
    with _LOCK:
        added = _rename(spark, fresh, _path(spark, location, kind, _name(version + 1)))
    if not added:
        files.delete(fresh, False)
    elif version >= KEPT:
        files.delete(_path(spark, location, kind, _name(version + 1 - KEPT)), False)
    return added


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Whether there was such a folder."""
    folder = _jvm(spark).Path(path)
    return _file_system(spark, folder).delete(folder, True)


def _read(
    spark: SparkSession, location: str, kind: str, columns: T.StructType
) -> tuple[int, list[Row]]:
    version = notes_version(spark, location, kind)
    if not version:
        return 0, []
    path = _path(spark, location, kind, _name(version))
    stream = _file_system(spark, path).open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    dates = [f.name for f in columns.fields if isinstance(f.dataType, T.DateType)]
    rows = []
    for line in text.splitlines():
        values = json.loads(line)
        values |= {name: date.fromisoformat(values[name]) for name in dates if values[name]}
        rows.append(Row(**{name: values[name] for name in columns.names}))
    return version, rows


def _name(version: int) -> str:
    return f"{version:020d}.json"


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs


def _path(spark: SparkSession, location: str, kind: str, name: str | None = None):
    folder = f"{location.rstrip('/')}_{kind}"
    return _jvm(spark).Path(folder if name is None else f"{folder}/{name}")


def _configuration(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def _file_system(spark: SparkSession, path):
    return path.getFileSystem(_configuration(spark))


def _rename(spark: SparkSession, source, target) -> bool:
    """Give a file its name, unless another one has it."""
    qualified = target.getFileSystem(_configuration(spark)).makeQualified(target)
    context = _jvm(spark).FileContext.getFileContext(qualified.toUri(), _configuration(spark))
    kinds = getattr(_jvm(spark), "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        context.rename(source, target, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    return True
