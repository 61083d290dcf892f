"""Helpers that the operators share: stored intermediate tables, salted joins, hashes of words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the control characters 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def checkpoint_folder(session: SparkSession) -> str:
    """The checkpoint folder that the cluster shares.

    Where ``spark.checkpoint.dir`` is unset, a local session gets a temporary folder.
    """
    context = session.sparkContext
    if not context.getCheckpointDir():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
            folder = tempfile.mkdtemp(prefix="tidemark-llm-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(frame: DataFrame) -> DataFrame:
    """The frame, computed once and written to the checkpoint folder.

    Later steps read the files, so nothing before them is run again and no executor holds the
    only copy.
    """
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def stored_columns(frame: DataFrame) -> DataFrame:
    """The frame, computed once and written to a new folder below the checkpoint folder as Parquet.

    For wide rows: a checkpoint holds its rows uncompressed.
    """
    path = f"{checkpoint_folder(frame.sparkSession)}/{uuid.uuid4()}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Rows of a few longs that may go to every executor: 32 MB at most.
MOST_BROADCAST = 1_000_000
#: Tasks that ``few`` leaves at least.
LEAST_TASKS = 16


def sized(keys: DataFrame, longs: int = 4) -> DataFrame:
    """``keys`` (stored rows of ``longs`` longs), to be broadcast if they are counted as few enough.

    Beyond that Spark joins them by a shuffle, with the same result.
    """
    return F.broadcast(keys) if keys.count() * longs <= 4 * MOST_BROADCAST else keys


def few(frame: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """The frame, which has about ``rows`` rows, in no more tasks than they need.

    Without it, every shuffle of a small table writes a block for each pair of partitions.
    """
    return frame.coalesce(max(LEAST_TASKS, -(-rows // per_task)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(rows: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, so that their names clash with nothing."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in needed]
    return rows.select(*needed, *([F.struct(*others).alias("_others")] if others else []))


def restored(names: list[str], *needed: str) -> list[Column]:
    """Columns by name again, after ``aside``."""
    return [
        F.col(c) if c in needed else F.col("_others").getField(c).alias(c) for c in names
    ]


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], salt: Column, salts: int = 32
) -> DataFrame:
    """Left join of rows with one row per key at most, where a key may hold most of ``many``.

    Rows of a key are dealt over ``salts`` tasks by ``salt`` (a long that differs from row to
    row); the single row of the key goes to each of them. Null keys match null keys.
    """
    spread = [F.lit(i) for i in range(salts)]
    marked = many.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.array(*spread)))
    left, right = marked.alias("l"), copies.alias("r")
    matches = F.col("l._salt") == F.col("r._salt")
    for key in keys:
        matches &= F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    added = [F.col(f"r.{c}") for c in few.columns if c not in keys]
    return left.join(right, matches, "left").select(
        *[F.col(f"l.{c}") for c in many.columns], *added
    )


# Hashes of words and shingles, for numpy.

_random = np.random.Generator(np.random.Philox(key=20240917))
_BYTE_VALUE = _random.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE = 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _hashes_of_piece(raw: np.ndarray) -> np.ndarray:
    letters = _LOWER[raw]
    inside = ~_IS_SPACE[letters]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(raw)) - np.maximum.accumulate(np.where(begins, np.arange(len(raw)), 0))
    place[~inside] = 0
    powers = np.full(int(place.max()) + 1, _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = np.where(inside, _BYTE_VALUE[letters], np.uint64(0)) * powers[place]
    return mixed(np.add.reduceat(values, starts))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, in order. Works in pieces of about 1 MB, cut
    between words, so that memory stays small for any length of text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found, at = [], 0
    while at < len(raw):
        end = at + _PIECE
        while end < len(raw) and not _IS_SPACE[raw[end]]:
            gap = np.flatnonzero(_IS_SPACE[raw[end : end + _PIECE]])
            end = end + int(gap[0]) if len(gap) else end + _PIECE
        found.append(_hashes_of_piece(raw[at:end]))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words, of the whole."""
    if not len(words):
        return np.empty(0, np.uint64)
    run = min(size, len(words))
    total = np.full(len(words) - run + 1, run, np.uint64)
    for i in range(run):
        total = total * _BASE + words[i : len(words) - run + 1 + i]
    return np.unique(mixed(total))
