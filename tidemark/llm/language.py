"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, drawn from its code point. A run of
three letters is bound into one vector: the letter vectors, rotated by two, one and no places,
multiplied element by element. A text is the sum (bundle) of its runs' vectors, a language the sum
of its training texts, each scaled to length one so that long texts do not rule. The prediction is
the language whose prototype has the largest cosine with the text.

Training sums are added up within each task first; a language then is ``DIMENSIONS`` rows per
task, summed by (language, dimension). What reaches the driver and the executors is one vector
per language; more than ``MOST_LANGUAGES`` languages are refused.

A text is taken as one of a learned language by its score. Random vectors that share no run have
cosines about 0 with a deviation of 1/sqrt(DIMENSIONS), so a score that the best of the prototypes
passes by chance with probability ``CHANCE`` is the noise floor. Long clean texts score far above it,
so the least score is halfway between the floor and the ``LOW`` quantile of the held-out texts whose
label is confirmed, among those of about as many runs (powers of two, ``LEAST`` texts at least).
Short texts score lower. Up to the size from which that quantile is above the floor, the score cannot
tell them from noise, so all of them stay, those of other languages too.

Defined cases: a text that is null or has no letter is 'und' with score 0, as is every text if
nothing could be learned. Ties go to the language first in code point order. Rows with a null
doc_id are used for training (null is not held out). Rows that occur again count again. Extra
columns pass through.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, restored

DIMENSIONS = 1024
RUN = 3
#: Vectors of runs kept by a task, and letters whose runs are looked up in a table.
MOST_RUNS, DENSE = 16_384, 128
MOST_LANGUAGES = 4096
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
CHANCE, LOW, LEAST = 1e-4, 1e-3, 100
_PIECE = 1 << 18


def is_held_out(doc_id: str = "doc_id"):
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


class Profiles:
    """Bundles of texts. Keeps the vectors of runs that it has met, up to ``MOST_RUNS``."""

    def __init__(self) -> None:
        self.letter_id = np.full(0x110000, -1, np.int32)  # of a code point; 0 for what is no letter
        self.letters = [_signs(0)]
        self.row = np.full(DENSE**RUN, -1, np.int32)  # of runs of the first DENSE letters
        self.other_rows: dict[int, int] = {}
        self.vectors = np.empty((MOST_RUNS, DIMENSIONS), np.float32)
        self.used = 0

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        ids = self.letter_id[codes]
        if ids.min(initial=0) < 0:
            for code in np.unique(codes[ids < 0]).tolist():
                low = ord(chr(code).lower()[0])
                if unicodedata.category(chr(code))[0] != "L":
                    self.letter_id[code] = 0
                    continue
                if self.letter_id[low] <= 0:
                    self.letter_id[low] = len(self.letters)
                    self.letters.append(_signs(low))
                self.letter_id[code] = self.letter_id[low]
            ids = self.letter_id[codes]
        return ids

    def _new_row(self, run: tuple[int, ...]) -> int:
        vector = np.ones(DIMENSIONS, np.int8)
        for place, letter in enumerate(run):
            vector = vector * np.roll(self.letters[letter], RUN - 1 - place)
        self.vectors[self.used] = vector
        self.used += 1
        return self.used - 1

    def _runs(self, text: str) -> Iterator[np.ndarray]:
        """Letter ids of the runs of a text, piece by piece. Gaps count as one blank."""
        for at in range(0, len(text), _PIECE):
            piece = text[at : at + _PIECE + RUN - 1].encode("utf-32-le", "surrogatepass")
            ids = self._ids(np.frombuffer(piece, np.uint32))
            blank = ids == 0
            if blank.all():
                continue
            ids = ids[~(blank & np.concatenate([[False], blank[:-1]]))]
            ends = [np.zeros(int(ids[0] != 0), np.int32), ids, np.zeros(int(ids[-1] != 0), np.int32)]
            ids = np.concatenate(ends).astype(np.int64)
            yield np.stack([ids[i : len(ids) - RUN + 1 + i] for i in range(RUN)])

    def _rows(self, runs: np.ndarray) -> np.ndarray:
        dense = (runs < DENSE).all(axis=0)
        first, second, third = runs[:, dense]
        codes = (first * DENSE + second) * DENSE + third
        rows = self.row[codes]
        if rows.min(initial=0) < 0:
            for code in np.unique(codes[rows < 0]).tolist():
                run = (code // DENSE**2, code // DENSE % DENSE, code % DENSE)
                self.row[code] = self._new_row(run)
            rows = self.row[codes]
        if dense.all():
            return rows
        rest = runs[:, ~dense]
        kinds, place = np.unique(rest[0] << 42 | rest[1] << 21 | rest[2], return_inverse=True)
        found = np.empty(len(kinds), np.int32)
        for i, kind in enumerate(kinds.tolist()):
            if kind not in self.other_rows:
                run = (kind >> 42, kind >> 21 & 0x1FFFFF, kind & 0x1FFFFF)
                self.other_rows[kind] = self._new_row(run)
            found[i] = self.other_rows[kind]
        return np.concatenate([rows, found[place]])

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' vectors at length one, and how many runs each has (none without letters)."""
        totals = np.zeros((len(texts), DIMENSIONS), np.float32)
        counted = np.zeros(len(texts), np.int64)
        pending: list[tuple[int, np.ndarray]] = []

        def add() -> None:
            if pending:
                counts = np.stack([c if len(c) == self.used else np.pad(c, (0, self.used - len(c)))
                                   for _, c in pending]).astype(np.float32)
                seen = np.flatnonzero(counts.any(axis=0))
                sums = counts[:, seen] @ self.vectors[seen]
                for (i, _), row in zip(pending, sums, strict=True):
                    totals[i] += row
                pending.clear()

        for i, text in enumerate(texts):
            for runs in self._runs(text or ""):
                counted[i] += runs.shape[1]
                for at in range(0, runs.shape[1], MOST_RUNS // 2):
                    part = runs[:, at : at + MOST_RUNS // 2]
                    if self.used + part.shape[1] > MOST_RUNS and self.used > MOST_RUNS // 2:
                        add()  # no room for as many new runs: begin anew
                        self.row[:], self.other_rows, self.used = -1, {}, 0
                    rows = self._rows(part)
                    pending.append((i, np.bincount(rows, minlength=self.used)))
                if len(pending) >= 64:
                    add()
        add()
        lengths = np.linalg.norm(totals, axis=1, keepdims=True)
        return totals / np.maximum(lengths, 1e-9), counted


def _signs(code: int) -> np.ndarray:
    """The vector of a letter; that of code 0 stands for the gap between words."""
    draws = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS)
    return (2 * draws - 1).astype(np.int8)


def _summed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bundles of a task's texts, added up by language: a row per language and dimension."""
    profiles, sums = Profiles(), {}
    for batch in frames:
        langs = np.array(batch.column(0).to_pylist(), object)
        vectors, counted = profiles.bundles(batch.column(1).to_pylist())
        lettered = counted > 0
        # Whole numbers, so that the sum does not depend on the order of the rows.
        whole = np.rint(vectors * 2**24).astype(np.int64)
        for lang in set(langs[lettered]):
            sums[lang] = sums.get(lang, 0) + whole[lettered & (langs == lang)].sum(axis=0)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * DIMENSIONS, pa.string()),
                pa.array(range(DIMENSIONS), pa.int32()),
                pa.array(total),
            ],
            names=["lang", "dimension", "total"],
        )


def prototypes(documents: DataFrame) -> dict[str, np.ndarray]:
    """A vector of length one per language, from the rows of ``documents`` that have ``lang``."""
    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sums = rows.mapInArrow(_summed, "lang string, dimension int, total long")
    sums = sums.groupBy("lang", "dimension").agg(F.sum("total").alias("total"))
    by_language = sums.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("dimension", "total"))).alias("vector")
    )
    found = by_language.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    vectors = {}
    for row in found:
        vector = np.array([x["total"] for x in row["vector"]], np.float64)
        vectors[row["lang"]] = (vector / max(np.linalg.norm(vector), 1e-12)).astype(np.float32)
    return vectors


def predicted(documents: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """``documents`` with lang_pred, score (the cosine with the best prototype, 0 at least) and _runs."""
    names = sorted(learned)
    matrix = np.array([learned[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)
    at = documents.columns.index("text")
    added = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("_runs", T.LongType()),
    ]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in batches:
            vectors, counted = profiles.bundles(batch.column(at).to_pylist())
            cosines = vectors @ matrix.T if names else np.zeros((len(vectors), 1))
            lettered = (counted > 0) & bool(names)
            best = cosines.argmax(axis=1)
            langs = [names[b] if known else UNKNOWN for b, known in zip(best, lettered, strict=True)]
            scores = np.where(lettered, cosines.max(axis=1).clip(0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(counted)],
                names=[*batch.schema.names, *[f.name for f in added]],
            )

    return documents.mapInArrow(judge, T.StructType([*documents.schema.fields, *added]))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    learned = prototypes(documents.where(~is_held_out()))
    rows = documents.select("doc_id", "text", is_held_out().alias("held_out"))
    return predicted(rows, learned).drop("text", "_runs")


def least_scores(documents: DataFrame, learned: dict[str, np.ndarray]) -> list[float]:
    """The score that a text of 2**i to 2**(i + 1) - 1 runs needs, for each i below 64."""
    chance = CHANCE / max(1, len(learned))
    floor = NormalDist().inv_cdf(1 - chance) / math.sqrt(DIMENSIONS)
    held = documents.where(is_held_out() & F.col("lang").isin(*learned)) if learned else None
    if held is None:
        return [floor] * 64
    judged = predicted(held.select("lang", "text"), learned).where("lang = lang_pred")
    found = judged.groupBy(F.floor(F.log2("_runs")).cast("int").alias("size")).agg(
        F.count("*").alias("n"), F.percentile_approx("score", LOW, 10_000).alias("low")
    )
    known = {r["size"]: (r["n"], r["low"]) for r in found.collect()}  # 64 rows at most
    least, decides = [], not known
    for size in range(64):
        for width in range(64):  # sizes around it, until they have enough texts
            near = [known[i] for i in known if abs(i - size) <= width]
            if sum(n for n, _ in near) >= LEAST:
                break
        low = min((low for _, low in near), default=floor)
        decides |= low > floor
        least.append(max(floor, (floor + low) / 2) if decides else 0.0)
    return least


def in_known_language(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text is prose of a learned language.

    A text is rejected if it is 'und', or if its score is below the one that texts of its number of
    runs need (``least_scores``).
    """
    learned = prototypes(documents.where(~is_held_out()))
    least = least_scores(documents, learned)
    needed_columns = ("doc_id", "text", "lang")
    judged = predicted(aside(documents, *needed_columns), learned)
    needed = F.get(F.lit(least), F.floor(F.log2("_runs")).cast("int"))
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= needed))
    return kept.select(*restored(documents.columns, *needed_columns))
