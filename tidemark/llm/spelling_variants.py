"""Groups of spellings: each word points to a far more frequent word one edit away.

Words are counted first, in Spark. Then, for the words that are frequent enough to keep:

* **Reduced alphabet.** A hash maps every letter to one of ``SYMBOLS`` symbols; a word becomes a
  reduced word over them.
* **Neighbourhood.** For each word all reduced words one deletion, replacement or insertion away
  from its reduced word are generated, and that word itself (the edit may change a letter into one
  of the same symbol). Over a small alphabet that is a few dozen, over the alphabet of all letters
  it would be hundreds or thousands.
* **Join.** The neighbourhoods meet the reduced vocabulary. One edit leaves the first or the last
  half of the word that it makes as it is, so the two must share that half exactly as well: an
  edit at an early place goes with the last letters, one at a late place with the first. Without
  it all words of one reduced word would meet each other.
* **Verification** on the original strings: Levenshtein distance 1 in code points.

A reduced word is kept as a 64-bit polynomial hash with that of one half, which numpy updates
for every edit at a cost of one step, so a word of any length needs work and rows in proportion to
its length. Different reduced words with one hash only add pairs to verify.

Scale: counting is one aggregate per word, combined before its shuffle. Neighbourhoods are rows, not
groups; a key holds words that share half of their letters and a reduced word, and its join can be split by adaptive execution. A word has few near words (one edit away, over the letters in
use), so hubs are bounded. Roots are found by doubling: each round a word takes over the root
of its root; forms are five times as frequent, so there are at most about 5 rounds.

Defined cases: null and empty texts have no words, a null id counts as empty, repeated rows count
each time, equal frequencies go to the smallest word in code-point order, an empty table gives an
empty result. Only the two named columns are read, so others can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, stored

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as the word that points to it.
TIMES = 5
SYMBOLS = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.Philox(key=13)).integers(
    1, 2**64, SYMBOLS, dtype=np.uint64
)
_CHUNK = 1 << 17


def noisy(run: Column, doc_id: Column, every: int) -> Column:
    """The run, less one letter wherever ``every`` divides the checksum of document and run."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    check = F.crc32(named.cast("binary"))
    place = F.pmod(check, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(F.pmod(check, F.lit(every)) == 0, cut).otherwise(run)


def counted_words(
    docs: DataFrame, text: str = "text", doc_id: str | None = None, every: int = 0
) -> DataFrame:
    """``word``, ``n`` of the words to group: long and frequent enough. With ``every`` a letter is
    deleted now and then, see ``noisy``."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LETTERS), F.lit(0))
    ids = F.col(doc_id) if doc_id else F.lit("")
    words = docs.select(ids.alias("id"), F.explode(runs).alias("run"))
    # Runs that stay short whatever happens, which most are, go before any further work.
    words = words.where(F.length("run") >= LEAST_LENGTH)
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", capital, small))
    words = words.withColumn("run", lowered.otherwise(F.col("run")))
    word = noisy(F.col("run"), F.col("id"), every) if every else F.col("run")
    counts = words.groupBy(word.alias("word")).agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _keys(generate: bool):
    """Arrow rows of (id, word) to rows of (id, key): of the reduced word, or of all its edits."""

    def rows(ids: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        symbol = (mixed(codes + np.uint64(1)) >> np.uint64(32)) % np.uint64(SYMBOLS)
        ends = np.cumsum(size)
        starts = ends - size
        owner = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(codes)) - starts[owner]
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(size.max()), _BASE)))
        terms = _VALUES[symbol] * powers[place]
        running = np.cumsum(terms, dtype=np.uint64)
        until = running - (running - terms)[starts][owner]  # of the word, this letter included
        total = until[ends - 1]
        letters = np.cumsum(np.append(np.uint64(0), (codes + np.uint64(1)) * powers[place]))
        unpowers = np.multiply.accumulate(
            np.append(np.uint64(1), np.full(int(size.max()), _UNBASE))
        )

        def halves(made: np.ndarray) -> np.ndarray:
            """Hashes of the first and the last letters that words of ``made`` letters keep."""
            half = made // 2
            first = letters[starts + half] - letters[starts]
            last = (letters[ends] - letters[ends - half]) * unpowers[size - half]
            return np.stack([mixed(first), mixed(last + np.uint64(1 << 63))])

        def key(reduced, of, kept, early):
            """Late edits keep the first letters, early ones the last."""
            return mixed(reduced + kept[early.astype(np.int64), of])

        every, kept = np.arange(len(words)), halves(size)
        nowhere = np.zeros(len(words), bool)
        found = [(every, key(total, every, kept, side)) for side in (nowhere, ~nowhere)]
        if generate:
            whole = total[owner]
            before, after = until - terms, whole - until
            shorter, longer = halves(size - 1), halves(size + 1)
            deleted = before + after * _UNBASE
            found.append((owner, key(deleted, owner, shorter, place < ((size - 1) // 2)[owner])))
            for value in _VALUES:
                put = value * powers[place]
                replaced, other = whole - terms + put, terms != put
                keys = key(replaced, owner, kept, place < (size // 2)[owner])
                found.append((owner[other], keys[other]))
                inserted = before + put + (whole - before) * _BASE
                early = place < ((size + 1) // 2)[owner]
                found.append((owner, key(inserted, owner, longer, early)))
                behind = total + value * powers[size]  # the last letter
                found.append((every, key(behind, every, longer, nowhere)))
        own = np.concatenate([x for x, _ in found])
        keys = np.concatenate([x for _, x in found])
        pairs = np.unique(np.stack([own.astype(np.uint64), keys]), axis=1)
        return ids[pairs[0].astype(np.int64)], pairs[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
            at = 0
            while at < len(words):
                end, letters = at, 0
                while end < len(words) and (end == at or letters + len(words[end]) <= _CHUNK):
                    letters += len(words[end])
                    end += 1
                own, keys = rows(ids[at:end], words[at:end])
                at = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(np.ascontiguousarray(keys).view(np.int64))],
                    names=["id", "key"],
                )

    return run


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``id``, ``near_id`` of words exactly one edit apart, in both directions; ``words``
    holds distinct, non-empty ``word``s with an ``id`` (long), stored."""
    schema = "id long, key long"
    edits = words.select("id", "word").mapInArrow(_keys(True), schema)
    reduced = words.select("id", "word").mapInArrow(_keys(False), schema)
    meet = edits.join(reduced.withColumnRenamed("id", "near_id"), "key")
    pairs = meet.where("id <> near_id").select("id", "near_id").distinct()
    left = words.select("id", "word")
    right = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"))
    both = pairs.join(left, "id").join(right, "near_id")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("id", "near_id")


def _roots(forms: DataFrame) -> DataFrame:
    """``id``, ``root_id`` of each word that has a form, by doubling; ``forms`` has id, form_id."""
    steps = stored(forms.select("id", F.col("form_id").alias("root_id")))
    while True:
        on = steps.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        joined = stored(steps.join(on, "root_id", "left"))
        steps = joined.select("id", F.coalesce("next", "root_id").alias("root_id"))
        if joined.where("next IS NOT NULL").isEmpty():
            return steps


def group_words(counts: DataFrame) -> DataFrame:
    """One row per word of ``counts`` (``word``, ``n``): ``word``, ``form``, ``root``, ``n``,
    ``n_near``, ``form_n``. ``form`` is the most frequent near word if it is ``TIMES`` as
    frequent, ``root`` the last word reached by following forms."""
    words = stored(counts.withColumn("id", F.monotonically_increasing_id()))
    near = near_words(words)
    other = words.select(F.col("id").alias("near_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = near.join(other, "near_id").groupBy("id").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("form_n")).alias("less"), "form", "form_n", "near_id")).alias("best"),
    )
    takes = F.col("best.form_n") >= TIMES * F.col("n")
    judged = stored(
        words.join(best, "id", "left").select(
            "id",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best.form")).alias("form"),
            F.when(takes, F.col("best.form_n")).alias("form_n"),
            F.when(takes, F.col("best.near_id")).alias("form_id"),
        )
    )
    roots = _roots(judged.where("form_id IS NOT NULL"))
    named = roots.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
    found = judged.join(named.select("id", "root"), "id", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
