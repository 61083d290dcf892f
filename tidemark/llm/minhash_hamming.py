"""MinHash near-duplicates by a multi-index Hamming join.

Every text becomes the set of its distinct runs of five words, and the set a signature of 64
slots of 14 bits, the low bits of 64 minima. Texts of equal sets are one class. Two classes are
candidates when at most ``MOST_DIFFERENT`` slots of their signatures differ. By pigeonhole, 31
differing slots leave one of the 16 chunks of four slots with at most one of them, so a class
gets a key for each chunk and each slot that may differ in it: the chunk with that slot blanked.
Every pair under the distance meets in a key. At similarity 0.75 a slot differs with
probability 1/4, so more than 31 of 64 do with probability about 1e-5, and less above it.
Candidates whose set sizes or parities rule out a link are passed over; links are confirmed on the
full sets. The parities of a set are 512 bits, each telling whether an odd number of its runs hash
to it: two sets differ in at least as many runs as bits, and linked ones in a seventh of their
sizes at most, so no link is passed over.

Groups of copies are never expanded into pairs. In rounds, each key draws a leader from its classes,
and every class is held against the nearest leader, by signature, that it met in another
component; the links found make the next components. Only keys whose classes lie in several
components matter: there, when the pairs left to look at are counted as no more than a fixed
number for each class, or a round ended fewer than a quarter of them, classes outside the most
common component are held against all classes of other components under the distance, each pair
in the first key that it shares; a key with many classes outside is split over tasks. No candidate
between components is left out, and one within a component cannot change the result.

Defined cases: a null or blank text has an empty set and no link. A row without doc_id has no
link and stays (component null). Rows of one doc_id are one document. Extra columns of the
input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, mixed, shingles, sized, stored, word_hashes
from .components import components

WORDS = 5
SLOTS, CHUNK, BITS = 64, 4, 14
CHUNKS = SLOTS // CHUNK
MOST_DIFFERENT = 2 * CHUNKS - 1
#: Pairs whose texts one task compares.
PAIRS_PER_TASK = 2_000
#: Rounds end when the pairs left are no more than this many for each class.
PAIRS_PER_CLASS = 1
#: Classes outside the main component of a key that one task holds against the others.
OUTSIDE_PER_TASK = 2_000
#: Longs of parity bits.
PARITIES = 8
_PARTS = [f"s{i}" for i in range(CHUNKS)]
_BITS = [f"p{i}" for i in range(PARITIES)]
_random = np.random.Generator(np.random.Philox(key=77))
_FLIPS = _random.integers(0, 2**64, SLOTS, dtype=np.uint64)
_FACTORS = _random.integers(0, 2**64, SLOTS, dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 longs of four slots each. A slot has 14 bits, and one above them that stays 0."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        block = (hashes[at : at + 512, None] ^ _FLIPS) * _FACTORS
        np.minimum(least, block.min(axis=0), out=least)
    slots = (mixed(least) & np.uint64(2**BITS - 1)).astype(np.int64).reshape(CHUNKS, CHUNK)
    return (slots << (BITS + 1) * np.arange(CHUNK)).sum(axis=1)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITIES values of the top bits, whether an odd number of hashes has it."""
    width = 64 * PARITIES
    counts = np.bincount((hashes >> np.uint64(65 - width.bit_length())).astype(int), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, digests, parts = batch.column(0), [], [], []
        for text in batch.column(1):
            found = shingles(word_hashes(text.as_py()), WORDS)
            counts.append(len(found))
            digests.append(blake2b(found.tobytes(), digest_size=16).digest())
            parts.append(np.concatenate([signature(found), parities(found)]))
        columns = np.array(parts, np.int64).reshape(-1, CHUNKS + PARITIES).T
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.binary())]
            + [pa.array(c, pa.int64()) for c in columns],
            names=["doc_id", "n_shingles", "digest", *_PARTS, *_BITS],
        )


_SIGNED = "doc_id long, n_shingles long, digest binary, "
_SIGNED += ", ".join(f"{p} long" for p in _PARTS + _BITS)


def _differing(left: str, right: str) -> list[Column]:
    """The number of slots in which two signatures differ, chunk by chunk."""

    lanes = [(BITS + 1) * slot for slot in range(CHUNK)]
    full = F.lit(sum((2**BITS - 1) << lane for lane in lanes))
    spare = F.lit(sum(2**BITS << lane for lane in lanes))

    def chunk(part: str) -> Column:
        differs = F.col(f"{left}.{part}").bitwiseXOR(F.col(f"{right}.{part}"))
        # Adding all ones carries into the spare bit of a slot iff the slot is not zero.
        return F.bit_count((differs + full).bitwiseAND(spare))

    return [chunk(part) for part in _PARTS]


def _may_link(left: str, right: str) -> Column:
    """Whether sets of these sizes and parities can be similar enough. The smaller is all that
    they share, and they differ in at least as many elements as parities."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    odd = [F.bit_count(F.col(f"{left}.{p}").bitwiseXOR(F.col(f"{right}.{p}"))) for p in _BITS]
    sizes = 100 * F.least(n, m) >= 75 * F.greatest(n, m)
    return sizes & (7 * reduce(Column.__add__, odd) <= n + m)


def _blanked(slot: int) -> int:
    return 2 ** (CHUNK * (BITS + 1)) - 1 - ((2**BITS - 1) << (BITS + 1) * slot)


def _keys() -> Column:
    """All keys of a signature. The lowest 6 bits of a key name its chunk and slot."""
    return F.explode(
        F.array(
            *[
                F.xxhash64(F.lit(CHUNK * c + j), F.col(part).bitwiseAND(F.lit(_blanked(j))))
                .bitwiseAND(F.lit(-SLOTS))
                .bitwiseOR(F.lit(CHUNK * c + j).cast("long"))
                for c, part in enumerate(_PARTS)
                for j in range(CHUNK)
            ]
        )
    )


def _first_key(left: str, right: str, key: Column) -> Column:
    """Whether ``key``, which both signatures have, is the first key in which they meet."""
    chunks = _differing(left, right)
    # A chunk without a differing slot is met in each of its keys; the first of them counts.
    return reduce(
        lambda later, c: F.when(
            chunks[c] <= 1,
            (key.bitwiseAND(F.lit(SLOTS - CHUNK)) == CHUNK * c)
            & ((chunks[c] == 1) | (key.bitwiseAND(F.lit(CHUNK - 1)) == 0)),
        ).otherwise(later),
        reversed(range(CHUNKS)),
        F.lit(False),
    )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lefts, rights, last = [], [], (None, None)
        for a, b, left, right in zip(*batch.columns, strict=True):
            if last[0] != right:  # rows come sorted by b, so a leader is read once
                last = (right, shingles(word_hashes(right.as_py()), WORDS))
            x, y = shingles(word_hashes(left.as_py()), WORDS), last[1]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= 75 * (len(x) + len(y) - shared):
                lefts.append(a.as_py())
                rights.append(b.as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array(lefts, pa.int64()), pa.array(rights, pa.int64())], names=["a", "b"]
        )


def confirmed(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` (stored) of doc_ids whose full sets are similar enough."""
    rows = pairs.count()
    pairs = few(pairs, rows)  # a join that Spark split may have left thousands of parts
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    wanted = stored(few(wanted, 2 * rows))
    texts = documents.join(sized(wanted), "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return few(both.mapInArrow(_confirm, "a long, b long"), rows, PAIRS_PER_TASK)


def _nearest(
    active: DataFrame, placed: DataFrame, sketches: DataFrame, rows: int, turn: int
) -> DataFrame:
    """Each class of the keys ``active`` with the nearest leader of another component.

    The leader of a key has the least id after the bits that the turn draws are flipped. As all
    keys order ids alike, the keys of near copies agree on few leaders, and a class meets few.
    """
    flips = F.xxhash64(F.lit(turn))
    leads = active.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(flips)).alias("least"))
    leads = leads.select("key", F.col("least").bitwiseXOR(flips).alias("lead"))
    leads = sized(stored(few(leads, rows)))
    met = few(active.join(leads, "key").where("rep <> lead"), rows)
    met = few(met.select("rep", "lead").distinct(), rows).alias("m")
    x, y = placed.alias("x"), placed.alias("y")
    met = met.join(x, F.col("m.rep") == F.col("x.rep")).join(y, F.col("m.lead") == F.col("y.rep"))
    met = met.where(F.col("x.component") != F.col("y.component")).select("m.rep", "m.lead")
    met, x, y = few(met, rows).alias("m"), sketches.alias("x"), sketches.alias("y")
    met = met.join(x, F.col("m.rep") == F.col("x.rep")).join(y, F.col("m.lead") == F.col("y.rep"))
    met = met.where(_may_link("x", "y"))
    distance = reduce(Column.__add__, _differing("x", "y"))
    near = few(met, rows).select(F.col("m.rep").alias("a"), "lead", distance.alias("d"))
    near = near.where(F.col("d") <= MOST_DIFFERENT).groupBy("a")
    near = near.agg(F.min(F.struct("d", "lead")).alias("n"))
    return few(near.select("a", F.col("n.lead").alias("b")), rows)


def _divided(active: DataFrame, placed: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The rows of the keys whose classes lie in several components, and the number of pairs that
    ``_crossing`` would look at for them."""
    met = few(active.join(placed, "rep"), rows)
    shares = few(met.groupBy("key", "component").agg(F.count("*").alias("n")), rows)
    keys = shares.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    keys = keys.where("most < all").selectExpr("key", "(all - most) * all AS pairs")
    keys = stored(few(keys, rows))
    pairs = keys.agg(F.sum(F.col("pairs").cast("decimal(38)"))).first()[0]
    return few(active.join(sized(keys.select("key")), "key", "left_semi"), rows), int(pairs or 0)


def _crossing(
    active: DataFrame, placed: DataFrame, sketches: DataFrame, rows: int
) -> DataFrame:
    """All pairs of classes of different components that share a key and are near enough."""
    met = few(active.join(placed, "rep"), rows)
    shares = few(met.groupBy("key", "component").agg(F.count("*").alias("n")), rows)
    main = shares.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all")
    )
    outside = F.ceil((F.col("all") - F.col("most.n")) / OUTSIDE_PER_TASK)
    main = main.select(
        "key", F.col("most.component").alias("main"), F.greatest(outside, F.lit(1)).alias("splits")
    )
    main = sized(stored(few(main, rows)))
    met = stored(few(met.join(main, "key").join(sketches, "rep"), rows))
    part = F.pmod(F.xxhash64("rep"), F.col("splits"))
    outside = met.where("component <> main").withColumn("part", part).alias("x")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))
    other = met.withColumn("part", parts).alias("y")
    pairs = outside.join(
        other,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.part") == F.col("y.part"))
        & (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & _may_link("x", "y")
        & (reduce(Column.__add__, _differing("x", "y")) <= MOST_DIFFERENT)
        & _first_key("x", "y", F.col("x.key")),
    )
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents``."""
    documents = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(documents.mapInArrow(_signed, _SIGNED))
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Never null; said here, it halves the code that joins run for each pair.
    none = F.lit(0).cast("long")
    classes = stored(
        linkable.groupBy("digest").agg(
            F.min("doc_id").alias("rep"),
            F.coalesce(F.min("n_shingles"), none).alias("n"),
            *[F.coalesce(F.min(p), none).alias(p) for p in _PARTS + _BITS],
        )
    )
    same = linkable.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest")
    copies = same.where(F.col("doc_id") != F.col("rep"))
    copies = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    n = classes.count()
    sketches = few(classes.select("rep", "n", *_PARTS, *_BITS), n)
    keys = sketches.select("rep", _keys().alias("key"))
    rows = SLOTS * n
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    shared = few(shared.where("low < high").select("key"), rows)
    active = stored(few(keys.join(shared, "key"), rows))
    # Not broadcast: rows this wide would be in the driver's memory several times, in each round.

    # Links of classes; those of equal texts come in at the end.
    links, before = None, math.inf
    placed = sized(stored(few(classes.select("rep", F.col("rep").alias("component")), n)))
    for turn in count():
        rows = active.count()
        pairs = stored(_nearest(active, placed, sketches, rows, turn))
        found = stored(confirmed(documents, pairs))
        reached = components(found if links is None else links.union(found))
        links = stored(reached.select(F.col("id").alias("a"), F.col("component").alias("b")))
        reps = classes.select("rep").distinct()
        placed = reps.join(sized(links), F.col("rep") == F.col("a"), "left").select(
            "rep", F.coalesce("b", "rep").alias("component")
        )
        placed = sized(stored(few(placed, n)))
        active, left = _divided(active, placed, rows)
        active = stored(active)
        if left <= PAIRS_PER_CLASS * n or 4 * left > 3 * before:
            break
        before = left
    crossing = stored(_crossing(active, placed, sketches, active.count()))
    whole = components(copies.union(links).union(confirmed(documents, crossing)))
    marked = signed.join(whole, signed.doc_id == whole.id, "left")
    reached = F.coalesce("component", "doc_id")
    return marked.select(
        "doc_id",
        "n_shingles",
        reached.alias("component_id"),
        F.coalesce(F.col("doc_id") == reached, F.lit(True)).alias("kept"),
    )
