"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash of its id. The words of a source are summed by the leading bits of
that hash; a running sum over these buckets finds the bucket in which the source's budget ends.
Only that bucket is summed again by its next bits, and so on, until all bits are used. The
result is one threshold per source: documents below it are taken once more, the others are not.
Thresholds of smaller budgets lie below those of larger ones, so mixes are nested, and a rerun
takes the same documents. Nothing is sorted but the buckets of a source.

Defined cases: a null or blank text has size 0. A null source is a source of its own, ranked
last. Rows of one doc_id share a hash, so they are taken together; a null doc_id is hashed as
the text 'null'. A source or a corpus without words has target 0. Extra columns pass through
unless they bear the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, aside, restored, salted_join, stored

#: Bits of the hash per level, from the top. 60 bits in all.
LEVELS = (12, 12, 12, 12, 12)
BITS = sum(LEVELS)
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target of every source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh 3, 1, 2 and so on in turn. A target is
    ``weight * level``, or ``most`` times the source's size if that is less; the level is the one
    at which the targets add up to ``share`` times all words. Sources stop in the order of
    ``size / weight``, so the level follows from running sums over the sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), turn + 1)
    ranked = sources.select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("most")
    )
    summed = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("budget"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("stopped"),
        (
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
        ).alias("weights_left"),
    )
    # A source stops if its limit is within the level that holds when all before it stopped.
    level = (F.col("budget") - F.col("stopped")) / F.col("weights_left")
    stops = F.col("most") <= level * F.col("weight")
    last_level = F.min(F.when(~stops, F.struct(F.col("most") / F.col("weight"), F.col("budget"),
                                               F.col("stopped"), F.col("weights_left"))))
    open_level = last_level.over(everything)
    shared = (open_level["budget"] - open_level["stopped"]) * F.col("weight")
    shared = shared / open_level["weights_left"]
    target = F.when(stops, F.col("most").cast("double")).otherwise(shared)
    return summed.select("source", "source_size", target.alias("target"))


def _thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """source and the hash below which a document is taken once more.

    ``wanted`` has a row per source with ``rest``, the words to take beyond whole rounds.
    """
    open_ends = wanted.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    used = 0
    for bits in LEVELS:
        used += bits
        shift = BITS - used
        within = salted_join(sized, open_ends, ["source"], F.col("hash"))
        within = within.where(F.shiftright("hash", shift + bits) == F.col("prefix"))
        buckets = within.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words")
        )
        along = Window.partitionBy("source").orderBy("bucket")
        before = F.coalesce(
            F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        running = buckets.select("source", "bucket", "words", before.alias("before"))
        running = salted_join(running, open_ends, ["source"], F.col("bucket"), 1)
        last = bits == LEVELS[-1] and shift == 0
        if last:
            # One document, or rows of one id: taken if that comes nearer to the budget.
            fits = 2 * F.col("before") + F.col("words") <= 2 * F.col("rest")
            ends = running.groupBy("source").agg(
                F.min(F.when(~fits, F.col("bucket"))).alias("end"),
                F.max("bucket").alias("top"),
            )
            return stored(
                ends.select("source", F.coalesce("end", F.col("top") + 1).alias("threshold"))
            )
        crossing = F.when(F.col("before") + F.col("words") >= F.col("rest"), F.struct("bucket", "before"))
        ends = running.groupBy("source").agg(
            F.min(crossing).alias("first"), F.max(F.struct("bucket", "before")).alias("top"),
            F.first("rest").alias("rest"),
        )
        end = F.coalesce("first", "top")
        open_ends = stored(
            ends.select(
                "source",
                (F.col("rest") - end["before"]).alias("rest"),
                end["bucket"].alias("prefix"),
            )
        )
    raise AssertionError


def _plan(sized: DataFrame) -> DataFrame:
    """source, source_size, target, rounds and threshold of every source."""
    aims = stored(targets(sized))
    rounds = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    aims = aims.withColumn("rounds", rounds)
    wanted = aims.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    ends = _thresholds(sized, wanted.select("source", "rest"))
    return stored(salted_join(aims, ends, ["source"], F.col("rounds"), 1))


def _times() -> Column:
    again = F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return F.least(F.col("rounds") + again, F.lit(MOST)).cast("int")


def mix(documents: DataFrame) -> DataFrame:
    """The columns of ``documents`` but text, with size, source_size, target and taken.

    A source with target ``t`` and ``n`` words takes every document ``floor(t / n)`` times, and
    the documents below its threshold once more. ``taken`` is the words of a document that the
    mix takes. The new columns replace those of their names; others can have any name.
    """
    added = ["size", "source_size", "target", "taken"]
    rows = aside(documents, "doc_id", "source", "text")
    rows = rows.withColumn("size", size_in_words(F.col("text")))
    rows = stored(rows.withColumn("hash", id_hash(F.col("doc_id"))).drop("text"))
    marked = salted_join(rows, _plan(rows), ["source"], F.col("hash"))
    taken = (F.col("size") * _times()).cast("long")
    names = [c for c in documents.columns if c not in [*added, "text"]]
    return marked.withColumn("taken", taken).select(
        *restored(names, "doc_id", "source"), *added
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the mix takes, those taken twice as two rows.

    A document without words has no part in any budget; it is dropped.
    """
    size, key = size_in_words(F.col("text")), id_hash(F.col("doc_id"))
    sized = stored(documents.select("source", size.alias("size"), key.alias("hash")))
    plan = _plan(sized).select("source", "rounds", "threshold")
    inputs = F.struct(*[F.col(c) for c in documents.columns]).alias("row")
    rows = documents.where(F.col("text").rlike(WORD)).select("source", key.alias("hash"), inputs)
    marked = salted_join(rows, plan, ["source"], F.col("hash"))
    repeated = marked.select("row", F.explode(F.array_repeat(F.lit(1), _times())))
    return repeated.select("row.*")
