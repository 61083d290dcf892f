"""Collocations of two to five words by direct-address tiling, exact counts per language.

A text is cut into pieces at ``.,;:!?`` and line ends, a piece into words at blanks; phrases do not
cross pieces. Level k counts all phrases of k words that can be frequent: those whose first and
last k - 1 words are frequent phrases themselves (a phrase is never more frequent than its parts,
so nothing is lost).

* **Frequency-ranked ids.** The most frequent prefixes and words of a level have ranks within their
  language. A phrase is the pair (rank of its first k - 1 words, rank of its last word).
* **Tiles.** Each task sorts the pairs of a block of text by tile of ``TILE`` x ``TILE`` ranks.
  A tile with many of them is counted by one dense ``bincount`` into an array that the task keeps;
  pairs of thin tiles, and those with a part that has no rank, are counted as sorted coordinates.
  Parts with a rank leave a task as their rank, which takes a fraction of the bytes of a hash.
* **Recursion.** Tasks emit counts, Spark adds them up per pair, the frequent pairs are ranked anew
  and are the prefixes of the next level.

Nothing depends on the ranks but speed. A phrase goes by 64-bit hashes: the one of its first words
and the one of its last word. Two different frequent words with one hash raise an error; that a
frequent phrase takes in the count of a rare one is left, with a probability of about
(number of distinct phrases) / 2^64.

Bounds: tasks get the ranks (``HEAD`` entries) and a bit map of the hashes of the frequent phrases
of the level before (``MOST_BITS`` bits at most; a false hit costs one more counted phrase, which
is too rare to stay). Both go through the driver and do not grow beyond that. Tasks work on blocks
of ``BLOCK`` bytes, cut between words with the last words carried over, so that a text of any
length needs little memory; only a single word must fit. All joins are on phrases, which are
distinct; the ranking keeps the first rows of each language before its shuffle.

Defined cases: null texts have no words, a null language is ``und``, repeated rows count each time,
equal scores rank by frequency and then by phrase, an empty table gives an empty result. Only the
two named columns are read, so others can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, stored

LEAST = 100
LONGEST = 5
FIRST = 2000
TILE = 512
#: Ranked prefixes and words of a level, over all languages.
HEAD = 65_536
#: Pairs of a block from which a tile is counted densely, and dense tiles that a task keeps.
DENSE_FROM = 4096
MOST_TILES = 96
BLOCK = 2 << 20
#: Entries of sorted coordinates that a task gathers before it emits them.
MOST_ENTRIES = 1 << 20
MOST_BITS = 1 << 28

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.Generator(np.random.Philox(key=20261202))
_BYTE_VALUE = _SEEDS.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# 0 inside a word, 1 blank, 2 end of a piece.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

_SCHEMA = "kind int, lang string, prefix long, last long, n long, word string"
_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("lang", pa.string()),
        ("prefix", pa.int64()),
        ("last", pa.int64()),
        ("n", pa.int64()),
        ("word", pa.string()),
    ]
)
_TOTAL, _WORD, _COUNT = 0, 1, 2
#: Set in every hash, so that none looks like a rank.
_HASH = np.uint64(1 << 63)


def _followed(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its first words and its last."""
    return mixed(prefix * _BASE + last) | _HASH


class _Words:
    """The words of a block: hash, piece and place of each; the first ``old`` were seen before."""

    def __init__(self, raw: np.ndarray, before: _Words | None):
        self.letters = _LOWER[raw]
        kinds = _KIND[raw]
        inside = kinds == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        self.starts = np.flatnonzero(begins)
        at = np.arange(len(raw), dtype=np.int32)
        place = at - np.maximum.accumulate(np.where(begins, at, 0))
        place[~inside] = 0
        powers = np.full(int(place.max(initial=0)) + 1, _BASE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        values = np.where(inside, _BYTE_VALUE[self.letters], np.uint64(0)) * powers[place]
        ends = np.cumsum(kinds == 2, dtype=np.int64)
        hashes = values[:0]
        if len(self.starts):
            hashes = mixed(np.add.reduceat(values, self.starts)) | _HASH
        pieces = ends[self.starts]
        self.old, self.breaks = 0, int(ends[-1]) if len(ends) else 0
        if before is not None:
            carried = before.hashes[-(LONGEST - 1) :]
            self.old = len(carried)
            hashes = np.concatenate([carried, hashes])
            pieces = np.concatenate([before.pieces[-(LONGEST - 1) :] - before.breaks, pieces])
        self.hashes, self.pieces, self.inside = hashes, pieces, inside

    def text(self, number: int) -> str:
        """The word of that number among those that are new."""
        start = int(self.starts[number])
        outside = np.flatnonzero(~self.inside[start : start + 64])
        end = start + int(outside[0]) if len(outside) else start + 64
        while not len(outside) and end < len(self.inside) and self.inside[end]:
            end += 1
        return self.letters[start : min(end, len(self.inside))].tobytes().decode("utf-8", "replace")


def _blocks(texts: list[bytes]) -> Iterator[_Words]:
    """The texts in blocks of about ``BLOCK`` bytes; a longer text in several that follow."""
    group: list[bytes] = []
    size = 0
    for text in [*texts, None]:
        if text is None or size + len(text) > BLOCK:
            if group:
                yield _Words(np.frombuffer(b"\n".join(group), np.uint8), None)
            group, size = [], 0
        if text is None:
            return
        if len(text) <= BLOCK:
            group.append(text)
            size += len(text) + 1
            continue
        raw, at, before = np.frombuffer(text, np.uint8), 0, None
        while at < len(raw):
            end = min(at + BLOCK, len(raw))
            while end < len(raw) and _KIND[raw[end]] == 0:
                gap = np.flatnonzero(_KIND[raw[end : end + BLOCK]])
                end += int(gap[0]) if len(gap) else min(BLOCK, len(raw) - end)
            before = _Words(raw[at:end], before)
            yield before
            at = end


class _Counts:
    """Counts of pairs that a task has gathered, and their way out as Arrow batches."""

    def __init__(self, prefix_ranks: dict, word_ranks: dict):
        self.prefix_ranks, self.word_ranks = prefix_ranks, word_ranks
        self.tiles: dict[tuple, np.ndarray] = {}
        self.sparse: dict[str, list] = {}
        self.entries = 0

    def add(self, lang: str, prefix: np.ndarray, last: np.ndarray) -> None:
        rows, cols = _ranks(self.prefix_ranks, lang, prefix), _ranks(self.word_ranks, lang, last)
        ranked = (rows >= 0) & (cols >= 0)
        rest = ~ranked
        if ranked.any():
            held = np.flatnonzero(ranked)
            wide = 1 + HEAD // TILE
            tile = (rows[held] // TILE) * wide + cols[held] // TILE
            order = np.argsort(tile, kind="stable")
            held, tile = held[order], tile[order]
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            for begin, end in zip(first, [*first[1:], len(tile)], strict=True):
                key, own = (lang, int(tile[begin])), held[begin:end]
                known = key in self.tiles
                if known or (end - begin >= DENSE_FROM and len(self.tiles) < MOST_TILES):
                    cell = (rows[own] % TILE) * TILE + cols[own] % TILE
                    found = np.bincount(cell, minlength=TILE * TILE)
                    self.tiles[key] = self.tiles[key] + found if known else found
                else:
                    rest[own] = True
        prefix = np.where(rows >= 0, rows.astype(np.uint64), prefix)[rest]
        last = np.where(cols >= 0, cols.astype(np.uint64), last)[rest]
        self._add_sparse(lang, *_summed(prefix, last, None))

    def _add_sparse(self, lang: str, prefix, last, n) -> None:
        self.sparse.setdefault(lang, []).append((prefix, last, n))
        self.entries += len(n)

    def out(self, final: bool) -> Iterator[pa.RecordBatch]:
        if not final and self.entries < MOST_ENTRIES:
            return
        for lang, parts in self.sparse.items():
            merged = _summed(*[np.concatenate(column) for column in zip(*parts, strict=True)])
            self.sparse[lang] = [merged]
        self.entries = sum(len(parts[0][2]) for parts in self.sparse.values())
        if not final and self.entries < MOST_ENTRIES // 2:
            return
        for lang, parts in self.sparse.items():
            yield _batch(_COUNT, lang, *parts[0])
        self.sparse, self.entries = {}, 0
        if final:
            for (lang, tile), counts in self.tiles.items():
                cells = np.flatnonzero(counts)
                row, col = divmod(tile, 1 + HEAD // TILE)
                prefix = (row * TILE + cells // TILE).astype(np.uint64)
                last = (col * TILE + cells % TILE).astype(np.uint64)
                yield _batch(_COUNT, lang, prefix, last, counts[cells])


def _summed(prefix: np.ndarray, last: np.ndarray, n: np.ndarray | None) -> tuple:
    """Sorted coordinates: one entry per pair, with its count or the sum of its counts."""
    order = np.lexsort((last, prefix)) if prefix.any() else np.argsort(last)
    prefix, last = prefix[order], last[order]
    new = np.ones(len(prefix), dtype=bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (last[1:] != last[:-1])
    first = np.flatnonzero(new)
    if n is None:
        counts = np.diff(np.append(first, len(prefix)))
    else:
        counts = np.add.reduceat(n[order], first) if len(first) else n[:0]
    return prefix[first], last[first], counts.astype(np.int64)


def _ranks(ranks: dict, lang: str, hashes: np.ndarray) -> np.ndarray:
    """The rank of each hash in its language, -1 where it has none."""
    if lang not in ranks:
        return np.full(len(hashes), -1)
    ordered, rank, _ = ranks[lang]
    found = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    return np.where(ordered[found] == hashes, rank[found], -1)


def _batch(kind: int, lang: str, prefix, last, n, words: list[str] | None = None):
    columns = [
        pa.array(np.full(len(n), kind, np.int32)),
        pa.array([lang] * len(n), pa.string()),
        pa.array(np.ascontiguousarray(prefix).view(np.int64)),
        pa.array(np.ascontiguousarray(last).view(np.int64)),
        pa.array(n, pa.int64()),
        pa.array(words, pa.string()) if words else pa.nulls(len(n), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _counter(level: int, frequent: np.ndarray | None, prefix_ranks: dict, word_ranks: dict):
    """What a task does at a level. ``frequent`` is the bit map of the level before."""

    def may_be_frequent(hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(len(frequent) * 64 - 1)
        return (frequent[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def pairs(words: _Words) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of ``level`` words, in one piece, ending in a new word, that can be frequent."""
        count = max(0, len(words.hashes) - level + 1)
        part = words.hashes[: count + 1]
        for i in range(1, level - 1):
            part = _followed(part, words.hashes[i : i + count + 1])
        whole = words.pieces[:count] == words.pieces[level - 1 : level - 1 + count]
        whole[: max(0, words.old - level + 1)] = False
        fine = may_be_frequent(part)
        whole &= fine[:-1] & fine[1:]
        return part[:-1][whole], words.hashes[level - 1 :][whole]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, told = _Counts(prefix_ranks, word_ranks), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for words in _blocks(own):
                    new = words.hashes[words.old :]
                    if not len(new):
                        continue
                    none = np.zeros(1, np.uint64)
                    if level == 1:
                        yield _batch(_TOTAL, lang, none, none, np.array([len(new)]))
                        counts._add_sparse(lang, *_summed(np.zeros_like(new), new, None))
                    else:
                        if level == 2:
                            yield from spelled(lang, words, new, told)
                        if len(words.hashes) >= level:
                            counts.add(lang, *pairs(words))
                    yield from counts.out(final=False)
        yield from counts.out(final=True)

    def spelled(lang: str, words: _Words, new: np.ndarray, told: dict):
        """The letters of words that can be frequent, once per task."""
        hashes, first = np.unique(new, return_index=True)
        known = told.get(lang, hashes[:0])
        fresh = may_be_frequent(hashes) & ~np.isin(hashes, known)
        if fresh.any():
            told[lang] = np.concatenate([known, hashes[fresh]])
            texts = [words.text(i) for i in first[fresh]]
            zeros = np.zeros(len(texts), np.uint64)
            yield _batch(_WORD, lang, zeros, hashes[fresh], zeros.astype(np.int64), texts)

    return count


def _bit_map(frequent: DataFrame) -> np.ndarray:
    """Bits of the hashes ``id``, 16 for each and ``MOST_BITS`` at most."""
    bits = 1 << 16
    while bits < min(MOST_BITS, 16 * frequent.count()):
        bits *= 2
    place = F.col("id").bitwiseAND(F.lit(bits - 1))
    slots = frequent.select(place.alias("p")).selectExpr(
        "shiftright(p, 6) AS slot", "shiftleft(1L, CAST(p & 63 AS INT)) AS bit"
    )
    held = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(bits // 64, np.uint64)
    found[held["slot"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return found


def _ranked(frequent: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language: hashes in order, the rank of each, and the hashes by rank."""
    head = frequent.orderBy(F.desc("n"), "id", "lang").limit(HEAD).select("lang", "id").toArrow()
    langs, ids = head["lang"].to_pylist(), head["id"].to_numpy().view(np.uint64)
    found = {}
    for lang in set(langs):
        own = ids[[x == lang for x in langs]]
        order = np.argsort(own)
        found[lang] = (own[order], order.astype(np.int64), own)
    return found


def _unranked(prefix_ranks: dict, word_ranks: dict):
    """Ranks back to hashes, and the hash of each phrase beside."""

    def hashes(langs: np.ndarray, codes: np.ndarray, ranks: dict) -> np.ndarray:
        found = codes.copy()
        for lang in ranks:
            own = (langs == lang) & (codes < _HASH)
            found[own] = ranks[lang][2][codes[own]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            prefix = hashes(langs, batch.column("prefix").to_numpy().view(np.uint64), prefix_ranks)
            last = hashes(langs, batch.column("last").to_numpy().view(np.uint64), word_ranks)
            own = _followed(prefix, last) if len(prefix) else last
            parts = [pa.array(x.view(np.int64)) for x in (prefix, last, own)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), *parts, batch.column("n")],
                names=["lang", "prefix", "last", "id", "n"],
            )

    return run


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST
) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``LONGEST`` words with at least ``least`` occurrences: ``lang``,
    ``words`` (hashes), ``phrase``, ``k``, ``n``; and ``lang``, ``total`` (all words)."""
    read = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )

    def level(k: int, *known) -> DataFrame:
        counted = read.mapInArrow(_counter(k, *known), _SCHEMA)
        summed = counted.groupBy("kind", "lang", "prefix", "last", "word").agg(
            F.sum("n").alias("n")
        )
        return stored(summed.where((F.col("kind") != _COUNT) | (F.col("n") >= least)))

    first = level(1, None, {}, {})
    totals = first.where(F.col("kind") == _TOTAL).select("lang", F.col("n").alias("total"))
    before = first.where(F.col("kind") == _COUNT).select("lang", F.col("last").alias("id"), "n")
    word_ranks = prefix_ranks = _ranked(before)
    singles, phrases = before, []
    for k in range(2, LONGEST + 1):
        found = level(k, _bit_map(before), prefix_ranks, word_ranks)
        if k == 2:
            spelled = found.where(F.col("kind") == _WORD).groupBy("lang", F.col("last").alias("id"))
            same = F.assert_true(F.count("word") == 1, F.lit("two words have one hash"))
            spelled = spelled.agg(F.coalesce(same.cast("string"), F.min("word")).alias("word"))
            singles = stored(singles.join(spelled, ["lang", "id"]))
            phrases.append(
                singles.select(
                    "lang", F.array("id").alias("words"), F.col("word").alias("phrase"),
                    F.lit(1).alias("k"), "n", "id",
                )
            )
        pairs = found.where(F.col("kind") == _COUNT).select("lang", "prefix", "last", "n")
        pairs = pairs.mapInArrow(
            _unranked(prefix_ranks, word_ranks),
            "lang string, prefix long, last long, id long, n long",
        )
        ending = singles.select("lang", F.col("id").alias("last"), "word")
        starting = phrases[-1].select("lang", F.col("id").alias("prefix"), "words", "phrase")
        grown = pairs.join(starting, ["lang", "prefix"]).join(ending, ["lang", "last"]).select(
            "lang",
            F.concat("words", F.array("last")).alias("words"),
            F.concat_ws(" ", "phrase", "word").alias("phrase"),
            F.lit(k).alias("k"),
            "n",
            "id",
        )
        before = stored(grown)
        phrases.append(before)
        prefix_ranks = _ranked(before)
        if not prefix_ranks:
            break
    every = phrases[0]
    for more in phrases[1:]:
        every = every.unionByName(more)
    return every.drop("id"), totals


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    first: int = FIRST,
) -> DataFrame:
    """The ``first`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its two parts at the cut of the lowest
    score, ``score`` = floor(1000 a n / (l r)) with ``n`` words in all, in exact decimals.
    A phrase inside a longer one that is as frequent is left out."""
    every, totals = frequent_phrases(docs, text, lang, least)
    every = stored(every)
    long = every.where("k > 1")
    cuts = long.select(
        "lang", "words", "k", F.col("n").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut")
    ).selectExpr("*", "slice(words, 1, cut) AS head", "slice(words, cut + 1, k - cut) AS tail")
    heads = every.select("lang", F.col("words").alias("head"), F.col("n").alias("l"))
    tails = every.select("lang", F.col("words").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    scored = scored.join(F.broadcast(totals) if totals.count() < 10_000 else totals, "lang")
    score = F.expr(
        "(CAST(a * 1000 AS DECIMAL(19, 0)) * CAST(total AS DECIMAL(19, 0)))"
        " div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    )
    scored = scored.groupBy("lang", "words").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"),
        F.first("total").alias("total"),
    )
    # A longer phrase that is as frequent contains one of one word more that is.
    inside = long.where("k > 2").selectExpr(
        "lang", "n", "explode(array(slice(words, 1, k - 1), slice(words, 2, k - 1))) AS words"
    )
    inside = inside.groupBy("lang", "words").agg(F.max("n").alias("around"))
    stay = long.join(inside, ["lang", "words"], "left").where("around IS NULL OR around < n")
    rows = stay.join(scored, ["lang", "words"]).select(
        "lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("total").alias("n"), "best.score"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
