"""Removal of long repeated byte strings by a distributed merge sort of suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed. Sorting
a suffix of each position would move hundreds of times the input, so suffixes start at anchors
only, chosen by content so that nothing is missed: the anchor of a window of ``LENGTH`` bytes is
the last smallest hash among the runs of ``GRAM`` bytes that start in its first ``SPAN`` positions.
Equal windows have their anchor at the same offset, so it suffices to sort the suffixes of anchors,
with the text on their left as far as their windows reach. As in prefix doubling, anchors whose
first ``CORE`` bytes (common to all windows of an anchor) occur once are dropped before the sort.

The sort: tasks collect runs of suffixes, sort them, and send them front-coded (length of the
prefix shared with the one before, then the rest), split into ranges by sampled bounds. A task per
range merges its runs in a loser tree that keeps, for every run, how much its head shares with the
last winner: heads that share different lengths are ordered by these alone, else comparison starts
behind the shared part. Neighbours that share ``CORE`` bytes form a group; within it, windows are
compared by anchor offset and hash of their bytes. Equal entries of a group are one.

Copies of whole documents need no sort: all their windows occur elsewhere. One of them takes part,
for the others. In the group work a passage in a third of all documents is one entry of a few
bytes per occurrence.

Defined cases: a null text counts as empty. Texts of fewer than ``LENGTH`` bytes lose nothing.
Rows that occur again, with or without doc_id, are copies of each other. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, stored

LENGTH = 400
GRAM, SPAN = 16, 256
CORE = LENGTH - SPAN + 1
RUN_BYTES = 24 << 20
RANGE_BYTES = 12 << 20
#: Prefixes sampled for the bounds, and their length (CORE at most, so that groups stay whole).
SAMPLE, HEAD = 4_000, 48
_PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_VALUES = np.random.Generator(np.random.Philox(key=8)).integers(0, 2**64, 256, np.uint64)


def _rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes, by doubling: hash(2n) from two hashes of n."""
    total, have, power = _VALUES[raw], 1, _BASE
    whole, length = None, 0  # the runs composed so far for the binary digits of size
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if whole is None:
                    whole, length = total, have
                else:
                    n = len(raw) - length - have + 1
                    whole = whole[:n] * power + total[length : length + n]
                    length += have
            left >>= 1
            if left:
                n = len(total) - have
                if n <= 0:
                    return np.empty(0, np.uint64)
                total = total[:n] * power + total[have : have + n]
                have, power = 2 * have, power * power
    return mixed(whole[: max(0, len(raw) - size + 1)])


def anchors(raw: np.ndarray) -> np.ndarray:
    """Rows (anchor, first and last window start that it serves), in order. Works piece by piece."""
    windows = len(raw) - LENGTH + 1
    found = []
    for at in range(0, max(windows, 0), _PIECE):
        n = min(_PIECE, windows - at)
        grams = _rolling(raw[at : at + n + SPAN + GRAM - 2], GRAM)
        # The last of equal hashes wins: later places get the smaller low bits.
        low = np.uint64((1 << 21) - 1)
        keys = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
        width = 1
        while 2 * width <= SPAN:  # minima over doubling widths
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        place = at + (low - (keys[:n] & low)).astype(np.int64)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(starts[1:], n) - 1
        found.append(np.stack([place[starts], at + starts, at + ends], 1))
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.concatenate(found)
    # An anchor whose windows lie in two pieces is two rows, which is as good.
    return rows


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for doc_id, text_hash, text in zip(*batch.columns, strict=True):
            raw = np.frombuffer(_bytes(text.as_py()), np.uint8)
            rows = anchors(raw)
            if len(rows):
                hashes = _rolling(raw, CORE)[rows[:, 0]].view(np.int64)
                parts.append((doc_id.as_py(), text_hash.as_py(), hashes, rows))
        sizes = [len(p[3]) for p in parts]
        rows = np.concatenate([p[3] for p in parts]) if parts else np.empty((0, 3), np.int64)
        hashes = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([p[0] for p in parts], np.int64), sizes)),
                pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), sizes)),
                pa.array(hashes),
                *[pa.array(rows[:, i].astype(np.int32)) for i in range(3)],
            ],
            names=["doc", "text_hash", "core", "anchor", "first", "last"],
        )


_CORES = "doc long, text_hash long, core long, anchor int, first int, last int"


def _shared(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the common prefix, known to be ``at`` at least."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    step = 8
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def _put(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _front_coded(entries: list[tuple]) -> bytes:
    """Sorted entries (right, left, doc, text_hash, anchor, first, last) without shared prefixes."""
    out, right, left = [], b"", b""
    for entry in entries:
        same, same_left = _shared(right, entry[0]), _shared(left, entry[1])
        right, left = entry[0], entry[1]
        out += [_put(same), _put(len(right) - same), right[same:]]
        out += [_put(same_left), _put(len(left) - same_left), left[same_left:]]
        out.append(entry[2].to_bytes(8, "little", signed=True))
        out.append(entry[3].to_bytes(8, "little", signed=True))
        out += [_put(n) for n in entry[4:]]
    return b"".join(out)


def _decoded(blob: bytes) -> Iterator[tuple]:
    """(prefix shared with the one before, entry) of a run, one by one."""
    at, right, left = 0, b"", b""

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = blob[at]
            at += 1
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7

    def part(before: bytes) -> tuple[int, bytes]:
        nonlocal at
        same, more = number(), number()
        at += more
        return same, before[:same] + blob[at - more : at]

    while at < len(blob):
        same, right = part(right)
        _, left = part(left)
        doc = int.from_bytes(blob[at : at + 8], "little", signed=True)
        text_hash = int.from_bytes(blob[at + 8 : at + 16], "little", signed=True)
        at += 16
        yield same, (right, left, doc, text_hash, number(), number(), number())


def _merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """(prefix shared with the one before, entry) of all runs in order, by a loser tree.

    ``known[r]`` is how much run r's head shares with the last winner. Of two heads, the one that
    shares more is smaller; on a tie they are compared behind that, and the loser then knows
    how much it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple | None] = [None] * k
    known = [0] * k

    def advance(r: int) -> None:
        step = next(runs[r], None) if r < len(runs) else None
        known[r], heads[r] = step if step else (-1, None)

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser."""
        if heads[x] is None:
            return y, x
        if heads[y] is None or known[x] > known[y]:
            return x, y
        if known[x] < known[y]:
            return y, x
        a, b = heads[x][0], heads[y][0]
        same = _shared(a, b, known[x])
        if same == len(a) or (same < len(b) and a[same] < b[same]):
            known[y] = same
            return x, y
        known[x] = same
        return y, x

    for r in range(k):
        advance(r)
        known[r] = 0 if heads[r] else -1
    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        yield known[winner], heads[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _repeated(group: list[tuple]) -> Iterator[tuple[tuple, int, int]]:
    """(entry, first, last window start) of the windows of a group that occur twice in it."""
    kinds: dict[tuple, list[tuple]] = {}
    for entry in group:
        right, left, _, _, anchor, first, last = entry
        kinds.setdefault((right, left, anchor - first, anchor - last), []).append(entry)
    if len(kinds) == 1 and len(group) < 2:
        return
    hashes, sizes = [], []
    for right, left, far, near in kinds:
        whole = np.frombuffer(left[::-1] + right, np.uint8)
        found = _rolling(whole, LENGTH)[: far - near + 1]
        offsets = np.arange(far, near - 1, -1, dtype=np.uint64)
        hashes.append(mixed(found ^ (offsets * _BASE)))
        sizes.append(len(found))
    every = np.concatenate(hashes)
    values, place = np.unique(every, return_inverse=True)
    weight = np.repeat([min(2, len(v)) for v in kinds.values()], sizes)
    twice = np.bincount(place, weight, len(values))[place] > 1
    at = 0
    for entries, size in zip(kinds.values(), sizes, strict=True):
        marks = np.concatenate([[0], twice[at : at + size], [0]]).astype(np.int8)
        at += size
        edges = np.flatnonzero(np.diff(marks))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for entry in entries:
                yield entry, entry[5] + begin, entry[5] + end - 1


_FOUND = pa.schema(
    [("doc", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]
)


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, blob) come sorted by range."""

    def done(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows, group = [], []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=_FOUND)

        for same, entry in _merged([_decoded(b) for b in blobs]):
            if same < CORE and group:
                rows += [(e[2], e[3], x, y) for e, x, y in _repeated(group)]
                group = []
                if len(rows) > 50_000:
                    yield batch()
                    rows = []
            group.append(entry)
        rows += [(e[2], e[3], x, y) for e, x, y in _repeated(group)]
        yield batch()

    current, blobs = None, []
    for batch in batches:
        for number, blob in zip(*batch.columns, strict=True):
            if number.as_py() != current:
                if blobs:
                    yield from done(blobs)
                current, blobs = number.as_py(), []
            blobs.append(blob.as_py())
    if blobs:
        yield from done(blobs)


def _runs(bounds: list[bytes]):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            entries.sort()
            numbers, blobs, at = [], [], 0
            for number in range(len(bounds) + 1):
                end = len(entries)
                if number < len(bounds):
                    end = bisect.bisect_left(entries, (bounds[number],), at)
                if end > at:
                    numbers.append(number)
                    blobs.append(_front_coded(entries[at:end]))
                at = end
            entries.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())],
                names=["range", "blob"],
            )

        for batch in batches:
            for doc, text_hash, text, places in zip(*batch.columns, strict=True):
                raw = _bytes(text.as_py())
                for p in places.as_py():
                    anchor, first, last = p["anchor"], p["first"], p["last"]
                    right = raw[anchor : last + LENGTH]
                    left = raw[first:anchor][::-1]
                    entry = (right, left, doc.as_py(), text_hash.as_py(), anchor, first, last)
                    entries.append(entry)
                    held += len(right) + len(left) + 300
                if held > RUN_BYTES:
                    yield flush()
                    held = 0
        if entries:
            yield flush()

    return runs


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first bytes of some suffixes, for the bounds of the ranges."""
    for batch in batches:
        heads = []
        for text, places in zip(*batch.columns, strict=True):
            raw = _bytes(text.as_py())
            heads += [raw[p["anchor"] :][:HEAD] for p in places.as_py() if p["core"] % 16 == 0]
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary())], names=["head"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without their repeated strings."""
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, found in zip(batch.column(2), batch.column(3), strict=True):
            raw = _bytes(text.as_py())
            mark = np.zeros(len(raw) + 1, np.int32)
            for x in found.as_py():
                mark[x["first"]] += 1
                mark[x["last"] + LENGTH] -= 1
            gone = np.cumsum(mark)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            names=["doc", "text_hash", "n_removed", "n_spans", "kept"],
        )


def repeated_strings(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary; null if nothing or all is removed)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    base = stored(
        rows.select(
            "doc_id", "doc", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        )
    )
    classes = stored(
        base.groupBy("digest").agg(
            F.min("doc").alias("doc"), F.count("*").alias("copies"),
            F.min("text_hash").alias("text_hash"),
        )
    )
    # Anchors whose core occurs twice, in one text or in different ones.
    cores = rows.where(F.octet_length("text") >= LENGTH).select("doc", "text_hash", "text")
    cores = cores.mapInArrow(_cores, _CORES)
    by_text = cores.groupBy("core", "doc", "text_hash").agg(
        F.count("*").alias("n"),
        F.collect_list(F.struct("anchor", "first", "last")).alias("places"),
    )
    by_text = by_text.alias("t").join(
        classes.select("doc", "text_hash").alias("c"),
        (F.col("t.doc") == F.col("c.doc")) & (F.col("t.text_hash") == F.col("c.text_hash")),
        "left_semi",
    )
    by_text = stored(by_text)
    repeated = by_text.groupBy("core").agg(F.sum("n").alias("times")).where("times > 1")
    kept = by_text.join(repeated.select("core"), "core")
    kept = kept.select("doc", "text_hash", "core", F.explode("places").alias("p"))
    kept = kept.groupBy("doc", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("p.anchor", "p.first", "p.last", "core"))).alias("places")
    )
    texts = rows.select("doc", "text_hash", "text")
    chosen = stored(kept.join(texts, ["doc", "text_hash"]))

    size = chosen.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    ranges = max(1, -(-size * (LENGTH + SPAN // 2) // RANGE_BYTES))
    heads = chosen.select("text", "places").mapInArrow(_heads, "head binary")
    heads = heads.orderBy(F.xxhash64("head")).limit(SAMPLE).collect()
    sample = sorted({bytes(r["head"]) for r in heads})
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)} if sample else set())
    sent = chosen.select("doc", "text_hash", "text", "places").mapInArrow(
        _runs(cuts), "range int, blob binary"
    )
    sent = sent.repartition(max(1, ranges), "range").sortWithinPartitions("range")
    found = sent.mapInArrow(_merge_ranges, "doc long, text_hash long, first int, last int")
    found = found.groupBy("doc", "text_hash").agg(
        F.collect_list(F.struct("first", "last")).alias("found")
    )
    cut = chosen.select("doc", "text_hash", "text").join(found, ["doc", "text_hash"])
    cut = cut.select("doc", "text_hash", "text", "found").mapInArrow(
        _cut, "doc long, text_hash long, n_removed long, n_spans long, kept binary"
    )
    cut = cut.dropDuplicates(["doc", "text_hash"])  # of repeated rows
    marked = base.join(classes.select("digest", "copies"), "digest").join(
        cut, ["doc", "text_hash"], "left"
    )
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return marked.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(
            F.when(whole, F.lit(sha256(b"").hexdigest()))
            .when(F.col("n_removed") > 0, F.sha2("kept", 256))
            .otherwise(F.hex("digest"))
        ).alias("kept_sha256"),
        F.when(~whole & (F.col("n_removed") > 0), F.col("kept")).alias("kept"),
    )
