"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class. A pass draws 62 random directions and sorts the classes by the signs
of their products with these, first direction first: vectors at a small angle agree in most signs, so
they come close together in some pass. Each vector is compared with the ``WINDOW`` that follow
it, and on as long as the last ``WINDOW`` held a link. So a run of near copies is compared whole,
however long it is. Pairs with a cosine of at least 0.95 in double precision are links; those of
all passes are united.

Two vectors at exactly the threshold agree in a sign with probability 0.9. Among N of them they
lie within a window if about log2(N / WINDOW) leading signs agree. The number of passes follows
from that and from N, so that such a pair is missed with probability ``MISSED``; pairs at smaller
angles far less often. What is found depends on these random draws, what is linked does not.

Spark sorts: rows of all passes are range-partitioned and sorted by (length, pass, key) and ranked by
the counts of the partitions, which are one small row each. Vectors stay behind and join their ranks
on the way to the blocks, so that they are moved once. Ranks are cut into blocks of
``BLOCK`` rows; a block also gets the next ``REACH``. A vector that has links up to the end of
that goes on to the next block in a further round. A block gives one row per linked vector: its links
there as one array, and the smallest vector that it reaches within the block. No pair is a row of
its own, so a group of copies gives as many rows as it has members. A link to a class of several
equal vectors counts as often: the block gives a row for each bit that is set in the sizes of
the classes linked, with those that have it. So a vector's links are distinct longs per bit, which
Spark counts by hashing; distinct structs would be compared with each other, all with all.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths do not link. A row without vec_id links with nothing and stays.
Rows of one vec_id count as one vector; if they differ, each of them may link. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components

THRESHOLD = 0.95
SIGNS = 62
WINDOW, REACH, BLOCK = 64, 1024, 4096
MISSED = 1e-4

_VALID = "vec_id long, digest binary, length int, vector binary"
_KEYED = "length int, pass int, key long, rep long, class long"


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link, as doubles of length one."""
    for batch in batches:
        rows = []
        for vec_id, vector in zip(batch.column(0), batch.column(1), strict=True):
            if not vec_id.is_valid or not vector.is_valid or vector.values.null_count:
                continue
            values = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
            if not len(values) or not np.isfinite(values).all() or not values.any():
                continue
            scaled = values / np.abs(values).max()  # so that no square is too large or small
            unit = scaled / np.linalg.norm(scaled)
            digest = blake2b(unit.tobytes(), digest_size=16).digest()
            rows.append((vec_id.as_py(), digest, len(values), unit.tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
            names=["vec_id", "digest", "length", "vector"],
        )


def passes_for(n: int) -> int:
    """How many passes find a pair at the threshold among ``n`` vectors but for MISSED."""
    agree = 1 - math.acos(THRESHOLD) / math.pi
    found = agree ** max(1.0, math.log2(max(n, 1) / WINDOW))
    return max(2, math.ceil(math.log(MISSED) / math.log1p(-found)))


def _keyed(passes: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            lengths = batch.column(0).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                vectors = np.array([np.frombuffer(v.as_py()) for v in part.column(3)])
                for number in range(passes):
                    draw = np.random.Generator(np.random.Philox(key=[number, int(length)]))
                    signs = vectors @ draw.standard_normal((int(length), SIGNS)) > 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            pa.array(np.full(len(vectors), number, np.int32)),
                            pa.array(signs.astype(np.int64) @ places),
                            part.column(1),
                            part.column(2),
                        ],
                        names=["length", "pass", "key", "rep", "class"],
                    )

    return keyed


def _compared(block: list[tuple], total: int) -> Iterator[pa.RecordBatch]:
    """Rows rep, root, bit, links of one block, and the queries that are to go on, from ``open``.

    A row of ``block`` is (role, rank, from, length, pass, key, rep, size, vector); role 0 is only
    compared against, 1 is a member, 2 came from an earlier block and starts at ``from``. There
    are ``total`` ranks.
    """
    targets = sorted((r for r in block if r[0] < 2), key=lambda r: r[1])
    ranks = np.array([r[1] for r in targets], np.int64)
    passes = np.array([(r[3], r[4]) for r in targets], np.int64).reshape(-1, 2)
    group = np.cumsum((passes != np.roll(passes, 1, axis=0)).any(axis=1))
    queries = [r for r in block if r[0] > 0]
    queries.sort(key=lambda r: (r[3], r[4], r[2]))
    first = np.searchsorted(ranks, [q[2] for q in queries])
    same = {tuple(p): g for p, g in zip(passes.tolist(), group.tolist(), strict=True)}
    own = np.array([same.get((q[3], q[4]), -1) for q in queries], np.int64)
    ends = {g: int(e) + 1 for e, g in enumerate(group)}
    lengths = np.array([r[3] for r in targets], np.int64)
    matrices = {}  # of the targets of one length, and where the first of them is
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)  # lengths are sorted first, so these are a run
        matrices[length] = (np.array([np.frombuffer(targets[i][8]) for i in at]), at[0])
    froms, tos, unfinished = [], [], {}
    for at in range(0, len(queries), WINDOW):
        for kind in np.unique(own[at : at + WINDOW]):
            tile = at + np.flatnonzero(own[at : at + WINDOW] == kind)
            if kind < 0:
                continue
            begin, end = int(first[tile].min()), ends[int(kind)]
            left = np.array([np.frombuffer(queries[i][8]) for i in tile])
            active = np.arange(len(tile))
            matrix, origin = matrices[queries[tile[0]][3]]
            while len(active) and begin < end:
                upto = min(begin + WINDOW, end)
                right = matrix[begin - origin : upto - origin]
                linked = left[active] @ right.T >= THRESHOLD
                linked &= np.arange(begin, upto) >= first[tile[active]][:, None]
                x, y = np.nonzero(linked)
                froms.append(tile[active[x]])
                tos.append(begin + y)
                on = linked.any(axis=1) | (upto - first[tile[active]] < WINDOW)
                active, begin = active[on], upto
            if len(active) and end == len(targets) and ranks[-1] + 1 < total:
                for i in tile[active]:
                    unfinished[int(i)] = int(ranks[-1]) + 1
    if froms:
        froms, tos = np.concatenate(froms), np.concatenate(tos)
    else:
        froms, tos = np.empty(0, np.int64), np.empty(0, np.int64)
    reps = np.array([t[6] for t in targets] + [q[6] for q in queries], np.int64)
    sizes = np.array([t[7] for t in targets] + [q[7] for q in queries], np.int64)
    names, node = np.unique(reps, return_inverse=True)
    size = np.zeros(len(names), np.int64)
    size[node] = sizes
    a, b = node[len(targets) + froms], node[tos]
    label = np.arange(len(names))
    while True:  # the smallest node that each reaches in this block
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
    roots = label[pairs[:, 0]]
    for bit in range(int(size[pairs[:, 1]].max(initial=1)).bit_length()):
        having = (size[pairs[:, 1]] >> bit) & 1 == 1
        if not having.any():
            continue
        a, b = pairs[having].T
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        found = [
            pa.array(names[a[starts]]),
            pa.array(names[roots[having][starts]]),
            pa.array(np.full(len(starts), bit, np.int32)),
            pa.ListArray.from_arrays(
                pa.array(np.append(starts, len(a)).astype(np.int32)), pa.array(names[b])
            ),
        ]
        rest = [pa.nulls(len(starts), f.type) for f in _LINKED_ARROW][len(found) :]
        yield pa.RecordBatch.from_arrays([*found, *rest], names=_LINKED_ARROW.names)
    again = [(queries[i], rank) for i, rank in unfinished.items()]
    if again:
        columns = zip(
            *[(q[6], q[6], 0, [], rank, q[1], q[3], q[4], q[5], q[7], q[8]) for q, rank in again],
            strict=True,
        )
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _LINKED_ARROW, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=_LINKED_ARROW.names)


_LINKED = (
    "rep long, root long, bit int, links array<long>, open long, rank long, "
    "length int, pass int, key long, size long, vector binary"
)
_LINKED_ARROW = pa.schema(
    [
        ("rep", pa.int64()),
        ("root", pa.int64()),
        ("bit", pa.int32()),
        ("links", pa.list_(pa.int64())),
        ("open", pa.int64()),
        ("rank", pa.int64()),
        ("length", pa.int32()),
        ("pass", pa.int32()),
        ("key", pa.int64()),
        ("size", pa.int64()),
        ("vector", pa.binary()),
    ]
)


def _blocks(total: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; one block at a time is in memory."""
        current, block = None, []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != current:
                    if block:
                        yield from _compared(block, total)
                    current, block = row[0], []
                block.append(row[1:])
        if block:
            yield from _compared(block, total)

    return blocks


def _sorted_ranks(keyed: DataFrame) -> DataFrame:
    """The rows with their rank in the order of length, pass and key."""
    order = ["length", "pass", "key", "rep", "class"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit(2**33 - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = placed.withColumn("part", part).join(firsts, "part")  # a row per partition
    return ranked.select((F.col("first") + within).alias("rank"), *keyed.columns)


def _linked(ranked: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rep, root, bit and links, a row for each block in which a class has links, and bit."""
    rest = ["rank", "from", "length", "pass", "key", "rep", "size", "vector"]
    block = F.floor(F.col("rank") / BLOCK)
    own = F.struct(block.alias("block"), F.lit(1).alias("role"))
    before = F.struct((block - 1).alias("block"), F.lit(0).alias("role"))
    ahead = (F.col("rank") % BLOCK < REACH) & (F.col("rank") >= BLOCK)
    placed = ranked.select("*", F.explode(F.when(ahead, F.array(own, before)).otherwise(F.array(own))))
    placed = placed.select("col.*", (F.col("rank") + 1).alias("from"), *ranked.columns)
    vectors = classes.select("class", "size", "vector")
    found = asked = None
    while True:
        if found is None:
            rows = placed.join(vectors, "class").select("block", "role", *rest)
        else:
            wanted = asked.select("block").distinct()
            again = placed.withColumn("role", F.lit(0)).join(wanted, "block")
            rows = again.join(vectors, "class").select("block", "role", *rest).union(asked)
        rows = rows.repartition("block").sortWithinPartitions("block")
        result = stored(rows.mapInArrow(_blocks(total), _LINKED))
        links = result.where("open IS NULL").select("rep", "root", "bit", "links")
        found = links if found is None else found.union(links)
        asked = result.where("open IS NOT NULL").select(
            F.floor(F.col("open") / BLOCK).alias("block"), F.lit(2).alias("role"), "rank",
            F.col("open").alias("from"), *rest[2:],
        )
        if asked.isEmpty():
            return found


def _others(linked: DataFrame) -> DataFrame:
    """rep and others: how many vectors its class links with, each once whatever block found it."""
    counted = linked.groupBy("rep", "bit").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("links")))).alias("n")
    )
    return counted.groupBy("rep").agg(F.expr("sum(shiftleft(1L, bit) * n)").alias("others"))


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings``."""
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding")
    valid = stored(rows.mapInArrow(_valid, _VALID))
    grouped = stored(
        valid.groupBy("digest").agg(
            F.min("vec_id").alias("rep"),
            F.count_distinct("vec_id").alias("size"),
            F.min("length").alias("length"),
            F.min("vector").alias("vector"),
        )
    )
    # Stored rows keep their numbers.
    classes = grouped.withColumn("class", F.monotonically_increasing_id())
    members = valid.select("vec_id", "digest").distinct()
    members = members.join(classes.select("digest", "rep", "size"), "digest")
    members = stored(members.select("vec_id", "rep", "size"))
    keyed = classes.select("length", "rep", "class", "vector")
    n = classes.count()
    passes = passes_for(n)
    keyed = keyed.mapInArrow(_keyed(passes), _KEYED)
    linked = stored(_linked(_sorted_ranks(keyed), classes, n * passes))

    near = _others(linked)
    counted = members.join(near, "rep", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    roots = linked.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()
    copies = members.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    whole = components(roots.union(copies))
    marked = rows.select("vec_id").join(counted, "vec_id", "left")
    marked = marked.join(whole, marked.vec_id == whole.id, "left")
    reached = F.coalesce("component", "vec_id")
    return marked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        reached.alias("component_id"),
        F.coalesce(F.col("vec_id") == reached, F.lit(True)).alias("kept"),
    )
