"""Sharding by best-fit-decreasing bin packing.

Documents of equal text are a group that stays together. Groups, largest first, each enter the
bin with the least remaining room that still holds them; the bins lie in a tree ordered by
their room. The capacity is the smallest at which the wanted number of bins suffices, found by
halving an interval.

Packing one group after the other is a single line of steps, so what enters it is bounded.
With capacity C about total / shards, groups of at least C / ``GRAIN`` bytes enter on their own:
there are at most shards * GRAIN of them. Smaller groups are first packed into bundles of that
size, by the same method, each task packing the groups that hash to it; all bundles of a task but one
are at least half full. So at most 3 * shards * GRAIN items and one per task reach the final
packing, whatever the input. A group larger than C cannot stay whole in shards of equal size: its
64 cells (see below) enter one by one.

The rows of a group are dealt into ``CELLS`` cells by a hash of doc_id, so that numbering the rows
of a group that holds a third of the corpus is spread over tasks as well.

Defined cases: a null text counts as empty; size 1, checksum 0. A row without doc_id is placed
like any other. Equal rows get slots of their own. An empty table gives an empty result. Extra
columns pass through ``shard`` unless they bear the name of a result column.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, restored, stored

SHARDS, GRAIN, CELLS = 16, 256, 64
STEPS = 24


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size. ``sizes`` fall; each fits a bin. The tree of bins is a sorted list,
    searched by halving; there are never more bins than are needed."""
    room: list[tuple[int, int]] = []
    bins = []
    for size in sizes:
        at = bisect_left(room, (size, -1))
        left, chosen = room.pop(at) if at < len(room) else (capacity, len(room))
        insort(room, (left - size, chosen))
        bins.append(chosen)
    return bins


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to ``shards`` - 1 of falling sizes, of the least capacity that was found."""
    if not sizes:
        return []
    low = max(sizes[0], -(-sum(sizes) // shards))
    high = low + sizes[0]
    while max(best_fit(sizes, high), default=0) >= shards:
        low, high = high, 2 * high
    for _ in range(STEPS):
        if low >= high:
            break
        middle = (low + high) // 2
        if max(best_fit(sizes, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return best_fit(sizes, high)


def _bundles(capacity: int):
    def bundled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups of one task, which come largest first, and their bundles."""
        room: list[tuple[int, int]] = []
        count = 0
        for frame in frames:
            bins = []
            for size in frame["bytes"].tolist():
                at = bisect_left(room, (size, -1))
                if at < len(room):
                    left, chosen = room.pop(at)
                else:
                    left, chosen, count = capacity, count, count + 1
                if left - size > 1:  # a bundle that is full takes no more
                    insort(room, (left - size, chosen))
                bins.append(chosen)
            yield frame.assign(bundle=bins)[["text_key", "task", "bundle"]]

    return bundled


def _final(shards: int):
    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        frame["shard"] = pd.Series(pack(frame["bytes"].tolist(), shards), dtype="int32")
        frame["base"] = frame.groupby("shard")["rows"].cumsum() - frame["rows"]
        return frame[["item", "shard", "base"]]

    return packed


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``documents`` with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null).

    Those replace columns of their names; other columns can have any name."""
    named = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    placed = _placed(aside(documents, "doc_id", "text"), shards)
    names = [c for c in documents.columns if c not in named]
    return placed.select(*restored(names, "doc_id", "text"), *named)


def _placed(documents: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        "*",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int").alias("cell"),
    )
    keys = rows.select("doc_id", "size", "text_crc32", "text_key", "cell")
    cells = stored(
        keys.groupBy("text_key", "cell").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows")
        )
    )
    total = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    capacity = max(1, -(-total // shards))
    grain = max(1, capacity // GRAIN)

    earlier = Window.partitionBy("text_key").orderBy("cell")  # at most CELLS rows
    group = Window.partitionBy("text_key")
    laid = cells.select(
        "*",
        (F.sum("rows").over(earlier) - F.col("rows")).alias("first"),
        F.sum("bytes").over(group).alias("group_bytes"),
        F.sum("rows").over(group).alias("group_rows"),
    )
    split = F.col("group_bytes") > capacity
    alone = F.col("group_bytes") >= grain
    whole_name = F.hex("text_key")
    cell_name = F.concat_ws("-", whole_name, F.col("cell").cast("string"))
    laid = laid.withColumn(
        "item", F.when(split, cell_name).when(alone, whole_name)
    ).withColumn("first", F.when(split, 0).otherwise(F.col("first")))
    laid = stored(laid)

    # Small groups: into bundles, task by task. Window sums give each group its place in one.
    small = laid.where(F.col("item").isNull()).groupBy("text_key").agg(
        F.first("group_bytes").alias("bytes"), F.first("group_rows").alias("rows")
    )
    dealt = small.repartition("text_key").sortWithinPartitions(F.desc("bytes"), "text_key")
    dealt = dealt.withColumn("task", F.spark_partition_id())
    bundled = dealt.mapInPandas(
        _bundles(grain), "text_key binary, task int, bundle long"
    )
    bundled = bundled.join(small.select("text_key", "bytes", "rows"), "text_key")
    placed = Window.partitionBy("task", "bundle").orderBy("text_key")
    bundled = stored(
        bundled.select(
            "text_key",
            F.concat_ws("/", F.lit("b"), "task", "bundle").alias("item"),
            "bytes",
            "rows",
            (F.sum("rows").over(placed) - F.col("rows")).alias("within"),
        )
    )

    own = laid.where(F.col("item").isNotNull()).select("item", "bytes", "rows")
    items = own.union(bundled.select("item", "bytes", "rows"))
    items = items.groupBy("item").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    schema = "item string, shard int, base long"
    shelves = items.withColumn("all", F.lit(0)).groupBy("all")
    shelves = stored(shelves.applyInPandas(_final(shards), schema))

    small_cells = laid.where(F.col("item").isNull()).drop("item").join(
        bundled.select("text_key", "item", "within"), "text_key"
    )
    cell_items = (
        laid.where(F.col("item").isNotNull())
        .select("text_key", "cell", "item", "first")
        .union(small_cells.select("text_key", "cell", "item", F.col("first") + F.col("within")))
    )
    starts = cell_items.join(shelves, "item").select(
        "text_key", "cell", "shard", (F.col("base") + F.col("first")).alias("start")
    )
    in_cell = Window.partitionBy("text_key", "cell").orderBy("doc_id")
    numbered = rows.withColumn("place", F.row_number().over(in_cell) - 1)
    result = numbered.join(starts, ["text_key", "cell"])
    return result.select(
        *documents.columns,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
