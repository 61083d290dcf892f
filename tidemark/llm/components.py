"""Connected components by alternating stars, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, few, stored


def _beside(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """The edges with the one row of their ``a`` in ``least``; at most ``rows`` rows each."""
    small = rows <= MOST_BROADCAST
    return few(edges.join(F.broadcast(least) if small else least, "a"), rows)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node passes its larger neighbours on to its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), 2 * rows)
    passed = _beside(both, least, 2 * rows).where(F.col("b") > F.col("a"))
    return few(passed.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node hangs itself and its smaller neighbours below the smallest of them."""
    least = few(edges.groupBy("a").agg(F.min("b").alias("m")), rows)
    passed = _beside(edges, least, rows).select(F.col("b").alias("a"), F.col("m").alias("b"))
    passed = passed.where(F.col("a") != F.col("b"))
    return few(passed.union(least.select("a", F.col("m").alias("b"))).distinct(), rows)


def _state(edges: DataFrame, rows: int) -> tuple[int, bool]:
    """The number of edges (at most ``rows``), and whether each node hangs directly below the least of its component:
    nodes with one edge down have none up, and the others have no edge down."""
    down = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = down.union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    tangled = (F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1))
    counted, found = few(nodes, 2 * rows).agg(F.sum("down"), F.max(tangled)).first()
    return counted or 0, not found


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id that it reaches) of every id that has a link.

    ``links`` holds undirected pairs ``a``, ``b`` of longs. Every step is a minimum per key,
    combined before its shuffle, and a join that adaptive execution can split; a node with
    many neighbours is no group in one task. The number of rounds is logarithmic in practice;
    each is written to the checkpoint folder. The driver gets one row per round.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(links.where(F.col("a") != F.col("b")).select(larger, smaller))
    rows = edges.count()
    edges = few(edges, rows)
    _, settled = _state(edges, rows)
    while not settled:
        # A step never has more edges than two for each edge before it. The large star is read twice,
        # and stored, or Spark would plan and run it twice.
        edges = stored(_small_star(stored(_large_star(edges, rows)), 2 * rows))
        rows, settled = _state(edges, 2 * rows)
    hung = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return few(hung.union(edges.select(F.col("b").alias("id"), "b").distinct()), 2 * rows)
