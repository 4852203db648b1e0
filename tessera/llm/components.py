"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import forget, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of every node on the least of them (large: those above the node, small: those below and itself)."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionAll(flipped) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    both = near.join(least, "a")
    out = both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else both.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for each node a that isn't the least of its component, b being the least. edges: columns a and b, longs.

    Each round is a table in the shared folder; the rounds grow with the logarithm of the longest chain. A node with many
    neighbours is combined before its rows are shuffled, and joins with a single row per node, which may be split.
    Nulls and loops link nothing; an empty list has no components.
    """
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    state, before = None, None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == state or not sums[0]:
            if before is not None:
                forget(before)
            return now
        state = sums
        if before is not None:
            forget(before)
        before = now
        now = written(_stars(_stars(now, large=True), large=False))
