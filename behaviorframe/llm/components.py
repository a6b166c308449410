"""Connected components of a large edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorframe.llm._common import drop, free, keep


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, label): of every node in an edge the smallest node it can reach.

    Each round is two joins on pre-aggregated minima, so a hub is split by the
    join, not gathered; the number of rounds is about the logarithm of the longest
    chain. Nothing but a count and a checksum reaches the driver.
    """
    held = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _sum(held)
    free(edges.sparkSession)
    while True:
        both = held.union(held.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = keep(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        new = keep(small, "small")
        now = _sum(new)
        drop(large)
        drop(held)
        held = new
        if now == state:
            break
        state = now
    roots = held.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return held.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
