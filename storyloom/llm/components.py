"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, component): each linked node's smallest reachable node; the smallest is left out.

    Every step is a minimum per node (partial sums, so hubs don't gather in a task) and an equi-join; a step's edges are
    written to the shared folder. Ends when the edges form stars: O(log n) rounds in practice.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = materialize(now, "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(found) == mark or not found[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(found)
