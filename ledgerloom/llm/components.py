"""Connected components of an edge table by alternating large-star and small-star steps; every group is only aggregated, never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.session import plan_bytes


PARTITION_BYTES = 4 << 20


def _sized(edges: DataFrame) -> int:
    """Partitions for what comes of a written edge table, by its size on disk."""
    return max(1, -(-(plan_bytes(edges) or PARTITION_BYTES * 200) // PARTITION_BYTES))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a long, b long) -> node, component: the smallest node reachable, for each node that has an edge to another.

    Self-loops, repeated edges and either direction are fine; edges with a null end are ignored; no edges give no rows.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    # done when the edges are stars: no smaller end has an edge to a node below it
    while not now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() or not now.groupBy("a").count().filter("count > 1").coalesce(_sized(now)).isEmpty():
        # large star: every larger neighbour points to the smallest of the neighbourhood
        n = _sized(now)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(n)
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: all smaller neighbours, and the node itself, point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(n)
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        now = written(small.coalesce(n), name)
    found = now.groupBy("a").agg(F.min("b").alias("b"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).union(found.select("b", "b")).distinct()
