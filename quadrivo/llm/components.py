"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, new_path, written

MAX_STEPS = 64


def _star(edges: DataFrame, large: bool, path: str) -> DataFrame:
    """Links each node's larger (large) or smaller (small) neighbours to the smallest of its neighbourhood, which is kept at path."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # A hub may have a third of all links. Its least neighbour is summed up on the map side and written, so that the join is a plain one, whose large partitions can be split.
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", path)
    joined = both.join(least, "a")
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (a, b: long, not null) the smallest node it is connected with.

    Both steps keep the components and shrink every tree to a star in O(log^2 n) rounds; each round's edges are written to the shared
    folder, so that lost executors cost one round at most. Only a count and a checksum reach the driver.
    """
    spark, was, path = edges.sparkSession, None, None
    edges = edges.select("a", "b").filter("a <> b")
    for _ in range(MAX_STEPS):
        to, *used = (new_path(spark, name) for name in ("edges", "least", "large", "least"))
        large = written(_star(edges, True, used[0]).filter("a <> b"), "large", used[1])
        edges = written(_star(large, False, used[2]).filter("a <> b").distinct(), "edges", to)
        for done in [*used, *([path] if path else [])]:
            drop_path(spark, done)
        path = to
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
