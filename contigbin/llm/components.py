"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's (large: greater; small: lesser) neighbours, and itself, at its least neighbour."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        both = both.union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    joined = both.join(least, "node")
    if large:
        moved = joined.filter("other > node").select(F.col("other").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("other").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``edges`` (a, b: long, in either order; loops ignored).

    Each round is written to the shared folder, so lost executors cost one round at most.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen, before = mark, now
        now = materialize(_star(_star(now, True), False), "edges")
        discard(before)
