"""Bidirected assembly graph as typed tables (ML-17): oriented states, links on both strands, traversals, strand-aware components.

A segment has two states, as read and reversed. A link joins a state to a state and, reversed,
their opposites; a walk visits states. A component of states holds either one state of each of its segments, so that
its mirror image is another component and orientations agree all through it, or both states of each: then some cycle turns the strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def opposite(orientation: Column) -> Column:
    return F.translate(orientation, "+-", "-+")


def states(segments: DataFrame) -> DataFrame:
    """segment, orientation and all other columns of ``segments``: two rows each."""
    return segments.withColumn("orientation", F.explode(F.array(F.lit("+"), F.lit("-"))))


def links(raw: DataFrame, segments: DataFrame) -> DataFrame:
    """a, ao, b, bo, overlap, n, reversed: each distinct oriented link and its reverse complement (ML-17). ``raw``: a, ao, b, bo, overlap.

    Of equal links the greatest overlap counts and n says how many there were; a link that is its own reverse complement stands once for each
    side. Raises if an end is no segment.
    """
    ends = raw.select(F.explode(F.array("a", "b")).alias("segment"))
    unknown = ends.join(segments.select("segment"), "segment", "left_anti").select("segment").limit(3).collect()
    if unknown:
        raise ValueError(f"links name unknown segments: {[r[0] for r in unknown]}")
    each = raw.groupBy("a", "ao", "b", "bo").agg(F.max("overlap").alias("overlap"), F.count("*").alias("n"))
    both = graph.both_strands(each)
    forward = F.col("reversed") == 0
    one, other = (each.select(F.col("a").alias("x"), F.col("ao").alias("xo"), F.col("b").alias("y"), F.col("bo").alias("yo"), "overlap", "n") for _ in range(2))
    own = both.filter(forward).join(one, (F.col("a") == F.col("x")) & (F.col("ao") == F.col("xo")) & (F.col("b") == F.col("y")) & (F.col("bo") == F.col("yo")))
    turned = both.filter(~forward).join(other, (F.col("b") == F.col("x")) & (opposite(F.col("bo")) == F.col("xo")) & (F.col("a") == F.col("y")) & (opposite(F.col("ao")) == F.col("yo")))
    columns = ["a", "ao", "b", "bo", "overlap", "n", "reversed"]
    return own.select(columns).union(turned.select(columns))


def traversals(steps: DataFrame) -> DataFrame:
    """contig, pos, path_length, rel, segment, orientation, next_segment, next_orientation: the states that walks visit, in order. ``steps``: contig, step, segment, orientation."""
    placed = graph.walk_positions(steps)
    after = F.lead(F.struct("segment", "orientation")).over(Window.partitionBy("contig").orderBy("pos"))
    return placed.withColumn("next", after).select("contig", "pos", "path_length", "rel", "segment", "orientation", F.col("next.segment").alias("next_segment"), F.col("next.orientation").alias("next_orientation"))


def components(segments: DataFrame, raw: DataFrame) -> DataFrame:
    """segment, component (least segment), strand (of the segment where the component's least segment is read forward), twisted (a cycle turns the strand; strand is then null).

    ``segments``: segment (whole numbers); ``raw``: a, ao, b, bo.
    """
    state = lambda segment, orientation: segment * 2 + (orientation == "-").cast("long")
    nodes = states(segments.select(F.col("segment").cast("long").alias("segment"))).select(state(F.col("segment"), F.col("orientation")).alias("id"))
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    pairs = F.array(F.struct(state(a, F.col("ao")).alias("src"), state(b, F.col("bo")).alias("dst")), F.struct(state(a, opposite(F.col("ao"))).alias("src"), state(b, opposite(F.col("bo"))).alias("dst")))
    found = graph.connected_components(nodes, raw.select(F.inline(pairs)))
    label = lambda o: F.max(F.when(F.col("id") % 2 == o, F.col("component")))
    each = found.groupBy(F.floor(F.col("id") / 2).alias("segment")).agg(label(0).alias("ahead"), label(1).alias("back"))
    twisted = F.col("ahead") == F.col("back")
    least = F.least("ahead", "back")
    strand = F.when(~twisted, F.when(F.col("ahead") == least, "+").otherwise("-"))
    return each.select("segment", F.floor(least / 2).alias("component"), strand.alias("strand"), twisted.alias("twisted"))
