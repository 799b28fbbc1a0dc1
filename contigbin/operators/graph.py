"""Assembly and evidence graphs (JN-6..8, AGG-13..17, AGG-35, WIN-2, WIN-8, SET-*, ML-7, ML-8, ML-17)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Tables
from . import streamed
from .neighbours import canonical_edges


def walk_positions(steps: DataFrame) -> DataFrame:
    """contig, segment, orientation, pos, path_length, rel: place of each step in its walk (WIN-8). ``steps``: contig, step, segment, orientation."""
    by = Window.partitionBy("contig")
    pos = F.row_number().over(by.orderBy("step")) - 1
    placed = steps.withColumns({"pos": pos.cast("long"), "path_length": F.count("*").over(by)})
    return placed.withColumn("rel", F.col("pos") / F.greatest(F.col("path_length") - 1, F.lit(1)))


def consecutive(steps: DataFrame) -> DataFrame:
    """contig, a, b: neighbouring segments of each walk."""
    after = F.lead("segment").over(Window.partitionBy("contig").orderBy("step"))
    return steps.select("contig", F.col("segment").alias("a"), after.alias("b")).filter("b IS NOT NULL")


def project_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst, n_links (and max_overlap) of contigs whose segments a link joins (JN-6, AGG-13).

    ``links``: a, b (and overlap); ``members``: segment, contig. A segment on very many contigs is split by AQE's skew join.
    """
    left = members.select(F.col("segment").alias("a"), F.col("contig").alias("x"))
    right = members.select(F.col("segment").alias("b"), F.col("contig").alias("y"))
    pairs = links.join(left, "a").join(right, "b").filter("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.count("*").alias("n_links"), *([F.max("overlap").alias("max_overlap")] if "overlap" in links.columns else []))


def shared_segments(members: DataFrame) -> DataFrame:
    """src, dst, shared: pairs of contigs on a common segment (JN-8)."""
    a, b = (members.select("segment", F.col("contig").alias(c)) for c in ("src", "dst"))
    return a.join(b, "segment").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def without_shared(projected: DataFrame, shared: DataFrame) -> DataFrame:
    """Projected links of pairs that share no segment (JN-7)."""
    return projected.join(shared.select("src", "dst"), ["src", "dst"], "left_anti")


def with_shared(projected: DataFrame, shared: DataFrame) -> DataFrame:
    """Projected links and pairs that share a segment, with all counts; 0 where there is none (JN-7, AGG-13)."""
    return projected.join(shared, ["src", "dst"], "full").na.fill(0)


def linked(edges: DataFrame) -> DataFrame:
    """src < dst, each once, of a stored graph's edges that have a link or a shared segment (SRC-25, PRJ-7).

    Read are gfa_link_count and shared_segment_count; without them the lowest two bits of edge_type; without both every edge stays.
    """
    have = set(edges.columns)
    if {"gfa_link_count", "shared_segment_count"} <= have:
        edges = edges.filter("gfa_link_count > 0 OR shared_segment_count > 0")
    elif "edge_type" in have:
        edges = edges.filter("edge_type & 3 <> 0")
    return canonical_edges(edges)


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: touched nodes, greatest degree, edges, mean degree over all ``nodes`` (id) (AGG-15)."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    sums = degree.agg(F.count("*").alias("touched"), F.max("d").alias("greatest"), F.sum("d").alias("s"))
    return sums.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n")))).select("touched", "greatest", F.expr("s div 2").alias("edges"), F.round(F.col("s") / F.col("n"), 6).alias("mean_degree"))


def segment_ids(segments: DataFrame, links: DataFrame, steps: DataFrame) -> DataFrame:
    """segment: every id that a segment record, a link's end or a walk names (SET-7)."""
    return segments.select("segment").union(links.select("a")).union(links.select("b")).union(steps.select("segment")).distinct()


def both_strands(links: DataFrame) -> DataFrame:
    """Each oriented link (a, ao, b, bo) and its reverse complement, marked (ML-17)."""
    turn = lambda c: F.translate(c, "+-", "-+")
    back = links.select(F.col("b").alias("a"), turn(F.col("bo")).alias("ao"), F.col("a").alias("b"), turn(F.col("ao")).alias("bo"), F.lit(1).alias("reversed"))
    return links.select("a", "ao", "b", "bo", F.lit(0).alias("reversed")).union(back)


def cap_degree(edges: DataFrame, ceiling: int) -> DataFrame:
    """Edges among the ``ceiling`` strongest of both their ends; ties by src, dst (WIN-2)."""
    ends = edges.select("src", "dst", "score", F.explode(F.array("src", "dst")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("score"), "src", "dst"))
    kept = ends.withColumn("rank", rank).filter(F.col("rank") <= ceiling).groupBy("src", "dst").agg(F.count("*").alias("n"), F.first("score").alias("score"))
    return kept.filter("n = 2").select("src", "dst", "score")


def degree_ceiling(n: int) -> int:
    return max(8, min(20, math.ceil(math.log2(max(n, 2)))))


def limit_degree(views: DataFrame, pairs: DataFrame, exact_limit: int) -> DataFrame:
    """src, dst of ``pairs`` (src < dst, each once), capped by ``degree_ceiling`` where there are over ``exact_limit`` nodes and more pairs than the ceiling lets all nodes have (ML-5).

    ``views``: id, a, b (unit rows). A pair's strength is its cosine in a, and that in b if both rows have one; ``pairs`` may have both already (a, b).
    """
    n = views.count()
    ceiling = degree_ceiling(n)
    if n <= exact_limit or pairs.count() <= n * ceiling // 2:
        return pairs.select("src", "dst")
    if not {"a", "b"} <= set(pairs.columns):
        tables, own = Tables(views.sparkSession, "scores"), Tables(views.sparkSession, "views")
        held = {k: streamed.files(streamed.kept(views.select("id", F.col(k).alias("u")), own)) for k in ("a", "b")}
        pairs = streamed.pair_dots(pairs.select("src", "dst"), held, tables)
        own.drop()
    score = F.col("a") + F.col("b")  # a row of zeros adds 0
    return cap_degree(pairs.select("src", "dst", score.alias("score")), ceiling).select("src", "dst")


def merge_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of both edge sets, their union, what b adds, and the Jaccard index (AGG-16, AGG-17)."""
    marked = a.select("src", "dst", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select("src", "dst", F.lit(0), F.lit(1))).groupBy("src", "dst").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = marked.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count("*").alias("n_union"), F.sum(F.col("b") * (1 - F.col("a"))).alias("n_added"), F.sum(F.col("a") * F.col("b")).alias("n_both"))
    return sums.withColumn("jaccard", F.when(F.col("n_union") > 0, F.col("n_both") / F.col("n_union")).otherwise(1.0))


def normalized_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, weight in both directions with self loops: 1 / sqrt(max(d_i * d_j, 1)), degrees with the loop (ML-7). ``nodes``: id."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).union(nodes.select("id", "id"))
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    out = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return out.select("src", "dst", (1.0 / F.sqrt(F.greatest(F.col("d") * F.col("e"), F.lit(1)))).alias("weight"))


def message_step(adjacency: DataFrame, values: DataFrame) -> DataFrame:
    """id, dim, value of A x for a long table of x (id, dim, value) (ML-8)."""
    return adjacency.join(values.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "dim").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def message_rows(adjacency: DataFrame, rows: DataFrame) -> DataFrame:
    """``message_step`` for rows of vectors (id, u): a link moves its vector once, which is taken apart where it arrives."""
    sent = adjacency.join(rows.select(F.col("id").alias("dst"), "u"), "dst").select(F.col("src").alias("id"), "weight", "u").repartition("id")
    values = sent.select("id", "weight", F.posexplode("u").alias("dim", "value"))
    return values.groupBy("id", F.col("dim").cast("long").alias("dim")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def connected_components(nodes: DataFrame, edges: DataFrame, of: Tables | None = None) -> DataFrame:
    """id, component (least id) of every node; large and small stars, each round written to a table of its own (AGG-35). ``of``: the tables that the last one goes with."""
    tables = Tables(nodes.sparkSession, "stars")
    now = tables.keep(canonical_edges(edges).select(F.col("dst").alias("a"), F.col("src").alias("b")))
    mark = None
    while (new := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != mark and new[0]:
        mark = new
        for large in (True, False):
            out = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
            if large:
                out = out.union(now.select("b", "a"))
            least = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            joined = out.join(least, "u")
            now = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
            now = now.filter("a <> b").distinct()
        now = tables.keep(now)
        tables.drop(1)
    if of is not None:
        of.paths += tables.paths
    return nodes.select("id").join(now.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))
