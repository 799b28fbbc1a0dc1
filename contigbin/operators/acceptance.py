"""Reports on a dataset without truth, and on bins (OPS-7, OPS-8, OPS-9, AGG-26, AGG-31, JN-16, PRJ-10, PRJ-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, labelling
from .ranks import attach

# Shares of contigs with a partner from which a dataset is strong or usable, and a rank correlation that says little
STRONG, USABLE, ALIKE = 0.10, 0.04, 0.95


def beside(row: DataFrame, *others: DataFrame) -> DataFrame:
    """``row`` with the columns of others of one row each (nulls where one has none)."""
    for one in others:
        found = one.first()
        row = row.withColumns({f.name: F.lit(found[f.name] if found else None).cast(f.dataType) for f in one.schema.fields})
    return row


def sharing(members: DataFrame) -> DataFrame:
    """contig: those that share a cluster with another contig (JN-16). ``members``: contig, cluster."""
    each = members.filter("cluster IS NOT NULL").select("contig", "cluster").distinct()
    common = each.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    return each.join(common, "cluster", "left_semi").select("contig").distinct()


def joinable(contigs: DataFrame, partners: DataFrame, by: str) -> DataFrame:
    """by, contigs, joinable, fraction: contigs that have a partner (AGG-31). ``contigs``: contig, by; ``partners``: contig, each once."""
    marked = contigs.join(partners.select("contig", F.lit(1).alias("_j")), "contig", "left")
    return marked.groupBy(by).agg(F.count("*").alias("contigs"), F.count("_j").alias("joinable"), (F.count("_j") / F.count("*")).alias("fraction"))


def capped(bins: DataFrame, limit: int) -> DataFrame:
    """contig, bin of bins of at most ``limit`` contigs (PRJ-11)."""
    few = bins.groupBy("bin").agg(F.count("*").alias("_n"))
    return attach(bins, few, "bin").filter(F.col("_n") <= limit).select("contig", "bin")


def withheld(edges: DataFrame, locked: DataFrame) -> tuple[DataFrame, int]:
    """The edges (src, dst) that touch no locked node (id), and how many do (PRJ-10)."""
    free = edges
    for end in ("src", "dst"):
        free = free.join(locked.select(F.col("id").alias(end)).distinct(), end, "left_anti")
    free = free.select(edges.columns)
    return free, edges.count() - free.count()


def assigned_share(contigs: DataFrame, bins: DataFrame) -> DataFrame:
    """One row: contigs and bases, how many of either are in a bin, and their shares (AGG-26). ``contigs``: contig, length; ``bins``: contig, bin (null: none)."""
    known = bins.filter("bin IS NOT NULL").select("contig", F.lit(1).alias("_b")).distinct()
    marked = contigs.join(known, "contig", "left")
    sums = marked.agg(F.count("*").alias("contigs"), F.count("_b").alias("assigned_contigs"), F.coalesce(F.sum("length"), F.lit(0)).alias("bases"), F.coalesce(F.sum(F.when(F.col("_b") == 1, F.col("length"))), F.lit(0)).alias("assigned_bases"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return sums.withColumns({"contig_share": share("assigned_contigs", "contigs"), "base_share": share("assigned_bases", "bases")})


def report(lengths: DataFrame, coverage: DataFrame, edges: DataFrame, members: DataFrame | None = None, cohort: int = 2_000) -> DataFrame:
    """One row of what a dataset without truth has to go by (OPS-7).

    ``lengths``: contig, length; ``coverage``: contig, sample, depth; ``edges``: src, dst (contigs); ``members``: contig, cluster of proteins.
    A contig is joinable if an edge or a shared cluster gives it a partner; the verdict is on those of ``cohort`` bases or more.
    """
    sized = lengths.select("contig", F.col("length").cast("long").alias("length"), (F.col("length") >= cohort).alias("in_cohort"), F.lit("all").alias("every"))
    large = sized.filter("in_cohort").select("contig", "every")
    between = lambda low, high: F.count_if((F.col("length") >= low) & (F.col("length") < high))
    of_length = sized.agg(
        F.count("*").alias("contigs"), F.count_if("in_cohort").alias("cohort"), F.sum("length").alias("bases"), F.min("length").alias("shortest"), F.percentile("length", F.lit(0.5)).alias("median_length"), F.max("length").alias("longest"),
        between(0, 5_000).alias("short"), between(5_000, 10_000).alias("medium"), F.count_if(F.col("length") >= 10_000).alias("long"),
    )
    half = labelling.n50(sized, "every").select("n50")
    flat = labelling.dead_samples(coverage).agg(F.count("*").alias("dead_samples"))
    own = coverage.join(large.select("contig"), "contig", "left_semi")
    ranks = labelling.rank_correlation_summary(own, "contig", "sample", "depth").select(F.col("median").alias("rank_correlation"), (F.col("median") > ALIKE).alias("samples_alike"))
    clean = edges.filter("src <> dst")
    links = graph.degree_stats(lengths.select(F.col("contig").alias("id")), clean).select(F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("touched", F.lit(0)).alias("linked_contigs"))
    sizes = graph.connected_components(lengths.select(F.col("contig").alias("id")), clean).groupBy("component").count().filter("count > 1").agg(F.count("*").alias("components"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_component"))
    partners = clean.select(F.explode(F.array("src", "dst")).alias("contig"))
    if members is not None:
        partners = partners.union(sharing(members))
    found = joinable(large, partners.distinct(), "every").agg(F.coalesce(F.max("joinable"), F.lit(0)).alias("joinable"), F.coalesce(F.max("fraction"), F.lit(0.0)).alias("joinable_fraction"))
    out = beside(of_length, half, flat, ranks, links, sizes, found)
    share = F.col("joinable_fraction")
    return out.withColumn("verdict", F.when(share >= STRONG, "strong").when(share >= USABLE, "usable").otherwise("weak"))
