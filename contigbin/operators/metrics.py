"""Scores of a partition against truth (AGG-18..28, JN-15). All work on counts by (bin, truth)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(labels: DataFrame) -> DataFrame:
    """bin, truth, n (AGG-20)."""
    return labels.groupBy("bin", "truth").agg(F.count("*").alias("n"))


def _dominant(cells: DataFrame, by: str):
    return cells.groupBy(by).agg(F.max("n").alias("n")).agg(F.sum("n").alias("hits"))


def _prf(hits_bin, hits_truth, assigned, total):
    p = F.when(assigned > 0, hits_bin / assigned).otherwise(F.lit(0.0))
    r = F.when(total > 0, hits_truth / total).otherwise(F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def precision_recall(labels: DataFrame, cohort: bool = False) -> DataFrame:
    """precision, recall, f1 of rows (bin, truth); bin is null where unassigned.

    Both divide by the rows with truth and a bin, or (``cohort``) recall by all rows
    with truth. Without such rows the core form gives NaN, the cohort form 0 (AGG-21, AGG-22).
    """
    known = labels.filter("truth IS NOT NULL")
    cells = contingency(known.filter("bin IS NOT NULL"))
    sums = _dominant(cells, "bin").withColumnRenamed("hits", "hb").join(_dominant(cells, "truth").withColumnRenamed("hits", "ht"))
    sums = sums.join(known.agg(F.count("*").alias("total"), F.count("bin").alias("assigned")))
    p, r, f = _prf(F.coalesce("hb", F.lit(0)), F.coalesce("ht", F.lit(0)), F.col("assigned"), F.col("total") if cohort else F.col("assigned"))
    if not cohort:
        nan = F.lit(float("nan"))
        p, r, f = (F.when(F.col("assigned") > 0, x).otherwise(nan) for x in (p, r, f))
    return sums.select(p.alias("precision"), r.alias("recall"), f.alias("f1"), "assigned", "total")


def singletons_for_missing(labels: DataFrame) -> DataFrame:
    """bin of its own for every row without one (JN-15)."""
    return labels.withColumn("bin", F.coalesce(F.col("bin").cast("string"), F.concat(F.lit("__unassigned__"), F.col("contig").cast("string"))))


def ari_nmi(labels: DataFrame) -> DataFrame:
    """ari, nmi of rows (bin, truth) (AGG-23, AGG-24)."""
    cells = contingency(labels)
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    rows, columns = (cells.groupBy(k).agg(F.sum("n").alias(c)) for k, c in (("bin", "nb"), ("truth", "nt")))
    n = cells.agg(F.sum("n").cast("double").alias("n_all"))
    full = cells.join(rows, "bin").join(columns, "truth").join(F.broadcast(n))
    mutual = full.agg(pairs(F.col("n")).alias("cell"), F.sum(F.col("n") / F.col("n_all") * F.ln(F.col("n") * F.col("n_all") / (F.col("nb") * F.col("nt")))).alias("mutual"), F.max("n_all").alias("total"))
    entropy = lambda df, c: df.join(F.broadcast(n)).agg(pairs(F.col(c)).alias(f"p_{c}"), (-F.sum(F.col(c) / F.col("n_all") * F.ln(F.col(c) / F.col("n_all")))).alias(f"h_{c}"))
    s = mutual.join(entropy(rows, "nb")).join(entropy(columns, "nt"))
    expected = F.col("p_nb") * F.col("p_nt") / (F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col("p_nb") + F.col("p_nt")) / 2
    ari = F.when((F.coalesce("total", F.lit(0)) < 2) | (most == expected), 1.0).otherwise((F.col("cell") - expected) / F.when(most != expected, most - expected))
    mean = (F.col("h_nb") + F.col("h_nt")) / 2
    return s.select(ari.alias("ari"), F.when(F.coalesce(mean, F.lit(0.0)) == 0, 1.0).otherwise(F.col("mutual") / F.when(mean != 0, mean)).alias("nmi"))


def high_quality_bins(labels: DataFrame, recovered: float = 0.9, contamination: float = 0.05) -> DataFrame:
    """bin, truth, hits, n_bin, n_truth of bins that hold most of a truth group and little else (AGG-25)."""
    known = labels.filter("truth IS NOT NULL")
    cells = contingency(known.filter("bin IS NOT NULL"))
    truth = known.groupBy("truth").agg(F.count("*").alias("n_truth"))
    by = Window.partitionBy("bin")
    top = cells.withColumns({"n_bin": F.sum("n").over(by), "r": F.row_number().over(by.orderBy(F.desc("n"), "truth"))}).filter("r = 1")
    return top.join(truth, "truth").filter((F.col("n") / F.col("n_truth") >= recovered) & (1 - F.col("n") / F.col("n_bin") <= contamination)).select("bin", "truth", F.col("n").alias("hits"), "n_bin", "n_truth")


def size_stats(bins: DataFrame) -> DataFrame:
    """One row: bins, singletons, multi, largest, rows, of rows (bin) (AGG-18)."""
    s = bins.filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("bins"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("largest"), F.sum("n").alias("members"))


def pair_prior(bins: DataFrame) -> DataFrame:
    """One row, prior: share of pairs that a partition joins, in [1e-7, 0.5] (AGG-19)."""
    s = bins.groupBy("bin").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"), F.sum("n").alias("all"))
    return s.select(F.least(F.greatest(F.col("inside") / F.greatest(F.col("all") * (F.col("all") - 1) / 2, F.lit(1.0)), F.lit(1e-7)), F.lit(0.5)).alias("prior"))


def equivalent(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: whether two labellings are the same partition (AGG-27)."""
    p = labels.select(a, b).distinct()
    return p.agg(F.count("*").alias("pairs"), F.countDistinct(a).alias("n_a"), F.countDistinct(b).alias("n_b")).withColumn("equivalent", (F.col("pairs") == F.col("n_a")) & (F.col("pairs") == F.col("n_b")))


def quality_summary(rows: DataFrame, by: str) -> DataFrame:
    """Counts by tier, mean and median completeness and contamination without nulls, rounded to 2 (AGG-28). Rows: tier, completeness, contamination."""
    # Tiers, best first
    tiers = ("Complete", "High-quality", "Medium-quality", "Low-quality", "Not-determined")
    counts = [F.count_if(F.col("tier") == t).alias(t.lower().replace("-", "_")) for t in tiers]
    stats = [f(c).alias(f"{n}_{c}") for c in ("completeness", "contamination") for n, f in (("mean", lambda c: F.round(F.avg(c), 2)), ("median", lambda c: F.round(F.percentile(c, F.lit(0.5)), 2)))]
    good = F.count_if(F.col("tier").isin(*tiers[:3])).alias("medium_or_better")
    return rows.groupBy(by).agg(F.count("*").alias("n"), *counts, *stats, F.count_if(F.col("contamination") > 5).alias("contaminated"), good)
