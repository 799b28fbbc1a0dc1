"""The run from raw inputs to bins (OPS-1, OPS-2, SNK-1, 2, 4)."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BinningConfig
from ..functions.vectors import unit
from ..operators import acceptance, completeness, evidence, features, graph, metrics, neighbours, partition, training
from ..sources import dataset, fasta, gfa, tables


def feature_views(contigs: DataFrame, coverage: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """contig, a (composition and abundance, clipped to 8), b (log profile): unit rows (E5, E6).

    ``contigs``: contig, and sequence unless k-mer ``counts`` (contig, kmer, cnt) are given; ``coverage``: contig, sample, depth (absent: 0).
    """
    counts = features.kmer_counts(contigs) if counts is None else counts
    scaled = features.cpm(features.left_fill(contigs, coverage))
    composition = features.clr(features.dense_kmers(contigs, counts)).select("contig", F.col("kmer").alias("feature"), F.col("z").alias("value"))
    both = composition.union(features.abundance_view(scaled))

    def row(df, key, name):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(key, "value"))), lambda x: x["value"])
        return df.groupBy("contig").agg(unit(ordered).alias(name))

    clipped = both.withColumn("value", F.least(F.greatest("value", F.lit(-8.0)), F.lit(8.0)))
    profile = features.log_profile(scaled).withColumnRenamed("profile", "value")
    return row(clipped, "feature", "a").join(row(profile, "sample", "b"), "contig")


def run(spark: SparkSession, fasta_path: str, coverage_path: str, gfa_path: str, output: str, paths: str | None = None, config: BinningConfig | None = None, learn: bool = True) -> DataFrame:
    """Bins contigs and writes assignments, per-bin FASTA and run.json under ``output``; returns contig, bin, length."""
    config, began = config or BinningConfig(), time.time()
    records = fasta.checked(fasta.read_fasta(spark, fasta_path))
    lengths = records.select("contig", F.struct("file", "position").alias("position"), F.length("sequence").cast("long").alias("length"))
    kept = features.retained(lengths, config.least_length, "position").select("contig", F.col("node_index").alias("id"), "length").checkpoint()
    n = kept.count()
    if n < 2:
        raise ValueError("at least two contigs must pass the length filter")
    coverage = tables.read_coverage(spark, coverage_path, kept)
    own = records.join(kept.select("contig"), "contig", "left_semi")
    views = feature_views(own, coverage).join(kept.select("contig", "id"), "contig").select("id", "contig", "a", "b").checkpoint()
    steps = gfa.read_paths(spark, gfa_path)
    if paths:
        steps = steps.unionByName(gfa.read_contig_paths(spark, paths, kept))
    named = gfa.contig_edges(gfa.read_links(spark, gfa_path, strict=True), kept, steps)
    return _binned(spark, kept, views, named, own, output, config, learn, began)


def run_prepared(spark: SparkSession, path: str, output: str, fasta_path: str | None = None, coverage_path: str | None = None, config: BinningConfig | None = None, learn: bool = True) -> DataFrame:
    """``run`` on a prepared dataset (``sources.dataset``): bins its contigs from stored k-mer counts, coverage and edges (OPS-1, JN-3).

    Sequences are needed for terminal repeats and per-bin FASTA alone: without ``fasta_path`` no contig is kept alone and no FASTA is written.
    """
    config, began = config or BinningConfig(), time.time()
    parts = dataset.read_dataset(spark, path, coverage_path)
    kept = features.retained(parts["contigs"].select("contig", "length", F.col("node_index").alias("at")), config.least_length, "at").select("contig", F.col("node_index").alias("id"), "length").checkpoint()
    if kept.count() < 2:
        raise ValueError("at least two contigs must pass the length filter")
    names = kept.select("contig")
    counts, coverage = (parts[t].join(names, "contig", "left_semi") for t in ("kmers", "coverage"))
    views = feature_views(names, coverage, counts).join(kept.select("contig", "id"), "contig").select("id", "contig", "a", "b").checkpoint()
    own = None
    if fasta_path:
        own = fasta.checked(fasta.read_fasta(spark, fasta_path)).join(names, "contig", "left_semi")
        missing = names.join(own, "contig", "left_anti").limit(3).collect()
        if missing:
            raise ValueError(f"contigs without a sequence: {[r[0] for r in missing]}")
    return _binned(spark, kept, views, graph.linked(parts["edges"]), own, output, config, learn, began)


def _binned(spark: SparkSession, kept: DataFrame, views: DataFrame, named: DataFrame, own: DataFrame | None, output: str, config: BinningConfig, learn: bool, began: float) -> DataFrame:
    """Bins from views. ``kept``: contig, id, length; ``views``: id, contig, a, b; ``named``: src, dst of links by contig; ``own``: contig, sequence, if they are at hand."""
    n, index = kept.count(), kept.select("contig", "id")
    of = lambda end, to: index.select(F.col("contig").alias(end), F.col("id").alias(to))
    assembly = neighbours.canonical_edges(named.join(of("src", "i"), "src").join(of("dst", "j"), "dst").select(F.col("i").alias("src"), F.col("j").alias("dst"))).checkpoint()

    a, b = (views.select("id", F.col(k).alias("u")) for k in ("a", "b"))
    nulls = {k: partition.null_scores(x, config.evidence.null_draws, config.seed).checkpoint() for k, x in (("a", a), ("b", b))}
    null = {k: evidence.robust_null(s).first() for k, s in nulls.items()}
    tail = "b" if null["b"]["scale"] >= 1e-3 else "a"
    prior = evidence.upper_tail_prior(nulls[tail], 2_000, null=null[tail]).first()[0]
    fits = {k: evidence.fit_mixture(nulls[k], prior, null=null[k]) for k in ("a", "b")}
    left, right = (views.select(F.col("id").alias(e), F.col("a").alias(f"a_{e}"), F.col("b").alias(f"b_{e}")) for e in ("src", "dst"))
    dots = assembly.join(left, "src").join(right, "dst").select("src", "dst", *(F.aggregate(F.zip_with(f"{k}_src", f"{k}_dst", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias(k) for k in ("a", "b")))
    supported = evidence.positive_edges(dots, fits, need_evidence=False).select("src", "dst").checkpoint()

    def knn(rows, k):
        return neighbours.reciprocal_knn(rows, min(k, n - 1), config.search.exact_rows).select("src", "dst")

    def statistical(u, k):
        pairs = knn(u, k).union(knn(b, k)).distinct().checkpoint()
        return graph.limit_degree(u.select("id", F.col("u").alias("a")).join(b.select("id", F.col("u").alias("b")), "id"), pairs, config.search.exact_rows)

    seeds = statistical(a, config.search.seed_neighbours).union(supported).distinct()
    embedding, learned = a, {}
    if learn:
        embedding, learned = training.embed(a.join(b.select("id", F.col("u").alias("b")), "id"), seeds, config, supported)
        embedding = embedding.select("id", F.col("z").alias("u")).checkpoint()
    candidates = statistical(embedding, config.search.neighbours).union(supported).distinct()
    null_a = partition.null_scores(embedding, config.evidence.null_draws, config.seed).checkpoint()

    locked = None
    if config.repeats.alone and own is not None:
        repeats = completeness.terminal_repeats(own, config.repeats.seed)
        gated = completeness.gate(repeats, config.repeats.least, config.repeats.share)
        locked = gated.join(index, "contig").select(F.col("id").alias("contig"), "locked").checkpoint()
    joined = embedding.select("id", F.col("u").alias("a")).join(b.select("id", F.col("u").alias("b")), "id")
    found, stats = partition.unknown_k(joined, candidates, {"a": null_a, "b": nulls["b"]}, config, locked)
    bins = found.join(kept, "id").select("contig", "bin", "length").checkpoint()

    tables.write_assignments(bins, f"{output}/assignments.tsv")
    if own is not None:
        fasta.write_bins(own, bins.select("contig", F.format_string("bin_%06d", "bin").alias("bin")), f"{output}/bins")
    sizes = metrics.size_stats(bins).first().asDict()
    alone = index.select("id").limit(0) if locked is None else locked.filter("locked").select(F.col("contig").alias("id"))
    shut, (_, withheld) = alone.count(), acceptance.withheld(candidates, alone)
    told = {"parameters": config.told(), "contigs": n, "assembly": {"candidates": assembly.count(), "supported": supported.count()}, "training": learned, "clustering": stats, "result": sizes, "locked": shut, "locked_fraction": shut / n, "withheld_edges": withheld, "seconds": round(time.time() - began, 3)}
    spark.createDataFrame([(json.dumps(told, sort_keys=True, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/run.json")
    return bins
