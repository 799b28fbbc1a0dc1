"""Labels from alignments, and quality reports of datasets (AGG-8..14, AGG-29..40, JN-12..16, WIN-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..functions.text import alphanumeric
from .pileup import interval_union  # noqa: F401  (queries take it from here)
from .ranks import attach, dealt, fresh, totals_before


def identities(hits: DataFrame) -> DataFrame:
    """query, target, matches, block, identity (AGG-9)."""
    return hits.groupBy("query", "target").agg(F.sum("matches").alias("matches"), F.sum("block").alias("block")).withColumn("identity", F.col("matches") / F.greatest(F.col("block"), F.lit(1)))


def best_targets(scored: DataFrame, tie: float = 0.02) -> DataFrame:
    """query, target, matches, identity, n_tied: most matches, then least target; n_tied within ``tie`` of the best (JN-13, WIN-10)."""
    by = Window.partitionBy("query")
    top = scored.withColumns({"best": F.max("matches").over(by), "r": F.row_number().over(by.orderBy(F.desc("matches"), "target"))})
    tied = F.count_if(F.col("matches") >= F.col("best") * (1 - tie)).over(by)
    return top.withColumn("n_tied", tied).filter("r = 1").select("query", "target", "matches", "identity", "n_tied")


def tied_pairs(scored: DataFrame, tie: float = 0.02) -> DataFrame:
    """src, dst: the best target of a query and each other within ``tie`` of it."""
    by = Window.partitionBy("query")
    near = scored.withColumns({"best": F.max("matches").over(by), "top": F.first("target").over(by.orderBy(F.desc("matches"), "target"))})
    near = near.filter((F.col("matches") >= F.col("best") * (1 - tie)) & (F.col("target") != F.col("top")))
    return near.select(F.least("top", "target").alias("src"), F.greatest("top", "target").alias("dst")).distinct()


def group_names(components: DataFrame) -> DataFrame:
    """component, members, size: sorted ids joined by a bar (AGG-11)."""
    return components.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), "|").alias("members"), F.count("*").alias("size"))


def cigar_length(cigar: Column) -> Column:
    """Sum of the lengths of M, = and X (AGG-14)."""
    parts = F.regexp_extract_all(cigar, F.lit("([0-9]+)[M=X]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def n50(lengths: DataFrame, by: str) -> DataFrame:
    """by, n50: the first length, in descending order, at which half of the total is reached (AGG-32). Null lengths don't count."""
    counts = lengths.filter("length IS NOT NULL").groupBy(by, "length").agg(F.sum("length").alias("n"))
    run = totals_before(counts, by, "length", "n")
    return run.filter((F.col("total") - F.col("before")) * 2 >= F.col("total")).groupBy(by).agg(F.max("length").cast("long").alias("n50"))


def average_ranks(values: DataFrame, by: str, value: str) -> DataFrame:
    """Adds rank_avg: rank within ``by``, ties averaged (WIN-6). Ranks come from counts by value."""
    counts = values.groupBy(by, value).agg(F.count("*").alias("_n"))
    ranks = totals_before(counts, by, value, "_n").select(by, value, (F.col("before") + (F.col("_n") + 1) / 2).alias("rank_avg"))
    return values.join(ranks, [by, value])


def rank_correlations(values: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """a, b, rho: rank correlation of each pair of ``by`` over the keys that both have (AGG-33); null where the ranks of one are all alike."""
    r = average_ranks(values, by, value).select(key, by, "rank_avg")
    a, b = (r.select(key, F.col(by).alias(s), F.col("rank_avg").alias(f"r{s}")) for s in ("a", "b"))
    return a.join(b, key).filter("a < b").groupBy("a", "b").agg(F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("rho"))


def rank_correlation_summary(values: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """One row: median, least and greatest rank correlation of pairs of ``by`` (AGG-33)."""
    rho = rank_correlations(values, key, by, value)
    clean = lambda c: F.round(c, 6) + F.lit(0.0)
    return rho.agg(clean(F.median("rho")).alias("median"), clean(F.min("rho")).alias("least"), clean(F.max("rho")).alias("greatest"))


def identity_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r, strand of equal sequences on either strand, forward first (JN-12); joined on hashes. Rows: id, sequence."""
    a = left.select(F.col("id").alias("l"), F.sha2("sequence", 256).alias("h"), F.sha2(reverse_complement(F.col("sequence")), 256).alias("b"))
    ends = a.select("l", F.explode(F.array(F.struct(F.col("h").alias("k"), F.lit("+").alias("strand")), F.struct(F.col("b").alias("k"), F.lit("-").alias("strand")))).alias("e")).select("l", "e.k", "e.strand")
    found = ends.join(right.select(F.col("id").alias("r"), F.sha2("sequence", 256).alias("k")), "k")
    return found.groupBy("l", "r").agg(F.min("strand").alias("strand"))


# What a token of a reference name (its parts between _) may be, whole; segments in any case.
ACCESSION_TOKEN = r"[A-Z]{1,2}_?\d{5,8}(\.\d+)?"
SEGMENT_TOKENS = (r"RNA\d+[A-Za-z]*", r"DNA-?[A-Za-z0-9]+", r"segment[_-]?\w+", r"S\d", r"M\d", r"L\d", r"clone_\d+")


def agent_name(name: Column) -> Column:
    """The agent of a reference name: its tokens up to the last that is no accession, less a segment token there (PRJ-18).

    The molecule is the whole name, as is the agent of a name of which nothing is left.
    """
    tokens = F.split(name, "_")
    own = F.filter(F.transform(tokens, lambda t, i: F.when(~t.rlike(f"^{ACCESSION_TOKEN}$"), i + 1)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(own), F.lit(0))
    segment = F.get(tokens, last - 1).rlike(f"(?i)^({'|'.join(SEGMENT_TOKENS)})$")
    kept = F.slice(tokens, F.lit(1), last - F.when((last > 1) & segment, 1).otherwise(0))
    return F.coalesce(F.nullif(F.array_join(kept, "_"), F.lit("")), name)


def gene_architecture(genes: DataFrame, lengths: DataFrame) -> DataFrame:
    """contig and its ORF features (AGG-29, WIN-4), zeros without genes. ``genes``: contig, start, end, strand, gc, table."""
    by = Window.partitionBy("contig").orderBy("start", "end", "strand")
    g = genes.withColumns({"size": F.col("end") - F.col("start"), "switch": F.coalesce((F.lag("strand").over(by) != F.col("strand")).cast("int"), F.lit(0))})
    s = g.groupBy("contig").agg(F.count("*").alias("n"), F.sum("size").alias("coding"), F.avg("size").alias("mean_orf_len"), F.sum("switch").alias("switches"), F.avg("gc").alias("gc_mean"), F.mode("table", True).alias("translation_table"))
    n, length = F.coalesce("n", F.lit(0)), F.greatest("length", F.lit(1))
    return lengths.join(s, "contig", "left").select(
        "contig", "length", n.alias("n_orfs"), (F.coalesce("coding", F.lit(0)) / length).alias("coding_density"), F.coalesce("mean_orf_len", F.lit(0.0)).alias("mean_orf_len"), (1000.0 * n / length).alias("orfs_per_kb"),
        F.when(n > 1, F.col("switches") / (n - 1)).otherwise(0.0).alias("strand_switch_rate"), F.coalesce("gc_mean", F.lit(0.0)).alias("gc_mean"), F.coalesce("translation_table", F.lit(0)).alias("translation_table"),
    )


def protein_clusters(members: DataFrame) -> DataFrame:
    """contig, cluster, n_proteins, cluster_size, cluster_contigs (AGG-30). ``members``: protein, contig, cluster (null: a cluster of its own)."""
    named = members.withColumn("cluster", F.coalesce("cluster", F.col("protein").cast("string")))
    each = named.groupBy("contig", "cluster").agg(F.count("*").alias("n_proteins"))
    sizes = each.groupBy("cluster").agg(F.sum("n_proteins").alias("cluster_size"), F.count("*").alias("cluster_contigs"))
    return each.join(sizes, "cluster").select("contig", "cluster", "n_proteins", "cluster_size", "cluster_contigs")


def closest_candidate(candidates: DataFrame, share: float = 0.01, least: int = 30, gc: float = 1.0) -> DataFrame:
    """term, id of the best of each term's candidates (SRT-7). Rows: term, id, name, length, gc, want_length, want_gc.

    Those whose length or G + C percentage is too far from what is wanted are out; a name that holds the term goes first,
    then the nearest length, then the least id. Fixed values: the tolerances.
    """
    off = F.abs(F.col("length") - F.col("want_length"))
    near = candidates.filter((off <= F.greatest(F.lit(least), share * F.col("want_length"))) & (F.abs(F.col("gc") - F.col("want_gc")) <= gc))
    best = F.min(F.struct((~F.contains(alphanumeric(F.col("name")), alphanumeric(F.col("term")))).alias("other"), off.alias("off"), "id"))
    return near.groupBy("term").agg(best.alias("b")).select("term", F.col("b.id").alias("id"))


def rivals(spans: DataFrame, groups: DataFrame, lengths: DataFrame, share: float = 0.25) -> DataFrame:
    """query, best, rival, extra: the first target of another group, by matches, whose spans cover ``share`` of the query outside the best's (JN-14).

    ``spans``: query, target, start, end, matches; ``groups``: target, truth; ``lengths``: query, length.
    Spans move once, by query; all that follows stays in its task.
    """
    named = attach(spans.filter("target IS NOT NULL").select("query", "target", "start", "end", "matches"), groups.select("target", "truth"), "target")
    rows = dealt(named, "query").join(lengths.select("query", "length"), "query")
    pair, query = Window.partitionBy("query", "target"), Window.partitionBy("query")
    by = query.orderBy(F.desc("total"), "target")
    size = F.greatest(F.col("end") - F.col("start"), F.lit(0))
    ranked = rows.withColumns({"total": F.sum("matches").over(pair), "most": F.sum(size).over(pair), "f": fresh(F.col("start"), F.col("end"), "query", "target")})
    ranked = ranked.withColumns({"rank": F.dense_rank().over(by), "best": F.first("target").over(by), "own": F.first("truth").over(by)})
    # what the best covers, as disjoint spans; a target whose spans add up to too little cannot be a rival
    beside = ranked.withColumn("cover", F.collect_list(F.when(F.col("target") == F.col("best"), F.col("f"))).over(query)).filter((F.col("truth") != F.col("own")) & (F.col("most") >= share * F.col("length")))
    both = lambda s, x: s + F.greatest(F.lit(0), F.least(x["end"], F.col("f.end")) - F.greatest(x["start"], F.col("f.start")))
    extra = F.col("f.end") - F.col("f.start") - F.aggregate("cover", F.lit(0).cast("long"), both)
    far = beside.groupBy("query", "best", "rank", F.col("target").alias("rival"), "length").agg(F.sum(extra).alias("extra")).filter(F.col("extra") >= share * F.col("length"))
    first = far.groupBy("query", "best").agg(F.min(F.struct("rank", "rival", "extra")).alias("r"))
    return first.select("query", "best", F.col("r.rival").alias("rival"), F.col("r.extra").alias("extra"))


def dead_samples(coverage: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """sample whose depths are all alike (AGG-34)."""
    return coverage.groupBy("sample").agg((F.max("depth") - F.min("depth")).alias("d")).filter(F.col("d") <= tolerance).select("sample")


def reachable_pairs(labels: DataFrame, components: DataFrame) -> DataFrame:
    """One row: pairs of contigs of one label, and those of them in one component (JN-17), from counts alone. Rows: contig, label; id, component."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = labels.join(components.withColumnRenamed("id", "contig"), "contig").groupBy("label", "component").agg(F.count("*").alias("n"))
    every = both.groupBy("label").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("pairs"))
    return every.join(both.agg(pairs(F.col("n")).alias("reachable"))).select(F.coalesce(F.col("pairs"), F.lit(0.0)).cast("long").alias("pairs"), F.coalesce(F.col("reachable"), F.lit(0.0)).cast("long").alias("reachable"))
