"""Truth labels of a mock community from alignments to its references, and what the labels say (OPS-6, SNK-13, PRJ-13, AGG-10, JN-13, JN-14)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, labelling
from .acceptance import beside
from .pileup import interval_union
from .ranks import dealt, fresh


@dataclass(frozen=True)
class Thresholds:
    """What an alignment must reach, how near ties are, and what a second genome must cover beside the first."""

    identity: float = 0.90
    query_cover: float = 0.50
    tie: float = 0.02
    chimera: float = 0.25


def supported(hits: DataFrame, lengths: DataFrame, how: Thresholds = Thresholds()) -> DataFrame:
    """query, target, start, end, matches, sums of the pair (m, b), length, f (what a span adds) of the alignments of all pairs that reach the identity and whose spans add up to the cover at least.

    Alignments move once, by query; all else stays in its task.
    """
    known = dealt(hits.filter("target IS NOT NULL").select("query", "target", F.col("query_start").alias("start"), F.col("query_end").alias("end"), "matches", "block"), "query").join(lengths.select("query", "length"), "query")
    pair = Window.partitionBy("query", "target")
    real = lambda c: F.sum(F.when(F.col("block") > 0, F.col(c))).over(pair)
    sums = known.withColumns({"m": real("matches"), "b": real("block"), "most": F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0))).over(pair)})
    near = sums.filter((F.col("m") / F.greatest("b", F.lit(1)) >= how.identity) & (_share("most") >= how.query_cover))
    return near.select("query", "target", "start", "end", "matches", "m", "b", "length", fresh(F.col("start"), F.col("end"), "query", "target").alias("f"))


def _share(covered: str):
    return F.when(F.col("length") > 0, F.col(covered) / F.col("length")).otherwise(0.0)


def passing(hits: DataFrame, lengths: DataFrame, how: Thresholds = Thresholds()) -> DataFrame:
    """query, target, matches, block, identity, query_cover of pairs that reach both thresholds (PRJ-13). ``hits``: alignments (``tables.read_paf``); ``lengths``: query, length."""
    return _covering(supported(hits, lengths, how), how)


def _covering(near: DataFrame, how: Thresholds) -> DataFrame:
    scored = near.groupBy("query", "target", F.col("m").alias("matches"), F.col("b").alias("block"), "length").agg(F.sum(F.col("f.end") - F.col("f.start")).alias("covered"))
    judged = scored.withColumns({"identity": F.col("matches") / F.greatest("block", F.lit(1)), "query_cover": _share("covered")})
    return judged.filter(F.col("query_cover") >= how.query_cover).select("query", "target", "matches", "block", "identity", "query_cover")


def merged_names(scored: DataFrame, tie: float) -> DataFrame:
    """name, truth: names that some query cannot tell apart share one truth, their names joined by a bar. ``scored``: query, name, matches."""
    near = scored.withColumn("best", F.max("matches").over(Window.partitionBy("query"))).filter(F.col("matches") >= F.col("best") * (1 - tie))
    pairs = near.withColumn("first", F.min("name").over(Window.partitionBy("query"))).filter("name <> first").select(F.col("first").alias("src"), F.col("name").alias("dst")).distinct()
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().checkpoint()
    found = graph.connected_components(nodes, pairs).checkpoint()
    named = labelling.group_names(found)
    return found.join(named, "component").select(F.col("id").alias("name"), F.col("members").alias("truth"))


def label(hits: DataFrame, references: DataFrame, lengths: DataFrame, level: str = "agent", how: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """labels, references and summary of a mock community.

    ``hits``: alignments of contigs (query) to references (target); ``references``: target, agent, molecule; ``lengths``: query, length of every
    contig; ``level``: the column of ``references`` that holds the genomes. labels: query, truth, molecule, identity, query_cover, status (labelled, merged, chimeric or
    unlabelled) of every contig. references: target, agent, molecule, truth, length, covered, fraction, contigs, bases. summary: one row.
    """
    near = supported(hits, lengths, how).checkpoint()
    scored = _covering(near, how).join(references.select("target", F.col(level).alias("of"), "molecule"), "target", "left")
    scored = scored.withColumns({"name": F.coalesce("of", "target"), "molecule": F.coalesce("molecule", "target")}).drop("of").checkpoint()
    merged = merged_names(scored, how.tie).checkpoint()
    with_truth = lambda rows: rows.join(merged, "name", "left").withColumn("truth", F.coalesce("truth", "name"))
    named = with_truth(scored)
    best = named.groupBy("query").agg(F.min(F.struct((-F.col("matches")).alias("m"), "target", "truth", "molecule", "identity", "query_cover")).alias("b")).select("query", "b.*")
    spans = near.join(scored.select("query", "target"), ["query", "target"], "left_semi").select("query", "target", "start", "end", "matches")
    # one truth a target: a target is named alike in every query
    rivals = labelling.rivals(spans, named.select("target", "truth").distinct(), lengths.select("query", "length"), how.chimera).select("query", F.lit(True).alias("chimeric"))
    status = F.when(F.col("chimeric"), "chimeric").when(F.col("truth").isNull(), "unlabelled").when(F.contains("truth", F.lit("|")), "merged").otherwise("labelled")
    judged = lengths.select("query", "length").join(best, "query", "left").join(rivals, "query", "left").withColumn("status", status)
    kept = lambda c: F.when(F.col("status").isin("labelled", "merged"), F.col(c)).alias(c)
    labels = judged.select("query", "length", *map(kept, ("truth", "molecule", "identity", "query_cover")), "status").checkpoint()
    recovered = recovery(hits, with_truth(references.withColumn("name", F.col(level))), labels)
    return {"labels": labels.drop("length"), "references": recovered, "summary": summary(labels, recovered, level, how)}


def recovery(hits: DataFrame, references: DataFrame, labels: DataFrame) -> DataFrame:
    """target, agent, molecule, truth, length, covered, fraction, contigs, bases: how much of each reference was assembled, and what has its truth (AGG-10, SNK-13).

    ``references``: target, agent, molecule, truth; ``labels``: truth, length of contigs. All alignments count here.
    """
    covered = interval_union(hits.select("target", F.col("target_start").alias("start"), F.col("target_end").alias("end")), "target")
    sizes = hits.groupBy("target").agg(F.max("target_length").alias("length"))
    given = labels.filter("truth IS NOT NULL").groupBy("truth").agg(F.count("*").alias("contigs"), F.sum("length").alias("bases"))
    rows = references.join(covered, "target", "left").join(sizes, "target", "left").join(given, "truth", "left").na.fill(0, ["covered", "length", "contigs", "bases"])
    share = F.when(F.col("length") > 0, F.col("covered") / F.col("length")).otherwise(0.0)
    return rows.select("target", "agent", "molecule", "truth", "length", "covered", share.alias("fraction"), "contigs", "bases")


def summary(labels: DataFrame, recovered: DataFrame, level: str, how: Thresholds) -> DataFrame:
    """One row: numbers of references, genomes and contigs by status, the merged genomes, and the thresholds (SNK-13)."""
    of = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    contigs = labels.agg(F.count("*").alias("contigs_total"), of("labelled", "merged").alias("contigs_labelled"), of("merged").alias("contigs_labelled_merged"), of("chimeric").alias("contigs_chimeric"), of("unlabelled").alias("contigs_unlabelled"), F.countDistinct("truth").alias("truth_genomes"))
    half = F.count_if((F.col("length") > 0) & (F.col("covered") >= 0.5 * F.col("length")))
    refs = recovered.agg(F.count("*").alias("references"), F.countDistinct("agent").alias("agents"), half.alias("references_half_covered"), F.array_sort(F.collect_set(F.when(F.contains("truth", F.lit("|")), F.col("truth")))).alias("merged_truth_genomes"))
    told = [F.lit(getattr(how, k)).alias(f"least_{k}" if k != "tie" else k) for k in ("identity", "query_cover", "tie", "chimera")]
    return beside(contigs, refs).select("*", F.lit(level).alias("level"), *told)
