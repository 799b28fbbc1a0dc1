"""Feature views of contigs: composition and abundance (AGG-1..4, WIN-11, PRJ-1, JN-2, E5, E6)."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import canonical_kmers
from .ranks import attach


def retained(contigs: DataFrame, least: int, order: str = "contig") -> DataFrame:
    """Contigs of at least ``least`` bases with a dense index from 0 in the order given (PRJ-1).

    The index of a row is its rank: rows are counted by range of the order key, so no
    task sorts the whole table.
    """
    kept = contigs.filter(F.col("length") >= least)
    return dense_index(kept, order, "node_index")


def dense_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rank - 1 over the whole table, by range-partitioned sort and partition offsets."""
    # written once: what follows reads it twice, and partitions must not change between
    placed = df.checkpoint().repartitionByRange(order).withColumn("_p", F.spark_partition_id()).checkpoint()
    local = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    before = local.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = before.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return local.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_b") + F.col("_r") - 1).cast("long")).drop("_p", "_r", "_b")


def kmer_counts(contigs: DataFrame, k: int = 4) -> DataFrame:
    """contig, kmer, cnt of canonical k-mers; windows with other letters than A, C, G, T are skipped (AGG-1).

    A contig is one row, so its windows are counted where it is: no row a window, no shuffle.
    """
    words = ["".join(w) for w in itertools.product("ACGT", repeat=k)]
    turned = str.maketrans("ACGT", "TGCA")
    least = np.array([min(i, words.index(w[::-1].translate(turned))) for i, w in enumerate(words)])
    names = pa.array(words)

    def run(batches):
        code = np.full(256, 255, np.uint8)
        code[list(b"ACGT")] = range(4)
        for batch in batches:
            contig, column = batch.column(0), batch.column(1).cast(pa.large_binary()).fill_null(b"")
            for at in range(0, batch.num_rows, 64):
                part = column.slice(at, 64)
                size = pc.binary_length(part).to_numpy()
                x = code[np.frombuffer(b"".join(part.to_pylist()), np.uint8)]
                n = max(0, len(x) - k + 1)
                row = np.repeat(np.arange(len(size)), size)
                ok, window = np.ones(n, bool), np.zeros(n, np.int64)
                for j in range(k):
                    ok &= (x[j : j + n] < 4) & (row[j : j + n] == row[:n])
                    window = window * 4 + x[j : j + n]
                key = row[:n][ok] * len(words) + least[window[ok]]
                count = np.bincount(key, minlength=len(size) * len(words))
                used = np.flatnonzero(count)
                if len(used):
                    yield pa.RecordBatch.from_arrays([contig.take(pa.array(at + used // len(words))), names.take(pa.array(used % len(words))), pa.array(count[used])], names=["contig", "kmer", "cnt"])

    return contigs.select("contig", "sequence").mapInArrow(run, f"contig {contigs.schema['contig'].dataType.simpleString()}, kmer string, cnt long")


def kmer_frequencies(counts: DataFrame) -> DataFrame:
    total = F.sum("cnt").over(Window.partitionBy("contig"))
    return counts.select("contig", "kmer", F.when(total > 0, F.col("cnt") / total).otherwise(0.0).alias("freq"))


def dense_kmers(contigs: DataFrame, counts: DataFrame, k: int = 4) -> DataFrame:
    """contig, kmer, cnt with every canonical k-mer, zeros included."""
    grid = contigs.select("contig", F.explode(F.array(*map(F.lit, canonical_kmers(k)))).alias("kmer"))
    return grid.join(counts, ["contig", "kmer"], "left").select("contig", "kmer", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def zscore(long: DataFrame, column: str, value: str, epsilon: float = 1e-5) -> DataFrame:
    """value := (x - mean) / (population deviation + epsilon) by ``column`` of a long table."""
    stats = long.groupBy(column).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return attach(long, stats, column).withColumn(value, (F.col(value) - F.col("_m")) / (F.col("_s") + epsilon)).drop("_m", "_s")


def clr(dense: DataFrame) -> DataFrame:
    """contig, kmer, z: centred log-ratio of counts + 0.5, standardised by k-mer (WIN-11, AGG-3)."""
    logs = dense.withColumn("l", F.ln(F.col("cnt") + 0.5))
    centred = logs.withColumn("z", F.col("l") - F.avg("l").over(Window.partitionBy("contig")))
    return zscore(centred.select("contig", "kmer", "z"), "kmer", "z")


#: A coverage table has so many samples at most.
SAMPLES = 100_000


def left_fill(contigs: DataFrame, coverage: DataFrame) -> DataFrame:
    """contig, sample, depth of every contig (``contigs``: contig) in every sample of ``coverage``, 0 where it has none (JN-2).

    The samples, of which there are SAMPLES at most, become an array that every contig unfolds. Raises beyond that.
    """
    found = coverage.select("sample").distinct().limit(SAMPLES + 1).collect()
    if len(found) > SAMPLES:
        raise ValueError(f"more than {SAMPLES} samples")
    samples = F.lit(sorted((r[0] for r in found if r[0] is not None))) if found else F.array().cast("array<string>")
    grid = contigs.select("contig", F.explode(samples).alias("sample"))
    return grid.join(coverage, ["contig", "sample"], "left").select("contig", "sample", F.coalesce("depth", F.lit(0.0)).alias("depth"))


def wide(coverage: DataFrame, samples: list[str]) -> DataFrame:
    """contig and a column for each sample, 0 where there is no depth; of a pair that repeats the greatest counts."""
    rows = coverage.groupBy("contig").pivot("sample", samples).agg(F.max("depth"))
    return rows.select("contig", *(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(s) for s in samples))


def cpm(coverage: DataFrame) -> DataFrame:
    """contig, sample, depth scaled to a million a sample (AGG-4)."""
    totals = coverage.groupBy("sample").agg(F.sum("depth").alias("_total"))
    return attach(coverage, totals, "sample").withColumn("depth", F.col("depth") * (1e6 / F.greatest(F.col("_total"), F.lit(1e-9)))).drop("_total")


def normalised(abundance: DataFrame, lengths: DataFrame) -> DataFrame:
    """contig, sample, share, depth, present: share of the sample; share over length with a mean of 1 over what is present; how many are (AGG-39).

    ``lengths``: contig, length.
    """
    totals = abundance.groupBy("sample").agg(F.sum("depth").alias("_total"))
    raw = attach(abundance, totals, "sample").join(lengths, "contig").withColumn("share", F.col("depth") / F.col("_total")).withColumn("raw", F.col("share") / F.col("length"))
    means = raw.groupBy("sample").agg(F.avg(F.when(F.col("raw") > 0, F.col("raw"))).alias("_mean"), F.count_if(F.col("share") > 0).alias("present"))
    return attach(raw, means, "sample").select("contig", "sample", "share", (F.col("raw") / F.col("_mean")).alias("depth"), "present")


def log_profile(scaled: DataFrame) -> DataFrame:
    """contig, sample, profile: log1p of depth, centred by contig (E6 before unit length)."""
    l = F.log1p("depth")
    return scaled.select("contig", "sample", (l - F.avg(l).over(Window.partitionBy("contig"))).alias("profile"))


def abundance_view(scaled: DataFrame) -> DataFrame:
    """contig, feature, value: shares, centred logs and the log total, each standardised (abundance part of E5)."""
    by = Window.partitionBy("contig")
    l, total = F.log1p("depth"), F.sum("depth").over(by)
    rows = scaled.select("contig", "sample", (F.col("depth") / F.greatest(total, F.lit(1e-9))).alias("share"), (l - F.avg(l).over(by)).alias("profile"), F.log1p(total).alias("total"))
    parts = F.array(F.struct(F.concat(F.lit("share_"), "sample").alias("feature"), F.col("share").alias("value")), F.struct(F.concat(F.lit("profile_"), "sample").alias("feature"), F.col("profile").alias("value")))
    long = rows.select("contig", F.explode(parts).alias("x")).select("contig", "x.feature", "x.value")
    totals = scaled.groupBy("contig").agg(F.log1p(F.sum("depth")).alias("value")).select("contig", F.lit("log_total").alias("feature"), "value")
    return zscore(long.union(totals), "feature", "value")
