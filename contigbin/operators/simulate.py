"""Tables for simulated communities (OPS-15, AGG-38..40, WIN-12, SRT-5): pools, strains, abundances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def genome_pool(genomes: DataFrame, least: int = 10_000, size: int | None = None, seed: int = 0) -> DataFrame:
    """genome_id (biome_%03d), biome, source_id, sequence, length: long enough, each sequence once (least biome and id), ``size`` a biome at most by hash order."""
    kept = genomes.withColumn("length", F.length("sequence").cast("long")).filter(F.col("length") >= least)
    first = kept.groupBy(F.md5(F.col("sequence").cast("binary")).alias("md5")).agg(F.min(F.struct("biome", "source_id", "sequence", "length")).alias("g")).select("g.*")
    draw = F.row_number().over(Window.partitionBy("biome").orderBy(F.xxhash64("source_id", F.lit(seed)), "source_id"))
    drawn = first.withColumn("_r", draw) if size else first.withColumn("_r", F.lit(1))
    chosen = drawn.filter(F.col("_r") <= (size or 1)).drop("_r")
    number = F.row_number().over(Window.partitionBy("biome").orderBy("source_id"))
    return chosen.withColumn("genome_id", F.format_string("%s_%03d", "biome", number)).select("genome_id", "biome", "source_id", "sequence", "length")


def strains(pool: DataFrame, per_species: int = 2, identity: float = 0.97, seed: int = 0) -> DataFrame:
    """strain_id, species_id, biome, sequence, ani_to_base: copies of each genome with substitutions at a share 1 - identity of its bases.

    A base changes where a hash of its place is small; letters turn by one in ACGT.
    """
    each = pool.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(per_species))))
    turn = lambda c: F.translate(c, "ACGT", "CGTA")
    hit = lambda i: F.pmod(F.xxhash64("genome_id", "s", i, F.lit(seed)), F.lit(1_000_000)) < round((1 - identity) * 1_000_000)
    letters = F.transform(F.split("sequence", ""), lambda c, i: F.when((F.col("s") > 1) & hit(i), turn(c)).otherwise(c))
    made = each.withColumn("mutated", F.array_join(letters, ""))
    same = F.size(F.filter(F.arrays_zip(F.split("sequence", "").alias("x"), F.split("mutated", "").alias("y")), lambda p: p["x"] == p["y"]))
    return made.select(F.format_string("%s_s%d", "genome_id", "s").alias("strain_id"), F.col("genome_id").alias("species_id"), "biome", F.col("mutated").alias("sequence"), (same / F.length("sequence")).alias("ani_to_base"))


def abundances(strain_ids: DataFrame, samples: int, seed: int = 0, sigma: float = 1.0, present: float = 0.8) -> DataFrame:
    """strain, sample, share: log-normal draws, absent in part of the samples, shares of 1 a sample (AGG-39)."""
    each = strain_ids.select(F.col("strain_id").alias("strain"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("strain", "sample", F.lit(seed), F.lit(k)), 11) + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    raw = each.withColumn("x", F.when(u(2) < present, F.exp(sigma * normal)).otherwise(0.0))
    return raw.select("strain", "sample", (F.col("x") / F.greatest(F.sum("x").over(Window.partitionBy("sample")), F.lit(1e-12))).alias("share"))


def depths(abundance: DataFrame, lengths: DataFrame) -> DataFrame:
    """strain, sample, depth: share over length, with a mean of 1 over what is present (AGG-40). Raises on strains without a length."""
    missing = abundance.join(lengths, "strain", "left_anti").select("strain").distinct().limit(3).collect()
    if missing:
        raise ValueError(f"strains without a length: {[r[0] for r in missing]}")
    raw = abundance.join(lengths, "strain").withColumn("d", F.col("share") / F.col("length"))
    return raw.select("strain", "sample", (F.col("d") / F.avg(F.when(F.col("d") > 0, F.col("d"))).over(Window.partitionBy("sample"))).alias("depth"))
