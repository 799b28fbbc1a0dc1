"""Terminal repeats and the completeness gate (FN-11, PRJ-12, AGG-41, ML-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import direct_repeat, inverted_repeat
from .features import dense_index


def terminal_repeats(contigs: DataFrame, seed: int = 21) -> DataFrame:
    """contig, length, direct_repeat, inverted_repeat."""
    s = F.col("sequence")
    return contigs.select("contig", F.length(s).cast("long").alias("length"), direct_repeat(s, seed).alias("direct_repeat"), inverted_repeat(s, seed).alias("inverted_repeat"))


def gate(repeats: DataFrame, least: int = 20, share: float = 0.20) -> DataFrame:
    """Adds locked: the greater repeat is at least ``least`` and at most ``share`` of the length."""
    r = F.greatest("direct_repeat", "inverted_repeat")
    return repeats.withColumn("locked", (r >= least) & (r <= share * F.col("length")))


def locked_share(gated: DataFrame) -> DataFrame:
    """One row: locked contigs and their share of all (AGG-41)."""
    n = F.count_if("locked")
    return gated.agg(n.alias("locked"), F.round(n / F.greatest(F.count("*"), F.lit(1)), 6).alias("fraction"))


def isolate(labelled: DataFrame) -> DataFrame:
    """contig, bin: locked contigs get labels of their own, then all labels become dense from 0 in their order (ML-15).

    The input is read several times, so it is checkpointed.
    """
    labelled = labelled.select("contig", "label", "locked").checkpoint()
    top = labelled.agg(F.max("label").alias("top"))
    alone = dense_index(labelled.filter("locked"), "contig", "r").join(F.broadcast(top)).select("contig", (F.col("top") + 1 + F.col("r")).alias("label"))
    rest = labelled.filter("NOT locked").select("contig", "label")
    both = rest.union(alone)
    return both.join(dense_index(both.select("label").distinct(), "label", "bin"), "label").select("contig", "bin")


def first_of(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
