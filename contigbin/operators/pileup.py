"""Depth along coordinates by difference arrays over tiles (SRC-16, AGG-12, PRJ-6, AGG-8, WIN-7).

A span adds one at its start and takes one off at its end. Such events move once, by group and
tile, and are summed by position; each tile of TILE positions is run through alone, from the depth
that the tiles before it leave. A target with a large share of all spans is thus many
tasks, and a task holds TILE events at most, however many spans there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import dealt, fresh

TILE = 1 << 16
#: Reads that don't count: unmapped, secondary, failing checks, duplicate, supplementary.
UNUSED = 0xF04


def usable(blocks: DataFrame, least_quality: int = 0) -> DataFrame:
    """The aligned blocks that count (flag, quality)."""
    return blocks.filter((F.col("flag").bitwiseAND(UNUSED) == 0) & (F.col("quality") >= least_quality))


def depth_runs(spans: DataFrame, *by: str, tile: int = TILE) -> DataFrame:
    """by.., start, end, depth: runs of positions of one depth between the first start and the last end of half-open spans (start, end).

    Runs are cut at tile borders and not merged. Empty spans add nothing, but their group has a run (of length 0). Null keys are keys.
    """
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    sign = F.when(end > start, 1).otherwise(0).cast("long")
    event = lambda pos, d: F.struct(pos.alias("pos"), d.alias("d"))
    ends = spans.select(F.struct(*by).alias("key"), F.explode(F.array(event(start, sign), event(F.greatest(start, end), -sign))).alias("e"))
    placed = dealt(ends.select("key", F.floor(F.col("e.pos") / tile).alias("tile"), "e.pos", "e.d"), "key", "tile")
    events = placed.groupBy("key", "tile", "pos").agg(F.sum("d").alias("d"))
    across, inside = Window.partitionBy("key").orderBy("tile"), Window.partitionBy("key", "tile").orderBy("pos")
    tiles = events.groupBy("key", "tile").agg(F.sum("d").alias("d"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("d").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = tiles.select("key", "tile", "first", before.alias("carry"), F.lead("tile").over(across).alias("next"))
    placed = events.join(carried, ["key", "tile"])
    depth = F.col("carry") + F.sum("d").over(inside)
    upto = F.coalesce(F.lead("pos").over(inside), F.col("next") * tile, F.col("pos"))
    runs = placed.select("key", F.col("pos").alias("start"), upto.alias("end"), depth.alias("depth"))
    heads = carried.filter("carry <> 0").select("key", (F.col("tile") * tile).alias("start"), F.col("first").alias("end"), F.col("carry").alias("depth"))
    return runs.union(heads).select("key.*", "start", "end", "depth")


def interval_union(spans: DataFrame, *by: str, tile: int = TILE) -> DataFrame:
    """by.., covered: length of the union of half-open spans (start, end); touching spans merge (AGG-8).

    Spans are cut at tile borders, so that covers of tiles add up and rows move once, by group and tile; of equal starts a task holds the longest alone.
    """
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    real = F.coalesce(end > start, F.lit(False))  # others add nothing, but their group has a row
    whole = spans.select(*by, F.when(real, start).otherwise(0).alias("start"), F.when(real, end).otherwise(0).alias("end"))
    tiles = F.sequence(F.floor(F.col("start") / tile), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / tile))
    cut = whole.withColumn("tile", F.explode(tiles)).withColumns({"start": F.greatest("start", F.col("tile") * tile), "end": F.least("end", (F.col("tile") + 1) * tile)})
    longest = dealt(cut, *by, "tile").groupBy(*by, "tile", "start").agg(F.max("end").alias("end"))
    own = longest.select(*by, fresh(F.col("start"), F.col("end"), *by, "tile").alias("f"))
    return own.groupBy(*by).agg(F.sum(F.col("f.end") - F.col("f.start")).cast("long").alias("covered"))


def depth_summary(blocks: DataFrame, lengths: DataFrame, least_quality: int = 0, tile: int = TILE) -> DataFrame:
    """contig, sample, length, depth (mean by base), zero_share, deepest (SRC-16, AGG-12). ``blocks``: contig, sample, start, end, flag, quality.

    Blocks are cut to the contig (``lengths``: contig, length); contigs without a length and pairs without a usable block have no row.
    """
    own = usable(blocks, least_quality).join(lengths.select("contig", "length"), "contig")
    cut = own.select("contig", "sample", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "length").alias("end"))
    runs, size = depth_runs(cut, "contig", "sample", tile=tile), F.col("end") - F.col("start")
    sums = runs.groupBy("contig", "sample").agg(F.sum(F.col("depth") * size).alias("bases"), F.sum(F.when(F.col("depth") > 0, size).otherwise(0)).alias("covered"), F.max(F.when(size > 0, F.col("depth")).otherwise(0)).alias("deepest"))
    n = F.greatest(F.col("length"), F.lit(1))
    return sums.join(lengths.select("contig", "length"), "contig").select("contig", "sample", "length", (F.col("bases") / n).alias("depth"), (1 - F.col("covered") / n).alias("zero_share"), "deepest")
