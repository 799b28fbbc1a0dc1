"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash. A bucket over the byte limit
is split on one more bit until every shard fits. All sizes come from one histogram
of the rows at a prefix a few bits longer than the limit asks for; only prefixes
that are too large even there go on to more bits. Rows that agree in all 60 bits
(repeated keys; one key may hold a third of all rows) are split on the bits of a
hash of their row number, so they fit too. The directory, not the rows, is what
grows with depth; it is joined by broadcast while its counted size allows.

DataFrame expressions only. A row larger than the limit has a shard of its own
(oversize). Null keys and null sizes count as empty and 0. Rows that repeat are rows
of their own. Very long texts count by their size alone. All columns stay, whatever
their names (they travel as one struct), but those named as the result's own (shard,
shard_depth, shard_bytes, shard_rows, oversize) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

BITS = 60
LIMIT = 8 << 20
RESULT = ["shard", "shard_depth", "shard_bytes", "shard_rows", "oversize"]


def hash_bits(key: Column) -> Column:
    """60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _text(node: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(node), depth, F.lit("0")))


def _leaves(rows: DataFrame, bits: int, known: int, limit: int) -> DataFrame:
    """_base, _prefix, depth, bytes, n: of each prefix of ``bits`` bits the shallowest ancestor that fits (null: none)."""
    fine = materialize(rows.groupBy("_base", "_prefix").agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("n")), "histogram")
    up = fine.withColumn("depth", F.explode(F.sequence(F.lit(known), F.lit(bits)))).withColumn("node", F.expr(f"shiftright(_prefix, {bits} - depth)"))
    fits = up.groupBy("_base", "depth", "node").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).filter((F.col("bytes") <= limit) | (F.col("n") == 1))
    best = up.select("_base", "_prefix", "depth", "node").join(fits, ["_base", "depth", "node"]).groupBy("_base", "_prefix").agg(F.min(F.struct("depth", "bytes", "n")).alias("leaf"))
    return materialize(fine.select("_base", "_prefix").join(best, ["_base", "_prefix"], "left").select("_base", "_prefix", F.col("leaf.depth").alias("_depth"), F.col("leaf.bytes").alias("_size"), F.col("leaf.n").alias("_n")), "directory")


def shard(rows: DataFrame, key: Column, size: Column, limit: int = LIMIT, spare_bits: int = 4) -> DataFrame:
    """``rows`` with shard (its prefix bits), shard_depth, shard_bytes, shard_rows, oversize."""
    columns = [c for c in rows.columns if c not in RESULT]
    whole = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None)
    left = rows.select(whole.alias("row"), F.lit(0).cast("long").alias("_base"), F.lit("").alias("_lead"), hash_bits(key.cast("string")).alias("_hash"), F.coalesce(size.cast("long"), F.lit(0)).alias("_bytes"))
    total = left.agg(F.sum("_bytes")).first()[0] or 0
    bits, known, tied, done = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + spare_bits), 0, False, []
    while True:
        left = left.withColumn("_prefix", F.shiftright("_hash", BITS - bits))
        leaves = _leaves(left, bits, known, limit)
        joined = left.join(maybe_broadcast(leaves, leaves.count(), 48), ["_base", "_prefix"])
        node = F.expr(f"shiftright(_prefix, cast({bits} - _depth as int))")
        done.append(joined.filter("_depth IS NOT NULL").select(*(F.col("row")[c].alias(c) for c in columns), F.concat("_lead", _text(node, F.col("_depth"))).alias("shard"), (F.length("_lead") + F.col("_depth")).cast("long").alias("shard_depth"), F.col("_size").alias("shard_bytes"), F.col("_n").alias("shard_rows"), (F.col("_size") > limit).alias("oversize")))
        if not leaves.filter("_depth IS NULL").take(1):
            break
        left = joined.filter("_depth IS NULL").drop("_depth", "_size", "_n")
        if bits < BITS:
            bits, known = min(BITS, bits + 16), bits + 1
        else:  # equal hashes: go on with the bits of a row number, fixed by writing it
            left = materialize(left.withColumn("_row", F.monotonically_increasing_id()), "ties")
            left = left.withColumns({"_base": F.col("_hash"), "_lead": F.concat("_lead", _text(F.col("_hash"), F.lit(BITS))), "_hash": hash_bits(F.col("_row").cast("string"))}).drop("_row")
            bits, known = 16, 1
            if tied:
                raise RuntimeError("row numbers collide")
            tied = True
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
