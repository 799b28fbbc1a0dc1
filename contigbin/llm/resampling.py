"""Quality classifier by importance resampling.

Target texts (labelled rows of the wanted value) and all raw texts each give a
generative model: the smoothed shares of hashed word unigrams and bigrams in
BUCKETS buckets, counted over all documents. A text's log importance weight is the
sum over its n-grams of log(target / raw): the ratio of the two models' likelihoods of
the whole text. (``per_grams`` = n, off by default, takes n times the mean instead,
which puts long and short texts on one scale.) Gumbel noise from a hash of doc_id and ``seed`` is added,
and the rows of the ``share`` greatest keys are kept: sampling without replacement in
proportion to the weights.

The k-th greatest key is found by counting keys in ever finer buckets, a fixed
number of counts a round; nothing is sorted and no row is sent to the driver but
the last few thousand keys. Ties at the threshold are kept together.

A text without words has log weight 0. Null text counts as empty; very long texts are
read whole. Without target rows all log weights are 0. Rows that repeat a doc_id (or
have none) are rows of their own that draw the same noise. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns, materialize, maybe_broadcast, shingle_hashes, slices, utf8, word_hashes

BUCKETS = 10_000
SHARE = 0.8
REFINE = 4_096


def _ngrams(column: pa.Array):
    """Buckets of each text's unigrams and bigrams."""
    words, first = word_hashes(*utf8(column))
    one = ((words >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)
    two = ((shingle_hashes(words, 2) >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.concatenate([one[a:b], two[a : max(a, b - 1)]])


def models(docs: DataFrame, labels: DataFrame, label: str, value: int) -> np.ndarray:
    """log(target / raw) of each bucket."""
    wanted = materialize(labels.filter(F.col(label) == value).select(F.col("doc_id").cast("long")).distinct().withColumn("target", F.lit(True)), "targets")
    marked = bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").join(maybe_broadcast(wanted, wanted.count(), 24), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def tally(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for grams, target in zip(_ngrams(part.column(0)), part.column(1).to_pylist(), strict=True):
                    n = np.bincount(grams, minlength=BUCKETS)
                    counts[0] += n
                    if target:
                        counts[1] += n
        used = np.flatnonzero(counts.any(0))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["g", "raw", "target"])

    # BUCKETS rows at most
    sums = columns(marked.mapInArrow(tally, "g long, raw long, target long").groupBy("g").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[sums["g"]] += sums["raw"]
    target[sums["g"]] += sums["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return ratio if sums["target"].sum() else np.zeros(BUCKETS)


def weigh(docs: DataFrame, ratio: np.ndarray, per_grams: float | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        ratio = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                sums = [(len(g), float(ratio[g].sum())) for g in _ngrams(part.column(1))]
                rows = [(n, x if per_grams is None else per_grams * x / max(n, 1)) for n, x in sums]
                n, w = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["doc_id", "n_grams", "log_weight"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def kth_greatest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th greatest value of a column of doubles, exactly."""
    key = F.col(column)
    while True:
        low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
        if not n or k < 1:
            return None
        if low == high or n <= REFINE:
            values = sorted((r[0] for r in rows.select(column).collect()), reverse=True) if low != high else None
            return values[min(k, n) - 1] if values else low
        bucket = F.least(F.floor((key - low) / (high - low) * REFINE), F.lit(REFINE - 1))
        counts = sorted(((r[0], r[1]) for r in rows.groupBy(bucket.alias("b")).count().collect()), reverse=True)
        for b, n in counts:
            if k <= n:
                break
            k -= n
        rows = rows.filter(bucket == b)


def resample(docs: DataFrame, labels: DataFrame, label: str = "quality", value: int = 1, share: float = SHARE, seed: int = 7, per_grams: float | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept: one row a document."""
    weighed = weigh(docs, models(docs, labels, label, value), per_grams)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + 0.5) / float(1 << 53)
    keyed = materialize(weighed.withColumn("key", F.col("log_weight") - F.ln(-F.ln(uniform))), "weights")
    least = kth_greatest(keyed, "key", round(share * keyed.count()))
    return keyed.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least)
