"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams (over UTF-8 bytes; A-Z lower-cased, digits
and runs of white space folded) that a text holds, present or absent. For each
feature r = log(p / q), with p and q the smoothed shares of toxic and other
training texts that hold it; the FEATURES whose r is most standard errors away from
0 stay, Z_MIN at least. A logistic regression is then trained on the vectors
scaled by r and brought to unit length. Only labelled rows whose crc32(doc_id as
text) mod ``folds`` is not ``fold`` take part in training.

The model is fitted on at most FIT_ROWS labelled documents (those of least hash of
doc_id; all up to that bound). Their texts are found by a broadcast of their
ids, whose size that bound proves. Everything sent to the driver is bounded by it
and by FEATURES: two bytes a feature that a document holds, so 8 KB a document at most.
Scoring reads every whole text, very long ones too.

Null and empty texts hold no feature: the bias alone makes their score. With no
training row of either class every score is 0.5. Labels other than 0 and 1 are
left out, and so are doc_ids with both. Of rows that repeat a labelled doc_id one
counts in training, that of the least text; all are scored, as are rows without a
doc_id. The columns used are doc_id, text and the label; others are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, columns, materialize, mix, powers, slices, utf8

BITS = 20
SIZES = (4, 5, 6, 7)
FIT_ROWS = 20_000
FEATURES = 4_096
Z_MIN = 3.0
MIN_TEXTS = 3
EPOCHS = 60

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48
_POWERS = {size: powers(0x9E3779B97F4A7C15 + 2 * size, size + 1)[1:] for size in range(1, 17)}


def grams(data: np.ndarray, bits: int = BITS, sizes: tuple = SIZES) -> np.ndarray:
    """Hashed n-grams of one text's bytes, padded by a blank on either side; repeated as they occur."""
    folded = np.full(len(data) + 2, 32, np.uint8)
    folded[1:-1] = _FOLD[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    x = folded[keep].astype(np.uint64) + np.uint64(1)
    out = []
    for size in sizes:
        n = len(x) - size + 1
        if n > 0:
            h = x[:n] * _POWERS[size][0]
            for k in range(1, size):
                h += x[k : k + n] * _POWERS[size][k]
            out.append((mix(h) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _texts(batch: pa.RecordBatch):
    """The bytes of each text, in order."""
    for part in slices(batch, "text"):
        data, offsets = utf8(part.column(part.schema.get_field_index("text")))
        for i in range(part.num_rows):
            yield data[offsets[i] : offsets[i + 1]]


def held_out(doc_id, folds: int = 5, fold: int = 0):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, fit_rows: int) -> DataFrame:
    """y, text of at most ``fit_rows`` labelled documents, one row each."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType())])
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(spark.createDataFrame(chosen, schema)), "doc_id")
    # one row a document; written once, as it is read twice
    return materialize(found.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("y", "text"), "training")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, bits: int = BITS, fit_rows: int = FIT_ROWS, z_min: float = Z_MIN) -> dict:
    """The model: ratio r and weight (scaled by r) of each feature, and the bias."""
    n_features = 1 << bits
    train = training_rows(bounded_batches(docs), labels, label, folds, fold, fit_rows)
    context = docs.sparkSession.sparkContext

    def tally(batches):
        """Of each task: the texts of either class that hold a feature (the last: all texts)."""
        counts = np.zeros((2, n_features + 1), np.int32)
        for batch in batches:
            for y, data in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
                counts[y, np.unique(grams(data, bits))] += 1
                counts[y, -1] += 1
        used = np.flatnonzero(counts.any(0))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used], pa.int64()), pa.array(counts[1, used], pa.int64())], names=["f", "q", "p"])

    # one row a feature at most; those of fewer than MIN_TEXTS texts are never selected
    sums = columns(train.mapInArrow(tally, "f long, q long, p long").groupBy("f").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).filter(f"p + q >= {MIN_TEXTS} OR f = {n_features}"))
    counts = np.zeros((2, n_features + 1))
    counts[0, sums["f"]], counts[1, sums["f"]] = sums["q"], sums["p"]
    none = {"ratio": np.zeros(n_features, np.float32), "weights": np.zeros(n_features, np.float32), "bias": 0.0, "bits": bits}
    if not counts[0, -1] or not counts[1, -1]:
        return none
    q, p = counts[:, :-1] + 0.5
    r = select(np.log(p / (counts[1, -1] + 1)) - np.log(q / (counts[0, -1] + 1)), p, q, z_min)
    ratio = context.broadcast(r.astype(np.float32))
    used = np.flatnonzero(r)  # FEATURES at most, but for ties
    width = np.uint16 if len(used) <= 1 << 16 else np.int32

    def vectors(batches):
        kept = ratio.value != 0
        place = np.cumsum(kept) - 1
        for batch in batches:
            rows = [np.unique(place[g[kept[g]]]).astype(width).tobytes() for g in (grams(x, bits) for x in _texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["y", "f"])

    got = sorted(train.mapInArrow(vectors, "y int, f binary").collect())
    return none | {"ratio": r.astype(np.float32)} | regress([used[np.frombuffer(x["f"], width)] for x in got], np.array([x["y"] for x in got], np.float64), r)


def select(r: np.ndarray, p: np.ndarray, q: np.ndarray, z_min: float) -> np.ndarray:
    """r of the features that tell most; 0 for the others."""
    z = np.where(p + q >= MIN_TEXTS + 1, np.abs(r) / np.sqrt(1 / p + 1 / q), 0)
    least = max(z_min, np.partition(z, -FEATURES)[-FEATURES] if len(z) > FEATURES else 0)
    return np.where(z >= least, r, 0)


def regress(xs: list, ys: np.ndarray, r: np.ndarray, epochs: int = EPOCHS, l2: float = 1e-3, rows: int = 1000) -> dict:
    """Logistic regression (Adam, full batch) on rows scaled by r and brought to unit length; classes weigh alike."""
    used = np.flatnonzero(r)
    at = np.zeros(len(r), np.int32)
    at[used] = np.arange(len(used))
    blocks = []
    for k in range(0, len(xs), rows):
        flat = np.concatenate(xs[k : k + rows])
        row = np.repeat(np.arange(len(xs[k : k + rows]), dtype=np.int32), [len(x) for x in xs[k : k + rows]])
        norm = np.sqrt(np.bincount(row, r[flat] ** 2, len(xs[k : k + rows]))) + 1e-9
        blocks.append((at[flat], row, (r[flat] / norm[row]).astype(np.float32), ys[k : k + rows]))
    weigh = 0.5 / max(1, (ys == 0).sum()), 0.5 / max(1, (ys == 1).sum())
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, epochs + 1):
        g = np.append(l2 / max(1, len(used)) * w, 0.0)
        for f, row, value, y in blocks:
            d = (1 / (1 + np.exp(-np.bincount(row, value * w[f], len(y)) - b)) - y) * np.where(y == 1, weigh[1], weigh[0])
            g[:-1] += np.bincount(f, value * d[row], len(used))
            g[-1] += d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        change = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - change[:-1], b - change[-1]
    weights = np.zeros(len(r), np.float32)
    weights[used] = w * r[used]
    return {"weights": weights, "bias": float(b)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score: the probability of label 1 for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        weights, ratio, bias, bits = model["weights"], model["ratio"].astype(np.float64), model["bias"], model["bits"]
        kept = ratio != 0
        for batch in batches:
            out = []
            for data in _texts(batch):
                g = grams(data, bits)
                f = np.unique(g[kept[g]])
                z = bias + float(weights[f].sum(dtype=np.float64)) / (np.sqrt((ratio[f] ** 2).sum()) + 1e-9)
                out.append(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score(docs, fit(docs, labels, folds=folds, fold=fold, **how))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
