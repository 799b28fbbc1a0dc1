"""Weights, scores and ranks against a brute-force version, for single words and longer runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from cases import DOCS, documents, lower
from pyspark.sql import functions as F

from contigbin.llm import target_resampling

ROWS = documents()
TARGET = [(k, ROWS[k][1]) for k in (2, 3, 5, 7)] + [(90, None), (91, "Ka lo, KA-lo éñ 12")]


def features(text, n):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
    return w, [" ".join(w[k : k + m]) for m in range(1, n + 1) for k in range(len(w) - m + 1)]


def brute(rows, target, n=1, buckets=10_000, seed=2024, share=10, least=20):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = Counter(), Counter()
    for _, text, *_ in rows:
        raw.update(map(of, features(text, n)[1]))
    for _, text in target:
        wanted.update(map(of, features(text, n)[1]))
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (raw.total() + buckets) / ((raw[b] + 1) * (wanted.total() + buckets))))
    out, ranked = [], []
    for doc, text, *_ in rows:
        w, f = features(text, n)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if len(w) >= least:
            ranked.append((-score, doc is not None, doc, len(f), weight, len(out)))
        out.append([doc, len(f), weight, score, None])
    for rank, r in enumerate(sorted(ranked)[: share * len(ranked) // 100], 1):
        out[r[-1]][4] = rank
    return sorted(map(str, out))


def result(spark, rows, target, **options):
    clashing = {c: F.lit(f"own {c}") for c in ("id", "target", "part", "word", "score", "rank", "n_words", "a.b")}
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumns(clashing)
    got = target_resampling.resample(docs, spark.createDataFrame(target, "item_id long, text string").withColumn("id", F.lit(1)), **options).collect()
    return sorted(str([r[c] for c in ("id", "n_features", "weight", "score", "rank")]) for r in got)


@pytest.mark.parametrize("options", [{}, {"n": 3, "share": 50}, {"n": 2, "buckets": 7, "share": 100, "least": 1}])
def test_equals_brute_force(spark, options):
    named = {{"least": "least_words"}.get(k, k): v for k, v in options.items()}
    assert result(spark, ROWS, TARGET, **named) == brute(ROWS, TARGET, **options)


def test_many_parts_give_the_same(spark, monkeypatch):
    want = result(spark, ROWS, TARGET, n=2)
    monkeypatch.setattr(target_resampling, "PART", 500)
    assert result(spark, ROWS, TARGET, n=2) == want == brute(ROWS, TARGET, n=2)


def test_awkward_rows(spark):
    text = " ".join(f"Word{k % 9}" for k in range(40))
    rows = [(7, text, "en", "x", 1), (7, text, "en", "x", 1), (7, text + " é", "en", "x", 1), (None, text, None, None, None), (8, None, "en", "x", 0), (9, "  - \x7f", "en", "x", 3), (10, "tie " * 50_000, "en", "x", 0)]
    assert result(spark, rows, TARGET, share=70) == brute(rows, TARGET, share=70)
    assert result(spark, rows, [], share=70) == brute(rows, [], share=70)
    assert result(spark, [], TARGET) == []


def test_draw_prefers_the_target(spark):
    rng = random.Random(4)
    vocabulary = {"good": [f"good{k}" for k in range(40)], "bad": [f"bad{k}" for k in range(400)]}
    rows = [(k, " ".join(rng.choices(vocabulary["good" if k % 4 == 0 else "bad"], k=60)), "", "", 0) for k in range(400)]
    target = [(k, " ".join(rng.choices(vocabulary["good"], k=60))) for k in range(40)]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame(target, "item_id long, text string")
    chosen = [r["id"] for r in target_resampling.resample(docs, items).filter("rank is not null").collect()]
    assert len(chosen) == 40 and sum(k % 4 == 0 for k in chosen) >= 30  # 10 by chance
