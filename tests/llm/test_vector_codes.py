"""Codes, errors and codebooks against a brute-force version; what the rounds shuffle; awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigbin.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=2, parts=16, entries=64):
    """vec_id -> [(code, error, label)], and the codebooks' hash. ``rows`` without any to be dropped."""
    data = sorted(([i, [math.floor(256 * float(np.float32(x))) for x in v], label] for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(data[0][1]) // parts
    books = [[v[p * width : (p + 1) * width] for _, v, _ in data[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in data:
            cut = [v[p * width : (p + 1) * width] for p in range(parts)]
            out.append([min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(books[p])) for p, x in enumerate(cut)])
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * width : (p + 1) * width] for (_, v, _), c in zip(data, codes, strict=True) if c[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = assign()
    of = [("".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for c in codes]
    by_label = {}
    for (_, _, label), (_, e) in zip(data, of, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), code, e, by_label[label], digest) for (i, _, label), (code, e) in zip(data, of, strict=True))


def vectors(n, dim=32, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(20)]
    return [(k * 3 % 1009, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([0, 0, 0, 1, 2, None])) for k in range(n)]


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("own") for c in ("id", "v", "code", "error", "old", "part", "entry", "a.b")})
    got = vector_codes.compress(df, **options).collect()
    return sorted((str(r["id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got)


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_equals_brute_force(spark, rounds):
    rows = vectors(300)
    assert result(spark, rows, rounds=rounds) == brute(rows, rounds)


def test_awkward_rows(spark):
    """Dropped rows, repeated and null ids, ties, other lengths, few vectors."""
    rows = [*vectors(90), (1, vectors(1, seed=9)[0][1], 4), (None, vectors(1, seed=8)[0][1], None)]
    rows += [(k, [v] * 32, 3) for k, v in ((2001, 0.0), (2002, 0.0), (2003, -0.5))]
    gone = [(5, None, 1), (6, [], 1), (7, [0.1] * 31, 1), (8, [0.1] * 31 + [None], 1), (9, [float("nan")] * 32, 1), (0, [float("inf")] * 32, 2), (-1, [1e30] * 32, 2)]
    assert result(spark, rows + gone) == brute(rows)
    assert result(spark, rows[:7] + gone) == brute(rows[:7])
    assert result(spark, []) == [] == result(spark, gone[:2])


def test_lengths_that_parts_do_not_divide_are_filled_with_zeros(spark):
    rows = vectors(80, dim=27)
    assert result(spark, rows) == brute([(i, v + [0.0] * 5, label) for i, v, label in rows])


def test_large_components_are_exact(spark):
    rows = [(k, [float((k * 7919 + j * 104729) % 200_000 - 100_000) for j in range(32)], k % 2) for k in range(100)]
    assert result(spark, rows) == brute(rows)


def test_rounds_shuffle_changed_parts_only_and_keep_sums(spark):
    df = spark.createDataFrame(vectors(300), SCHEMA)
    state = vector_codes.start(df)
    for _ in range(2):
        before, state = state, vector_codes.advance(state)
    width = state.books.shape[2]
    again = vector_codes.assign(state.rows, before.books)
    assert again.filter("old != code").count() == 0 and vector_codes.changes(again, 16, width).count() == 0
    assert state.counts.sum(1).tolist() == [300] * 16
    full = vector_codes.changes(again.withColumn("old", F.lit(None).cast("array<int>")), 16, width).collect()
    assert {(r["part"], r["entry"]): list(r[2:]) for r in full} == {(p, k): [state.counts[p, k], *state.sums[p, k]] for p in range(16) for k in range(64) if state.counts[p, k]}


def test_labels_beyond_the_broadcast_ones_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_LABELS", 3)
    rows = vectors(120)
    assert result(spark, rows) == brute(rows)
