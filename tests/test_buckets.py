"""Neighbours by buckets against brute force: recall, splits, probes, rows that no centre parts."""

import numpy as np
import pytest

from contigbin.operators import buckets, model


def clustered(n=600, groups=12, width=8, seed=1, hot=0.5):
    """Half of all rows lie in one group; some rows are equal."""
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < hot, 0, rng.integers(0, groups, n))
    x = rng.normal(size=(groups, width))[group] + 0.3 * rng.normal(size=(n, width))
    x[:20] = x[0]
    return model.unit_rows(x)[0]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, u array<double>").repartition(4)


def brute(x, queries, k):
    c = np.round(x[queries] @ x.T, 9)
    c[np.arange(len(queries)), queries] = -9
    return {(int(q), int(j)) for q, row in zip(queries, c, strict=True) for j in np.lexsort((np.arange(len(x)), -row))[:k]}


def test_all_probes_are_exact_and_recall_is_measured(spark):
    x = clustered()
    rows = frame(spark, x)
    index = buckets.fit(rows, size=40)
    assert len(index.all) > 12 and len(index.all) == len(index.parent)
    queries = rows.filter("id % 100 = 0")
    want = brute(x, np.arange(0, 600, 100), 5)
    for block in (2048, 64):
        got = {(r["i"], r["j"]) for r in buckets.search(rows, index, 5, 10_000, queries, block).collect()}
        assert got == want
    assert {(r["i"], r["j"]) for r in buckets.exact(rows, queries, 5).collect()} == want
    one = {(r["i"], r["j"]) for r in buckets.search(rows, index, 5, 1, queries).collect()}
    share = buckets.recall(buckets.exact(rows, queries, 5), buckets.search(rows, index, 5, 1, queries))
    assert share == pytest.approx(len(one & want) / len(want)) and share < 1
    probes, reached = buckets.tuned(rows, index, 5, 0.9, start=1)
    assert reached >= 0.9 and probes <= len(index.all)


def test_a_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(buckets, "OVERSIZE", 1)
    rows = frame(spark, clustered(hot=0.8))
    first = buckets.fit(rows, size=100)
    assert len(first.all) > len(first.first) and set(first.parent.tolist()) == set(range(len(first.first)))
    x = clustered(hot=0.8)
    own = first.bucket(x)
    assert np.bincount(own).max() < np.bincount((x @ first.first.T).argmax(1)).max()


def test_equal_rows_and_small_tables(spark):
    same = frame(spark, np.tile([[1.0, 0.0]], (50, 1)))
    index = buckets.fit(same, size=5)
    got = buckets.search(same, index, 3, 2, block=8).collect()
    assert len(got) == 150 and {(r["i"], r["j"]) for r in got} == {(i, j) for i in range(50) for j in [v for v in range(4) if v != i][:3]}
    two = frame(spark, np.eye(2))
    assert buckets.tuned(two, buckets.fit(two), 5)[1] == 1.0
