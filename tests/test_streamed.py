"""Steps that read rows past what a task holds: the same results as joins, from files that grow with the rows."""

from pathlib import Path

import numpy as np

from contigbin.operators import model, training
from contigbin.sources.store import Tables


def written(tables: Tables) -> int:
    return sum(f.stat().st_size for path in tables.paths for f in Path(path.removeprefix("file:")).rglob("*.parquet"))


def test_files_of_parts_do_not_grow_with_the_parts(spark):
    """Before, every part was written with the vectors of all neighbours of its neighbours: here five copies of the table."""
    n, width = 100, 300
    x = model.unit_rows(np.random.default_rng(4).normal(size=(n, width)))[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, u array<double>")
    links = spark.createDataFrame([(i, (i + k) % n) for i in range(n) for k in (1, 7, 31)], "src long, dst long")
    of = Tables(spark, "parts")
    parts = training.parts_of(rows, links, 0, size=20, of=of)
    assert parts.count() >= 4 and written(of) < 2 * x.nbytes
    of.drop()


def test_dots_of_pairs_are_those_of_their_rows(spark):
    from contigbin.operators import streamed

    rng = np.random.default_rng(6)
    x, pairs = rng.normal(size=(50, 5)), rng.integers(0, 60, (700, 2))  # rows 50 to 59 are missing
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, u array<double>").repartition(3)
    given = spark.createDataFrame([(int(i), int(j), k) for k, (i, j) in enumerate(pairs)], "src long, dst long, k long")
    views, tables = Tables(spark, "views"), Tables(spark, "dots")
    held = streamed.files(streamed.kept(rows, views))
    for most in (streamed.PAIRS, 40):
        got = {r["k"]: r["c"] for r in streamed.pair_dots(given, {"c": held}, tables, most).collect()}
        assert len(got) == 700
        for k, (i, j) in enumerate(pairs):
            assert got[k] is None if max(i, j) >= 50 else abs(got[k] - x[i] @ x[j]) < 1e-12
    for own in (views, tables):
        own.drop()
