"""Approximate neighbours by buckets, with a measured recall (JN-10).

Centres are fitted on a sample of SAMPLE rows at most; every row goes to the bucket of
its nearest centre, and a bucket of more than OVERSIZE times the mean is split by centres
fitted on a sample of its own. A row is compared with the rows of the ``probes`` buckets whose centres are
nearest to it. Rows are written once, bucket by bucket, and tasks that hold a block of queries read them past these, so that no row
is copied for the queries that ask for its bucket, and rows that no centre can part are still searched whole. How many probes are needed depends on the data: ``tuned`` doubles them
until the recall of a sample of queries against all rows is reached.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Tables
from . import neighbours, streamed

SAMPLE, CENTRES, ROWS, OVERSIZE = 32_768, 2_048, 500, 3
#: Oversized buckets are split in one round, so many at most, the largest first, each by a sample of SUB rows.
SPLIT, SUB = 64, 512
QUERIES, RECALL = 500, 0.9


def centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centres of unit rows, by spherical k-means from distinct rows."""
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        sums = np.zeros_like(c)
        np.add.at(sums, (x @ c.T).argmax(1), x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


class Index:
    """Centres of the buckets; ``first`` are those of the first fit, ``parent`` says which of them each bucket lies in."""

    def __init__(self, first: np.ndarray):
        self.first, self.all, self.parent = first, first, np.arange(len(first))

    def bucket(self, x: np.ndarray) -> np.ndarray:
        own, found = (x @ self.first.T).argmax(1), np.zeros(len(x), np.int64)
        for p in np.unique(own):
            inside, rows = np.flatnonzero(self.parent == p), own == p
            found[rows] = inside[(x[rows] @ self.all[inside].T).argmax(1)]
        return found

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(x @ self.all.T), axis=1, kind="stable")[:, :probes]

    def split(self, own: dict[int, np.ndarray], k: int, seed: int) -> Index:
        """With the buckets ``own`` (rows of each) parted into k."""
        keep = [p for p in range(len(self.first)) if p not in own]
        made = [(p, centres(rows, k, seed)) for p, rows in own.items()]
        out = Index(self.first)
        out.all = np.concatenate([self.first[keep], *(c for _, c in made)])
        out.parent = np.concatenate([np.array(keep, int), *(np.full(len(c), p) for p, c in made)])
        return out


def _matrix(rows: DataFrame) -> np.ndarray:
    """The vectors of a bounded sample."""
    u = rows.select("u").toArrow()["u"].combine_chunks()
    return np.asarray(u.flatten()).reshape(len(u), -1).astype(float) if len(u) else np.zeros((0, 1))


def _dealt(rows: DataFrame, of, name: str, kind: str) -> DataFrame:
    """``rows`` (id, u) with a column that ``of`` gives for a batch of vectors."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                x = np.asarray(piece.column("u").flatten()).reshape(piece.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([*piece.columns, of(x)], names=["id", "u", name])

    return rows.select("id", "u").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, u array<double>, {name} {kind}")


def fit(rows: DataFrame, seed: int = 0, sample: int = SAMPLE, most: int = CENTRES, size: int = ROWS) -> Index:
    """The index of ``rows`` (id, u: unit rows)."""
    n = rows.count()
    by = F.xxhash64("id", F.lit(seed))
    share = min(1.0, 1.5 * sample / max(n, 1))  # of the hashes, so that the sort below takes few rows
    some = rows.select("id", "u").filter(F.pmod(by, F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy(by, "id").limit(sample)
    first = Index(centres(_matrix(some), max(1, min(most, math.ceil(n / size))), seed))
    parents = _dealt(rows, lambda x: pa.array(first.bucket(x)), "bucket", "long")
    counts = {r["bucket"]: r["count"] for r in parents.groupBy("bucket").count().collect()}  # ``most`` rows at most
    large = sorted((p for p, c in counts.items() if c > OVERSIZE * max(size, n / max(len(first.all), 1))), key=lambda p: -counts[p])[:SPLIT]
    if not large:
        return first
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(by, "id"))
    thin = parents.filter(F.col("bucket").isin(large)).withColumn("_share", F.element_at(F.create_map(*(F.lit(v) for p in large for v in (p, min(1.0, 2.0 * SUB / counts[p])))), F.col("bucket")))
    thin = thin.filter(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)).withColumn("r", rank).filter(F.col("r") <= SUB)
    own = {p: _matrix(thin.filter(F.col("bucket") == p)) for p in large}
    parted = {p: x for p, x in own.items() if len(np.unique(x, axis=0)) > 1}
    return first.split(parted, min(32, max(2, math.ceil(max(counts.values()) / size))), seed) if parted else first


def dealt(rows: DataFrame, index: Index, tables: Tables) -> DataFrame:
    """id, u, bucket of ``rows`` in files, a bucket's rows together."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    have = _dealt(rows.select(F.col("id").cast("long").alias("id"), "u").na.drop(), lambda x: pa.array(shared.value.bucket(x)), "bucket", "long")
    return tables.keep(have.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id"), **{"parquet.block.size": 8 << 20})


def search(rows: DataFrame, index: Index, k: int, probes: int, queries: DataFrame | None = None, block: int = neighbours.MOST, table: DataFrame | None = None, of: Tables | None = None) -> DataFrame:
    """i, j, cosine, rank: of each query (all rows, if none are given) the k most similar other rows of its probed buckets; ties by id.

    ``block``: queries of a task at most; ``table``: ``rows`` as ``dealt``, if they are written already; ``of``: the tables that the result goes with.
    """
    spark, own = rows.sparkSession, Tables(rows.sparkSession, "buckets")
    probes = min(probes, len(index.all))
    table = dealt(rows, index, own) if table is None else table
    asked = table if queries is None else own.keep(queries.select(F.col("id").cast("long").alias("id"), "u").na.drop())
    counts = sorted((r[0], r[1]) for r in asked.groupBy("_metadata.file_path").count().collect())
    size = min(block, max(neighbours.LEAST, math.ceil(sum(n for _, n in counts) / neighbours.TASKS)))
    tasks = [piece for (piece,) in neighbours._cut([(path, 0, n) for path, n in counts], size)]
    shared, paths = spark.sparkContext.broadcast(index), streamed.files(table)

    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                ids, ask = (np.concatenate(x) for x in zip(*neighbours._read(tasks[task], neighbours.BLOCK, ["id", "u"]), strict=True))
                cosine, near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
                wants = np.zeros((len(ids), len(shared.value.all)), bool)
                for at in range(0, len(ids), neighbours.AT_ONCE):
                    part = slice(at, at + neighbours.AT_ONCE)
                    np.put_along_axis(wants[part], shared.value.nearest(ask[part], probes), True, axis=1)
                for have, x, bucket in streamed.batches(paths, ("id", "u", "bucket"), neighbours.BLOCK):
                    ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
                    for start, end in zip([0, *ends[:-1]], ends, strict=True):
                        some = np.flatnonzero(wants[:, bucket[start]])
                        if len(some):
                            c, j = cosine[some], near[some]
                            neighbours.merged(c, j, ask[some], ids[some], x[start:end], have[start:end])
                            cosine[some], near[some] = c, j
                row, col = np.nonzero(np.isfinite(cosine))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], near[row, col], cosine[row, col], col + 1)], names=["i", "j", "cosine", "rank"])

    of = Tables(spark, "found") if of is None else of
    found = of.keep(spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, "i long, j long, cosine double, rank long"))
    own.drop()
    return found


def recall(exact: DataFrame, found: DataFrame) -> float:
    """Share of the pairs (i, j) of ``exact`` that are in ``found``; 1 if there are none."""
    hit = exact.select("i", "j").join(found.select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return hit["hit"] / hit["n"] if hit["n"] else 1.0


def exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """i, j, cosine, rank of the queries against all rows, by brute force in blocks."""
    return search(rows, Index(np.zeros((1, len(rows.select("u").first()["u"])))), k, 1, queries)


def tuned(rows: DataFrame, index: Index, k: int, least: float = RECALL, queries: DataFrame | None = None, start: int = 4, table: DataFrame | None = None) -> tuple[int, float]:
    """The first of start, 2 start, .. probes that reaches the recall, and the recall. ``queries``: QUERIES rows of least hash, if none are given; ``table``: as in ``search``."""
    tables, held = Tables(rows.sparkSession, "recall"), Tables(rows.sparkSession, "buckets")
    table = dealt(rows, index, held) if table is None else table
    by = F.xxhash64("id", F.lit(2))
    queries = tables.keep((table.orderBy(by, "id").limit(QUERIES) if queries is None else queries).select("id", "u"))
    share, probes = 1.0, 1
    if queries.take(1):
        truth, probes = search(rows, index, k, len(index.all), queries, table=table, of=tables), start
        while (share := recall(truth, search(rows, index, k, probes, queries, table=table, of=tables))) < least and probes < len(index.all):
            probes *= 2
    for own in (tables, held):
        own.drop()
    return min(probes, len(index.all)), share
