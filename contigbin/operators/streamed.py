"""Rows in files that tasks read past what they hold: dot products of pairs, and sums over links.

A join moves a row once for each of its pairs or links. Here the rows are written once, to the folder that all
executors share; a task holds a bounded number of pairs (or of nodes with their links) and reads the
rows in batches, so disk grows with the rows and with the pairs, not with pairs times the length of a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.store import Tables, open_store

#: Pairs that a task holds, rows of a batch, and pairs (or links) that are worked out at once.
PAIRS, BATCH, AT_ONCE = 1 << 18, 2048, 1 << 14
#: Nodes whose links a task holds.
NODES = 8192


def kept(rows: DataFrame, tables: Tables) -> DataFrame:
    """``rows`` (id, u) in files, those without a vector aside."""
    return tables.keep(rows.select(F.col("id").cast("long").alias("id"), "u").filter(F.col("u").isNotNull() & ~F.exists("u", F.isnull)))


def files(table: DataFrame) -> list[str]:
    """The files of a table that ``Tables`` has written."""
    return sorted(table.inputFiles())


def batches(paths: list[str], columns: tuple[str, ...], size: int = BATCH, ragged: tuple[str, ...] = ()):
    """The columns of each batch of rows: numbers as an array, vectors as a matrix, the lists ``ragged`` as they are."""
    from pyarrow import parquet

    for path in paths:
        store, name = open_store(path)
        with store.open_input_file(name) as source:
            for batch in parquet.ParquetFile(source).iter_batches(size, columns=list(columns), use_threads=False):
                if batch.num_rows:
                    yield [batch.column(c) if c in ragged else _array(batch.column(c)) for c in columns]


def _array(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def met(ordered: np.ndarray, order: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (by ``order``) of the values of ``ordered`` that are in ``have``, and where they are there."""
    low, high = (np.searchsorted(ordered, have, side) for side in ("left", "right"))
    n = high - low
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
    return order[at], np.repeat(np.arange(len(have)), n)


def placed(ids: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ids`` (in order, each once) of those ids that are in ``have``, and which of ``have`` they are."""
    if not len(ids):
        return np.zeros(0, int), np.zeros(0, int)
    at = np.minimum(np.searchsorted(ids, have), len(ids) - 1)
    hit = ids[at] == have
    return at[hit], np.flatnonzero(hit)


def _tasks(rows: DataFrame, n: int, most: int, least: int) -> int:
    return max(1, math.ceil(n / most), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / least)))


def pair_dots(pairs: DataFrame, views: dict[str, list[str]], tables: Tables, most: int = PAIRS) -> DataFrame:
    """``pairs`` (src, dst and other columns) with the dot product of their rows in each view, given by its files; null where a row is missing.

    The result goes with ``tables``. Products are added in the order of the dimensions, as ``functions.vectors.dot`` adds them.
    """

    def dotted(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        src, dst = (table.column(c).to_numpy() for c in ("src", "dst"))
        order = np.argsort(dst, kind="stable")
        turned, (ids, at) = dst[order], np.unique(src, return_inverse=True)
        for name, paths in views.items():
            rows, there = None, np.zeros(len(ids), bool)
            for have, u in batches(paths, ("id", "u")):
                rows = np.zeros((len(ids), u.shape[1])) if rows is None else rows
                to, of = placed(ids, have)
                rows[to], there[to] = u[of], True
            dots, known = np.zeros(len(src)), np.zeros(len(src), bool)
            for have, u in batches(paths, ("id", "u")):
                pair, row = met(turned, order, have)
                for k in range(0, len(pair), AT_ONCE):
                    p, r = pair[k : k + AT_ONCE], row[k : k + AT_ONCE]
                    total = np.zeros(len(p))
                    for x in np.ascontiguousarray((rows[at[p]] * u[r]).T):
                        total += x
                    dots[p], known[p] = total, there[at[p]]
            table = table.append_column(name, pa.array(dots, mask=~known))
        return table.to_batches()

    def run(found):
        held, n = [], 0
        for batch in found:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from dotted(held)
                held, n = [], 0
        if n:
            yield from dotted(held)

    schema = StructType([*pairs.schema.fields, *(StructField(name, DoubleType()) for name in views)])
    dealt = pairs.repartition(_tasks(pairs, pairs.count(), most, 4096), "src")
    return tables.keep(dealt.mapInArrow(run, schema))


def link_sums(links: DataFrame, n: int, paths: list[str], column: str, work, schema: str, also: tuple[str, ...] = ()) -> DataFrame:
    """What ``work`` makes of a batch of nodes: their ids, their own vectors ``column``, the sums of weight times the vectors that their links lead to, and their columns ``also``.

    ``links``: src, dst, weight, with a loop at each of the ``n`` nodes; ``paths``: files of id and these columns.
    """

    def run(found):
        held = [b for b in found if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        src, dst, weight = (table.column(c).to_numpy() for c in ("src", "dst", "weight"))
        order = np.argsort(dst, kind="stable")
        turned, (ids, at) = dst[order], np.unique(src, return_inverse=True)
        sums = own = None
        for have, *columns in batches(paths, ("id", column, *also)):
            if sums is None:
                own = [np.zeros((len(ids), x.shape[1])) for x in columns]
                sums = np.zeros_like(own[0])
            to, of = placed(ids, have)
            for x, new in zip(own, columns, strict=True):
                x[to] = new[of]
            link, row = met(turned, order, have)
            for k in range(0, len(link), AT_ONCE):
                by = np.argsort(at[link[k : k + AT_ONCE]], kind="stable") + k
                node = at[link[by]]
                starts = np.flatnonzero(np.diff(node, prepend=-1))
                sums[node[starts]] += np.add.reduceat(columns[0][row[by]] * weight[link[by], None], starts, axis=0)
        for k in range(0, len(ids), BATCH):
            part = slice(k, k + BATCH)
            yield work(ids[part], own[0][part], sums[part], *(x[part] for x in own[1:]))

    dealt = links.select("src", "dst", "weight").repartition(_tasks(links, n, NODES, 256), "src")
    return dealt.mapInArrow(run, schema)


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
