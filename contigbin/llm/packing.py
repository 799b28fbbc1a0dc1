"""Packing: best-fit decreasing over a segment tree of remaining capacities.

Every text becomes ids, followed by one end id. Overlong documents are first cut
into full windows; what remains of each is one piece. Pieces go, longest first,
each into the open sequence that it fills most tightly.

Only lengths decide where a piece goes, and there are at most ``capacity`` of
them. So the plan is made for counts by length: equal pieces are placed in one
step, and the plan has a size that does not depend on the input. It is made on
the driver from one count per length; then each piece finds its place by its rank
among the pieces of its length, on the executors. Ranks are dealt by (length,
salt), so that no task has to hold all pieces of one length. A full window fills a
sequence by itself: those are numbered in the order in which they were written, behind
all others, without being moved.

Null text counts as empty (the end id alone). Very long texts are encoded whole. Rows
that repeat a doc_id, or have none, are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, columns, materialize, maybe_broadcast
from .tokens import encoder

CAPACITY = 2048
END_ID = 1
SALTS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt int"


class CapacityTree:
    """Segment tree over capacities 0..capacity; a leaf holds stacks of open sequences with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, step: int, n: int) -> None:
        """n sequences with this room: first, first + step, .."""
        self.open[room].append((first, step, n))
        at = self.size + room
        while at:
            self.count[at] += n
            at >>= 1

    def take(self, room: int, most: int) -> tuple[int, int, int]:
        first, step, n = self.open[room].pop()
        if n > most:
            self.open[room].append((first + most * step, step, n - most))
            n = most
        at = self.size + room
        while at:
            self.count[at] -= n
            at >>= 1
        return first, step, n

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open sequence has."""
        at = self.size + least
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for counts by length.

    Rows: length, rank of the first piece, pieces, pieces a sequence, first sequence, step, offset there.
    """
    tree, rows, made = CapacityTree(capacity), [], 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                each = min(capacity // length, left)
                n = left // each
                first, step, room = made, 1, capacity
                made += n
            else:
                each = min(room // length, left)
                first, step, n = tree.take(room, left // each)
            rows.append((length, rank, n * each, each, first, step, capacity - room))
            rank += n * each
            left -= n * each
            if room > each * length:
                tree.add(room - each * length, first, step, n)
    return np.array(rows, np.int64).reshape(-1, 7)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, model: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", salts: int = SALTS) -> DataFrame:
    """Pieces of all documents: full windows and what remains."""

    def cut(batches):
        enc = encoder(model, ranks)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), (((doc or 0) + start) * 0x9E3779B1 >> 12) % salts))
            if not out:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.int32()], strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, salts: int = SALTS, **how) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, salts=salts, **how).withColumn("whole", F.col("length") == capacity), "pieces", "whole")
    rest = cut.filter("NOT whole").drop("whole")
    dealt = rest.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most capacity x salts rows, whatever the input
    by = columns(dealt)
    counts = np.zeros((capacity + 1, salts), np.int64)
    counts[by["length"], by["salt"]] = by["n"]
    starts = counts.cumsum(1) - counts
    made = plan({length: n for length, n in enumerate(counts.sum(1).tolist()) if n}, capacity)
    shared = spark.sparkContext.broadcast((starts, made))
    opened = int((made[:, 2] // made[:, 3])[made[:, 6] == 0].sum())

    def place(batches):
        starts, made = shared.value
        key = made[:, 0] * -(1 << 44) + made[:, 1]  # ascending: lengths fall, ranks rise
        current, rank = None, 0
        for batch in batches:
            length, salt = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            ranks = np.empty(batch.num_rows, np.int64)
            change = np.flatnonzero((np.diff(length) != 0) | (np.diff(salt) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                if b > a:
                    now = (int(length[a]), int(salt[a]))
                    if now != current:
                        current, rank = now, int(starts[now])
                    ranks[a:b] = np.arange(rank, rank + b - a)
                    rank += b - a
            at = np.searchsorted(key, length.astype(np.int64) * -(1 << 44) + ranks, side="right") - 1
            step = made[at]
            inside = ranks - step[:, 1]
            sequence = step[:, 4] + inside // step[:, 3] * step[:, 5]
            offset = step[:, 6] + inside % step[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = rest.repartition("length", "salt").sortWithinPartitions("length", "salt", "doc_id", "start", "ids_crc32")
    placed = dealt.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # a file of full windows holds nothing else, so a row's number in its file and the files before it give its number
    full = cut.filter("whole").select(*placed.columns[:5], F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = full.groupBy("file").agg(F.count("*").alias("n"))
    files = materialize(files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n") + opened).alias("first")), "files")  # one row a file
    numbered = full.join(maybe_broadcast(files, files.count(), 512), "file").select(*placed.columns[:5], (F.col("first") + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(numbered)
