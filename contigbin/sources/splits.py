"""Text files in splits (SRC-1, SRC-11, SRC-12, SRC-17, WIN-3): a file is read by as many tasks as it has byte ranges.

Spark's text reader begins each byte range at the next record. Here every record also
gets its range and its place in it, in one pass and without a shuffle; what a line takes
over from lines above it is found inside the range first, and for the lines before a range's
first mark from a table of one row a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of one row a byte range is broadcast up to so many rows (about 100 bytes each).
BROADCAST_SPLITS = 500_000

SCHEMA = "file string, split long, value string, mark string, at long, above string"


def scan(spark: SparkSession, path: str, mark: Column | None = None, sep: str = "\n", encoding: str | None = None) -> DataFrame:
    """file, split (first byte of the range), value, mark, at (place in the range), above (the last mark at or above, within the range).

    ``mark``: what the lines below take over, null where there is nothing; an expression over ``value``.
    ``encoding``: of the files, if they aren't UTF-8; without a byte order mark, so UTF-16LE and not UTF-16.
    """
    reader = spark.read.option("lineSep", sep)
    raw = (reader.option("encoding", encoding) if encoding else reader).text(path)
    value = F.decode(F.col("value").cast("binary"), encoding) if encoding else F.col("value")
    located = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), value.alias("value"))
    given = located.select("file", "split", "value", (F.lit(None).cast("string") if mark is None else mark).alias("mark"))

    def run(batches):
        place, last, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, split, marks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(3)
            code = files.indices.to_numpy()
            own = (files.dictionary[int(code[0])].as_py(), int(split[0]))
            if own != place:
                place, last, n = own, None, 0
            starts = np.concatenate([[0], np.flatnonzero((np.diff(code) != 0) | (np.diff(split) != 0)) + 1])
            rows, group = np.arange(batch.num_rows), np.searchsorted(starts, np.arange(batch.num_rows), side="right") - 1
            at = rows - starts[group] + np.where(group == 0, n, 0)
            seen = np.maximum.accumulate(np.where(marks.is_valid().to_numpy(zero_copy_only=False), rows, -1))
            inside = seen >= starts[group]
            above = marks.take(pa.array(np.where(inside, seen, 0), mask=~inside))
            if last is not None:  # from the batch before, for the first range's head
                above = pa.compute.if_else(pa.array(~inside & (group == 0)), pa.scalar(last, pa.string()), above)
            n, last = int(at[-1]) + 1, above[-1].as_py()
            place = (files.dictionary[int(code[-1])].as_py(), int(split[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), above], names=["file", "split", "value", "mark", "at", "above"])

    return given.mapInArrow(run, SCHEMA)


def _per_split(splits: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``splits`` (one row a range)."""
    many = splits.count() > BROADCAST_SPLITS
    return rows.join(splits if many else F.broadcast(splits), ["file", "split"], "left")


def filled(lines: DataFrame) -> DataFrame:
    """``above`` filled from earlier ranges of the file: the last mark at or above each line."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.max_by("above", "at").alias("last"))
    before = splits.select("file", "split", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    return _per_split(before, lines).withColumn("above", F.coalesce("above", "before")).drop("before")


def numbered(lines: DataFrame) -> DataFrame:
    """With ``number``, the line's place in its file (from 0)."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = splits.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return _per_split(before, lines).withColumn("number", F.col("before") + F.col("at")).drop("before")
