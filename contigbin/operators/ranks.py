"""Running totals within groups of any size, and joins with few rows (WIN-6, AGG-32, AGG-33)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table of counted size is broadcast up to so many rows.
FEW = 500_000
#: Rows of a task in which rows are sorted by group, so that its memory does not grow with the table.
SORTED = 250_000


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt out by columns to so many tasks that each has about SORTED rows; what is grouped by these and more columns then stays in its task."""
    n = math.ceil(rows.count() / SORTED)
    return rows.repartition(n, *by) if n > 1 else rows.repartition(*by)  # a number of its own, which is not coalesced


def fresh(start: Column, end: Column, *by: str) -> Column:
    """Struct (start, end) of what a half-open span adds to the spans of its group that begin before it; of length 0 if nothing. Spans that touch add up."""
    first = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest(start, F.max(end).over(first))
    return F.struct(begin.alias("start"), F.greatest(begin, end).alias("end"))


def attach(rows: DataFrame, sums: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of ``sums``, which has one row for each value of ``on`` (a null is a value): by broadcast if those are few, however many rows a value has."""
    side = sums.withColumnRenamed(on, "_on")
    few = F.broadcast(side) if side.count() <= FEW else side
    return rows.join(few, F.col(on).eqNullSafe(F.col("_on"))).drop("_on")


def totals_before(counts: DataFrame, by: str, value: str, n: str) -> DataFrame:
    """Adds ``before`` and ``total``: sums of ``n`` over the lesser values of ``by``, and over all of it. ``counts``: one row for each pair of by and value.

    Rows are dealt to tasks in the order of (by, value), so a large group is many tasks; each
    adds up its own rows, and what the tasks before it hold comes from one row a task and group.
    The dealing is checkpointed, as it is sampled and may fall differently when it is made again.
    """
    dealt = counts.repartitionByRange(by, value).withColumn("_task", F.spark_partition_id()).checkpoint()
    own = dealt.groupBy(by, "_task").agg(F.sum(n).alias("_n"))
    across = Window.partitionBy(by)
    earlier = F.coalesce(F.sum("_n").over(across.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = own.select(F.col(by).alias("_by"), F.col("_task").alias("_of"), earlier.alias("_earlier"), F.sum("_n").over(across).alias("total"))
    few = F.broadcast(tasks) if tasks.count() <= FEW else tasks
    inside = Window.partitionBy(by, "_task").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("before", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = run.join(few, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_task") == F.col("_of")))
    return joined.withColumn("before", F.col("before") + F.col("_earlier")).drop("_by", "_of", "_earlier", "_task")
