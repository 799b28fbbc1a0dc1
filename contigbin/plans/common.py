"""Projections of the supplied tables that the queries share, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import dna_letters
from ..functions.vectors import length, unit
from ..sources.store import scratch  # noqa: F401  (the queries take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    """Rounded to 6 digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, sequence: the DNA letters of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig"), dna_letters(F.col("text")).alias("sequence"))


SEQ = "seq as (select doc_id as contig, regexp_replace(upper(text), '[^ACGT]', '', 'g') as sequence from documents)"


def cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, sample, depth: event values by user and type, zero where there is none."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("contig"), F.col("event_type").alias("sample")).agg(F.sum("value").alias("depth"))


COV = "cov as (select user_id as contig, event_type as sample, sum(value) as depth from events group by 1, 2)"


def vec(spark: SparkSession, sf_dir: str, start: int = 1, size: int = 64) -> DataFrame:
    """id, label, u: embeddings (or some of their dimensions) at unit length."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.slice("embedding", start, size).cast("array<double>").alias("e"))
    return e.select("id", "label", unit(F.col("e")).alias("u"))


def raw(spark: SparkSession, sf_dir: str, start: int = 1, size: int = 64) -> DataFrame:
    """id, label, e, norm: the rows of ``vec`` as they are stored, in half the bytes, with what u is divided by; for the search."""
    e = F.slice("embedding", start, size)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), e.alias("e"), length(e).alias("norm"))


def vec_sql(name: str = "vec", start: int = 1, size: int = 64) -> str:
    e = f"list_transform(embedding[{start}:{start + size - 1}], lambda x: x::DOUBLE)"
    return (
        f"{name}_e as (select vec_id as id, label::BIGINT as label, {e} as e from embeddings), "
        f"{name} as (select id, label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) as u from {name}_e)"
    )


def knn_sql(name: str = "knn", rows: str = "vec", k: int = 8) -> str:
    return (
        f"{name}_p as (select a.id as i, b.id as j, round(list_dot_product(a.u, b.u), 9) as cosine from {rows} a join {rows} b on a.id <> b.id), "
        f"{name}_t as (select *, row_number() over (partition by i order by cosine desc, j) as rank from {name}_p qualify rank <= {k}), "
        f"{name} as (select a.i as src, a.j as dst, a.cosine from {name}_t a join {name}_t b on a.i = b.j and a.j = b.i where a.i < a.j)"
    )


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, step, segment, orientation: orders as walks over parts."""
    orientation = F.when(F.col("l_linestatus") == "O", "+").otherwise("-")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", orientation.alias("orientation"))  # lines that agree so far may differ in orientation
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contig"), key.alias("step"), F.col("l_partkey").alias("segment"), orientation.alias("orientation"))


#: ``walk`` as SQL; steps are ordered by n1, segment, n3, orientation.
WALK = "walk as (select l_orderkey as contig, l_linenumber as n1, l_partkey as segment, l_suppkey as n3, case when l_linestatus = 'O' then '+' else '-' end as orientation from lineitem)"


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, bin, truth of documents: bins by source, none without a label; truth by language."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig"), "source", "lang", F.col("n_chars").alias("length"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("contig"), "quality")
    return d.join(known, "contig", "left").select("contig", F.when(F.col("quality").isNotNull(), F.col("source")).alias("bin"), F.col("lang").alias("truth"), "length", "quality")


PART = "part_labels as (select d.doc_id as contig, case when l.quality is not null then d.source end as bin, d.lang as truth, d.n_chars as length, l.quality from documents d left join labels l on d.doc_id = l.doc_id)"
