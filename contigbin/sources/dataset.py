"""A prepared dataset in one folder: contigs, k-mer counts, coverage, edges, parameters (SRC-6, SRC-7, SRC-29, SNK-5, SNK-6)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from . import tables

TABLES = ("contigs", "kmers", "coverage", "edges")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store that Spark reads has the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def path_of(spark: SparkSession, path: str) -> str:
    """The whole path in its store, without store and a slash at the end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri().getPath()


def write_dataset(contigs: DataFrame, coverage: DataFrame, edges: DataFrame, path: str, least: int = 2_000, config: dict | None = None) -> None:
    """``contigs``: contig, sequence; ``coverage``: contig, sample, depth; ``edges``: src, dst (contig names). Short contigs go, with what refers to them."""
    sized = contigs.withColumn("length", F.length("sequence").cast("long"))
    kept = features.retained(sized, least).select("node_index", "contig", "length", "sequence").checkpoint()
    names = kept.select("contig")
    kept.drop("sequence").write.mode("overwrite").parquet(f"{path}/contigs")
    features.kmer_counts(kept).write.mode("overwrite").parquet(f"{path}/kmers")
    coverage.join(names, "contig", "left_semi").write.mode("overwrite").parquet(f"{path}/coverage")
    inside = edges.join(names.withColumnRenamed("contig", "src"), "src", "left_semi").join(names.withColumnRenamed("contig", "dst"), "dst", "left_semi")
    inside.select(edges.columns).write.mode("overwrite").parquet(f"{path}/edges")
    told = contigs.sparkSession.createDataFrame([(json.dumps(config or {}, sort_keys=True),)], "value string")
    told.coalesce(1).write.mode("overwrite").text(f"{path}/config.json")


def coverage_path(spark: SparkSession, path: str, config: dict, given: str | None = None) -> str:
    """The first that exists of: the path given, the folder's own table, one named by the parameters (SRC-6)."""
    candidates = [given] if given else [f"{path}/coverage", f"{path}/coverage.csv", *([f"{config['work_dir']}/coverage.csv"] if "work_dir" in config else [])]
    for candidate in candidates:
        if exists(spark, candidate):
            return candidate
    raise FileNotFoundError(f"no coverage table at {', '.join(candidates)}")


def read_dataset(spark: SparkSession, path: str, coverage: str | None = None) -> dict[str, DataFrame | dict]:
    """The tables of a folder by name, and config; raises if one is missing or a contig lacks coverage (SRC-7)."""
    if missing := missing_parts(spark, path):
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    config = json.loads(spark.read.text(f"{path}/config.json").first()[0])
    out = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES if t != "coverage"}
    found = coverage_path(spark, path, config, coverage)
    out["coverage"] = tables.read_coverage(spark, found, out["contigs"]) if found.endswith((".csv", ".tsv")) else spark.read.parquet(found)
    bare = out["contigs"].join(out["coverage"].select("contig").distinct(), "contig", "left_anti").limit(3).collect()
    if bare:
        raise ValueError(f"contigs without coverage: {[r['contig'] for r in bare]}")
    return out | {"config": config}


def missing_parts(spark: SparkSession, path: str) -> list[str]:
    return [p for p in ("contigs", "kmers", "edges", "config.json") if not exists(spark, f"{path}/{p}")]


def discover(spark: SparkSession, paths: list[str]) -> tuple[list[str], dict[str, str]]:
    """The folders that hold a dataset, and why the others are passed over (SRC-29)."""
    lacking = {p: missing_parts(spark, p) for p in paths}
    return [p for p, m in lacking.items() if not m], {p: f"lacks {', '.join(m)}" for p, m in lacking.items() if m}


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; made and written first where it is absent (SNK-6)."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)
