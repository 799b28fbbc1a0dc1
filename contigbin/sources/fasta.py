"""FASTA: a Python data source, strict and tolerant readers, writers (SRC-1..4, SNK-2, 3, 10, 12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dna import wrapped
from . import splits
from .store import GroupFileSource

SCHEMA = "path string, position long, contig string, description string, sequence string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastaSource(DataSource):
    """``spark.read.format("fasta")``: one task a file (options path, encoding); .gz is read as it is.

    For files on the executors' own file systems; ``read_fasta`` reads what Spark reads.
    """

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition):
        import gzip

        opened = gzip.open if partition.path.endswith(".gz") else open
        with opened(partition.path, "rt", encoding=self.options.get("encoding", "utf-8-sig")) as lines:
            head, parts, position = None, [], 0
            for line in lines:
                line = line.strip()
                if line.startswith(">"):
                    if head is not None:
                        yield partition.path, position, head.split(None, 1)[0] if head else "", head, "".join(parts)
                        position += 1
                    head, parts = line[1:], []
                elif line and head is not None:
                    parts.append(line)
            if head is not None:
                yield partition.path, position, head.split(None, 1)[0] if head else "", head, "".join(parts)


def read_fasta(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """file, position (rises within a file), contig (first token of the header), description, sequence, from any store Spark reads (SRC-1, SRC-3).

    Records are split at a line that starts with '>', so a '>' inside a header does no
    harm; a file is read in as many byte ranges as it has, and nothing is shuffled. Text before the first record stands in
    a row with a null contig. Byte order marks are dropped. ``encoding``: see ``splits.scan``.
    """
    raw = splits.scan(spark, path, sep="\n>", encoding=encoding)
    first = (F.col("split") == 0) & (F.col("at") == 0)
    text = F.regexp_replace(F.when(first, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), "\r", "")
    # only a file's first record keeps its mark: the separator has taken the others'
    starts = text.startswith(">")
    body = F.when(starts & first, F.substr(text, F.lit(2))).otherwise(text)
    loose = first & ~starts
    head = F.substring_index(body, "\n", 1)
    rest = F.regexp_replace(F.substr(body, F.length(head) + 2), r"\s", "")
    position = F.col("split") + F.col("at")  # a record takes more than a byte, so this rises within a file
    rows = raw.select("file", position.alias("position"), F.when(~loose, F.regexp_extract(head, r"^(\S*)", 1)).alias("contig"), F.when(~loose, head).alias("description"), F.when(loose, F.regexp_replace(text, r"\s", "")).otherwise(rest).alias("sequence"))
    return rows.filter("contig IS NOT NULL OR sequence <> ''")


def checked(records: DataFrame) -> DataFrame:
    """contig, sequence in upper case, or an error (SRC-2): an id that is empty or repeats, a sequence before a header, a header without a sequence."""
    bad = records.filter("contig IS NULL OR contig = '' OR sequence = ''").select("contig", F.length("sequence").alias("n")).limit(3).collect()
    if bad:
        raise ValueError(f"records without an id or a sequence: {[tuple(r) for r in bad]}")
    twice = records.groupBy("contig").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"contigs repeat: {[r[0] for r in twice]}")
    return records.select("file", "position", "contig", F.upper("sequence").alias("sequence"))


def fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    """contig of each header; sequences are never kept (SRC-4)."""
    return spark.read.text(path).filter("value LIKE '>%'").select(F.regexp_extract("value", r"^>(\S*)", 1).alias("contig"))


def subset(records: DataFrame, names: DataFrame) -> DataFrame:
    """Records whose contig is in ``names``, in the order of files and positions, in range-partitioned files (JN-19)."""
    return records.join(names.select("contig").distinct(), "contig", "left_semi").repartitionByRange("file", "position").sortWithinPartitions("file", "position")


def longer(records: DataFrame, least: int = 1_000) -> DataFrame:
    """Records of at least ``least`` letters (PRJ-5)."""
    return records.filter(F.length("sequence") >= least)


def record(contig: Column, sequence: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), contig, F.lit("\n"), wrapped(sequence, width))


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    records.select(record(F.col("contig"), F.col("sequence"), width)).write.mode("overwrite").text(path)


def write_bins(records: DataFrame, bins: DataFrame, path: str, width: int = 80) -> None:
    """``path`` as a folder of one FASTA file a bin, contigs in their order (SNK-2); earlier files there go when all new ones are written.

    Raises if a binned contig has no record, or two bins would share a file name (what is no letter, digit, '.', '_' or '-' becomes '_').
    """
    missing = bins.join(records, "contig", "left_anti").select("contig").limit(3).collect()
    if missing:
        raise ValueError(f"contigs without a sequence: {[r[0] for r in missing]}")
    safe = F.regexp_replace(F.col("bin").cast("string"), "[^A-Za-z0-9._-]", "_").alias("name")
    twice = bins.select("bin", safe).distinct().groupBy("name").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"bins of one file name: {[r[0] for r in twice]}")
    order = [c for c in ("file", "position") if c in records.columns] or ["contig"]
    rows = bins.select("contig", safe).join(records.select(*dict.fromkeys(["contig", *order, "sequence"])), "contig")
    dealt = rows.repartition("name").sortWithinPartitions("name", *order).select("name", record(F.col("contig"), F.col("sequence"), width).alias("value"))
    records.sparkSession.dataSource.register(GroupFileSource)
    dealt.write.format("group_files").option("path", path).mode("append").save()


def link_bins(records: DataFrame, bins: DataFrame, gap: int = 1500) -> tuple[DataFrame, DataFrame]:
    """(bin, n_contigs, sequence with ``gap`` N between contigs in their order), and the contigs that are missing (SNK-10)."""
    safe = F.regexp_replace(F.col("bin").cast("string"), "[^A-Za-z0-9._-]", "_")
    joined = bins.join(records.select("contig", "sequence"), "contig").groupBy(safe.alias("bin"))
    linked = joined.agg(F.count("*").alias("n_contigs"), F.array_sort(F.collect_list(F.struct("contig", "sequence"))).alias("s"))
    return linked.select("bin", "n_contigs", F.array_join(F.transform("s", lambda x: x["sequence"]), "N" * gap).alias("sequence")), bins.join(records, "contig", "left_anti").select("contig")


def fastq(records: DataFrame, quality: str = "I") -> DataFrame:
    """value: FASTQ records with a placeholder quality; empty sequences are dropped (SNK-12)."""
    return records.filter("sequence <> ''").select(F.concat(F.lit("@"), "contig", F.lit("\n"), "sequence", F.lit("\n+\n"), F.repeat(F.lit(quality), F.length("sequence"))).alias("value"))


def read_length(spark: SparkSession, path: str, reads: int = 20_000) -> float:
    """Mean length of the first reads of a FASTQ file, or of the first files of a folder (SRC-17). A file may be cut anywhere: lines are numbered over its ranges."""
    lines = splits.numbered(splits.scan(spark, path)).filter("number % 4 = 1").select("file", "number", F.length("value").alias("n"))
    first = lines.orderBy("file", "number").limit(reads)
    return first.agg(F.avg("n")).first()[0] or 0.0
