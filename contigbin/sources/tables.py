"""Delimited tables: coverage, PAF, registries, assignments, keyed results (SRC-5, 15, 19..26, SNK-1, 7, 8, 14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import wrapped
from ..operators.features import dense_index

PAF = "query string, query_length long, query_start long, query_end long, strand string, target string, target_length long, target_start long, target_end long, matches long, block long"


def separator(spark: SparkSession, path: str) -> str:
    """Tab if the first line has one, else comma."""
    first = spark.read.text(path).limit(1).collect()
    return "\t" if first and "\t" in first[0][0] else ","


def read_coverage(spark: SparkSession, path: str, retained: DataFrame | None = None) -> DataFrame:
    """contig, sample, depth from a wide table with a contig column (SRC-5, PRJ-15).

    Raises if a contig repeats, a value is not a finite number of 0 or more, there is
    no sample, or a contig of ``retained`` (contig) is missing.
    """
    wide = spark.read.csv(path, sep=separator(spark, path), header=True)
    samples = [c for c in wide.columns if c != "contig"]
    if "contig" not in wide.columns or not samples or len(set(wide.columns)) < len(wide.columns):
        raise ValueError("a coverage table needs a contig column and distinct sample columns")
    long = wide.select("contig", F.explode(F.map_from_arrays(F.array(*map(F.lit, samples)), F.array(*(F.col(f"`{s}`") for s in samples)))).alias("sample", "text")).withColumn("depth", F.expr("try_cast(text as double)"))
    bad = long.filter("depth IS NULL OR depth < 0 OR isnan(depth) OR depth = double('infinity')").limit(3).collect()
    if bad:
        raise ValueError(f"coverage must be finite and not negative: {[tuple(r)[:3] for r in bad]}")
    twice = wide.groupBy("contig").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"contigs repeat in the coverage table: {[r[0] for r in twice]}")
    if retained is not None:
        missing = retained.select("contig").join(wide.select("contig"), "contig", "left_anti")
        n = missing.count()
        if n:
            raise ValueError(f"coverage table is missing {n} contigs, such as {[r[0] for r in missing.orderBy('contig').limit(3).collect()]}")
        long = long.join(retained.select("contig"), "contig", "left_semi")
    return long.select("contig", "sample", "depth")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments: the first eleven fields (SRC-15); shorter lines are skipped."""
    f = F.split("value", "\t")
    names = [x.split() for x in PAF.split(", ")]
    rows = spark.read.text(path).filter(F.size(f) >= 11)
    return rows.select(*(F.expr(f"try_cast(split(value, '\\t')[{k}] as {t})").alias(n) for k, (n, t) in enumerate(names)))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows under the first line that is no comment; '-' is null (SRC-19)."""
    lines = spark.read.text(path).filter("trim(value) <> '' AND NOT value LIKE '#%'")
    header = lines.first()[0].split("\t")
    fields = F.split("value", "\t", -1)
    rows = lines.filter(F.col("value") != "\t".join(header))
    return rows.select(*(F.nullif(F.trim(F.get(fields, F.lit(k))), F.lit("-")).alias(n.lstrip("#")) for k, n in enumerate(header)))


def read_assignments(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, bin from lines of any order: the first token that is a contig, the first other token (SRC-22).

    Blank lines and comments are skipped, and lines without a contig or another token.
    Raises if a contig has two bins.
    """
    tokens = F.array_remove(F.split(F.regexp_replace("value", ",", "\t"), r"\s+"), "")
    rows = lines.filter("trim(value) <> '' AND NOT value LIKE '#%'").select(F.monotonically_increasing_id().alias("line"), tokens.alias("t"))
    each = rows.select("line", F.posexplode("t").alias("pos", "token"))
    known = each.join(contigs.select(F.col("contig").alias("token")).distinct(), "token").groupBy("line").agg(F.min(F.struct("pos", "token")).alias("c"))
    other = each.join(known, "line").filter(F.col("pos") != F.col("c.pos")).groupBy("line").agg(F.min(F.struct("pos", "token")).alias("b"), F.first("c.token").alias("contig"))
    found = other.select("contig", F.col("b.token").alias("bin")).distinct()
    check = F.count("*").over(Window.partitionBy("contig")) > 1
    return found.withColumn("bin", F.when(check, F.raise_error(F.concat("contig", F.lit(" occurs in two bins")))).otherwise(F.col("bin")))


# Header names of bin tables, compared in lower case.
CONTIG_NAMES = ("contig", "contig_id", "contigname", "contig_name", "sequence", "sequence_id", "scaffold", "scaffold_id", "name", "seq_name")
BIN_NAMES = ("bin", "bin_id", "cluster", "cluster_id", "clustername", "cluster_name", "binid", "group")


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """contig, bin from a tab-separated table (SRC-24): by its header, else the column with more distinct values is the contig."""
    lines = spark.read.text(path).filter("trim(value) <> '' AND NOT value LIKE '#%'").select("value", F.split("value", "\t").alias("f"))
    first = lines.first()
    if first is None or len(first["f"]) < 2:
        raise ValueError(f"{path} is not a table of two columns or more")
    header = [x.strip().lower() for x in first["f"]]
    contig, bin_ = (next((k for k, x in enumerate(header) if x in names), None) for names in (CONTIG_NAMES, BIN_NAMES))
    body = lines if contig is None and bin_ is None else lines.filter(F.col("value") != first["value"])
    if contig is None or bin_ is None:
        n = body.agg(F.countDistinct(F.get("f", F.lit(0))), F.countDistinct(F.get("f", F.lit(1)))).first()
        contig, bin_ = (0, 1) if n[0] >= n[1] else (1, 0)
    return body.filter(F.size("f") > max(contig, bin_)).select(F.trim(F.col("f")[contig]).alias("contig"), F.trim(F.col("f")[bin_]).alias("bin"))


def assignments_from_folder(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """contig, bin from a folder of FASTA files, one a bin, at any depth (SRC-23): the bin is the file's path in the folder, without its ending. Raises if a contig is in two bins."""
    from .dataset import path_of

    lines = spark.read.option("recursiveFileLookup", True).text(path).filter("value LIKE '>%'")
    own = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z0-9]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    inside = F.substr(own, F.lit(len(path_of(spark, path)) + 2))
    ending = r"(?i)\.(fa|fna|fasta)(\.gz)?$"
    ids = lines.select(F.regexp_extract("value", r"^>(\S*)", 1).alias("contig"), inside.alias("file")).filter(F.col("file").rlike(ending))
    found = ids.select("contig", F.regexp_replace("file", ending, "").alias("bin")).join(contigs.select("contig").distinct(), "contig", "left_semi").distinct()
    several = F.count("*").over(Window.partitionBy("contig")) > 1
    return found.withColumn("bin", F.when(several, F.raise_error(F.concat("contig", F.lit(" occurs in two bins")))).otherwise(F.col("bin")))


def read_pairs(files: DataFrame) -> DataFrame:
    """sample, stem, r1, r2 from a listing (path) of read files, mates marked _1/_2 or _R1/_R2 (SRC-18); numbered by stem. Raises if a mate repeats."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(fastq|fq)(\.gz)?$", "")
    mate = F.coalesce(F.nullif(F.regexp_extract(base, r"[._]R?([12])$", 1), F.lit("")), F.lit("1"))
    marked = files.filter(F.col("path").rlike(r"\.(fastq|fq)(\.gz)?$")).select("path", F.regexp_replace(base, r"[._]R?[12]$", "").alias("stem"), mate.alias("mate"))
    twice = marked.groupBy("stem", "mate").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"mates repeat: {[tuple(r)[:2] for r in twice]}")
    wide = marked.groupBy("stem").agg(F.max(F.when(F.col("mate") == "1", F.col("path"))).alias("r1"), F.max(F.when(F.col("mate") == "2", F.col("path"))).alias("r2"))
    return dense_index(wide, "stem", "n").select(F.concat(F.lit("sample"), F.col("n").cast("string")).alias("sample"), "stem", "r1", "r2")


def read_virus_names(spark: SparkSession, path: str) -> DataFrame:
    """contig of a virus summary (seq_name), without a provirus suffix (SRC-20)."""
    return spark.read.csv(path, sep="\t", header=True).select(F.substring_index("seq_name", "|", 1).alias("contig")).distinct()


def read_quality_summary(spark: SparkSession, path: str) -> DataFrame:
    """contig, tier, completeness, contamination of a quality summary (SRC-21); what is no number is null."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return spark.read.csv(path, sep="\t", header=True).select(F.col("contig_id").alias("contig"), F.col("checkv_quality").alias("tier"), number("completeness").alias("completeness"), number("contamination").alias("contamination"))


def export_cohort(records: DataFrame, truth: DataFrame, coverage: DataFrame, path: str, least: int = 2000) -> int:
    """Labelled contigs of ``least`` bases for other tools (SNK-9, PRJ-3, PRJ-4, PRJ-17): FASTA, truth, coverage, alias tables; their number.

    ``truth``: contig, strain; labels that are empty, nan, none, unmapped or unbinned do not count.
    """
    labelled = truth.filter(~F.lower(F.trim("strain")).isin("", "nan", "none", "unmapped", "unbinned"))
    cohort = records.withColumn("length", F.length("sequence").cast("long")).filter(F.col("length") >= least).join(labelled, "contig").checkpoint()
    missing = cohort.join(coverage, "contig", "left_anti").select("contig").limit(3).collect()
    if missing:
        raise ValueError(f"contigs without coverage: {[r[0] for r in missing]}")
    species = F.regexp_replace("strain", r"_s\d+$", "")
    mean = coverage.groupBy("contig").agg(F.avg("depth").alias("mean_depth"))
    alias = F.format_string("CB%07d_length_%d_cov_%.4f", F.col("n") + 1, "length", "mean_depth")
    named = dense_index(cohort.join(mean, "contig"), "contig", "n").select("contig", alias.alias("alias"))
    cohort.select("contig", "length", "strain", species.alias("species")).write.mode("overwrite").csv(f"{path}/truth.tsv", sep="\t", header=True)
    coverage.join(cohort.select("contig"), "contig", "left_semi").write.mode("overwrite").parquet(f"{path}/coverage.parquet")
    named.write.mode("overwrite").csv(f"{path}/aliases.tsv", sep="\t", header=True)
    for name, rows in (("cohort.fasta", cohort), ("aliased.fasta", cohort.join(named, "contig").select(F.col("alias").alias("contig"), "sequence"))):
        rows.select(F.concat(F.lit(">"), "contig", F.lit("\n"), wrapped(F.col("sequence")))).write.mode("overwrite").text(f"{path}/{name}")
    return cohort.count()


def unaliased(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with names in place of the aliases in ``column`` (JN-20). ``aliases``: contig, alias; rows of no known alias go."""
    names = aliases.select(F.col("alias").alias("_alias"), F.col("contig").alias("_contig"))
    return rows.join(names, rows[column] == names["_alias"]).withColumn(column, F.col("_contig")).drop("_alias", "_contig")


def report(rows: DataFrame, by: str) -> DataFrame:
    """Rows by falling ``by`` as a number; those without one last (SRT-3)."""
    return rows.orderBy(F.expr(f"try_cast({by} as double)").desc_nulls_last(), *(c for c in rows.columns if c != by))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], replace: bool) -> DataFrame:
    """Rows of both; of equal keys the incoming (``replace``) or the existing (SNK-7). Raises if the columns differ."""
    if existing.columns != incoming.columns:
        raise ValueError(f"columns differ: {existing.columns} and {incoming.columns}")
    first, second = (incoming, existing) if replace else (existing, incoming)
    return first.unionByName(second.join(first.select(keys), keys, "left_anti").select(existing.columns)).select(existing.columns)


def completed_keys(results: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of finished rows (SNK-8)."""
    return results.filter("status LIKE 'completed%'").select(keys).distinct()


def write_assignments(bins: DataFrame, path: str, prefix: str = "bin") -> None:
    """contig_id, bin_id, length as tab-separated text, sorted by contig within range-partitioned files (SNK-1, SNK-14)."""
    named = bins.select(F.col("contig").alias("contig_id"), F.format_string(f"{prefix}_%06d", F.col("bin")).alias("bin_id"), "length")
    named.repartitionByRange("contig_id").sortWithinPartitions("contig_id").write.csv(path, sep="\t", header=True)
