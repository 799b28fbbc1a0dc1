"""Assembly graphs and walks: GFA, contigs.paths, path tables, FASTG (SRC-8..14, SNK-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, labelling, neighbours
from ..operators.ranks import dealt
from . import splits


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (rising within a file), f (tab-separated fields)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value", F.split("value", "\t", -1).alias("f"))


def _after(fields: str, n: int) -> Column:
    """The fields behind the first n."""
    return F.slice(fields, F.lit(n + 1), F.greatest(F.size(fields) - n, F.lit(0)))


def tags(fields: Column) -> Column:
    """Optional fields TAG:TYPE:VALUE as a map; of a tag that repeats the last counts. Numbers stay text and are cast where they are read (SRC-10)."""
    good = F.filter(fields, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    pairs = F.transform(good, lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)).alias("k"), F.substr(x, F.lit(6)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    return F.map_from_arrays(names, last)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """segment, length (of the sequence, or LN), depth (DP), kmer_count (KC), tags (SRC-9)."""
    s = _lines(spark, path).filter("f[0] = 'S' AND size(f) >= 3").select(F.col("f")[1].alias("segment"), F.col("f")[2].alias("sequence"), tags(_after("f", 3)).alias("tags"))
    number = lambda k, t: F.expr(f"try_cast(tags['{k}'] as {t})")
    return s.select("segment", F.when(F.col("sequence") != "*", F.length("sequence").cast("long")).otherwise(F.coalesce(number("LN", "bigint"), F.lit(0))).alias("length"), number("DP", "double").alias("depth"), number("KC", "bigint").alias("kmer_count"), "tags")


def read_links(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """a, ao, b, bo, cigar, overlap, tags of L records; shorter records are skipped or (``strict``) an error (SRC-8, SRC-9)."""
    lines = _lines(spark, path).filter("f[0] = 'L'")
    if strict:
        bad = lines.filter("size(f) < 6").select("value").limit(1).collect()
        if bad:
            raise ValueError(f"invalid L record: {bad[0][0]}")
    f = F.col("f")
    return lines.filter("size(f) >= 6").select(f[1].alias("a"), f[2].alias("ao"), f[3].alias("b"), f[4].alias("bo"), f[5].alias("cigar"), labelling.cigar_length(f[5]).alias("overlap"), tags(_after("f", 6)).alias("tags"))


def _steps(path: Column) -> Column:
    """segment and orientation ('+' unless it ends in '-') of each step of a list (FN-4)."""
    parts = F.filter(F.split(path, "[,;]"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.struct(F.regexp_replace(F.trim(x), "[+-]+$", "").alias("segment"), F.when(F.trim(x).endswith("-"), "-").otherwise("+").alias("orientation")))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos, segment, orientation of P records."""
    p = _lines(spark, path).filter("f[0] = 'P' AND size(f) >= 3")
    return p.select(F.col("f")[1].alias("contig"), F.posexplode(_steps(F.col("f")[2])).alias("pos", "s")).select("contig", F.col("pos").cast("long").alias("pos"), "s.*")


def read_contig_paths(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """contig, pos, segment, orientation of a contigs.paths file (SRC-11, SRC-12).

    A header names a contig, or its reverse with a ' at the end; the lines below are its
    walk. Walks of reverse and of unknown contigs are skipped. A file may be cut anywhere: the last
    header above a line is carried over byte ranges (``splits.filled``).
    """
    text = F.trim("value")
    header = (text != "") & ~text.rlike(r"^[^,;]*[+-][,;]?$|[+-],")
    lines = splits.filled(splits.scan(spark, path, F.when(header, text)))
    walks = lines.filter("mark IS NULL AND trim(value) <> ''").withColumnRenamed("above", "contig").join(contigs.select("contig"), "contig")
    steps = walks.select("contig", "file", (F.col("split") + F.col("at")).alias("line"), F.posexplode(_steps(F.trim("value"))).alias("at", "s"))
    pos = F.row_number().over(Window.partitionBy("contig").orderBy("file", "line", "at")) - 1
    return steps.select("contig", pos.cast("long").alias("pos"), "s.*")


def read_path_table(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """contig, pos, segment (edge_N), orientation of a table with graph_path (SRC-13); * and ?? are skipped."""
    t = spark.read.csv(path, sep="\t", header=True)
    name = t.columns[0]
    steps = t.select(F.col(f"`{name}`").alias("contig"), F.posexplode(F.filter(F.split("graph_path", ","), lambda x: x.rlike("^-?[0-9]+$"))).alias("at", "x"))
    steps = dealt(steps, "contig").join(contigs.select("contig"), "contig")
    pos = F.row_number().over(Window.partitionBy("contig").orderBy("at")) - 1
    return steps.select("contig", pos.cast("long").alias("pos"), F.concat(F.lit("edge_"), F.regexp_replace("x", "^-", "")).alias("segment"), F.when(F.col("x").startswith("-"), "-").otherwise("+").alias("orientation"))


def read_fastg(records: DataFrame) -> DataFrame:
    """a, ao, b, bo from the headers of FASTG records (SRC-14): name:next,next; with ' for the reverse."""
    head = F.regexp_replace("description", ";.*$", "")
    node = lambda c: F.regexp_replace(c, "'$", "")
    side = lambda c: F.when(c.endswith("'"), "-").otherwise("+")
    own = F.substring_index(head, ":", 1)
    after = F.when(F.instr(head, ":") > 0, F.substr(head, F.length(own) + 2)).otherwise(F.lit(""))
    return records.select(own.alias("a"), F.explode(F.filter(F.split(after, ","), lambda x: x != "")).alias("b")).select(node(F.col("a")).alias("a"), side(F.col("a")).alias("ao"), node(F.col("b")).alias("b"), side(F.col("b")).alias("bo"))


def contig_edges(links: DataFrame, contigs: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """src, dst (contig names) that links join (JN-6); every contig also owns the segment of its name. Raises if none does."""
    own = contigs.select(F.col("contig").alias("segment"), "contig")
    members = own if steps is None else own.union(steps.join(contigs.select("contig"), "contig").select("segment", "contig")).distinct()
    edges = neighbours.canonical_edges(graph.project_links(links.select("a", "b"), members))
    if not edges.take(1):
        raise ValueError("the links do not map to pairs of the contigs: give a graph whose segments or paths carry their names, or a table of walks")
    return edges


def write_gfa(contigs: DataFrame, links: DataFrame, path: str) -> None:
    """S and L records (SNK-11). ``contigs``: contig, length; ``links``: a, ao, b, bo."""
    s = contigs.select(F.concat_ws("\t", F.lit("S"), "contig", F.lit("*"), F.concat(F.lit("LN:i:"), F.col("length").cast("string"))).alias("value"))
    e = links.select(F.concat_ws("\t", F.lit("L"), "a", "ao", "b", "bo", F.lit("0M")).alias("value"))
    s.union(e).write.mode("overwrite").text(path)
