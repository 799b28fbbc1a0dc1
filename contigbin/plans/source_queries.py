"""Sources and sinks by round trip: a table is written in a format of the field and read back by the operator; and reports over what is read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import alphanumeric, run_name, version_in
from ..operators import completeness, graph, labelling, pileup, simulate
from ..sources import dataset, fasta, gfa, tables
from .common import COV, SEQ, WALK, cov, r6, scratch, seq, table, walk
from .feature_queries import query as _query


def _written(df, label: str) -> str:
    """The path of ``df`` (one string column) as text."""
    path = scratch(df.sparkSession, label)
    df.select(F.col(df.columns[0]).alias("value")).write.text(path)
    return path


def _records(spark, d):
    return seq(spark, d).filter("sequence <> ''").select(F.concat(F.lit("c"), "contig").alias("contig"), "sequence")


def _fasta(spark, d) -> str:
    path = scratch(spark, "fasta")
    fasta.write_fasta(_records(spark, d), path)
    return path


@_query(f"with {SEQ} select 'c' || contig as contig, length(sequence)::BIGINT as length, md5(sequence) as digest from seq where sequence <> ''")
def fasta_round_trip(spark, d):
    """SRC-1, SRC-2, SNK-3."""
    r = fasta.checked(fasta.read_fasta(spark, _fasta(spark, d)))
    return r.select("contig", F.length("sequence").cast("long").alias("length"), F.md5(F.col("sequence").cast("binary")).alias("digest"))


@_query(f"with {SEQ} select 'c' || contig as contig from seq where sequence <> ''")
def fasta_headers(spark, d):
    """SRC-4."""
    return fasta.fasta_ids(spark, _fasta(spark, d))


@_query(f"with {SEQ} select 'c' || contig as contig, length(sequence)::BIGINT as length from seq where length(sequence) >= 1000 and contig in (select doc_id from labels where quality = 1)")
def fasta_subset(spark, d):
    """JN-19, PRJ-5."""
    names = table(spark, d, "labels").filter("quality = 1").select(F.concat(F.lit("c"), "doc_id").alias("contig"))
    r = fasta.subset(fasta.longer(fasta.read_fasta(spark, _fasta(spark, d))), names)
    return r.select("contig", F.length("sequence").cast("long").alias("length"))


@_query(f"with {SEQ} select round(avg(n), 6) as mean_length from (select length(sequence) as n from seq where sequence <> '' order by contig limit 20000)")
def fastq_read_length(spark, d):
    """SNK-12, SRC-17: of all reads, the probe takes the first 20,000."""
    path = scratch(spark, "fastq")
    fasta.fastq(_records(spark, d).withColumn("k", F.substr("contig", F.lit(2)).cast("long")).repartitionByRange("k").sortWithinPartitions("k")).write.text(path)
    return spark.createDataFrame([(round(fasta.read_length(spark, path), 6),)], "mean_length double")


@_query(f"with {COV}, g as (select c.contig, s.sample from (select distinct contig from cov) c, (select distinct sample from cov) s) select g.contig::VARCHAR as contig, g.sample, round(coalesce(depth, 0), 4) as depth from g left join cov using (contig, sample)")
def coverage_round_trip(spark, d):
    """SRC-5, PRJ-15."""
    wide = cov(spark, d).groupBy("contig").pivot("sample", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.max("depth"), 4)).na.fill(0.0)
    path = scratch(spark, "coverage")
    wide.write.csv(path, sep="\t", header=True)
    return tables.read_coverage(spark, path, wide.select(F.col("contig").cast("string").alias("contig")))


def _gfa(spark, d) -> str:
    by = F.lead(F.struct("segment", "orientation")).over(Window.partitionBy("contig").orderBy("step"))
    w = walk(spark, d).withColumn("next", by).filter("next IS NOT NULL")
    links = w.select(F.col("segment").cast("string").alias("a"), F.col("orientation").alias("ao"), F.col("next.segment").cast("string").alias("b"), F.col("next.orientation").alias("bo"))
    path = scratch(spark, "gfa")
    gfa.write_gfa(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("contig"), F.col("p_size").alias("length")), links, path)
    return path


@_query("select p_partkey::VARCHAR as segment, p_size::BIGINT as length from part")
def gfa_segments_round_trip(spark, d):
    """SRC-9, SRC-10, FN-3, SNK-11."""
    return gfa.read_segments(spark, _gfa(spark, d)).select("segment", "length")


@_query(f"""with {WALK}, lk as (select segment as a, orientation as ao, lead(segment) over w as b, lead(orientation) over w as bo from walk window w as (partition by contig order by n1, segment, n3, orientation))
select a::VARCHAR as a, ao, b::VARCHAR as b, bo, count(*)::BIGINT as n, 0::BIGINT as overlap from lk where b is not null group by 1, 2, 3, 4""")
def gfa_links_round_trip(spark, d):
    """SRC-8, SRC-9, AGG-14."""
    return gfa.read_links(spark, _gfa(spark, d), strict=True).groupBy("a", "ao", "b", "bo").agg(F.count("*").alias("n"), F.max("overlap").alias("overlap"))


@_query("""select p_partkey::VARCHAR as segment, (case when p_size % 2 = 0 then p_size * 3 else length(p_name) end)::BIGINT as length, case when p_size % 3 = 0 then p_size / 2.0e0 end as depth, p_partkey::BIGINT as kmer_count,
case when p_size % 5 = 0 then 'last' else 'x' || p_size end as tag from part""")
def gfa_tags(spark, d):
    """SRC-10: lengths from LN or the sequence, DP and KC, a tag that repeats, many tags before the one that is read."""
    s, tag = F.col("p_size"), F.concat_ws
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("z"), F.substr(F.concat(F.lit("0"), i.cast("string")), F.length(i.cast("string"))), F.lit(":i:1"))), "\t")
    fields = [F.lit("S"), F.col("p_partkey").cast("string"), F.when(s % 2 == 0, "*").otherwise(F.repeat(F.lit("A"), F.length("p_name"))), F.concat(F.lit("LN:i:"), (s * 3).cast("string")), many,
              F.when(s % 3 == 0, F.concat(F.lit("DP:f:"), (s / 2).cast("string"))), F.concat(F.lit("KC:i:"), F.col("p_partkey").cast("string")), F.concat(F.lit("xx:Z:x"), s.cast("string")), F.when(s % 5 == 0, "xx:Z:last")]
    path = _written(table(spark, d, "part").select(tag("\t", *fields)), "tags")
    return gfa.read_segments(spark, path).select("segment", "length", "depth", "kmer_count", F.col("tags")["xx"].alias("tag"))


_STEPS = f"with {WALK}, p as (select contig, segment, orientation, row_number() over (partition by contig order by n1, segment, n3, orientation) - 1 as pos from walk)"


def _walk_text(spark, d):
    """contig, text: each walk as a list of signed segments."""
    steps = F.array_sort(F.collect_list(F.struct("step", F.concat(F.col("segment").cast("string"), "orientation").alias("s"))))
    return walk(spark, d).groupBy("contig").agg(F.array_join(F.transform(steps, lambda x: x["s"]), ",").alias("text"))


@_query(f"{_STEPS} select 'w' || contig as contig, pos::BIGINT as pos, segment::VARCHAR as segment, orientation from p")
def gfa_paths_round_trip(spark, d):
    """SRC-11, FN-4, WIN-3."""
    path = _written(_walk_text(spark, d).select(F.concat(F.lit("P\tw"), "contig", F.lit("\t"), "text", F.lit("\t*"))), "paths")
    return gfa.read_paths(spark, path)


@_query(f"{_STEPS} select 'w' || contig as contig, pos::BIGINT as pos, segment::VARCHAR as segment, orientation from p where contig % 3 > 0")
def contig_paths_round_trip(spark, d):
    """SRC-12: walks of reverse and of unknown contigs are skipped."""
    w = _walk_text(spark, d)
    lines = w.select(F.concat(F.lit("w"), "contig", F.lit("\n"), "text", F.lit("\nw"), "contig", F.lit("'\n"), "text"))
    known = w.filter("contig % 3 > 0").select(F.concat(F.lit("w"), "contig").alias("contig"))
    return gfa.read_contig_paths(spark, _written(lines, "contig-paths"), known)


@_query(f"{_STEPS} select 'w' || contig as contig, pos::BIGINT as pos, 'edge_' || segment as segment, orientation from p")
def path_table_round_trip(spark, d):
    """SRC-13."""
    w = _walk_text(spark, d)
    signed = F.transform(F.split("text", ","), lambda x: F.concat(F.when(x.endswith("-"), "-").otherwise(""), F.regexp_replace(x, "[+-]$", "")))
    path = scratch(spark, "path-table")
    w.select(F.concat(F.lit("w"), "contig").alias("#seq_name"), F.concat(F.lit("*,"), F.array_join(signed, ","), F.lit(",??")).alias("graph_path")).write.csv(path, sep="\t", header=True)
    return gfa.read_path_table(spark, path, w.select(F.concat(F.lit("w"), "contig").alias("contig")))


@_query("""with p as (select p_partkey as k, lead(p_partkey) over (order by p_partkey) as n, p_size as s from part)
select 'EDGE_' || k as a, case when s % 2 = 0 then '-' else '+' end as ao, 'EDGE_' || n as b, case when s % 3 = 0 then '-' else '+' end as bo from p where n is not null
union all select 'EDGE_' || k, case when s % 2 = 0 then '-' else '+' end, 'EDGE_1', '+' from p where n is not null""")
def fastg_links(spark, d):
    """SRC-14."""
    s, k = F.col("p_size"), F.col("p_partkey")
    p = table(spark, d, "part").withColumn("n", k + 1).join(table(spark, d, "part").select(k.alias("n")), "n")
    head = F.concat(F.lit("EDGE_"), k, F.when(s % 2 == 0, "'").otherwise(""), F.lit(":EDGE_"), "n", F.when(s % 3 == 0, "'").otherwise(""), F.lit(",EDGE_1;"))
    return gfa.read_fastg(p.select(head.alias("description")))


@_query(f"""with {WALK}, lk as (select segment as a, lead(segment) over (partition by contig order by n1, segment, n3, orientation) as b from walk)
select p_partkey::VARCHAR as segment from part union select a::VARCHAR from lk where b is not null union select b::VARCHAR from lk where b is not null union select 's' || l_suppkey from lineitem""")
def segment_id_set(spark, d):
    """SET-7."""
    path = _gfa(spark, d)
    steps = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("segment"))
    return graph.segment_ids(gfa.read_segments(spark, path), gfa.read_links(spark, path), steps)


@_query("""select distinct least(l_suppkey, l_partkey) as src, greatest(l_suppkey, l_partkey) as dst from lineitem where l_suppkey <> l_partkey and (l_linenumber > 4 or l_quantity > 40)""")
def stored_graph_edges(spark, d):
    """SRC-25, PRJ-7."""
    l = table(spark, d, "lineitem")
    return graph.linked(l.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.greatest(F.col("l_linenumber") - 4, F.lit(0))).alias("gfa_link_count"), F.greatest(F.col("l_quantity") - 40, F.lit(0.0)).alias("shared_segment_count")))


@_query("""with h as (select 'q' || l_partkey as query, 't' || l_suppkey as target, sum(l_quantity)::BIGINT as matches, sum(l_quantity + 3)::BIGINT as block from lineitem group by 1, 2)
select query, target, matches, block, round(matches / block, 6) as identity from h""")
def paf_round_trip(spark, d):
    """SRC-15, AGG-9; lines of fewer fields are skipped."""
    q = F.col("l_quantity").cast("long")
    fields = [F.concat(F.lit("q"), "l_partkey"), "1000", "0", q, "+", F.concat(F.lit("t"), "l_suppkey"), "2000", "5", q + 5, q, q + 3, "60"]
    line = F.concat_ws("\t", *((F.lit(f) if isinstance(f, str) else f).cast("string") for f in fields))
    rows = table(spark, d, "lineitem").select(line.alias("value")).union(spark.createDataFrame([("too\tshort",)], "value string"))
    return labelling.identities(tables.read_paf(spark, _written(rows, "paf"))).withColumn("identity", r6(F.col("identity")))


@_query("select n_name as dataset, n_nationkey::VARCHAR as study, case when n_regionkey > 1 then n_regionkey::VARCHAR end as accessions from nation")
def registry_round_trip(spark, d):
    """SRC-19."""
    n = table(spark, d, "nation")
    rows = n.select(F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string")).otherwise("-")).alias("value"))
    head = spark.createDataFrame([("# comment",), ("",), ("dataset\tstudy\taccessions",)], "value string").coalesce(1)
    return tables.read_registry(spark, _written(head.union(rows).coalesce(1), "registry"))


@_query("select c_name as contig, 'n' || c_nationkey as bin from customer")
def bins_table_round_trip(spark, d):
    """SRC-24, SNK-14."""
    path = scratch(spark, "bins")
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("ClusterName"), F.lit("x").alias("other"), F.col("c_name").alias("ContigName"))
    c.coalesce(1).write.csv(path, sep="\t", header=True)
    return tables.read_bins(spark, path)


@_query("select 'c' || c_custkey as contig, printf('bin_%06d', c_nationkey::BIGINT) as bin from customer")
def assignments_round_trip(spark, d):
    """SNK-1, SRC-22."""
    path = scratch(spark, "assignments")
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("contig"), F.col("c_nationkey").alias("bin"), F.lit(5000).alias("length"))
    tables.write_assignments(rows, path)
    return tables.read_assignments(spark.read.text(path), rows)


@_query(f"with {SEQ} select 'c' || contig as contig, source || '.x' as bin from seq join documents on doc_id = contig where sequence <> ''")
def assignments_from_folder(spark, d):
    """SNK-2, SRC-23: bins written as one FASTA file each, and their folder read as assignments."""
    path = scratch(spark, "bin-files")
    bins = table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("contig"), F.concat("source", F.lit(".x")).alias("bin"))
    records = _records(spark, d)
    fasta.write_bins(records, bins.join(records.select("contig"), "contig", "left_semi"), path)
    return tables.assignments_from_folder(spark, path, bins)


@_query("select distinct split_part(url, '?', 1) || page_id as contig from pages")
def virus_names(spark, d):
    """SRC-20."""
    name = F.concat(F.substring_index("url", "?", 1), "page_id")
    path = scratch(spark, "virus")
    table(spark, d, "pages").select(F.explode(F.array(name, F.concat(name, F.lit("|provirus_1_200")))).alias("seq_name"), F.lit(1).alias("length")).write.csv(path, sep="\t", header=True)
    return tables.read_virus_names(spark, path)


@_query("""select p_name || p_partkey as contig, p_type as tier, case when p_size > 9 then p_size * 1.5e0 end as completeness, p_size / 4.0e0 as contamination from part""")
def quality_summary_round_trip(spark, d):
    """SRC-21, SRT-3: written best first; NA is no number."""
    p = table(spark, d, "part")
    c = F.when(F.col("p_size") > 9, (F.col("p_size") * 1.5).cast("string")).otherwise("NA")
    path = scratch(spark, "summary")
    rows = p.select(F.concat("p_name", "p_partkey").alias("contig_id"), F.col("p_type").alias("checkv_quality"), c.alias("completeness"), (F.col("p_size") / 4).alias("contamination"))
    tables.report(rows, "completeness").write.csv(path, sep="\t", header=True)
    return tables.read_quality_summary(spark, path)


@_query("select 'sample' || (row_number() over (order by lpad(n_nationkey::VARCHAR, 3, '0')) - 1) as sample, 'r' || lpad(n_nationkey::VARCHAR, 3, '0') as stem, 'd/r' || lpad(n_nationkey::VARCHAR, 3, '0') || '_1.fastq.gz' as r1, case when n_regionkey > 0 then 'd/r' || lpad(n_nationkey::VARCHAR, 3, '0') || '_2.fastq.gz' end as r2 from nation")
def read_pairs(spark, d):
    """SRC-18, JN-18."""
    stem = F.concat(F.lit("d/r"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    n = table(spark, d, "nation").select(F.explode(F.array_compact(F.array(F.concat(stem, F.lit("_1.fastq.gz")), F.when(F.col("n_regionkey") > 0, F.concat(stem, F.lit("_2.fastq.gz"))), F.concat(stem, F.lit(".txt"))))).alias("path"))
    return tables.read_pairs(n)


@_query("select o_orderkey as k, o_orderstatus as s from orders where o_orderstatus = 'F'")
def completed_rows(spark, d):
    """SNK-8."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderstatus") == "F", "completed_ok").otherwise("failed").alias("status"))
    return tables.completed_keys(o, ["k", "s"])


_COHORT = f"""{SEQ}, c as (select 'c' || contig as contig, length(sequence)::BIGINT as length, source || '_s' || contig % 7 as strain, source as species, contig as id from seq join documents on doc_id = contig where length(sequence) >= 300 and lang <> 'de')"""


@_query(f"with {_COHORT} select contig, length, strain, species, printf('CB%07d_length_%d_cov_%.4f', row_number() over (order by contig), length, 1.5e0 + id % 10) as alias from c")
def cohort_export(spark, d):
    """SNK-9, PRJ-3, PRJ-4, JN-20: what is exported, with names mapped back from their aliases."""
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("c"), "doc_id").alias("contig")
    truth = docs.select(name, F.when(F.col("lang") == "de", "unbinned").otherwise(F.concat("source", F.lit("_s"), F.col("doc_id") % 7)).alias("strain"))
    depth = docs.select(name, F.explode(F.array(F.struct(F.lit("a").alias("sample"), (F.col("doc_id") % 10 + 1.0).alias("depth")), F.struct(F.lit("b").alias("sample"), (F.col("doc_id") % 10 + 2.0).alias("depth")))).alias("x")).select("contig", "x.*")
    path = scratch(spark, "cohort")
    tables.export_cohort(_records(spark, d), truth, depth, path, 300)
    exported = spark.read.csv(f"{path}/truth.tsv", sep="\t", header=True, schema="contig string, length long, strain string, species string")
    aliases = spark.read.csv(f"{path}/aliases.tsv", sep="\t", header=True)
    found = fasta.read_fasta(spark, f"{path}/aliased.fasta").select(F.col("contig").alias("alias"))
    return exported.join(tables.unaliased(found.withColumn("a", F.col("alias")), "a", aliases).select("alias", F.col("a").alias("contig")), "contig")


@_query(f"""with {SEQ}, k as (select row_number() over (order by contig) - 1 as i, contig, length(sequence) as n from seq where length(sequence) >= 300),
w as (select k.contig, greatest(0, n - 3) as windows, n, i from k) select 'c' || contig as contig, i::BIGINT as node_index, n::BIGINT as length, windows::BIGINT as windows, 1::BIGINT as samples from w""")
def dataset_round_trip(spark, d):
    """SNK-5, SRC-7, SRC-29: a prepared dataset, found and read again."""
    r = seq(spark, d).select(F.format_string("c%d", "contig").alias("contig"), F.col("contig").alias("k"), "sequence")
    path = scratch(spark, "dataset")
    ordered = r.withColumn("contig", F.format_string("%012d", "k"))  # the index follows the numbers
    edges = ordered.select(F.col("contig").alias("src"), F.format_string("%012d", F.col("k") + 1).alias("dst"))
    dataset.write_dataset(ordered.drop("k"), ordered.select("contig", F.lit("s").alias("sample"), F.lit(1.0).alias("depth")), edges, path, 300)
    found, _ = dataset.discover(spark, [path, f"{path}-absent"])
    parts = dataset.read_dataset(spark, found[0])
    windows = parts["kmers"].groupBy("contig").agg(F.sum("cnt").alias("windows"))
    samples = parts["coverage"].groupBy("contig").agg(F.count("*").alias("samples"))
    named = parts["contigs"].join(windows, "contig").join(samples, "contig")
    return named.select(F.concat(F.lit("c"), F.col("contig").cast("long").cast("string")).alias("contig"), "node_index", "length", "windows", "samples")


_BLOCKS = """b as (select l_suppkey as contig, l_returnflag as sample, date_diff('day', date '1992-01-01', l_shipdate::DATE)::BIGINT as s, l_quantity::BIGINT as n from lineitem where l_linenumber <> 4 and l_partkey % 60 >= 10),
len as (select distinct l_suppkey as contig, 2400 + l_suppkey % 97 as length from lineitem)"""


def _blocks(spark, d):
    """Aligned blocks, of which every fourth line's are secondary, and lengths that cut some of them off."""
    l = table(spark, d, "lineitem")
    flag = F.when(F.col("l_linenumber") == 4, 0x100).otherwise(16)
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    blocks = l.select(F.col("l_suppkey").alias("contig"), F.col("l_returnflag").alias("sample"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), flag.alias("flag"), (F.col("l_partkey") % 60).alias("quality"))
    return blocks, l.select(F.col("l_suppkey").alias("contig")).distinct().withColumn("length", 2400 + F.col("contig") % 97)


@_query(f"""with {_BLOCKS}, base as (select contig, sample, p, count(*) as depth from (select contig, sample, length, unnest(range(s, s + n)) as p from b join len using (contig)) where p < length group by 1, 2, 3),
sums as (select contig, sample, sum(depth) as bases, count(*) as covered, max(depth) as deepest from base group by 1, 2),
every as (select distinct b.contig, sample from b join len using (contig))
select contig, sample, length::BIGINT as length, round(coalesce(bases, 0) / length, 6) as depth, round(1 - coalesce(covered, 0) / length, 6) as zero_share, coalesce(deepest, 0)::BIGINT as deepest from every left join sums using (contig, sample) join len using (contig)""")
def aligned_depth(spark, d):
    """AGG-12, PRJ-6, SRC-16: depth by base; unmapped and secondary blocks, and those of low quality, do not count."""
    s = pileup.depth_summary(*_blocks(spark, d), 10)
    return s.select("contig", "sample", F.col("length").cast("long").alias("length"), r6(F.col("depth")).alias("depth"), r6(F.col("zero_share")).alias("zero_share"), "deepest")


@_query(f"""with {_BLOCKS}, base as (select contig, sample, p, count(*) as depth from (select contig, sample, unnest(range(s, s + n)) as p from b) group by 1, 2, 3)
select contig, sample, depth::BIGINT as depth, count(*)::BIGINT as positions from base group by 1, 2, 3""")
def depth_histogram(spark, d):
    """SRC-16: how many positions of each contig and sample have each depth, from runs over tiles."""
    runs = pileup.depth_runs(pileup.usable(_blocks(spark, d)[0], 10), "contig", "sample", tile=256)
    return runs.filter("depth > 0 AND end > start").groupBy("contig", "sample", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("positions"))


@_query("select event_type as sample from events group by 1 having max(value - value) - min(value - value) <= 1e-9 and event_type < 'f' union all select 'flat' as sample")
def dead_samples(spark, d):
    """AGG-34."""
    e = table(spark, d, "events").select(F.col("event_type").alias("sample"), "value")
    depth = e.withColumn("depth", F.when(F.col("sample") < "f", 2.0).otherwise(F.col("value"))).select("sample", "depth")
    return labelling.dead_samples(depth.union(e.select(F.lit("flat"), F.lit(0.0))))


@_query(f"""with {COV}, x as (select contig as strain, sample, depth / (1000 + contig % 97) as d from cov), m as (select sample, avg(d) as m from x where d > 0 group by 1)
select strain, sample, round(d / m, 6) as depth from x join m using (sample)""")
def simulated_depths(spark, d):
    """AGG-40."""
    a = cov(spark, d).select(F.col("contig").alias("strain"), "sample", F.col("depth").alias("share"))
    lengths = a.select("strain").distinct().withColumn("length", 1000 + F.col("strain") % 97)
    return simulate.depths(a, lengths).withColumn("depth", r6(F.col("depth")))


@_query("""with n as (select c_nationkey as label, c_custkey % 5 as component, count(*) as n from customer group by 1, 2)
select (select sum(m * (m - 1) / 2) from (select sum(n) as m from n group by label))::BIGINT as pairs, (select sum(n * (n - 1) / 2) from n)::BIGINT as reachable""")
def reachable_pairs(spark, d):
    """JN-17."""
    c = table(spark, d, "customer")
    return labelling.reachable_pairs(c.select(F.col("c_custkey").alias("contig"), F.col("c_nationkey").alias("label")), c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("component")))


@_query("""with x as (select s_suppkey as k, 'Virus_' || s_suppkey || case s_suppkey % 4 when 0 then '_RNA2' when 1 then '_DNA-C' when 2 then '_segment3' else '' end as base from supplier)
select base || case when k % 3 = 0 then '_MZ405653' when k % 3 = 1 then '_AB12345.1_C123456' else '' end as name, 'Virus_' || k as agent from x""")
def agent_names(spark, d):
    """PRJ-18."""
    k = F.col("s_suppkey")
    base = F.concat(F.lit("Virus_"), k, F.when(k % 4 == 0, "_RNA2").when(k % 4 == 1, "_DNA-C").when(k % 4 == 2, "_segment3").otherwise(""))
    name = F.concat(base, F.when(k % 3 == 0, "_MZ405653").when(k % 3 == 1, "_AB12345.1_C123456").otherwise(""))
    return table(spark, d, "supplier").select(name.alias("name"), labelling.agent_name(name).alias("agent"))


@_query("""select p_partkey as k, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as plain, 'v' || p_size || '.' || (p_partkey % 10) as said, p_size || '.' || (p_partkey % 10) as version,
p_brand || '__coasm__' || p_type || case when p_size % 2 = 0 then '__t' || p_size else '' end as run from part""")
def names_and_versions(spark, d):
    """FN-7, FN-8, FN-9."""
    p = table(spark, d, "part")
    said = F.concat(F.lit("v"), "p_size", F.lit("."), F.col("p_partkey") % 10)
    tag = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("t"), "p_size")).otherwise("")
    return p.select(F.col("p_partkey").alias("k"), alphanumeric(F.col("p_name")).alias("plain"), said.alias("said"), version_in(said).alias("version"), run_name(F.col("p_brand"), F.col("p_type"), tag).alias("run"))


@_query("""with c as (select p_brand as term, p_partkey as id, p_brand as name, 40000 + p_size * 20 as length, 40 + (p_partkey % 5) * 0.5e0 as gc, 40300 as want, 41.0e0 as gcw from part),
x as (select term, id, abs(length - want) as off, not contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(term), '[^a-z0-9]', '', 'g')) as other from c where abs(length - want) <= greatest(30, 0.01e0 * want) and abs(gc - gcw) <= 1)
select term, id from x qualify row_number() over (partition by term order by other, off, id) = 1""")
def closest_candidates(spark, d):
    """SRT-7."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), (40000 + F.col("p_size") * 20).alias("length"), (40 + (F.col("p_partkey") % 5) * 0.5).alias("gc"), F.lit(40300).alias("want_length"), F.lit(41.0).alias("want_gc"))
    return labelling.closest_candidate(p)


@_query("""with g as (select conv_id as contig, turn * 100 as s, turn * 100 + length(coalesce(text, '')) as e, role as strand from conversations),
o as (select *, lag(strand) over (partition by contig order by s, e, strand) as before from g),
a as (select contig, count(*) as n, sum(e - s) as coding, avg(e - s) as m, count_if(before is not null and before <> strand) as sw from o group by 1)
select contig, 10000::BIGINT as length, n::BIGINT as n_orfs, round(coding / 10000, 6) as coding_density, round(m, 6) as mean_orf_len, round(n / 10.0e0, 6) as orfs_per_kb, round(case when n > 1 then sw / (n - 1) else 0 end, 6) as strand_switch_rate, 40.0e0 as gc_mean, 11::BIGINT as translation_table from a
union all select -1, 10000, 0, 0, 0, 0, 0, 0, 0""")
def gene_features(spark, d):
    """AGG-29, WIN-4; a contig without genes has zeros."""
    start = F.col("turn") * 100
    genes = table(spark, d, "conversations").select(F.col("conv_id").alias("contig"), start.alias("start"), (start + F.length(F.coalesce("text", F.lit("")))).alias("end"), F.col("role").alias("strand"), F.lit(40.0).alias("gc"), F.lit(11).cast("long").alias("table"))
    lengths = genes.select("contig").distinct().union(spark.range(1).select(F.lit(-1).cast("long"))).withColumn("length", F.lit(10000).cast("long"))
    return labelling.gene_architecture(genes, lengths).select("contig", "length", "n_orfs", *(r6(F.col(c)).alias(c) for c in ("coding_density", "mean_orf_len", "orfs_per_kb", "strand_switch_rate", "gc_mean")), F.col("translation_table").cast("long").alias("translation_table"))


@_query("""with s as (select l_partkey as query, l_suppkey as target, date_diff('day', date '1992-01-01', l_shipdate::DATE)::BIGINT as s, l_quantity::BIGINT as n from lineitem),
sc as (select query, target, sum(n) as matches, target % 10 as truth from s group by 1, 2),
r as (select *, row_number() over w as rank, first_value(target) over w as best, first_value(truth) over w as own from sc window w as (partition by query order by matches desc, target)),
days as (select distinct query, target, unnest(range(s, s + n)) as day from s),
p as (select r.query, r.best, r.target as rival, r.rank, count(*) as extra from r join days d on d.query = r.query and d.target = r.target where truth <> own and not exists (select 1 from days b where b.query = r.query and b.target = r.best and b.day = d.day) group by 1, 2, 3, 4)
select query, best, rival, extra::BIGINT as extra from p where extra >= 0.25e0 * 100 qualify row_number() over (partition by query order by rank) = 1""")
def rival_targets(spark, d):
    """JN-14: the first target of another truth group with cover of its own."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    n = F.col("l_quantity").cast("long")
    spans = table(spark, d, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("target"), day.alias("start"), (day + n).alias("end"), n.alias("matches"))
    groups = spans.select("target").distinct().withColumn("truth", F.col("target") % 10)
    return labelling.rivals(spans, groups, spans.select("query").distinct().withColumn("length", F.lit(100)))


@_query(f"with {SEQ} select count_if(length(sequence) >= 500)::BIGINT as locked, round(count_if(length(sequence) >= 500) / count(*), 6) as fraction from seq")
def locked_share(spark, d):
    """AGG-41."""
    return completeness.locked_share(seq(spark, d).select((F.length("sequence") >= 500).alias("locked")))


@_query(f"with {COV}, r as (select contig, sample, rank() over (partition by sample order by depth) + (count(*) over (partition by sample, depth) - 1) / 2.0e0 as r from cov), p as (select corr(a.r, b.r) as rho from r a join r b on a.contig = b.contig and a.sample < b.sample group by a.sample, b.sample) select round(median(rho), 6) + 0.0 as median, round(min(rho), 6) + 0.0 as least, round(max(rho), 6) + 0.0 as greatest from p")
def spearman_summary(spark, d):
    """AGG-33."""
    return labelling.rank_correlation_summary(cov(spark, d), "contig", "sample", "depth")
