"""Queries 1-9, 55, 63: composition and abundance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dna import gc_percent
from ..operators import features
from .common import COV, SEQ, cov, r6, seq, table

QUERIES, ORACLES = {}, {}
_KMERS = f"""{SEQ},
words as (select contig, sequence[i:i+3] as kmer from (select contig, sequence, unnest(range(1, length(sequence) - 2)) as i from seq where length(sequence) >= 4)),
counts as (select contig, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as kmer, count(*)::BIGINT as cnt from words group by 1, 2)"""
_GRID = """grid as (select contig, m.kmer from seq, (select distinct least(k, reverse(translate(k, 'ACGT', 'TGCA'))) as kmer from
(select a.c || b.c || d.c || e.c as k from (values ('A'),('C'),('G'),('T')) a(c), (values ('A'),('C'),('G'),('T')) b(c), (values ('A'),('C'),('G'),('T')) d(c), (values ('A'),('C'),('G'),('T')) e(c))) m),
dense as (select g.contig, g.kmer, coalesce(c.cnt, 0)::BIGINT as cnt from grid g left join counts c on g.contig = c.contig and g.kmer = c.kmer)"""
_CPM = f"""{COV}, cpm as (select contig, sample, depth * (1e6 / greatest(sum(depth) over (partition by sample), 1e-9)) as depth from cov)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {_KMERS} select contig, kmer, cnt from counts")
def kmer_canonical_counts(spark, d):
    return features.kmer_counts(seq(spark, d))


@query(f"with {_KMERS} select contig, kmer, round(cnt / sum(cnt) over (partition by contig), 6) as freq from counts")
def kmer_frequencies(spark, d):
    return features.kmer_frequencies(features.kmer_counts(seq(spark, d))).select("contig", "kmer", r6(F.col("freq")).alias("freq"))


@query(f"with {_KMERS}, {_GRID} select contig, kmer, cnt from dense")
def kmer_dense_vector(spark, d):
    s = seq(spark, d)
    return features.dense_kmers(s, features.kmer_counts(s))


@query(f"""with {_KMERS}, {_GRID}, logs as (select contig, kmer, ln(cnt + 0.5e0) as l from dense),
c as (select contig, kmer, l - avg(l) over (partition by contig) as z from logs), s as (select kmer, avg(z) as m, stddev_pop(z) as sd from c group by 1)
select contig, kmer, round((z - m) / (sd + 1e-5), 6) + 0.0 as z from c join s using (kmer)""")
def tnf_clr(spark, d):
    s = seq(spark, d)
    return features.clr(features.dense_kmers(s, features.kmer_counts(s))).select("contig", "kmer", r6(F.col("z")).alias("z"))


@query(f"with {SEQ} select contig, length(sequence)::BIGINT as length, (row_number() over (order by contig) - 1)::BIGINT as node_index from seq where length(sequence) >= 200")
def length_filter_reindex(spark, d):
    return features.retained(seq(spark, d).select("contig", F.length("sequence").cast("long").alias("length")), 200)


_SAMPLES = ["click", "error", "purchase", "signup", "view"]


@query(f"with {COV} select contig, " + ", ".join(f"round(coalesce(max(case when sample = '{s}' then depth end), 0), 4) as {s}" for s in _SAMPLES) + " from cov group by 1")
def coverage_pivot(spark, d):
    wide = features.wide(cov(spark, d), _SAMPLES)
    return wide.select("contig", *(F.round(s, 4).alias(s) for s in _SAMPLES))


@query(f"with {_CPM} select contig, sample, round(ln(1 + depth), 6) as log_depth from cpm")
def coverage_cpm_log(spark, d):
    return features.cpm(cov(spark, d)).select("contig", "sample", r6(F.log1p("depth")).alias("log_depth"))


@query(f"""with {_CPM}, x as (select contig, sample, depth / greatest(sum(depth) over (partition by contig), 1e-9) as share, ln(1 + depth) - avg(ln(1 + depth)) over (partition by contig) as profile from cpm),
l as (select contig, 'share_' || sample as feature, share as value from x union all select contig, 'profile_' || sample, profile from x union all select contig, 'log_total', ln(1 + sum(depth)) from cpm group by 1),
s as (select feature, avg(value) as m, stddev_pop(value) as sd from l group by 1) select contig, feature, round((value - m) / (sd + 1e-5), 5) + 0.0 as value from l join s using (feature)""")
def coverage_abundance_view(spark, d):
    return features.abundance_view(features.cpm(cov(spark, d))).select("contig", "feature", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(f"with {SEQ}, {COV}, samples as (select distinct sample from cov) select s.contig, m.sample, round(coalesce(c.depth, 0), 4) as depth from seq s cross join samples m left join cov c on c.contig = s.contig and c.sample = m.sample")
def coverage_left_fill(spark, d):
    return features.left_fill(seq(spark, d), cov(spark, d)).withColumn("depth", F.round("depth", 4))


@query(f"with {SEQ} select contig, round(case when length(sequence) > 0 then 100.0e0 * length(regexp_replace(sequence, '[^GC]', '', 'g')) / length(sequence) else 0 end, 6) as gc from seq")
def gc_percent_by_contig(spark, d):
    return seq(spark, d).select("contig", r6(gc_percent(F.col("sequence"))).alias("gc"))


@query(f"""with {COV}, s as (select contig, sample, depth / sum(depth) over (partition by sample) as share from cov), len as (select contig, 1000 + contig % 97 as length from (select distinct contig from cov)),
x as (select s.contig, sample, share, share / length as raw from s join len using (contig))
select contig, sample, round(share, 9) as share, round(raw / avg(case when raw > 0 then raw end) over (partition by sample), 6) as depth, (count_if(share > 0) over (partition by sample))::BIGINT as present from x""")
def abundance_normalise(spark, d):
    c = cov(spark, d)
    lengths = c.select("contig").distinct().withColumn("length", 1000 + F.col("contig") % 97)
    return features.normalised(c, lengths).select("contig", "sample", F.round("share", 9).alias("share"), r6(F.col("depth")).alias("depth"), "present")
