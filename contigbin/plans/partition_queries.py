"""Queries 37-43, 52, 61, 64, 65: scores and reports of partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acceptance, metrics
from .common import PART, part_labels, r6, table
from .feature_queries import query as _query

_CELLS = f"with {PART}, known as (select * from part_labels where truth is not null), cells as (select bin, truth, count(*) as n from known where bin is not null group by 1, 2)"
_HITS = f"{_CELLS}, h as (select (select sum(n) from (select max(n) as n from cells group by bin)) as hb, (select sum(n) from (select max(n) as n from cells group by truth)) as ht, (select count(bin) from known) as assigned, (select count(*) from known) as total)"


def _scores(df):
    return df.select(*(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")), "assigned", "total")


@_query(f"""{_HITS}, p as (select hb / assigned as "precision", ht / assigned as recall, assigned, total from h)
select round("precision", 6) as "precision", round(recall, 6) as recall, round(2 * "precision" * recall / ("precision" + recall), 6) as f1, assigned::BIGINT as assigned, total::BIGINT as total from p""")
def prf_core(spark, d):
    return _scores(metrics.precision_recall(part_labels(spark, d)))


@_query(f"""{_HITS}, p as (select hb / assigned as "precision", ht / total as recall, assigned, total from h)
select round("precision", 6) as "precision", round(recall, 6) as recall, round(2 * "precision" * recall / ("precision" + recall), 6) as f1, assigned::BIGINT as assigned, total::BIGINT as total from p""")
def prf_benchmark(spark, d):
    return _scores(metrics.precision_recall(part_labels(spark, d), cohort=True))


@_query(f"""with {PART}, k as (select coalesce(bin, '__unassigned__' || contig) as bin, truth from part_labels), cells as (select bin, truth, count(*)::DOUBLE as n from k group by 1, 2),
b as (select bin, sum(n) as n from cells group by 1), t as (select truth, sum(n) as n from cells group by 1), a as (select sum(n) as n from cells),
s as (select (select sum(n * (n - 1) / 2) from cells) as c, (select sum(n * (n - 1) / 2) from b) as pb, (select sum(n * (n - 1) / 2) from t) as pt, (select n from a) as n,
(select sum(x.n / a.n * ln(x.n * a.n / (b.n * t.n))) from cells x join b using (bin) join t using (truth), a) as mutual, (select -sum(b.n / a.n * ln(b.n / a.n)) from b, a) as hb, (select -sum(t.n / a.n * ln(t.n / a.n)) from t, a) as ht)
select round((c - pb * pt / (n * (n - 1) / 2)) / ((pb + pt) / 2 - pb * pt / (n * (n - 1) / 2)), 6) + 0.0 as ari, round(mutual / ((hb + ht) / 2), 6) as nmi from s""")
def ari_nmi(spark, d):
    s = metrics.ari_nmi(metrics.singletons_for_missing(part_labels(spark, d)))
    return s.select(r6(F.col("ari")).alias("ari"), r6(F.col("nmi")).alias("nmi"))


_SUPPLY = "labels_of as (select p_partkey as contig, p_brand as bin, case when p_partkey % 41 = 0 then 'none' else 'g' || (hash_of.k) end as truth from part join (select p_brand as b, min(p_partkey) as k from part group by 1) hash_of on b = p_brand)"


@_query(f"""with {_SUPPLY}, c as (select bin, truth, count(*) as n from labels_of group by 1, 2), t as (select truth, count(*) as nt from labels_of group by 1),
x as (select *, sum(n) over (partition by bin) as nb, row_number() over (partition by bin order by n desc, truth) as r from c)
select bin, truth, n::BIGINT as hits, nb::BIGINT as n_bin, nt::BIGINT as n_truth from x join t using (truth) where r = 1 and n / nt >= 0.9 and 1 - n / nb <= 0.05""")
def hq_bins(spark, d):
    p = table(spark, d, "part")
    first = p.groupBy(F.col("p_brand").alias("bin")).agg(F.min("p_partkey").alias("k"))
    rows = p.select(F.col("p_partkey").alias("contig"), F.col("p_brand").alias("bin")).join(first, "bin")
    return metrics.high_quality_bins(rows.select("contig", "bin", F.when(F.col("contig") % 41 == 0, "none").otherwise(F.concat(F.lit("g"), "k")).alias("truth")))


@_query(f"with {PART}, s as (select bin, count(*) as n from part_labels where bin is not null group by 1) select count(*)::BIGINT as bins, count_if(n = 1)::BIGINT as singletons, count_if(n > 1)::BIGINT as multi, max(n)::BIGINT as largest, sum(n)::BIGINT as members from s")
def bin_size_stats(spark, d):
    return metrics.size_stats(part_labels(spark, d))


@_query("""with p as (select distinct l_returnflag as a, case l_returnflag when 'A' then 3 when 'N' then 1 else 2 end as b from lineitem)
select count(*)::BIGINT as pairs, count(distinct a)::BIGINT as n_a, count(distinct b)::BIGINT as n_b, count(*) = count(distinct a) and count(*) = count(distinct b) as equivalent from p""")
def partition_equivalence(spark, d):
    f = F.col("l_returnflag")
    return metrics.equivalent(table(spark, d, "lineitem").select(f.alias("a"), F.when(f == "A", 3).when(f == "N", 1).otherwise(2).alias("b")), "a", "b")


@_query("with s as (select label, count(*)::DOUBLE as n from embeddings group by 1) select round(least(greatest(sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2), 1e-7), 0.5), 9) as prior from s")
def pair_prior(spark, d):
    return metrics.pair_prior(table(spark, d, "embeddings").select(F.col("label").alias("bin"))).select(F.round("prior", 9).alias("prior"))


@_query(f"""with {PART}, c as (select bin, truth, quality, count(*) as n from part_labels where bin is not null group by 1, 2, 3)
select coalesce(truth, '') as truth, coalesce(quality, -1)::BIGINT as tier, count(distinct bin)::BIGINT as n_labels, count(distinct case when n >= 2 then bin end)::BIGINT as multi, coalesce(sum(case when n >= 2 then n end), 0)::BIGINT as members from c group by rollup (truth, quality)""")
def multi_label_stats(spark, d):
    c = part_labels(spark, d).filter("bin IS NOT NULL").groupBy("bin", "truth", "quality").agg(F.count("*").alias("n"))
    many = F.when(F.col("n") >= 2, F.col("n"))
    stats = c.rollup("truth", "quality").agg(F.countDistinct("bin").alias("n_labels"), F.countDistinct(F.when(F.col("n") >= 2, F.col("bin"))).alias("multi"), F.coalesce(F.sum(many), F.lit(0)).alias("members"))
    return stats.select(F.coalesce("truth", F.lit("")).alias("truth"), F.coalesce("quality", F.lit(-1)).cast("long").alias("tier"), "n_labels", "multi", "members")


@_query("with c as (select c_custkey as contig, c_nationkey as bin, count(*) over (partition by c_nationkey) as n from customer) select contig, bin from c where n <= 60")
def bin_cap(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("contig"), F.col("c_nationkey").alias("bin"))
    return acceptance.capped(c, 60)


@_query(f"""with {PART} select count(*)::BIGINT as contigs, count(bin)::BIGINT as assigned_contigs, sum(length)::BIGINT as bases, coalesce(sum(case when bin is not null then length end), 0)::BIGINT as assigned_bases,
round(count(bin) / count(*), 6) as contig_share, round(coalesce(sum(case when bin is not null then length end), 0) / sum(length), 6) as base_share from part_labels""")
def assigned_share(spark, d):
    """AGG-26."""
    p = part_labels(spark, d)
    s = acceptance.assigned_share(p.select("contig", "length"), p.select("contig", "bin"))
    return s.withColumns({c: r6(F.col(c)) for c in ("contig_share", "base_share")})


_TIER = "case when p_size > 45 then 'Complete' when p_size > 35 then 'High-quality' when p_size > 20 then 'Medium-quality' when p_size > 5 then 'Low-quality' else 'Not-determined' end"


@_query(f"""with r as (select p_brand as method, {_TIER} as tier, case when p_size > 5 then p_retailprice / 17 end as completeness, case when p_size % 4 > 0 then (p_partkey % 90) / 10.0e0 end as contamination from part)
select method, count(*)::BIGINT as n, count_if(tier = 'Complete')::BIGINT as complete, count_if(tier = 'High-quality')::BIGINT as high_quality, count_if(tier = 'Medium-quality')::BIGINT as medium_quality, count_if(tier = 'Low-quality')::BIGINT as low_quality, count_if(tier = 'Not-determined')::BIGINT as not_determined,
round(avg(completeness), 2) as mean_completeness, round(median(completeness), 2) as median_completeness, round(avg(contamination), 2) as mean_contamination, round(median(contamination), 2) as median_contamination,
count_if(contamination > 5)::BIGINT as contaminated, count_if(tier in ('Complete', 'High-quality', 'Medium-quality'))::BIGINT as medium_or_better from r group by 1""")
def checkv_style_summary(spark, d):
    s = F.col("p_size")
    tier = F.when(s > 45, "Complete").when(s > 35, "High-quality").when(s > 20, "Medium-quality").when(s > 5, "Low-quality").otherwise("Not-determined")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("method"), tier.alias("tier"), F.when(s > 5, F.col("p_retailprice") / 17).alias("completeness"), F.when(s % 4 > 0, (F.col("p_partkey") % 90) / 10.0).alias("contamination"))
    return metrics.quality_summary(rows, "method")


@_query("with s as (select regexp_replace(c_mktsegment || '_s' || (c_custkey % 9), '_s[0-9]+$', '') as species, c_acctbal from customer) select species, count(*)::BIGINT as n, round(sum(c_acctbal), 2) as total from s group by 1")
def species_rollup(spark, d):
    name = F.concat("c_mktsegment", F.lit("_s"), (F.col("c_custkey") % 9).cast("string"))
    s = table(spark, d, "customer").select(F.regexp_replace(name, "_s\\d+$", "").alias("species"), "c_acctbal")
    return s.groupBy("species").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
