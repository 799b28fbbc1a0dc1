"""Queries 44-51, 53-54, 56, 59-60: labels from alignments, dataset reports, keyed tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import acceptance, graph, labelling, mock
from ..sources import keyed
from .common import COV, cov, r6, scratch, table
from .feature_queries import query as _query

_SPANS = "spans as (select l_suppkey as target, l_partkey as query, date_diff('day', date '1992-01-01', l_shipdate::DATE)::BIGINT as s, (date_diff('day', date '1992-01-01', l_shipdate::DATE) + l_quantity)::BIGINT as e from lineitem)"


def _spans(spark, d):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("query"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))


def _union_sql(source: str, by: str) -> str:
    return f"(select {by}, sum(greatest(0, e - greatest(s, coalesce(reach, s))))::BIGINT as covered from (select *, max(e) over (partition by {by} order by s, e rows between unbounded preceding and 1 preceding) as reach from {source}) group by {by})"


@_query(f"with {_SPANS} select target, covered from {_union_sql('spans', 'target')}")
def interval_union(spark, d):
    return labelling.interval_union(_spans(spark, d), "target")


_SCORED = "scored as (select l_partkey as query, l_suppkey as target, sum(l_quantity)::BIGINT as matches, sum(l_quantity + round(l_discount * 100))::BIGINT as block from lineitem group by 1, 2)"


def _scored(spark, d):
    q = F.col("l_quantity")
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("target"), q.cast("long").alias("matches"), (q + F.round(F.col("l_discount") * 100)).cast("long").alias("block"))
    return labelling.identities(hits)


@_query(f"""with {_SCORED}, x as (select *, max(matches) over (partition by query) as best, row_number() over (partition by query order by matches desc, target) as r from scored),
y as (select *, count_if(matches >= best * 0.98e0) over (partition by query) as n_tied from x) select query, target, matches, round(matches / greatest(block, 1), 6) as identity, n_tied::BIGINT as n_tied from y where r = 1 and matches / greatest(block, 1) >= 0.9""")
def paf_identity_labels(spark, d):
    best = labelling.best_targets(_scored(spark, d)).filter("identity >= 0.9")
    return best.select("query", "target", "matches", r6(F.col("identity")).alias("identity"), "n_tied")


@_query(f"""with recursive {_SCORED}, x as (select *, max(matches) over (partition by query) as best, first_value(target) over (partition by query order by matches desc, target) as top from scored),
e as (select distinct top as a, target as b from x where matches >= best * 0.98e0 and target <> top), b as (select a, b from e union select b, a from e),
reach(id, other) as (select a, a from b union select r.id, b.b from reach r join b on b.a = r.other), c as (select id, min(other) as component from reach group by 1)
select component, string_agg(id::VARCHAR, '|' order by id) as members, count(*)::BIGINT as size from c group by 1""")
def tie_groups(spark, d):
    pairs = labelling.tied_pairs(_scored(spark, d))
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return labelling.group_names(graph.connected_components(nodes, pairs))


_CHIMERA = f"{_SPANS}, tot as (select query, target, covered, row_number() over (partition by query order by covered desc, target) as r from {_union_sql('spans', 'query, target')})"


@_query(f"""with {_CHIMERA}, best as (select query, target as best, covered as b from tot where r = 1), rival as (select query, target as rival, covered as v from tot where r = 2),
both_ as (select s.query, s.s, s.e from spans s join best on s.query = best.query and s.target = best.best union all select s.query, s.s, s.e from spans s join rival on s.query = rival.query and s.target = rival.rival)
select query, best, rival, (covered - b)::BIGINT as extra, (covered - b) >= 0.25 * covered as chimeric from best join rival using (query) join {_union_sql('both_', 'query')} using (query)""")
def chimera_flag(spark, d):
    spans = _spans(spark, d)
    total = labelling.interval_union(spans, "query", "target")
    by = Window.partitionBy("query").orderBy(F.desc("covered"), "target")
    ranked = total.withColumn("r", F.row_number().over(by)).filter("r <= 2")
    pair = ranked.groupBy("query").agg(F.max(F.when(F.col("r") == 1, F.col("target"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("target"))).alias("rival"), F.max(F.when(F.col("r") == 1, F.col("covered"))).alias("b")).filter("rival IS NOT NULL")
    both = labelling.interval_union(spans.join(ranked.select("query", "target"), ["query", "target"]), "query")
    extra = F.col("covered") - F.col("b")
    return pair.join(both, "query").select("query", "best", "rival", extra.alias("extra"), (extra >= 0.25 * F.col("covered")).alias("chimeric"))


@_query(f"""with {_SPANS}, u as (select target, covered from {_union_sql('spans', 'target')}), n as (select target, count(distinct query) as contigs, sum(e - s) as bp from spans group by 1)
select s_suppkey as target, coalesce(covered, 0)::BIGINT as covered, round(least(coalesce(covered, 0) / 3650.0e0, 1.0e0), 6) as fraction, coalesce(contigs, 0)::BIGINT as contigs, coalesce(bp, 0)::BIGINT as bp, coalesce(covered, 0) / 3650.0e0 >= 0.5 as recovered from supplier left join u on u.target = s_suppkey left join n on n.target = s_suppkey""")
def reference_recovery(spark, d):
    spans = _spans(spark, d)
    hits = spans.select("target", F.col("start").alias("target_start"), F.col("end").alias("target_end"), F.lit(3650).cast("long").alias("target_length"))
    name = F.col("s_suppkey")
    refs = table(spark, d, "supplier").select(name.alias("target"), name.alias("agent"), name.alias("molecule"), name.alias("truth"))
    found = mock.recovery(hits, refs, spans.groupBy(F.col("target").alias("truth"), "query").agg(F.sum(F.col("end") - F.col("start")).alias("length")))
    return found.select("target", "covered", r6(F.least("fraction", F.lit(1.0))).alias("fraction"), "contigs", F.col("bases").alias("bp"), (F.col("fraction") >= 0.5).alias("recovered"))


@_query("""with c as (select lang, n_chars as length, sum(n_chars) over (partition by lang order by n_chars desc, doc_id rows unbounded preceding) as reached, sum(n_chars) over (partition by lang) as total from documents),
n as (select lang, max(case when reached >= total / 2 then length end) as n50 from c group by 1),
h as (select lang, case when n_chars < 5000 then 'short' when n_chars <= 10000 then 'medium' else 'long' end as size, count(*) as n, min(n_chars) as shortest, median(n_chars) as middle, max(n_chars) as longest, sum(n_chars) as total from documents group by grouping sets ((lang, size), (lang)))
select h.lang, coalesce(size, 'all') as size, h.n::BIGINT as n, shortest::BIGINT as shortest, round(middle, 1) as middle, longest::BIGINT as longest, h.total::BIGINT as total, case when size is null then n50 end as n50 from h join n on n.lang = h.lang""")
def n50_histogram(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("n_chars").alias("length"))
    sized = docs.withColumn("size", F.when(F.col("length") < 5000, "short").when(F.col("length") <= 10000, "medium").otherwise("long"))
    stats = [F.count("*").alias("n"), F.min("length").alias("shortest"), F.round(F.percentile("length", F.lit(0.5)), 1).alias("middle"), F.max("length").alias("longest"), F.sum("length").alias("total")]
    whole = sized.groupBy("lang").agg(*stats).join(labelling.n50(docs, "lang"), "lang").withColumn("size", F.lit("all"))
    return sized.groupBy("lang", "size").agg(*stats).withColumn("n50", F.lit(None).cast("long")).unionByName(whole)


@_query(f"""with {COV}, r as (select contig, sample, rank() over (partition by sample order by depth) + (count(*) over (partition by sample, depth) - 1) / 2.0e0 as r from cov)
select a.sample as a, b.sample as b, round(corr(a.r, b.r), 6) + 0.0 as rho from r a join r b on a.contig = b.contig and a.sample < b.sample group by 1, 2""")
def spearman_samples(spark, d):
    return labelling.rank_correlations(cov(spark, d), "contig", "sample", "depth").withColumn("rho", r6(F.col("rho")))


@_query("""with l as (select distinct doc_id, md5(unnest(string_split(text, chr(10)))) as line from documents), n as (select line from l group by 1 having count(*) > 1)
select d.source, count(*)::BIGINT as contigs, count(s.doc_id)::BIGINT as joinable, round(count(s.doc_id) / count(*), 6) as fraction from documents d left join (select distinct doc_id from l join n using (line)) s on s.doc_id = d.doc_id group by 1""")
def joinable_fraction(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("contig"), "source", "text")
    lines = docs.select("contig", F.explode(F.split("text", "\n")).alias("l")).select("contig", F.md5(F.col("l").cast("binary")).alias("cluster"))
    return acceptance.joinable(docs.select("contig", "source"), acceptance.sharing(lines), "source").withColumn("fraction", r6(F.col("fraction")))


@_query("""with m as (select distinct l_orderkey as contig, l_partkey || '/' || l_suppkey as cluster from lineitem), n as (select cluster from m group by 1 having count(*) > 1) select distinct contig from m join n using (cluster)""")
def cluster_partners(spark, d):
    """JN-16: contigs that share a protein cluster with another."""
    return acceptance.sharing(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contig"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("cluster")))


@_query(f"""with {COV}, len as (select o_orderkey as contig, 500 + (o_orderkey * 7919) % 12000 as length, o_custkey from orders), big as (select contig from len where length >= 2000),
e as (select distinct x.contig as src, y.contig as dst from len x join len y on x.o_custkey = y.o_custkey and x.contig < y.contig and x.o_custkey % 5 = 0), deg as (select unnest([src, dst]) as contig from e), m as (select distinct l_orderkey as contig, l_partkey || '/' || l_suppkey as cluster from lineitem where l_linenumber = 1),
sh as (select distinct contig from m where cluster in (select cluster from m group by 1 having count(*) > 1)), partner as (select contig from deg union select contig from sh),
sizes as (select o_custkey, count(*) as n from len where o_custkey % 5 = 0 group by 1 having count(*) > 1),
own as (select c.* from cov c join big using (contig)), rk as (select contig, sample, rank() over (partition by sample order by depth) + (count(*) over (partition by sample, depth) - 1) / 2.0e0 as r from own),
rho as (select corr(a.r, b.r) as rho from rk a join rk b on a.contig = b.contig and a.sample < b.sample group by a.sample, b.sample), half as (select length, sum(length) over (order by length desc, contig rows unbounded preceding) as reached, sum(length) over () as total from len),
j as (select count(*) as n from big where contig in (select contig from partner))
select (select count(*) from len)::BIGINT as contigs, (select count(*) from big)::BIGINT as cohort, (select sum(length) from len)::BIGINT as bases, (select max(length) from half where reached >= total / 2)::BIGINT as n50, (select count(*) from e)::BIGINT as edges, (select count(distinct contig) from deg)::BIGINT as linked_contigs,
(select count(*) from sizes)::BIGINT as components, (select max(n) from sizes)::BIGINT as largest_component, (select n from j)::BIGINT as joinable, round((select n from j) / (select count(*) from big), 6) as joinable_fraction, round((select median(rho) from rho), 6) + 0.0 as rank_correlation,
case when (select n from j) / (select count(*) from big) >= 0.1 then 'strong' when (select n from j) / (select count(*) from big) >= 0.04 then 'usable' else 'weak' end as verdict""")
def acceptance_report(spark, d):
    """OPS-7: the report of a dataset without truth, in one call; contigs are orders, linked if a customer (every fifth) has both."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("contig"), (500 + (F.col("o_orderkey") * 7919) % 12000).alias("length"), "o_custkey")
    by = o.filter("o_custkey % 5 = 0")
    edges = by.select(F.col("contig").alias("src"), "o_custkey").join(by.select(F.col("contig").alias("dst"), "o_custkey"), "o_custkey").filter("src < dst").select("src", "dst")
    members = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("contig"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("cluster"))
    found = acceptance.report(o.select("contig", "length"), cov(spark, d), edges, members)
    plain = found.select("contigs", "cohort", "bases", "n50", "edges", "linked_contigs", "components", "largest_component", "joinable", "joinable_fraction", "rank_correlation", "verdict")
    return plain.withColumns({"joinable_fraction": r6(F.col("joinable_fraction")), "rank_correlation": r6(F.col("rank_correlation"))})


# alignments of parts to suppliers, and the suppliers' genomes: two names a genome, and every seventh pair of genomes hard to tell apart
_HITS = """h as (select 'c' || l_partkey as query, 'r' || l_suppkey as target, date_diff('day', date '1992-01-01', l_shipdate::DATE)::BIGINT as s, l_quantity::BIGINT as n, round(l_discount * 100)::BIGINT as extra from lineitem),
len as (select 'c' || p_partkey as query, 150 + 5 * p_size as length from part), ref as (select 'r' || s_suppkey as target, 'g' || (s_suppkey // 2) as agent from supplier)"""
_MOCK = f"""{_HITS}, days as (select distinct query, target, unnest(range(s, s + n)) as day from h), sc as (select query, target, sum(n)::BIGINT as matches, sum(n) / sum(n + extra) as identity from h group by 1, 2),
cover as (select query, target, count(*) as covered from days group by 1, 2), ok as (select sc.*, agent, covered / length as cover, length from sc join cover using (query, target) join len using (query) join ref using (target) where identity >= 0.9 and covered / length >= 0.5),
top as (select *, max(matches) over (partition by query) as most from ok), tied as (select query, agent from top where matches >= most * 0.98e0), e as (select distinct (min(agent) over (partition by query)) as a, agent as b from tied), u as (select a, b from e where a <> b union select b, a from e where a <> b),
reach(id, other) as (select a, a from u union select r.id, u.b from reach r join u on u.a = r.other), comp as (select id, min(other) as c from reach group by 1), names as (select id as agent, m as truth from comp join (select c, string_agg(id, '|' order by id) as m from comp group by 1) using (c)),
named as (select ok.*, coalesce(truth, agent) as truth from ok left join names using (agent)), ranked as (select *, row_number() over w as rank, first_value(target) over w as best, first_value(truth) over w as own from named window w as (partition by query order by matches desc, target)),
bad as (select r.query from ranked r join days x on x.query = r.query and x.target = r.target where truth <> own and not exists (select 1 from days b where b.query = r.query and b.target = r.best and b.day = x.day) group by r.query, r.target, r.length having count(*) >= 0.25e0 * r.length),
labels as (select len.query, case when bad.query is null then truth end as truth, case when bad.query is null then target end as molecule, case when bad.query is null then identity end as identity, case when bad.query is null then cover end as query_cover,
case when bad.query is not null then 'chimeric' when truth is null then 'unlabelled' when contains(truth, '|') then 'merged' else 'labelled' end as status, len.length from len left join (select * from ranked where rank = 1) r on r.query = len.query left join (select distinct query from bad) bad on bad.query = len.query)"""


def _mock(spark, d):
    day, n = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long"), F.col("l_quantity").cast("long")
    hits = table(spark, d, "lineitem").select(
        F.concat(F.lit("c"), "l_partkey").alias("query"), F.concat(F.lit("r"), "l_suppkey").alias("target"), day.alias("query_start"), (day + n).alias("query_end"), day.alias("target_start"), (day + n).alias("target_end"),
        F.lit(2600).cast("long").alias("target_length"), n.alias("matches"), (n + F.round(F.col("l_discount") * 100).cast("long")).alias("block"),
    )
    lengths = table(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("query"), (150 + 5 * F.col("p_size")).cast("long").alias("length"))
    target = F.concat(F.lit("r"), "s_suppkey")
    refs = table(spark, d, "supplier").select(target.alias("target"), F.concat(F.lit("g"), F.floor(F.col("s_suppkey") / 2)).alias("agent"), target.alias("molecule"))
    return mock.label(hits, refs, lengths)


@_query(f"with recursive {_MOCK} select query, truth, molecule, round(identity, 6) as identity, round(query_cover, 6) as query_cover, status from labels")
def mock_labels(spark, d):
    """OPS-6, PRJ-13: labels of all contigs in one call, with ties merged and chimeras found."""
    return _mock(spark, d)["labels"].withColumns({c: r6(F.col(c)) for c in ("identity", "query_cover")})


@_query(f"""with recursive {_MOCK}, given as (select truth, count(*) as contigs, sum(length) as bases from labels where truth is not null group by 1), tcover as (select target, count(distinct day) as covered from (select target, unnest(range(s, s + n)) as day from h) group by 1)
select ref.target, ref.agent, ref.target as molecule, coalesce(names.truth, ref.agent) as truth, (case when covered is null then 0 else 2600 end)::BIGINT as length, coalesce(covered, 0)::BIGINT as covered, round(coalesce(covered, 0) / 2600.0e0, 6) as fraction, coalesce(contigs, 0)::BIGINT as contigs, coalesce(bases, 0)::BIGINT as bases
from ref left join names using (agent) left join given on given.truth = coalesce(names.truth, ref.agent) left join tcover on tcover.target = ref.target""")
def mock_references(spark, d):
    """SNK-13, AGG-10: how much of each reference was assembled, and what carries its genome's label."""
    return _mock(spark, d)["references"].withColumn("fraction", r6(F.col("fraction")))


@_query("""with m as (select l_orderkey as contig, p_brand as cluster, count(*) as n from lineitem join part on p_partkey = l_partkey group by 1, 2)
select contig, cluster, n::BIGINT as n_proteins, (sum(n) over (partition by cluster))::BIGINT as cluster_size, (count(*) over (partition by cluster))::BIGINT as cluster_contigs from m""")
def protein_cluster_rollup(spark, d):
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("cluster"))
    return labelling.protein_clusters(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contig"), "l_partkey").join(brand, "l_partkey").withColumnRenamed("l_partkey", "protein"))


@_query("""with o as (select conv_id as contig, turn, role, length(text) as len, lag(role) over (partition by conv_id order by turn) as before from conversations),
s as (select contig, count(*) as n_orfs, avg(len) as mean_len, sum(len) as coding, count_if(before is not null and before <> role) as switches, mode(role order by role) as x from o group by 1)
select contig, n_orfs::BIGINT as n_orfs, round(mean_len, 4) as mean_orf_len, coding::BIGINT as coding, round(case when n_orfs > 1 then switches / (n_orfs - 1) else 0 end, 6) as switch_rate from s""")
def orf_architecture(spark, d):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    o = table(spark, d, "conversations").select(F.col("conv_id").alias("contig"), F.char_length("text").alias("len"), (before.isNotNull() & (before != F.col("role"))).alias("switch"))
    s = o.groupBy("contig").agg(F.count("*").alias("n_orfs"), F.round(F.avg("len"), 4).alias("mean_orf_len"), F.sum("len").alias("coding"), F.count_if("switch").alias("switches"))
    return s.select("contig", "n_orfs", "mean_orf_len", "coding", r6(F.when(F.col("n_orfs") > 1, F.col("switches") / (F.col("n_orfs") - 1)).otherwise(0.0)).alias("switch_rate"))


@_query("select md5(text) as digest, min(doc_id) as first_id, count(*)::BIGINT as copies from documents where text is not null group by 1")
def md5_dedupe(spark, d):
    digest = F.md5(F.col("text").cast("binary"))
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@_query("""with old as (select o_orderkey as k, o_orderstatus as status, round(o_totalprice, 2) as price from orders where o_orderdate < timestamp '1998-01-01'),
new as (select o_orderkey as k, 'U' as status, round(o_totalprice, 2) as price from orders where o_orderpriority = '1-URGENT')
select k, status, price from new union all select k, status, price from old where k not in (select k from new)""")
def keyed_upsert(spark, d):
    """SNK-7: two changes of a keyed table, each a version of its own."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"), "o_orderdate", "o_orderpriority")
    path = scratch(spark, "keyed")
    keyed.upsert(rows.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select("k", "status", "price"), path, ["k"], replace=True)
    keyed.upsert(rows.filter("o_orderpriority = '1-URGENT'").select("k", F.lit("U").alias("status"), "price"), path, ["k"], replace=True)
    return keyed.read(spark, path)


@_query("select c_name as contig, 'bin' || c_nationkey as bin from customer")
def assignment_import(spark, d):
    from ..sources.tables import read_assignments

    c = table(spark, d, "customer")
    number, name, bin_ = F.col("c_custkey"), F.col("c_name"), F.concat(F.lit("bin"), "c_nationkey")
    lines = c.select(F.when(number % 3 == 0, F.concat_ws("\t", name, bin_)).when(number % 3 == 1, F.concat_ws(",", bin_, name)).otherwise(F.concat_ws(" ", name, bin_, F.lit("x"))).alias("value"))
    lines = lines.union(spark.createDataFrame([("# comment",), ("",), ("unknown\tbin1",)], "value string"))
    return read_assignments(lines, c.select(name.alias("contig")))
