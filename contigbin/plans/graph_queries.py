"""Queries 21-27, 34-36, 57-58, 62: assembly graph, terminal repeats, sequence identity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..operators import assembly, completeness, features, graph, labelling, neighbours
from ..sources import fasta
from .common import SEQ, WALK, r6, seq, table, walk
from .feature_queries import query as _query

_NEXT = f"{WALK}, nxt as (select contig, segment as a, lead(segment) over (partition by contig order by n1, segment, n3, orientation) as b from walk)"


@_query(f"with {_NEXT} select distinct least(a, b) as src, greatest(a, b) as dst from nxt where b is not null and a <> b")
def canonical_edges(spark, d):
    return neighbours.canonical_edges(graph.consecutive(walk(spark, d)).select(F.col("a").alias("src"), F.col("b").alias("dst")))


# segments are orders: a link joins a customer's next one, contigs are the suppliers on an order; all rows of both tables
_LINKS = """nxt as (select o_orderkey as a, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as b, o_totalprice as price from orders),
links as (select a, b, floor(price / 1000)::BIGINT as overlap from nxt where b is not null), members as (select distinct l_orderkey as segment, l_suppkey as contig from lineitem)"""
_PROJ = f"{_LINKS}, proj as (select least(x.contig, y.contig) as src, greatest(x.contig, y.contig) as dst, count(*)::BIGINT as n_links, max(overlap)::BIGINT as max_overlap from links l join members x on x.segment = l.a join members y on y.segment = l.b where x.contig <> y.contig group by 1, 2)"
_SHARED = f"{_PROJ}, shared as (select x.contig as src, y.contig as dst, count(*)::BIGINT as shared from members x join members y on x.segment = y.segment and x.contig < y.contig group by 1, 2)"


def _parts(spark, d):
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), after.alias("b"), F.floor(F.col("o_totalprice") / 1000).alias("overlap")).filter("b IS NOT NULL")
    return links, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment"), F.col("l_suppkey").alias("contig")).distinct()


@_query(f"with {_PROJ} select src, dst, n_links, max_overlap from proj")
def gfa_link_projection(spark, d):
    return graph.project_links(*_parts(spark, d))


@_query(f"with {_SHARED} select src, dst, shared from shared")
def shared_segment_pairs(spark, d):
    return graph.shared_segments(_parts(spark, d)[1])


@_query(f"with {_SHARED} select src, dst, n_links, max_overlap from proj p where not exists (select 1 from shared s where s.src = p.src and s.dst = p.dst)")
def path_projection_excl_shared(spark, d):
    links, members = _parts(spark, d)
    return graph.without_shared(graph.project_links(links, members), graph.shared_segments(members))


@_query(f"with {_SHARED} select src, dst, coalesce(n_links, 0)::BIGINT as n_links, coalesce(max_overlap, 0)::BIGINT as max_overlap, coalesce(shared, 0)::BIGINT as shared from proj full join shared using (src, dst)")
def path_projection_with_shared(spark, d):
    links, members = _parts(spark, d)
    return graph.with_shared(graph.project_links(links, members), graph.shared_segments(members))


@_query(f"""with {_SHARED}, kept as (select src, dst from (select src, dst, coalesce(n_links, 0) as n_links, coalesce(shared, 0) as shared from proj full join shared using (src, dst)) where n_links > 1 or shared > 1),
ends as (select unnest([src, dst]) as node from kept), deg as (select node, count(*) as d from ends group by 1), n as (select count(distinct l_suppkey) as n from lineitem)
select count(*)::BIGINT as touched, max(d)::BIGINT as greatest, sum(d)::BIGINT // 2 as edges, round(sum(d) / any_value(n), 6) as mean_degree from deg, n""")
def graph_degrees(spark, d):
    links, members = _parts(spark, d)
    named = graph.with_shared(graph.project_links(links, members), graph.shared_segments(members))
    kept = graph.linked(named.withColumns({"gfa_link_count": F.col("n_links") - 1, "shared_segment_count": F.col("shared") - 1}))
    return graph.degree_stats(members.select(F.col("contig").alias("id")).distinct(), kept)


@_query(f"""with {WALK}, p as (select contig, segment, orientation, row_number() over (partition by contig order by n1, segment, n3, orientation) - 1 as pos, count(*) over (partition by contig) as path_length from walk)
select contig, segment, orientation, pos::BIGINT as pos, path_length::BIGINT as path_length, round(pos / greatest(path_length - 1, 1), 6) as rel from p""")
def walk_positions(spark, d):
    return graph.walk_positions(walk(spark, d)).select("contig", "segment", "orientation", "pos", "path_length", r6(F.col("rel")).alias("rel"))


@_query("select p_partkey as segment, o as orientation, round(ln(1 + p_size), 6) as log_size, round(p_retailprice, 4) as price from part cross join (values ('+'), ('-')) t(o)")
def oriented_segment_states(spark, d):
    """ML-17: the states of every segment."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("segment"), r6(F.log1p("p_size")).alias("log_size"), F.round("p_retailprice", 4).alias("price"))
    return assembly.states(p)


# links of chains of eleven parts and, for some, of their ends; every eleventh chain's closing link turns the strand
_CHAIN = """lk as (select p_partkey as a, case when p_size % 2 = 0 then '+' else '-' end as ao, p_partkey + 1 as b, case when p_size % 3 = 0 then '+' else '-' end as bo, p_size as overlap from part where p_partkey % 11 > 0 and p_partkey < (select max(p_partkey) from part)
union all select p_partkey, '+', p_partkey - 9, case when p_size % 5 = 0 then '+' else '-' end, 7 from part where p_partkey % 11 = 10)"""


def _chain(spark, d):
    p, k, s = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    last = p.agg(F.max("p_partkey")).first()[0] or 0
    side = lambda n: F.when(s % n == 0, "+").otherwise("-")
    first = p.filter((k % 11 > 0) & (k < last)).select(k.alias("a"), side(2).alias("ao"), (k + 1).alias("b"), side(3).alias("bo"), s.alias("overlap"))
    return p.select(k.alias("segment")), first.union(p.filter(k % 11 == 10).select(k, F.lit("+"), k - 9, side(5), F.lit(7)))


@_query(f"""with {_CHAIN}, e as (select a, ao, b, bo, max(overlap) as overlap, count(*) as n from lk group by 1, 2, 3, 4)
select a, ao, b, bo, overlap::BIGINT as overlap, n::BIGINT as n, 0 as reversed from e union all select b, translate(bo, '+-', '-+'), a, translate(ao, '+-', '-+'), overlap, n, 1 from e""")
def assembly_links(spark, d):
    """ML-17: links on both strands with their attributes."""
    segments, raw = _chain(spark, d)
    return assembly.links(raw, segments).withColumn("overlap", F.col("overlap").cast("long"))


@_query(f"""with {WALK}, p as (select contig, segment, orientation, row_number() over w - 1 as pos, count(*) over (partition by contig) as path_length, lead(segment) over w as next_segment, lead(orientation) over w as next_orientation from walk window w as (partition by contig order by n1, segment, n3, orientation))
select contig, pos::BIGINT as pos, path_length::BIGINT as path_length, round(pos / greatest(path_length - 1, 1), 6) as rel, segment, orientation, next_segment, next_orientation from p""")
def assembly_traversals(spark, d):
    """ML-17, WIN-8: the states that walks visit."""
    return assembly.traversals(walk(spark, d)).withColumn("rel", r6(F.col("rel")))


@_query(f"""with recursive {_CHAIN}, st as (select 2 * a + (ao = '-')::INT as x, 2 * b + (bo = '-')::INT as y from lk union all select 2 * a + (ao = '+')::INT, 2 * b + (bo = '+')::INT from lk), u as (select x, y from st union select y, x from st),
n as (select 2 * p_partkey + o as id from part, (values (0), (1)) t(o)), reach(id, other) as (select id, id from n union select r.id, u.y from reach r join u on u.x = r.other), c as (select id, min(other) as label from reach group by 1),
s as (select id // 2 as segment, max(case when id % 2 = 0 then label end) as ahead, max(case when id % 2 = 1 then label end) as back from c group by 1)
select segment::BIGINT as segment, (least(ahead, back) // 2)::BIGINT as component, case when ahead < back then '+' when ahead > back then '-' end as strand, ahead = back as twisted from s""")
def assembly_components(spark, d):
    """ML-17: strand-aware components."""
    return assembly.components(*_chain(spark, d))


_ORIENTED = f"{WALK}, lk as (select segment as a, orientation as ao, lead(segment) over w as b, lead(orientation) over w as bo from walk window w as (partition by contig order by n1, segment, n3, orientation))"


@_query(f"""with {_ORIENTED}, x as (select a, ao, b, bo, 0 as reversed from lk where b is not null union all select b, translate(bo, '+-', '-+'), a, translate(ao, '+-', '-+'), 1 from lk where b is not null)
select a, ao, b, bo, reversed, count(*)::BIGINT as n from x group by all""")
def reverse_complement_links(spark, d):
    by = F.lead(F.struct("segment", "orientation"))
    w = walk(spark, d).withColumn("next", by.over(Window.partitionBy("contig").orderBy("step"))).filter("next IS NOT NULL")
    links = w.select(F.col("segment").alias("a"), F.col("orientation").alias("ao"), F.col("next.segment").alias("b"), F.col("next.orientation").alias("bo"))
    return graph.both_strands(links).groupBy("a", "ao", "b", "bo", "reversed").agg(F.count("*").alias("n"))


def _with_repeats(spark, d):
    """Sequences; every third glued to its own first 40 letters, every next to their reverse complement."""
    s = seq(spark, d)
    start = F.left("sequence", F.lit(40))
    glued = F.when(F.col("contig") % 3 == 0, F.concat("sequence", start)).when(F.col("contig") % 3 == 1, F.concat("sequence", reverse_complement(start))).otherwise(F.col("sequence"))
    return s.select("contig", glued.alias("sequence"))


_REP = f"""{SEQ}, g as (select contig, case contig % 3 when 0 then sequence || left(sequence, 40) when 1 then sequence || reverse(translate(left(sequence, 40), 'ACGT', 'TGCA')) else sequence end as s from seq),
h as (select contig, s, reverse(translate(s, 'ACGT', 'TGCA')) as rc, length(s) as n, instr(reverse(s), reverse(left(s, 21))) as behind from g),
rep as (select contig, n::BIGINT as length, (case when n >= 84 and n > 20 + behind and 20 + behind <= n // 2 and right(s, 20 + behind) = left(s, 20 + behind) then 20 + behind else 0 end)::BIGINT as direct_repeat,
(case when n >= 84 and left(s, 21) = left(rc, 21) then coalesce(list_min(list_filter(range(22, n // 2 + 1), lambda j: s[j] <> rc[j])) - 1, n // 2) else 0 end)::BIGINT as inverted_repeat from h)"""


@_query(f"with {_REP} select * from rep")
def terminal_repeats(spark, d):
    return completeness.terminal_repeats(_with_repeats(spark, d))


@_query(f"with {_REP} select *, greatest(direct_repeat, inverted_repeat) >= 20 and greatest(direct_repeat, inverted_repeat) <= 0.2 * length as locked from rep")
def completeness_gate(spark, d):
    return completeness.gate(completeness.terminal_repeats(_with_repeats(spark, d)))


@_query(f"""with {_REP}, l as (select contig, contig % 20 as label, greatest(direct_repeat, inverted_repeat) >= 20 and greatest(direct_repeat, inverted_repeat) <= 0.2 * length as locked from rep),
x as (select contig, case when locked then (select max(label) from l) + row_number() over (partition by locked order by contig) else label end as label from l)
select contig, (dense_rank() over (order by label) - 1)::BIGINT as bin from x""")
def isolate_and_relabel(spark, d):
    gated = completeness.gate(completeness.terminal_repeats(_with_repeats(spark, d)))
    return completeness.isolate(gated.select("contig", (F.col("contig") % 20).alias("label"), "locked"))


_ID = f"{SEQ}, r as (select contig as l, sequence from seq where sequence <> ''), q as (select contig as r, case when contig % 2 = 0 then sequence else reverse(translate(sequence, 'ACGT', 'TGCA')) end as sequence from seq where sequence <> '')"


@_query(f"with {_ID}, x as (select l, r.sequence as a, q.r as r, q.sequence as b, '+' as strand from r join q on r.sequence = q.sequence union all select l, r.sequence, q.r, q.sequence, '-' from r join q on reverse(translate(r.sequence, 'ACGT', 'TGCA')) = q.sequence) select l, r, min(strand) as strand from x group by 1, 2")
def sequence_identity_join(spark, d):
    s = seq(spark, d).filter("sequence <> ''")
    turned = s.select(F.col("contig").alias("id"), F.when(F.col("contig") % 2 == 0, F.col("sequence")).otherwise(reverse_complement(F.col("sequence"))).alias("sequence"))
    return labelling.identity_matches(s.select(F.col("contig").alias("id"), "sequence"), turned)


@_query(f"""with {SEQ}, b as (select regexp_replace(d.source || '/' || d.lang, '[^A-Za-z0-9._-]', '_', 'g') as bin, contig, sequence from seq join documents d on d.doc_id = contig)
select bin, count(*)::BIGINT as n_contigs, md5(string_agg(sequence, repeat('N', 1500) order by contig)) as digest, (sum(length(sequence)) + 1500 * (count(*) - 1))::BIGINT as length from b group by 1""")
def bin_linking(spark, d):
    s = seq(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("contig"), F.concat_ws("/", "source", "lang").alias("name")), "contig")
    linked, _ = fasta.link_bins(s, s.select("contig", F.col("name").alias("bin")))
    return linked.select("bin", "n_contigs", F.md5(F.col("sequence").cast("binary")).alias("digest"), F.length("sequence").cast("long").alias("length"))


_CIGAR = "(o_orderkey % 90 + 10) || 'M' || (o_orderkey % 7) || 'I' || (o_orderkey % 13) || '=' || (o_orderkey % 5) || 'D' || (o_orderkey % 11) || 'X'"


@_query(f"with c as (select o_orderkey as id, {_CIGAR} as cigar from orders) select id, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[M=X]', 1), lambda x: x::BIGINT))::BIGINT as aligned from c")
def cigar_length(spark, d):
    k = F.col("o_orderkey")
    cigar = F.concat(k % 90 + 10, F.lit("M"), k % 7, F.lit("I"), k % 13, F.lit("="), k % 5, F.lit("D"), k % 11, F.lit("X"))
    return table(spark, d, "orders").select(k.alias("id"), labelling.cigar_length(cigar).alias("aligned"))
