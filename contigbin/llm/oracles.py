"""SQL (DuckDB) for the queries whose results SQL can express, over the same tables."""

from __future__ import annotations

from . import quality, sharding, target_resampling, vector_codes

_WORDS = r"'[^\x20\x09-\x0D]+'"
_SPACE = r"'[\x20\x09-\x0D]+'"


def _sharding() -> str:
    return f"""with r as (select doc_id, strlen(coalesce(text, ''))::BIGINT as n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT as h from documents),
d as (select unnest(range(0, 41))::BIGINT as d), nodes as (select d, h >> (60 - d)::INT as node, sum(n_bytes)::BIGINT as b, count(*) as n from r, d group by 1, 2),
fits as (select r.doc_id, r.n_bytes, nodes.*, row_number() over (partition by r.doc_id order by nodes.d) as k from r join nodes on nodes.node = r.h >> (60 - nodes.d)::INT where b <= {sharding.LIMIT} or n = 1)
select doc_id, n_bytes, case when d = 0 then '' else lpad(bin(node), d::INT, '0') end as shard, d as shard_depth, b as shard_bytes, n::BIGINT as shard_rows, b > {sharding.LIMIT} as oversize from fits where k = 1"""


def _quality() -> str:
    marks = "".join(quality.END)
    closing = quality.CLOSING.replace("'", "''")
    phrases = f"(len(lw) <= 12 and regexp_matches(lower(line), '{quality.PHRASE}'))"
    return f"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents),
g as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
rep as (select doc_id, count(distinct p)::BIGINT as n from (select doc_id, i + unnest([0, 1, 2]) as p from (select doc_id, i, count(*) over (partition by doc_id, s) as c from g) where c > 1) group by 1),
l0 as (select doc_id, unnest(range(1, len(x) + 1)) as k, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from d)),
l1 as (select *, regexp_extract_all(line, {_WORDS}) as lw, row_number() over (partition by doc_id, line order by k) as again from l0),
l2 as (select *, rtrim(lw[-1], '{closing}') as tail from l1 where len(lw) > 0),
l3 as (select *, tail <> '' and contains('{marks}', right(tail, 1)) as ended, length(array_to_string(lw, '')) as chars from l2),
l4 as (select *, len(regexp_extract_all(line, '[|>»·•]')) >= 2 or len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.1e0 * length(line) or (again > 1 and len(lw) >= 3)
  or (not ended and (len(lw) < 3 or (len(lw) <= 8 and len(list_filter(lw, lambda x: x = lower(x) and x <> upper(x))) = 0))) or {phrases} as fails from l3),
ln as (select doc_id, count(*)::BIGINT as n_lines, count_if(again > 1)::BIGINT as n_dup_lines, count_if(fails)::BIGINT as n_lines_removed, coalesce(sum(chars) filter (where fails), 0)::BIGINT as chars_removed from l4 group by 1),
s as (select doc_id, len(w)::BIGINT as n_words, length(array_to_string(w, ''))::BIGINT as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT as n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT as n_dup_lines, coalesce(rep.n, 0)::BIGINT as n_repeat_words, coalesce(n_lines, 0)::BIGINT as n_lines, coalesce(n_lines_removed, 0)::BIGINT as n_lines_removed, coalesce(chars_removed, 0)::BIGINT as chars_removed
  from d left join rep using (doc_id) left join ln using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and chars_removed <= 0.5e0 * word_chars as kept, n_lines, n_lines_removed, chars_removed from s"""


def _decontamination() -> str:
    """All windows of an item's size that hold a shingle of an item of that size, by exact similarity alone."""
    split = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), {_SPACE}), lambda x: x <> '')"
    return f"""with d as (select doc_id, {split} as w from documents), b as (select item_id, {split} as w from benchmark),
ds as (select doc_id, len(w) as nw, p, array_to_string(w[p + 1:p + 5], ' ') as s from (select doc_id, w, unnest(range(0, len(w) - 4)) as p from d where len(w) >= 5)),
bs as (select item_id, len(w) as n, q, array_to_string(w[q + 1:q + 5], ' ') as s from (select item_id, w, unnest(range(0, len(w) - 4)) as q from b where len(w) >= 5)),
hits as (select ds.* from ds where s in (select s from bs)), near as (select distinct doc_id, nw, p, bs.n as m, least(bs.n, nw) as n from hits join bs using (s)),
win as (select distinct doc_id, m, n, unnest(range(greatest(0, p - n + 5), least(p, nw - n) + 1)) as start from near),
cnt as (select win.doc_id, win.m, win.start, win.n, hits.s, count(*) as c from win join hits on hits.doc_id = win.doc_id and hits.p between win.start and win.start + win.n - 5 group by 1, 2, 3, 4, 5),
its as (select item_id, n as m, s, count(*) as c from bs group by 1, 2, 3), size as (select item_id, count(*) as k from bs group by 1),
sim as (select cnt.doc_id, its.item_id, cnt.start, cnt.n, sum(least(cnt.c, its.c)) as inter from cnt join its using (m, s) group by 1, 2, 3, 4),
j as (select doc_id, item_id, start, n, inter / (n - 4 + k - inter) as similarity from sim join size using (item_id))
select doc_id, item_id, start::BIGINT as start_word, n::BIGINT as n_words, round(similarity, 9) as similarity from j where similarity >= 0.8e0 - 1e-9
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1"""


def _chat() -> str:
    own = "'\\### Assistant: </turn> ok'"
    escaped = "replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
    return f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', {own} union all select -7, 1, 'assistant', {own}),
o as (select *, row_number() over w - 1 as k, lag(role) over w as before from c window w as (partition by conv_id order by turn, role, text)),
f as (select *, (coalesce(before, '') || '>' || role) not in ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') as bad from o)
select conv_id, count(*)::BIGINT as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::BIGINT as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
sum(length({escaped.format("role")}) + length({escaped.format("text")}) + length('<turn:>') + length('</turn>') + 1)::BIGINT as formatted_chars,
count_if(bad) = 0 and max_by(role, k) = 'assistant' as valid, (min(k) filter (where bad))::BIGINT as first_bad from f group by 1"""


def _suffixes() -> str:
    return """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as m from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from d where length(h) >= 200)),
dup as (select doc_id, i from (select doc_id, i, row_number() over (partition by m order by doc_id, i) as r from w) where r > 1),
edge as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 or lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as new from dup),
grp as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from edge), span as (select doc_id, g, min(i) as a, max(i) + 100 as b from grp group by 1, 2),
seg as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from span union all select doc_id, max(b), null from span group by 1),
kept as (select seg.doc_id, string_agg(substr(h, 2 * seg.a + 1, case when seg.b is null then length(h) else 2 * (seg.b - seg.a) end), '' order by seg.a, seg.b nulls last) as k from seg join d using (doc_id) group by 1),
s as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from span group by 1)
select doc_id, (length(h) // 2)::BIGINT as n_bytes, coalesce(n_removed, 0)::BIGINT as n_removed, coalesce(n_spans, 0)::BIGINT as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from d left join s using (doc_id) left join kept using (doc_id)"""


def _near() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with recursive d as (select doc_id, regexp_extract_all({lower}, {_WORDS}) as w from documents),
s as (select distinct doc_id, md5(x) as x from (select doc_id, array_to_string(w[i:i + 3], chr(10)) as x from (select doc_id, w, unnest(range(1, len(w) - 2)) as i from d where len(w) >= 4) union all select doc_id, array_to_string(w, chr(10)) from d where len(w) between 1 and 3)),
n as (select doc_id, count(*) as n from s group by 1), df as (select x, count(*) as f from s group by 1),
pre as (select doc_id, x from (select s.doc_id, x, n, row_number() over (partition by s.doc_id order by f, x) as r from s join df using (x) join n on n.doc_id = s.doc_id) where r <= n - ceil(0.8e0 * n) + 1),
cand as (select distinct a.doc_id as a, b.doc_id as b from pre a join pre b on a.x = b.x and a.doc_id < b.doc_id),
both_ as (select a, b, count(*) as k from cand join s x on x.doc_id = a join s y on y.doc_id = b and y.x = x.x group by 1, 2),
e as (select a, b from both_ join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)), u as (select a, b from e union select b, a from e),
reach(id, other) as (select doc_id, doc_id from d union select r.id, u.b from reach r join u on u.a = r.other), c as (select id, min(other) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::BIGINT as n_shingles, component_id, d.doc_id = component_id as kept from d join c on c.id = d.doc_id left join n on n.doc_id = d.doc_id"""


def _codes() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    squares = "list_sum(list_transform(list_zip(p.x, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(r: int) -> str:
        return f"a{r} as (select vec_id, label, p, x, m % {entries} as k, m // {entries} as d from (select p.vec_id, p.label, p.p, p.x, min({squares}::BIGINT * {entries} + e.k) as m from p join e{r} e using (p) group by all))"

    def moved(r: int) -> str:
        return f"""u{r} as (select p, k, j, sum(x[j])::BIGINT as s, count(*)::BIGINT as n from (select p, k, x, unnest(range(1, len(x) + 1)) as j from a{r}) group by all),
e{r + 1} as (select e.p, e.k, coalesce(u.c, e.c) as c from e{r} e left join (select p, k, list((s - ((s % n) + n) % n) // n order by j) as c from u{r} group by 1, 2) u on u.p = e.p and u.k = e.k)"""

    return f"""with v as (select vec_id, label, list_transform(embedding, lambda y: floor({vector_codes.SCALE} * y::DOUBLE)::BIGINT) as v, len(embedding) // {parts} as w from embeddings
where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
p as (select vec_id, label, p, v[p * w + 1:p * w + w] as x from (select *, unnest(range(0, {parts})) as p from v)),
e0 as (select p, row_number() over (partition by p order by vec_id) - 1 as k, x as c from p where vec_id in (select vec_id from v order by vec_id limit {entries})),
{", ".join(f"{assigned(r)}, {moved(r)}" for r in range(vector_codes.ROUNDS))}, {assigned(vector_codes.ROUNDS)},
h as (select sha256(string_agg(x::VARCHAR, ',' order by p, k, j)) as codebooks_sha256 from (select p, k, unnest(c) as x, unnest(range(0, len(c))) as j from e{vector_codes.ROUNDS})),
r as (select vec_id, label, string_agg(printf('%02x', k), '' order by p) as code, sum(d)::BIGINT as error from a{vector_codes.ROUNDS} group by 1, 2)
select vec_id, code, error, (sum(error) over (partition by label))::BIGINT as label_error, codebooks_sha256 from r, h"""


def _target() -> str:
    r, word = target_resampling, r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shift = "case when {0} & 1 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
    steps = ", ".join(f"t{k + 1} as (select i, {shift.format('c')} as c from t{k})" for k in range(8))
    return f"""with t0 as (select i, i as c from (select unnest(range(0, 256))::BIGINT as i)), {steps}, tab as (select list(c order by i) as tab from t8),
d as (select doc_id, regexp_extract_all({lower}, {word}) as w from documents), b as (select regexp_extract_all({lower}, {word}) as w from benchmark),
x as (select f, sum(s)::BIGINT as s, sum(t)::BIGINT as t from (select unnest(w) as f, 1 as s, 0 as t from d union all select unnest(w), 0, 1 from b) group by 1),
y as (select f, s, t, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INT + 1, 2))::BIGINT) as bytes from x),
g as (select f, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, o: xor(c >> 8, tab[(xor(c, o) & 255) + 1])), 4294967295) % {r.BUCKETS} as bucket from y, tab),
n as (select bucket, sum(s)::BIGINT as s, sum(t)::BIGINT as t from g group by 1), a as (select sum(s)::BIGINT as s, sum(t)::BIGINT as t from n),
gain as (select bucket, floor(1000 * ln(((n.t + 1)::DOUBLE * (a.s + {r.BUCKETS})::DOUBLE) / ((n.s + 1)::DOUBLE * (a.t + {r.BUCKETS})::DOUBLE)))::BIGINT as gain from n, a),
o as (select doc_id, count(*)::BIGINT as n, sum(gain)::BIGINT as z from (select doc_id, unnest(w) as f from d) join g using (f) join gain using (bucket) group by 1),
q as (select doc_id, coalesce(n, 0)::BIGINT as n_features, coalesce((z - ((z % n) + n) % n) // n, 0)::BIGINT as weight, len(w) as words, ('0x' || substr(sha256('{r.SEED}:' || doc_id), 1, 8))::BIGINT as h from d left join o using (doc_id)),
z as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT as score from q), k as (select ({r.SHARE} * count(*)) // 100 as k from z where words >= {r.LEAST_WORDS}),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank from z where words >= {r.LEAST_WORDS})
select z.doc_id, n_features, weight, score, case when rank <= k then rank end::BIGINT as rank from z left join ranked using (doc_id), k"""


ORACLES = {
    "op1_sharding": _sharding(),
    "op2_quality_rules": _quality(),
    "op3_decontamination": _decontamination(),
    "op4_chat_format": _chat(),
    "op8_suffix_dedup": _suffixes(),
    "op9_near_dedup": _near(),
    "op11_vector_codes": _codes(),
    "op12_target_resampling": _target(),
}
