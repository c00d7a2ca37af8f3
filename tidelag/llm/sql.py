"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

JACCARD = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
u as (select doc_id, len(sh) as n, unnest(sh) as x from s),
l as (
  select a.doc_id as a, b.doc_id as b from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2
  having 100 * count(*) >= 75 * (first(a.n) + first(b.n) - count(*))),
c as (select doc_id as doc, doc_id as comp from s union select l.b, c.comp from c join l on l.a = c.doc)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, min(c.comp) as component_id from s join c on c.doc = s.doc_id group by 1, 2
"""

SUBSTRINGS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as s from (select doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) as p from d)),
r as (select doc_id, p from w qualify row_number() over (partition by s order by doc_id, p) > 1),
i as (select doc_id, p, sum(case when p > before + 100 or before is null then 1 else 0 end) over (partition by doc_id order by p) as g
  from (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from r)),
x as (select doc_id, g, min(p) as b, max(p) + 100 as e from i group by 1, 2),
k as (select doc_id, b, e, coalesce(lag(e) over (partition by doc_id order by b), 0) as done from x),
y as (select k.doc_id, sum(e - b) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * done + 1, 2 * (b - done)), '' order by b) as front, max(e) as last from k join d using (doc_id) group by 1)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(case when last is null then h else concat(front, substr(h, 2 * last + 1)) end)) as kept_sha256 from d left join y using (doc_id)
"""

NEGATIVES = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same,
    cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

MANIFEST = """
with recursive d as (
  select doc_id, source, lang, n_chars, text, list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), cast(range(8) as bigint[])),
        lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)) as crc from documents),
f as (
  select doc_id, lang, case when doc_id is null then '-' else concat(length(cast(doc_id as varchar)), ':', doc_id) end as f1,
    case when source is null then '-' else concat(strlen(source), ':', source) end as f2,
    case when lang is null then '-' else concat(strlen(lang), ':', lang) end as f3, n_chars,
    n_chars + case when xor(crc, 4294967295::bigint) % 7 = 0 then 1 else 0 end as seen_chars,
    case when text is null then '-' else concat(strlen(text), ':', text) end as f5 from d),
l as (
  select doc_id, coalesce('=' || lang, '-') as tree,
    sha256(concat(f1, f2, f3, case when n_chars is null then '-' else concat(length(cast(n_chars as varchar)), ':', n_chars) end, f5)) as leaf,
    sha256(concat(f1, f2, f3, case when seen_chars is null then '-' else concat(length(cast(seen_chars as varchar)), ':', seen_chars) end, f5)) as seen from f),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as total from l),
up as (
  select tree, 0 as level, pos, leaf as node, total from p
  union all
  select tree, any_value(level) + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (any_value(total) + 1) // 2 from up where total > 1 group by tree, pos // 2),
subroots as (select tree, node as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as total from up where total = 1),
top as (
  select 0 as level, pos, subroot as node, total from subroots
  union all
  select any_value(level) + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (any_value(total) + 1) // 2 from top where total > 1 group by pos // 2),
height as (select tree, max(level) as h from up group by 1),
low as (select tree, level, any_value(total) as total from up group by 1, 2),
high as (select level, any_value(total) as total from top group by 1),
steps as (
  select p.tree, p.pos as leaf_pos, low.level as step, p.pos >> low.level as own, low.level as level, false as upper from p join low on low.tree = p.tree where low.total > 1
  union all
  select p.tree, p.pos, height.h + high.level, s.pos >> high.level, high.level, true
  from p join height on height.tree = p.tree join subroots s on s.tree = p.tree join high on high.total > 1),
nodes as (select tree, level, pos, node, false as upper from up union all select null, level, pos, node, true from top),
path as (
  select s.tree, s.leaf_pos, s.step, s.own % 2 as odd, coalesce(u.node, '') as beside from steps s
  left join nodes u on u.pos = xor(s.own, 1) and u.level = s.level and u.upper = s.upper and coalesce(u.tree, s.tree) = s.tree),
proof as (select tree, leaf_pos, sha256(string_agg(beside, '' order by step)) as proof_sha256, list(beside order by step) as besides, list(odd order by step) as odds, count(*) as n from path group by 1, 2),
folds as (
  select p.tree, p.pos, 0 as k, seen as node from p
  union all
  select f.tree, f.pos, k + 1, case when odds[k + 1] = 1 then sha256(concat(besides[k + 1], node)) else sha256(concat(node, besides[k + 1])) end
  from folds f join proof r on r.tree = f.tree and r.leaf_pos = f.pos where k < n),
folded as (select tree, pos, arg_max(node, k) as folded_root from folds group by 1, 2)
select p.doc_id, leaf, subroot, root.node as root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root.node as verified
from p join subroots s using (tree) join (select node from top where total = 1) root on true
join folded g on g.tree = p.tree and g.pos = p.pos left join proof r on r.tree = p.tree and r.leaf_pos = p.pos
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_components": JACCARD, "op4_repeated_substrings": SUBSTRINGS, "op11_hard_negatives": NEGATIVES, "op12_merkle_manifest": MANIFEST}
