"""SQL (DuckDB) for those of the queries that SQL can express over whole tables."""

from __future__ import annotations

#: Words of a text, as all operators on words take them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '[', '&#91;'), '<', '&lt;')"


CHAT = f"""with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
  placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, count(*) over (partition by conv_id) as n,
    length('[TURN]' || replace({_escaped('role')}, chr(10), '&#10;') || chr(10) || {_escaped('text')} || '</s>') as chars from said),
  summed as (select *, sum(chars) over (partition by conv_id order by k) as upto from placed),
  whole as (select conv_id, max(n) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by k) as turns,
    coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '') as loss, sum(upto) filter (role = 'assistant' or k = n) as formatted from summed group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(formatted as bigint) as formatted_chars from whole"""

SUBSTRINGS = f"""with docs as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
  words as (select r, unnest(range(1, len(ws) + 1)) as k, unnest(ws) as word, len(ws) as n, ws from docs),
  starts as (select r, k, word, case when k + 34 <= n then sha256(array_to_string(ws[k:k + 34], ' ')) end as win from words),
  seen as (select win from starts where win is not null group by win having count(*) > 1),
  marked as (select s.*, case when e.win is not null then 1 else 0 end as again from starts s left join seen e using (win)),
  covered as (select *, max(again) over (partition by r order by k rows between 34 preceding and current row) as gone from marked),
  done as (select r, sum(gone) as removed, string_agg(word, ' ' order by k) filter (gone = 0) as kept from covered group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join done using (r)"""

#: All pairs that share a shingle, their exact similarities, and what their links lead to.
NEAR = f"""with recursive docs as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
  classes as (select min(doc_id) as id, array_to_string(ws, ' ') as body, any_value(ws) as ws, count(*) as copies from docs where len(ws) > 0 and doc_id is not null group by body),
  shingles as materialized (select distinct body, case when len(ws) < 5 then body else array_to_string(ws[k:k + 4], ' ') end as s from (select body, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as k from classes)),
  sizes as (select body, count(*) as n from shingles group by body),
  -- shingles of fewer than five words only equal themselves
  shared as (select a.body as x, b.body as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.body < b.body group by 1, 2),
  links as materialized (select x, y from shared join sizes p on p.body = x join sizes q on q.body = y where c >= 0.8 * (p.n + q.n - c) - 1e-9),
  either as materialized (select x, y from links union select y, x from links),
  reach as (select body as a, body as b from classes where body in (select x from either) union select reach.a, either.y from reach join either on either.x = reach.b),
  part as (select a as body, min(b) as p from reach group by a),
  placed as (select c.*, coalesce(p.p, c.body) as p from classes c left join part p using (body)),
  whole as (select p, min(id) as class_id, sum(copies) as class_size from placed group by p),
  found as (select body, class_id, class_size from placed join whole using (p))
select d.doc_id, coalesce(f.class_id, d.doc_id) as class_id, cast(coalesce(f.class_size, 1) as bigint) as class_size, coalesce(d.doc_id = coalesce(f.class_id, d.doc_id), true) as kept
from docs d left join found f on f.body = array_to_string(d.ws, ' ') and d.doc_id is not null"""

VECTORS = """with recursive usable as materialized (select row_number() over () as r, vec_id, cast(embedding as double[]) as v from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links as materialized (select a.r as x, b.r as y from usable a join usable b on a.r <> b.r and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95),
  degree as (select x as r, count(*) as n from links group by x),
  reach as (select r as a, r as b from usable where r in (select x from links) union select reach.a, links.y from reach join links on links.x = reach.b),
  part as (select a as r, min(u.vec_id) as least from reach join usable u on u.r = reach.b group by a),
  good as (select vec_id, coalesce(n, 0) as n_links, coalesce(least, vec_id) as component_id from usable left join degree using (r) left join part using (r)),
  rest as (select vec_id, 0 as n_links, vec_id as component_id from embeddings
    where not coalesce(vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false))
select vec_id, cast(n_links as bigint) as n_links, component_id, coalesce(vec_id = component_id, true) as kept from (select * from good union all select * from rest)"""
