"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from . import license as lic
from .chat import CALLS as CALLS_TABLE

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of items meet windows of documents by equality, for each length of window that items have.
DECONTAMINATE = f"""with i as (select coalesce(item_id::string, '') as item, {_WORDS} as w from benchmark), j as (select item, w, least(10, len(w)) as n from i where len(w) > 0),
iw as (select distinct item, n, array_to_string(w[a : a + n - 1], ' ') as x from (select *, unnest(range(1, len(w) - n + 2)) as a from j)),
d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents), sizes as (select distinct n from j),
dw as (select r, n, a, array_to_string(w[a : a + n - 1], ' ') as x from (select r, n, w, unnest(range(1, len(w) - n + 2)) as a from d, sizes where len(w) >= n)),
h as (select dw.r, dw.n, dw.a, iw.item from dw join iw on iw.n = dw.n and iw.x = dw.x),
k as (select r, count(distinct p) as n_hit from (select r, unnest(range(a, a + n)) as p from (select distinct r, n, a from h)) group by r), m as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated from d left join k using (r) left join m using (r)"""

#: Chats without calls, as the fixture tables hold them; calls and results are held against plain cases in the tests.
CHAT = """select conv_id, turn, 0::bigint as part, 'message' as kind, null::string as call_id, null::string as name, 'ok' as status, turn as at_turn, 0::bigint as level,
'{"content":' || to_json(coalesce(text, '')) || case when role is null then '' else ',"role":' || to_json(role) end || '}' as json from conversations where role is null or role <> 'tool'"""

#: The same for conversations with calls: of a run, a call's level is its place, or the number of calls of the run that there are before it.
CALLS = f"""with m as ({CALLS_TABLE}), c as (select * from conversations where role <> 'tool'),
h as (select c.*, (select count(*) from generate_series(1, c.turn % 4) g(k) where (select count(*) from c x where x.conv_id = c.conv_id and x.turn between c.turn - k and c.turn - 1) = k) as level from c)
select conv_id, turn, 0::bigint as part, 'message' as kind, null::string as call_id, null::string as name, 'ok' as status, turn as at_turn, 0::bigint as level,
  '{{"content":' || to_json(regexp_replace(text, '<tool_call>.*</tool_call>', '', 's')) || ',"role":"assistant"}}' as json from m where role = 'assistant'
union all select conv_id, turn * 2, 1, 'call', 'c' || turn, case when turn % 5 = 3 then 'none' else 'search' end, case when turn % 5 = 3 then 'invalid' when turn % 3 = 1 then 'unanswered' else 'ok' end, turn * 2, level,
  '{{"arguments":{{"limit":' || turn || ',"query":"q' || turn || '"}},"id":"c' || turn || '","name":"' || case when turn % 5 = 3 then 'none' else 'search' end || '","type":"call"}}' from h
union all select conv_id, turn * 2 + 1, 1, 'result', 'c' || turn, null, 'ok', turn * 2 + 1, level + 1, '{{"content":"r' || turn || '","id":"c' || turn || '","type":"result"}}' from h where turn % 3 <> 1"""

_ALL = lic.all_templates()
_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, n, x.replace("'", "''")) for i, (n, x) in enumerate(_ALL))
_GRANTED = "regexp_replace(regexp_replace(coalesce(text, ''), '{}', ' ', 'g'), '{}', ' ', 'g')".format(*(x.replace("'", "''") for x in (lic.DENIED, lic.QUOTED)))
_TERMS = "regexp_extract_all(lower({0}), '[a-z0-9]+(?:[.-][0-9a-z]+)*')"

LICENSE = f"""with t as (select * from (values {_TEMPLATES}) v(i, name, x)), tt as (select i, term, count(*) as n from (select i, unnest({_TERMS.format("x")}) as term from t) group by all),
idf as (select term, ln({len(_ALL) + 1}.0 / (1 + count(*))) + 1 as idf from tt group by 1), tw as (select tt.i, tt.term, tt.n * idf.idf as w from tt join idf using (term)), tn as (select i, sqrt(sum(w * w)) as norm from tw group by 1),
d as (select doc_id, source || '/k' || doc_id // 1000 || '/d' || doc_id // 20 || '/doc' || doc_id as path, text,
    array_to_string(list_filter(string_split({_GRANTED}, chr(10)), lambda l: regexp_matches(l, '{lic.HEADER}')), chr(10)) as lines, case when regexp_matches(lines, '{lic.GRANT}') then lines else '' end as header from documents),
h as (select distinct header from d where header <> ''), ht as (select header, term, count(*) as n from (select header, unnest({_TERMS.format("header")}) as term from h) group by all),
hw as (select header, term, n * coalesce(idf.idf, ln({len(_ALL) + 1}.0) + 1) as w from ht left join idf using (term)), hn as (select header, sqrt(sum(w * w)) as norm from hw group by 1),
c as (select hw.header, tw.i, sum(hw.w * tw.w) / any_value(hn.norm) / any_value(tn.norm) as score from hw join tw using (term) join hn using (header) join tn using (i) group by all),
b as (select header, first(i order by score desc, i) as i, max(score) as score from c group by 1), o as (select c.header, max(c.score) as score from c join b using (header) join t x on x.i = c.i join t y on y.i = b.i where x.name <> y.name group by 1),
m as (select header, sum(n) as n, bool_or(term in ('2', '2.0', 'v2')) as v2, bool_or(term in ('3', '3.0', 'v3')) as v3 from ht group by 1),
own as (select b.header, t.name, round(b.score, 6) as score from b join t using (i) join m using (header) left join o using (header) where b.score >= case when m.n > {lic.SHORT} then {lic.LEAST_LONG} else {lic.LEAST} end and b.score - coalesce(o.score, 0) >= {lic.MARGIN}
  and case when t.name = 'GPL-2.0' then m.v2 when t.name in ('GPL-3.0', 'LGPL-3.0', 'AGPL-3.0') then m.v3 else true end),
f as (select d.*, own.name, own.score, regexp_extract(d.path, '^(.*)/[^/]*$', 1) as dir from d left join own using (header)),
l as (select dir, first(name order by score desc, path) as name, first(score order by score desc, path) as score from f where name is not null and length(header) / greatest(length(text), 1) >= {lic.FILE_SHARE} group by dir),
a as (select f.dir, first(l.dir order by length(l.dir) desc) as above from (select distinct dir from f where name is null) f join l on l.dir = f.dir or f.dir like l.dir || '/%' group by f.dir)
select f.doc_id, f.path, coalesce(f.name, l.name) as license, coalesce(f.score, l.score) as score, case when f.name is not null then 'header' when l.name is not null then 'directory' else 'none' end as origin, case when f.name is null then l.dir end as inherited_from from f left join a on a.dir = f.dir and f.name is null left join l on l.dir = a.above"""

#: Every pattern of failures runs through every order of the filters, step by step.
AUDIT = r"""
with x as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as least,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
f as (
  select part, (case when len(w) < 100 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
    || case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when doc_id > least then 'E' else '' end) as fails,
    exists (select 1 from labels l where l.doc_id = x.doc_id and l.quality = 1)::int as good,
    exists (select 1 from labels l where l.doc_id = x.doc_id and l.toxic = 1)::int as toxic
  from x),
p as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from l a, l b, l c, l d, l e
  where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select *, i::int as step, substr(filter_order, i, 1) as letter from (select *, unnest(range(1, 6)) as i from o)),
r as (
  select p.*, s.*, contains(fails, letter) as here, coalesce(list_min(list_filter(range(1, 6), lambda k: contains(fails, substr(filter_order, k, 1)))), 6) as gone
  from p, s),
y as (
  select part, filter_order, step, any_value(letter) as letter, sum(n) filter (gone > step) as kept, sum(n) filter (gone = step) as removed,
    sum(n) filter (here and gone < step) as redundant, sum(n) filter (fails = letter) as unique_fails, sum(good) filter (gone = step) as good_lost,
    sum(toxic) filter (gone = step) as toxic_lost
  from r group by part, filter_order, step)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, letter), 0)::bigint as shapley
from y"""

_D = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, round by round; ties go to the smaller number."""
    parts = [
        """v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)""",
        f"""c0 as materialized (
  select row_number() over (order by h) - 1 as c, x as y from (select x, sha256('2:' || vec_id) as h from v order by h limit {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select r, arg_min(c, d * 64 + c) as c, min(d) as d from (select r, c, {_D} as d from v, c{i}) group by r)")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (
  select c{i}.c, coalesce(m.y, c{i}.y) as y from c{i} left join (
    select c, list((s - ((s % n + n) % n)) // n order by i)::bigint[] as y from (
      select c, i, sum(e) as s, count(*) as n from (select c, unnest(x) as e, unnest(range(64)) as i from v join a{i} using (r)) group by c, i)
    group by c) m on m.c = c{i}.c)""")
    return "with " + ",\n".join(parts) + f"""
select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(y, ',')) as centroid_sha256
from v join a{rounds} a using (r) join c{rounds} c on c.c = a.c"""


ORACLES = {"op11_clusters": _clusters(), "op12_audit": AUDIT, "op4_chat": CHAT, "linked_calls": CALLS, "op5_decontaminate": DECONTAMINATE, "op6_license": LICENSE}
