"""Queries over a whole graph: addresses of every kind, evidence held against them; registered beside those of `queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import templates as t
from .operators import evidence
from .plans import fetch, ingest, reads, reproduction
from .queries import query
from .sources.landing import kept, shared_checkpoints

_d = t.for_duckdb

_ID = "case when p_partkey % 10 = 9 then '10.1000/x' || cast(p_partkey as string) else 'P' || cast(p_partkey as string) end"
_K = "cast(p_partkey as string)"
_NULL = "cast(null as string)"
_FIVE = "from part join (select r_regionkey as r from region) on r < p_partkey % 5"

#: Tables of a graph: papers (some by DOI, some sharing one), their parts, two snapshots of each repository.
GRAPH = {
    "papers": f"""select {_ID} as arxiv_id, p_name as title, p_type as abstract, case when p_partkey % 50 = 3 then '10.2000/same' else '10.2000/d' || {_K} end as doi,
  {_NULL} as published_at, {_ID} || 'v2' as latest_version, p_brand as author from part""",
    "paper_versions": f"select {_ID} || 'v' || cast(v as string) as paper_version, {_ID} as arxiv_id, case when v = 1 then 'LATEX_EXACT' else 'UNAVAILABLE' end as fidelity from part join (select r_regionkey as v from region) on v in (1, 2)",
    "sections": f"""select {_ID} || 'v2' as paper_version, '1.' || cast(r as string) as section_path, cast(2 as int) as level, p_name || ' ' || cast(r as string) as title, {_NULL} as latex_label,
  'body "' || p_brand || '"' as body, cast(r * 10 as int) as src_line_start, cast(r * 10 + 9 as int) as src_line_end, cast(r as int) as ordinal {_FIVE}""",
    "equations": f"""select {_ID} || 'v2' as paper_version, 'h' || {_K} || '-' || cast(r as string) as content_hash, 'x = ' || cast(r as string) as latex, 'equation' as environment, r <> 2 as is_numbered,
  case when r = 2 then {_NULL} when r = 3 then '1' else cast(r as string) end as derived_number, 'LIKELY' as number_conf, {_NULL} as latex_label, {_NULL} as section_id, cast(r as int) as src_line, cast(r as int) as ordinal {_FIVE}""",
    "components": f"select {_ID} || 'v2' as paper_version, 'c' || cast(r as string) as slug, p_brand as name, 'loss' as kind, {_NULL} as description, {_NULL} as section_id, 'AGENT' as source {_FIVE}",
    "algorithms": f"""select {_ID} || 'v2' as paper_version, 'step-' || cast(r as string) as slug, 'Step' as name, case when r = 0 then 'figure_image' else 'latex_env' end as presentation, r > 0 as extractable,
  case when r > 0 then 'do ' || p_name end as body, {_NULL} as section_id, cast(r as int) as src_line {_FIVE}""",
    "stated_values": f"select {_ID} || 'v2' as paper_version, 'v' || cast(r as string) as id, 'tau' as symbol, cast(p_size as string) as value_text, {_NULL} as section_id, cast(9 - r as int) as src_line, p_type as context {_FIVE}",
    "declared_urls": f"""select {_ID} || 'v2' as paper_version, 'https://h/' || cast(r as string) as url, 'h' as host, {_NULL} as owner, {_NULL} as repo, r = 0 as in_abstract, {_NULL} as section_id,
  cast(r as int) as src_line, 'at h' as context {_FIVE}""",
    "implementation_candidates": f"select {_ID} || 'v2' as paper_version, 'own/r' || cast(r as string) as repo_id, 'OFFICIAL' as relation, 'LIKELY' as confidence, cast(5 - r as int) as rank {_FIVE}",
    "repos": "select 'own/r' || cast(r_regionkey as string) as id, cast(r_regionkey * 7 as bigint) as stars, 'mit' as license, r_regionkey = 1 as archived from region",
    "bib_entries": f"""select {_ID} || 'v2' as paper_version, 'k' || cast(r as string) as bib_key, p_name as title, p_brand as authors, cast(2000 + r as int) as year, case when r = 1 then '2001.00001' end as arxiv_id,
  {_NULL} as doi {_FIVE}""",
    "citation_sites": f"select {_ID} || 'v2' as paper_version, 'k' || cast(r as string) as bib_key from part join (select r_regionkey as r from region) on r <= p_partkey % 3 join (select n_nationkey as n from nation) on n < r",
    "analyses": f"select {_ID} || 'v2' as paper_version, 'a' || cast(r as string) as id, p_brand as author, cast('2024-01-0' || cast(r + 1 as string) || ' 00:00:00' as timestamp) as created_at, p_name as summary {_FIVE}",
    "mappings": f"""select {_ID} || 'v2|own/r' || cast(r as string) || '|' || cast(n as string) as id, {_ID} || 'v2' as paper_version, 'own/r' || cast(r as string) || '@s' as snapshot_id, 'component' as anchor_kind,
  'c' || cast(n as string) as anchor_id, case when n = 0 then 'MATCHED' else 'ABSENT' end as status, 'LIKELY' as confidence, 'names' as method, 'reason ' || cast(n as string) as reasoning
  from part join (select r_regionkey as r from region) on r < p_partkey % 5 join (select n_nationkey as n from nation) on n < 3""",
    "differences": f"""select 'd' || cast(n as string) as id, {_ID} || 'v2' as paper_version, 'own/r' || cast(r as string) || '@s' as snapshot_id, 'TRAINING' as kind, 'states' as paper_states, 'does' as code_does,
  'differs' as difference, case n when 0 then 'MINOR' when 1 then 'BLOCKING' else 'COSMETIC' end as severity, 'LIKELY' as confidence
  from part join (select r_regionkey as r from region) on r < p_partkey % 5 join (select n_nationkey as n from nation) on n < 3""",
    "plans": f"""select {_ID} || 'v2' as paper_version, 'own/r' || cast(r as string) as repo, case n when 0 then 'training' else 'dataset' end as part, 'PARTIAL' as status, cast(n + 2 as bigint) as n, cast(n as bigint) as n_matched
  from part join (select r_regionkey as r from region) on r < p_partkey % 5 join (select n_nationkey as n from nation) on n < 2""",
    "lineage_edges": f"""select {_ID} as from_paper, 'P' || cast(p_partkey - p_partkey % 10 + r as string) as to_paper, 'CITES' as relation, 'CONFIRMED' as confidence, 'registry' as source, r = 1 as is_influential {_FIVE}""",
    "repo_snapshots": """select 'own/r' || cast(r as string) || '@' || case when s = 1 then 's' else 'old' end as id, 'own/r' || cast(r as string) as repo_id, case when s = 1 then 's' else 'old' end as commit_sha,
  cast('2024-01-0' || cast(s + 1 as string) || ' 00:00:00' as timestamp) as indexed_at, 'ast' as indexer, cast(5 as bigint) as symbol_count, cast(2 as bigint) as file_count
  from (select r_regionkey as r from region) join (select n_nationkey as s from nation) on s < 2""",
    "symbols": """select 'own/r' || cast(p_partkey % 5 as string) || case when p_partkey % 7 = 0 then '@old' else '@s' end as snapshot_id, 'src/m' || cast(p_partkey % 3 as string) || '.py' as file_path,
  'src/m' || cast(p_partkey % 3 as string) || '.py::f' || cast(p_partkey as string) || '#function' as qualified_name, 'f' || cast(p_partkey as string) as name, 'function' as kind, cast(1 + p_partkey % 4 as int) as line_start,
  cast(3 + p_partkey % 4 as int) as line_end, 'def f' || cast(p_partkey as string) || '()' as signature from part""",
    "code_files": """select 'own/r' || cast(r as string) as repo, 'src/m' || cast(n as string) || '.py' as path, 'a' || chr(10) || 'b' || cast(r as string) || chr(10) || 'c' || cast(n as string) || chr(10) || 'd' || chr(10) || 'e' as text
  from (select r_regionkey as r from region) join (select n_nationkey as n from nation) on n < 3""",
    "evidence": "select 'ev' || cast(n_nationkey as string) as id, 'paper_section' as kind, 'evi://e/' || cast(n_nationkey as string) as uri from nation",
    "evidence_links": f"""select 'ev' || cast(r as string) as evidence_id, 'mapping' as subject_kind, {_ID} || 'v2|own/r' || cast(r as string) || '|0' as subject_id, 'SUPPORTS' as stance {_FIVE}
  union all select 'ev' || cast(9 + r as string), 'implementation_candidate', {_ID} || 'v2|own/r' || cast(r as string), 'CONTRADICTS' {_FIVE}""",
}

_SUBJECT = "case p_partkey % 4 when 0 then 'P' || cast(p_partkey as string) when 1 then 'P' || cast(p_partkey as string) || 'v2' when 2 then '10.2000%2Fd' || cast(p_partkey as string) else case when p_partkey % 10 = 9 then '10.1000%2Fx' || cast(p_partkey as string) else '10.2000%2Fsame' end end"
#: Addresses: every part asks for something of every kind, some of it not there; kinds by n, targets by part.
ADDRESSES = f"""select distinct 'evi://' || case n when 0 then 'paper/' || {_SUBJECT} when 1 then 'paper/' || {_SUBJECT} || '/section/1.' || cast(p_partkey % 4 as string) when 2 then 'paper/' || {_SUBJECT} || '/equation/' || cast(p_partkey % 3 as string)
  when 3 then 'paper/' || {_SUBJECT} || '/equation/h' || {_K} || '-' || cast(p_partkey % 4 as string) when 4 then 'paper/' || {_SUBJECT} || '/component/c' || cast(p_partkey % 3 as string) when 5 then 'paper/' || {_SUBJECT} || '/algorithm/step-' || cast(p_partkey % 3 as string)
  when 6 then 'paper/' || {_SUBJECT} || '/values' when 7 then 'paper/' || {_SUBJECT} || '/urls' when 8 then 'paper/' || {_SUBJECT} || '/implementations' when 9 then 'paper/' || {_SUBJECT} || '/references' when 10 then 'paper/' || {_SUBJECT} || '/analysis'
  when 11 then 'mapping/' || {_SUBJECT} || '/own/r' || cast(p_partkey % 3 as string) when 12 then 'difference/' || {_SUBJECT} || '/own/r' || cast(p_partkey % 3 as string) when 13 then 'plan/' || {_SUBJECT} || '/own/r' || cast(p_partkey % 3 as string)
  when 14 then 'lineage/' || {_SUBJECT} when 15 then 'repo/own/r' || cast(p_partkey % 7 as string) when 16 then 'repo/own/r' || cast(p_partkey % 6 as string) || '/file/src/m' || cast(p_partkey % 4 as string) || '.py'
  when 17 then 'repo/own/r' || cast(p_partkey % 5 as string) || '/symbol/src%2Fm' || cast(p_partkey % 3 as string) || '.py%3A%3Af' || {_K} || '%23function' else 'nothing/' || {_K} end as uri
  from part join (select n_nationkey as n from nation) on n < 19"""  # fmt: skip


def graph(spark, d):
    """The graph's tables; those that are read more than once by a plan are written first."""
    out = {name: t.derived(spark, d, sql) for name, sql in GRAPH.items()}
    out["papers"] = out["papers"].withColumn("authors", F.array(F.struct(F.col("author").alias("name"))))
    out["analyses"] = out["analyses"].withColumn("fields", F.create_map(F.lit("summary"), "summary", F.lit("by"), "author"))
    return out


_G = ",\n".join(f"{name} as ({sql})" for name, sql in GRAPH.items())
_EVIDENCE = """(select to_json(coalesce(list({{'id': e.id, 'kind': e.kind, 'uri': e.uri, 'stance': l.stance}} order by e.id), [])) from evidence_links l join evidence e on e.id = l.evidence_id
    where l.subject_kind = '{}' and l.subject_id = {})"""
_LIST = "'[' || string_agg(item, ',' order by place, sort) || ']'"
_CONTENTS = f"""
items as (
  select 'paper' as kind, paper_version as subject, '' as target, 0 as place, '' as sort, json_object('paper_version', paper_version, 'title', title, 'authors', [author], 'published_at', published_at, 'abstract', abstract, 'fidelity', fidelity,
    'counts', json_object('sections', (select count(*) from sections x where x.paper_version = v.paper_version), 'equations', (select count(*) from equations x where x.paper_version = v.paper_version),
      'algorithms', (select count(*) from algorithms x where x.paper_version = v.paper_version), 'stated_values', (select count(*) from stated_values x where x.paper_version = v.paper_version),
      'declared_urls', (select count(*) from declared_urls x where x.paper_version = v.paper_version), 'components', (select count(*) from components x where x.paper_version = v.paper_version)))::varchar as item
  from paper_versions v join papers using (arxiv_id)
  union all select 'section', paper_version, section_path, ordinal, section_path, json_object('section_path', section_path, 'level', level, 'title', title, 'latex_label', latex_label, 'src_lines', [src_line_start, src_line_end], 'body', body) from sections
  union all select 'equation', paper_version, key, ordinal, content_hash, json_object('content_hash', content_hash, 'latex', latex, 'environment', environment, 'is_numbered', is_numbered, 'derived_number', derived_number, 'number_conf', number_conf,
    'latex_label', latex_label, 'section_id', section_id, 'src_line', src_line, 'shared', shared) from (
      select *, content_hash as key, false as shared from equations union all select *, derived_number, count(*) over (partition by paper_version, derived_number) > 1 from equations where derived_number is not null)
  union all select 'component', paper_version, slug, 0, slug, json_object('slug', slug, 'name', name, 'kind', kind, 'description', description, 'section_id', section_id, 'source', source) from components
  union all select 'algorithm', paper_version, slug, src_line, slug, json_object('slug', slug, 'name', name, 'presentation', presentation, 'extractable', extractable, 'body', body, 'section_id', section_id, 'src_line', src_line) from algorithms
  union all select 'values', paper_version, '', src_line, id, json_object('symbol', symbol, 'value', value_text, 'section_id', section_id, 'src_line', src_line, 'context', context) from stated_values
  union all select 'urls', paper_version, '', src_line, url, json_object('url', url, 'host', host, 'owner', owner, 'repo', repo, 'in_abstract', in_abstract, 'section_id', section_id, 'src_line', src_line, 'context', context) from declared_urls
  union all select 'implementations', paper_version, '', rank, repo_id, json_object('repo_id', repo_id, 'relation', relation, 'confidence', confidence, 'rank', rank, 'stars', stars, 'license', license, 'archived', archived,
    'evidence', {_EVIDENCE.format("implementation_candidate", "c.paper_version || '|' || c.repo_id")}) from implementation_candidates c join repos on repos.id = repo_id
  union all select 'references', paper_version, '', -cited, bib_key, json_object('bib_key', bib_key, 'title', title, 'authors', authors, 'year', year, 'arxiv_id', arxiv_id, 'doi', doi, 'cited_times', cited) from (
    select b.*, (select count(*) from citation_sites s where s.paper_version = b.paper_version and s.bib_key = b.bib_key) as cited from bib_entries b)
  union all select 'analysis', paper_version, '', 0, id, json_object('id', id, 'author', author, 'fields', json_object('by', author, 'summary', summary)) from analyses where (paper_version, created_at) in (select (paper_version, max(created_at)) from analyses group by paper_version)
  union all select 'mapping', paper_version, split_part(snapshot_id, '@', 1), 0, status || '|' || anchor_kind || '|' || id, json_object('id', id, 'anchor_kind', anchor_kind, 'anchor_id', anchor_id, 'status', status, 'confidence', confidence, 'method', method,
    'reasoning', reasoning, 'evidence', {_EVIDENCE.format("mapping", "m.id")}) from mappings m
  union all select 'difference', paper_version, split_part(snapshot_id, '@', 1), case severity when 'BLOCKING' then 1 when 'SIGNIFICANT' then 2 when 'MINOR' then 3 else 4 end, id, json_object('kind', kind, 'paper_states', paper_states, 'code_does', code_does,
    'difference', difference, 'severity', severity, 'confidence', confidence) from differences
  union all select 'plan', paper_version, repo, 0, part, json_object('part', part, 'status', status, 'n', n, 'n_matched', n_matched) from plans
  union all select 'lineage', e, '', 0, from_paper || '|' || to_paper || '|' || relation, json_object('from_paper', from_paper, 'to_paper', to_paper, 'relation', relation, 'confidence', confidence, 'source', source, 'is_influential', is_influential)
    from (select *, unnest(list_distinct([from_paper, to_paper])) as e from lineage_edges)
  union all select 'repo', repo_id, '', 0, id, json_object('repo_id', repo_id, 'commit_sha', commit_sha, 'indexer', indexer, 'symbol_count', symbol_count, 'file_count', file_count) from repo_snapshots where commit_sha = 's'
  union all select 'file', split_part(snapshot_id, '@', 1), file_path, line_start, qualified_name, json_object('qualified_name', qualified_name, 'name', name, 'kind', kind, 'lines', [line_start, line_end], 'signature', signature) from symbols where snapshot_id like '%@s'
  union all select 'symbol', split_part(snapshot_id, '@', 1), qualified_name, line_start, file_path, json_object('qualified_name', qualified_name, 'name', name, 'kind', kind, 'file_path', file_path, 'lines', [line_start, line_end], 'signature', signature,
    'source', array_to_string(string_split(text, chr(10))[line_start:line_end], chr(10))) from symbols left join code_files on repo = split_part(snapshot_id, '@', 1) and path = file_path where snapshot_id like '%@s'),
a as (select uri, string_split(substr(uri, 7), '/') as s from {_d(ADDRESSES)}),
b as (
  select uri, case when s[1] = 'paper' then case when len(s) = 2 then 'paper' else s[3] end when s[1] = 'repo' then case when len(s) = 3 then 'repo' else s[4] end when s[1] = 'nothing' then null else s[1] end as kind,
    url_decode(case when s[1] = 'repo' then s[2] || '/' || s[3] else s[2] end) as named,
    url_decode(case when s[1] = 'paper' then s[4] when s[1] = 'repo' then array_to_string(s[5:], '/') else array_to_string(s[3:], '/') end) as target
  from a),
n as (
  select k, count(distinct pv) as n, min(pv) as pv, min(id) as id from (
    select paper_version as k, paper_version as pv, arxiv_id as id from paper_versions union all select arxiv_id, latest_version, arxiv_id from papers union all select doi, latest_version, arxiv_id from papers) group by k),
c as (
  select uri, kind, n.n as papers, case when kind in ('repo', 'file', 'symbol') then named when n.n = 1 and kind = 'lineage' then n.id when n.n = 1 then n.pv end as subject, coalesce(target, '') as target
  from b left join n on n.k = named and kind not in ('repo', 'file', 'symbol')),
m as (
  select kind, subject, target, count(*) as n, case when kind in ('values', 'urls', 'implementations', 'references', 'mapping', 'difference', 'plan', 'lineage', 'file') then {_LIST} else first(item order by place, sort, item) end as content
  from items group by kind, subject, target),
g as (
  select kind, subject, target, min((place, sort)) as w from items where kind in ('section', 'equation', 'component', 'algorithm', 'file', 'symbol') and not (kind = 'equation' and regexp_matches(target, '^[0-9]+$')) group by all),
h as (select kind, subject, string_agg(target, ',' order by p) as available from (select *, row_number() over (partition by kind, subject order by w, target) as p from g) where p <= 40 group by all)
"""  # fmt: skip


@query(f"""with {_G}, {_CONTENTS}
select uri, kind, case when kind is null then 'UNRECOGNISED' when papers > 1 then 'AMBIGUOUS' when m.n is not null then 'FOUND'
  when subject is not null and kind in ('values', 'urls', 'implementations', 'references', 'mapping', 'difference', 'plan', 'lineage', 'analysis') then 'EMPTY' else 'NOT_FOUND' end as status,
  case when kind is not null then subject end as subject, case when kind is not null then nullif(target, '') end as target, m.n, content, case when m.n is null then available end as available
from c left join m using (kind, subject, target) left join h using (kind, subject)""")
def fetched_addresses(spark, d):
    """Addresses of all kinds, found, empty, missing and ambiguous, with their content."""
    return fetch.fetch(kept(t.derived(spark, d, ADDRESSES)), graph(spark, d), kept)


#: Evidence of subjects: each address supports one and speaks against the next.
_CITED = f"""select 'item' as subject_kind, 's' || cast(length(uri) as string) || substr(uri, 7, 4) as subject_id, uri, case when length(uri) % 5 = 0 then 'CONTRADICTS' else 'SUPPORTS' end as stance from ({ADDRESSES})"""


@query(f"""with {_G}, {_CONTENTS},
r as (select uri from c left join m using (kind, subject, target) where kind is not null and coalesce(papers, 1) = 1 and (m.n is not null
  or subject is not null and kind in ('values', 'urls', 'implementations', 'references', 'mapping', 'difference', 'plan', 'lineage', 'analysis'))),
e as (select * from {_d(_CITED)})
select subject_id, case when count(*) filter (stance = 'SUPPORTS' and uri in (select uri from r)) > 0 then 'CONFIRMED' else 'UNKNOWN' end as confidence,
  count(*) filter (stance <> 'SUPPORTS' or uri in (select uri from r)) as n_kept from e group by 1""")
def evidence_by_address(spark, d):
    """What evidence on addresses of all kinds leaves of claims."""
    none = F.lit(None).cast("string")
    e = kept(t.derived(spark, d, _CITED)).select("subject_kind", "subject_id", F.lit("cited").alias("kind"), "uri", none.alias("locator"), none.alias("excerpt"), "stance")
    claims = e.select(*evidence.SUBJECT).distinct().withColumn("confidence", F.lit("CONFIRMED"))
    final, left = evidence.record(claims, e, fetch.resolving(e.select("uri"), graph(spark, d)))
    n = left.groupBy("subject_id").agg(F.count("*").alias("n_kept"))
    return final.join(n, "subject_id", "left").select("subject_id", "confidence", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query(f"""with {_G},
m as (select paper_version, split_part(snapshot_id, '@', 1) as repo, status, count(*) as n from mappings group by all),
r as (select paper_version, repo, string_agg(status || '=' || n, ',' order by status || '=' || n) as own from m group by all)
select v.paper_version, {", ".join(f"(select count(*) from {n} x where x.paper_version = v.paper_version) as n_{n}" for n in ("sections", "equations", "algorithms", "stated_values", "components"))}, 0::bigint as n_claims,
  coalesce((select string_agg(repo_id, ',' order by rank, repo_id) from implementation_candidates c where c.paper_version = v.paper_version), '') as implementations,
  coalesce((select string_agg(repo || ': ' || own, '; ' order by repo) from r where r.paper_version = v.paper_version), '') as mapped,
  case when exists (select 1 from analyses a where a.paper_version = v.paper_version) then 'analysed' else 'needs_analysis' end as status,
  (select arg_max(id, created_at) from analyses a where a.paper_version = v.paper_version) as analysis
from paper_versions v""")
def paper_overviews(spark, d):
    """What a graph has on every paper version, as one answer each."""
    return reads.overview(graph(spark, d))


@query(f"""with {_G} select distinct paper_version, split_part(snapshot_id, '@', 1) as repo, anchor_id, reasoning as item from mappings where status = 'ABSENT'""")
def missing_information(spark, d):
    return reproduction.missing_information(graph(spark, d)["mappings"].withColumn("repo", F.substring_index("snapshot_id", "@", 1)))


_CLAIMED = """select doc_id as item, 'D' || cast(doc_id % 9 as string) as paper_version, case when doc_id % 13 = 0 then cast(null as string) else ' claims ' || cast(doc_id as string) || ' ' end as name,
  case when doc_id % 4 = 0 then cast(null as string) when doc_id % 6 = 0 then 'guess' else 'result' end as kind, doc_id as n from documents"""


@query(f"""with c as (select *, trim(name) as statement, doc_kind from (select *, coalesce(kind, 'contribution') as doc_kind from {_d(_CLAIMED)})),
r as (select *, case when statement is null then 'no statement' when doc_kind = 'guess' then 'unknown kind' when n % 5 = 1 then 'no cited address resolves' end as reason from c)
select item, doc_kind as kind, reason, reason is null as accepted, case when reason is null and n % 2 = 0 then paper_version || ':sec:' || n end as section_id,
  paper_version || ':claim:' || substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(coalesce(statement, ''))), 1, 12) as claim_id from r""")
def validated_claims(spark, d):
    """Claims written back: which are accepted, why the others aren't, and their ids."""
    rows = kept(t.derived(spark, d, _CLAIMED))
    own = F.concat(F.lit("evi://paper/x/"), F.when(F.col("n") % 2 == 0, "section/").otherwise("values/"), "n")
    items = rows.withColumn("uris", F.array(F.lit("evi://nowhere"), own)).drop("n")
    return evidence.validate_claims(items, rows.where("n % 5 <> 1").select(own.alias("uri"))).select("item", "kind", "reason", "accepted", "section_id", "claim_id")


# ── ingest ───────────────────────────────────────────────────────────────────


@query("""
select 'P' || p_partkey || 'v1' as paper_version, case when p_partkey % 4 <> 3 and p_partkey % 3 <> 0 then 1 else 2 end::bigint as turn,
  case when p_partkey % 5 = 0 then 7 else 5 end::bigint as n_sections, p_size || 'e-4' as tau, 0::bigint as n_errors from part""")
def incremental_ingest(spark, d):
    """Papers ingested in two turns, of which the second brings new and changed ones; a third has nothing to do."""
    g = ingest.graph(spark, f"{shared_checkpoints(spark).rstrip('/')}/graph-{uuid.uuid4().hex}")
    papers = kept(t.derived(spark, d, t.PAPERS, "part"))
    old = papers.where("k % 4 <> 3").withColumn("tex", F.when(F.col("k") % 3 == 0, F.concat("tex", F.lit("\n\\section{To be dropped} rho = 7."))).otherwise(F.col("tex")))
    for sources in (old, papers, papers):
        ingest.ingest_changed(g, sources)
    turns = g.valid(1).select("key", "run", F.lit(1).alias("turn")).unionByName(g.valid(2).join(g.valid(1), ["key", "run"], "left_anti").select("key", "run", F.lit(2).alias("turn")))
    at = g.valid().join(turns, ["key", "run"]).select(F.col("key").alias("paper_version"), "turn")
    n = g.read("sections").groupBy("paper_version").agg(F.count("*").alias("n_sections"))
    values = g.read("stated_values").where("symbol in ('tau', 'rho')").groupBy("paper_version").agg(F.max_by("value_text", "symbol").alias("tau"))
    errors = g.read("errors").groupBy("paper_version").agg(F.count("*").alias("n_errors"))
    return at.join(n, "paper_version", "left").join(values, "paper_version", "left").join(errors, "paper_version", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
