"""Queries of the composites that users call, of landed responses and of lookups; registered beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as q
from . import templates as t
from .functions import text as T
from .operators import codeindex, correlate, discover, evidence, extract, lineage, scan
from .plans import ingest, reads, reproduction
from .queries import ORACLES, query
from .sources import compact, flatten, landing

_d = t.for_duckdb


def _cte(sql: str, name: str) -> str:
    """SQL as a named part of a WITH clause."""
    return f"{name} as ({sql})"


# ── mapping, differences, gaps ───────────────────────────────────────────────


@query(f"""with {_cte(ORACLES["map_stated_values"], "v")}, {_cte(ORACLES["map_components"], "c")}, {_cte(ORACLES["map_algorithms"], "a")}
select paper_version, 'stated_value' as anchor_kind, label, status from v union all select paper_version, 'component', label, status from c union all select paper_version, 'algorithm', label, status from a""")
def map_papers(spark, d):
    e = q._kept(q._events(spark, d, "heading", "value", "algorithm"))
    s = extract.sections(e)
    a = extract.located(extract.algorithms(e), s).withColumn("id", F.concat("paper_version", F.lit(":algo:"), "slug"))
    tables = {"stated_values": extract.located(extract.stated_values(e), s), "components": t.derived(spark, d, t.COMPONENTS), "algorithms": a}
    return correlate.map_papers(tables, t.derived(spark, d, t.PAIRS), q._symbols(spark, d), q._lines(spark, d)).select("paper_version", "anchor_kind", "label", "status")


_BEST = q._MAP_COMPONENTS[: q._MAP_COMPONENTS.index(",\ng as")]
_BONUS = "case k.kind " + " ".join(f"when '{kind}' then regexp_matches(y.name, '(?i){p}')::int" for kind, p in correlate.SYMBOL_KINDS.items()) + " else 0 end"


@query(f"""{_BEST}, k as (select * from {_d(t.COMPONENTS)}), y as (select * from {_d(t.SYMBOLS)}), z as (select c.id, c.paper_version, c.name, c.tk, f.qualified_name, list_sum(list_transform(c.tk, lambda x: contains(f.hay, x[:case when length(x) > 5 then 5 else length(x) end])::int)) as covered, {_BONUS} as bonus
from c join k on k.id = c.id and k.paper_version = c.paper_version join f on f.repo = c.repo and f.tk = c.tk join y on y.repo = f.repo and y.qualified_name = f.qualified_name)
select paper_version, name as label, qualified_name as symbol_id, covered::bigint as covered from (select *, row_number() over (partition by paper_version, id order by covered desc, bonus desc, qualified_name) as n from z) where n = 1 and covered / len(tk) >= 0.5""")
def component_symbols(spark, d):
    rows = q._mapped_components(spark, d).where("symbol_id is not null")
    return rows.select("paper_version", "label", "symbol_id", F.regexp_extract("reasoning", r"matches (\d+)/", 1).cast("long").alias("covered"))


@query(f"""with {_cte(ORACLES["missing_components"], "m")}, {_cte(ORACLES["behaviour_differences"], "b")}, {_cte(ORACLES["changed_hyperparameters"], "c")}, u as (select paper_version, 'MISSING_COMPONENT' as kind, subject, severity from m union all select paper_version, kind, subject, severity from b union all select paper_version, 'CHANGED_HYPERPARAMETER', subject, 'SIGNIFICANT' from c)
select *, (case severity when 'BLOCKING' then 0 when 'SIGNIFICANT' then 1 else 2 end)::bigint as severity_order from u""")
def all_differences(spark, d):
    values = q._kept(q._mapped_values(spark, d))
    mapped = correlate.graded(values.unionByName(q._mapped_components(spark, d, values)))
    rows = correlate.differences(mapped, t.derived(spark, d, t.COMPONENTS), q._kept(q._papers(spark, d)), t.derived(spark, d, t.PAIRS), q._lines(spark, d))
    return rows.select("paper_version", "kind", "subject", "severity", "severity_order")


@query(f"""with {_cte(ORACLES["map_components"], "m")}, {_cte(ORACLES["hidden_constants"], "h")}, {_cte(ORACLES["external_artifacts"], "x")}, p as (select paper_version, 'r' || k % 10 as repo from {_d(q._TEXTS)})
select paper_version, 'ABSENT_FROM_REPOSITORY' as kind, label as subject, 1::bigint as n, 0::bigint as gap_order from m where status = 'ABSENT' and paper_version in (select paper_version from p) union all select p.paper_version, 'EXTERNAL_DEPENDENCY', x.path, x.n, 1 from p join x using (repo) union all select paper_version, 'CONFIG_HIDDEN', path || ':' || line, n, 2 from h""")
def reproduction_gaps(spark, d):
    papers = t.derived(spark, d, q._TEXTS)
    pairs = papers.select("paper_version", F.concat(F.lit("r"), F.col("k") % 10).alias("repo"))
    mapped = q._verdicts(spark, d).join(pairs, ["paper_version", "repo"], "left_semi")
    lines = q._lines(spark, d).unionByName(t.derived(spark, d, q._DOWNLOADS))
    return correlate.gaps(mapped, papers.select("paper_version", "tex"), pairs, lines).select("paper_version", "kind", "subject", "n", "gap_order")


_MAPPED = "select 'm' || cast(p_partkey as string) as id, case p_partkey % 4 when 0 then 'MATCHED' when 1 then 'ABSENT' when 2 then 'AMBIGUOUS' else 'UNKNOWN' end as status from part"
_LINKED = "select distinct case when l_linenumber < 7 then 'mapping' else 'claim' end as subject_kind, 'm' || cast(l_partkey as string) as subject_id, 'ev' || cast(l_orderkey % 50 as string) as evidence_id, case when l_suppkey % 3 = 0 then 'CONTRADICTS' else 'SUPPORTS' end as stance from lineitem"


@query(f"""with l as (select * from {_d(_LINKED)} where subject_kind = 'mapping') select m.id, m.status, count(*) filter (stance = 'SUPPORTS') as n_for, count(*) filter (stance = 'CONTRADICTS') as n_against, case when count(stance) > 0 then coalesce(string_agg(evidence_id, ',' order by evidence_id) filter (stance = 'SUPPORTS'), '') end as evidence_for,
case when count(stance) > 0 then coalesce(string_agg(evidence_id, ',' order by evidence_id) filter (stance = 'CONTRADICTS'), '') end as evidence_against,
case status when 'MATCHED' then 'read the located code to confirm that it is used as stated' when 'ABSENT' then 'find the implementation under another name' when 'AMBIGUOUS' then 'identify one site among the candidates' else 'state the anchor with a name of its own' end as advice
from {_d(_MAPPED)} m left join l on l.subject_id = m.id group by m.id, m.status""")
def explained_mappings(spark, d):
    return evidence.explain(t.derived(spark, d, _MAPPED), t.derived(spark, d, _LINKED)).select("id", "status", "n_for", "n_against", "evidence_for", "evidence_against", "advice")


# ── discovery, lineage, plans ────────────────────────────────────────────────


@query("""with p as (select p_partkey as k, 'P' || p_partkey || 'v1' as paper_version from part) select paper_version, 'lab' || k % 11 || '/tool' || k % 13 as repo, true as declared, true as in_abstract, 1::bigint as seed from p
union all select paper_version, 'x/' || i, false, false, (i + 1)::bigint from p, range(1, 8) r(i)""")
def implementation_seeds(spark, d):
    urls = extract.declared_urls(q._events(spark, d, "url"))
    found = t.derived(spark, d, "select 'P' || cast(p_partkey as string) || 'v1' as paper_version, cast(n_nationkey as int) as place, case when n_nationkey = 0 then 'LAB' || cast(p_partkey % 11 as string) || '/Tool' || cast(p_partkey % 13 as string) else 'x/' || cast(n_nationkey as string) end as repo from part join nation on n_nationkey < 12")
    return discover.seeds(urls, found)


@query(f"""with {_cte(ORACLES["predecessors"], "p")}, {_cte(ORACLES["forward_edges"], "f")} select paper_version as from_paper, to_paper, relation, confidence, 'bibliography' as source from (select *, 'CONFIRMED' as confidence from p) union all select from_paper, cited, relation, confidence, 'citation_index' from f""")
def lineage_edges(spark, d):
    back = lineage.predecessors(q._entries(spark, d), q._sites(spark, d), 10)
    return lineage.edges(back, q._forward(spark, d)).select("from_paper", "to_paper", "relation", "confidence", "source")


@query(f"""with {_cte(ORACLES["plan_sections"], "p")}, {_cte(ORACLES["stated_environment"], "e")}, {_cte(ORACLES["manifest_dependencies"], "m")}, r as (select 'P' || p_partkey || 'v1' as paper_version, 'r' || p_partkey % 10 as repo from part), n as (select repo, count(*) as n, count(*) filter (pinned) as k from m group by 1),
x as (select paper_version, (e.python is not null)::bigint + (e.cuda is not null)::bigint as n from r left join e using (repo)) select * from p union all select paper_version, 'environment', n, n, case n when 2 then 'KNOWN' when 1 then 'PARTIAL' else 'UNKNOWN' end from x
union all select paper_version, 'dependencies', coalesce(n, 0), coalesce(k, 0), case when n is null then 'UNKNOWN' when n = k then 'KNOWN' else 'PARTIAL' end from r left join n using (repo)""")
def whole_plan(spark, d):
    values = q._kept(q._mapped_values(spark, d))
    mapped = correlate.graded(values.unionByName(q._mapped_components(spark, d, values)))
    manifests = q._kept(t.derived(spark, d, q._MANIFESTS))
    tables = {"components": t.derived(spark, d, t.COMPONENTS), "stated_values": extract.stated_values(q._events(spark, d, "value"))}
    rows = reproduction.plan(tables, mapped, t.derived(spark, d, t.PAIRS), landing.manifest_dependencies(manifests), landing.stated_environment(manifests))
    return rows.select("paper_version", "part", "n", "n_matched", "status")


_RESULTS = "select 'O' || cast(l_orderkey % 300 as string) as paper_version, cast(row_number() over (partition by l_orderkey % 300 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) as ordinal, case when l_partkey % 5 = 0 then 'Top Accuracy' else 'size' end as symbol, case when l_suppkey % 7 = 0 then 'a BLEU of' when l_suppkey % 7 = 1 then cast(null as string) else 'plain' end as context, cast(l_linenumber as int) as src_line from lineitem"


@query(f"""select paper_version, ordinal::bigint as ordinal, n from (select *, row_number() over (partition by paper_version order by src_line, ordinal) as n from {_d(_RESULTS)} where regexp_matches(lower(symbol), 'accuracy|bleu') or regexp_matches(lower(coalesce(context, '')), 'accuracy|bleu')) where n <= 8""")
def expected_results(spark, d):
    return reproduction.expected_results(t.derived(spark, d, _RESULTS)).select("paper_version", "ordinal", "n")


@query(f"""with r as (select * from {_d(q._RANKED)}), g as (select 'r' || o_orderkey as repo_id, o_orderkey % 6 as repo_stars, o_orderpriority as license, o_orderstatus = 'F' as archived from orders where o_orderkey % 3 > 0) select r.paper_version, g.repo_id, r.relation, g.repo_stars as stars, g.license, g.archived from r join g on g.repo_id = r.repo""")
def implementations_of(spark, d):
    repos = t.derived(spark, d, "select 'r' || cast(o_orderkey as string) as id, o_orderkey % 6 as stars, o_orderpriority as license, o_orderstatus = 'F' as archived from orders where o_orderkey % 3 > 0")
    return reads.implementations(t.derived(spark, d, q._RANKED).withColumnRenamed("repo", "repo_id").drop("stars"), repos).select("paper_version", "repo_id", "relation", "stars", "license", "archived")


_COUNTS = """select 'P' || cast(p_partkey as string) as paper_version, case n when 0 then 'sections' when 1 then 'equations' when 2 then 'stated_values' when 3 then 'components' else 'citation_sites' end as entity,
  cast((p_size + n) % (9 - n) as bigint) as n from part join (select r_regionkey as n from region) on n < 1 + p_partkey % 5"""


@query(f"""
with c as (
  select paper_version, coalesce(sum(n) filter (entity = 'sections'), 0)::bigint as sections, coalesce(sum(n) filter (entity = 'equations'), 0)::bigint as equations, coalesce(sum(n) filter (entity = 'stated_values'), 0)::bigint as stated_values,
    coalesce(sum(n) filter (entity = 'components'), 0)::bigint as components, coalesce(sum(n) filter (entity = 'citation_sites'), 0)::bigint as citation_sites from {_d(_COUNTS)} group by 1),
m as (
  select paper_version, count(*) filter (status = 'MATCHED') as n_matched, count(*) filter (status = 'ABSENT') as n_absent, count(*) filter (status = 'AMBIGUOUS') as n_ambiguous, count(*) filter (status = 'UNKNOWN') as n_unknown
  from {_d(q._VERDICTS)} group by 1),
d as (
  select paper_version, count(*) filter (severity = 'BLOCKING') as n_blocking, count(*) filter (severity = 'SIGNIFICANT') as n_significant, count(*) filter (severity = 'MINOR') as n_minor from {_d(q._DIFFERENCES)} group by 1)
select c.*, coalesce(n_matched, 0) as n_matched, coalesce(n_absent, 0) as n_absent, coalesce(n_ambiguous, 0) as n_ambiguous, coalesce(n_unknown, 0) as n_unknown, coalesce(n_blocking, 0) as n_blocking,
  coalesce(n_significant, 0) as n_significant, coalesce(n_minor, 0) as n_minor from c left join m using (paper_version) left join d using (paper_version)""")
def batch_report(spark, d):
    return reads.report(t.derived(spark, d, _COUNTS), t.derived(spark, d, q._VERDICTS), t.derived(spark, d, q._DIFFERENCES))


# ── code, bibliographies, landed responses ───────────────────────────────────


@query("""select 'r' || p_partkey % 10 as repo, 'pkg/f' || p_partkey || '.py::' || replace(s.q, '#n', p_size::string) as qualified_name, replace(s.x, '#n', p_size::string) as source from part, (values ('LIMIT#constant', 'LIMIT = #n'), ('Net#n#class', 'class Net#n:' || chr(10) || '    def run(self, x):' || chr(10) || '        return x'),
('Net#n.run#method', '    def run(self, x):' || chr(10) || '        return x'), ('go#function', 'async def go(a, b=#n):' || chr(10) || '    pass')) s(q, x) where p_partkey % 10 <> 3""")
def source_of_symbols(spark, d):
    files = q._kept(t.derived(spark, d, q._SOURCE_FILES, "part"))
    return codeindex.symbol_source(codeindex.python_symbols(files), files)


_B = "chr(92)"
_BBL = f"""select 'P' || cast(p_partkey as string) || 'v1' as paper_version, case when p_partkey % 3 = 0 then 'm.bib' else 'm.bbl' end as file, case when p_partkey % 3 = 0 then 'bib' else 'bbl' end as kind, case when p_partkey % 3 = 0
 then '@article{{k' || cast(p_partkey % 7 as string) || ',' || chr(10) || ' title = {{On ' || p_name || '}}, author = "Ada L", year = ' || cast(p_size + 1950 as string) || ', eprint = {{2001.' || lpad(cast(p_partkey as string), 5, '0') || '}}' || chr(10) || '}}' || chr(10) || '@misc{{k' || cast(p_partkey % 5 as string) || ', booktitle = {{Proceedings}}, title = {{T}}, year = {{1999}}, doi = {{10.1000/b' || cast(p_size as string) || '}}}}'
 else {_B} || 'bibitem[x]{{k' || cast(p_partkey % 7 as string) || '}} Wu, Z., ~Xiong' || chr(10) || {_B} || 'newblock ' || {_B} || 'emph{{Some fine long ' || p_name || '}}.' || chr(10) || {_B} || 'newblock arXiv preprint arXiv:1805.' || lpad(cast(p_partkey as string), 5, '0') || ', 2018.' || chr(10) || {_B} || 'bibitem{{u}} Doe.' || chr(10) || {_B} || 'newblock Short.' || chr(10) || {_B} || 'newblock Venue of 2016, doi 10.1000/x' || cast(p_size as string) || '.' end as text from part"""
_BIB_ROWS = f"""with f as (select p_partkey as k, 'P' || p_partkey || 'v1' as paper_version, p_name, p_size from part) select paper_version, 'k' || k % 7 as bib_key, 'Wu, Z., Xiong' as authors, 'Some fine long ' || p_name as title, 2018::bigint as year, '1805.' || lpad(k::string, 5, '0') as arxiv_id, null as doi from f where k % 3 > 0 union all select paper_version, 'u', 'Doe.', 'Venue of 2016, doi 10.1000/x' || p_size, 2016, null, '10.1000/x' || p_size from f where k % 3 > 0
union all select paper_version, 'k' || k % 7, 'Ada L', 'On ' || p_name, null, '2001.' || lpad(k::string, 5, '0'), null from f where k % 3 = 0 and k % 7 <> k % 5 union all select paper_version, 'k' || k % 5, null, 'Proceedings', 1999, null, '10.1000/b' || p_size from f where k % 3 = 0"""


@query(_BIB_ROWS)
def bibliography_entries(spark, d):
    return scan.bibliography(t.derived(spark, d, _BBL)).select("paper_version", "bib_key", "authors", "title", "year", "arxiv_id", "doi")


@query(f"""with {_cte(_BIB_ROWS, "b")}, {_cte(ORACLES["citation_sites"], "c")}, n as (select paper_version, bib_key, count(*) as cite_count from c group by all) select paper_version, bib_key, title, coalesce(cite_count, 0) as cite_count, b.authors is null and b.title is null as empty from b full join n using (paper_version, bib_key)""")
def bibliography_with_sites(spark, d):
    rows = extract.bibliography_with_sites(scan.bibliography(t.derived(spark, d, _BBL)), extract.citation_sites(q._events(spark, d, "cite")))
    return rows.select("paper_version", "bib_key", "title", "cite_count", (F.col("raw") == "").alias("empty"))


_CUSTOMERS = "select c_custkey as k, c_name as name, lower(c_mktsegment) as word from customer"


@query(f"""select 'q' || k as query, '2001.' || lpad(k::string, 5, '0') as arxiv_id, (k % 4 + 1)::bigint as version, 'On ' || name as title, 'all of ' || word as abstract, 'Ada ' || word || ';B N' as authors from {_d(_CUSTOMERS)}""")
def feed_entries(spark, d):
    n, k = F.lit("\n"), F.lpad("k", 5, "0")
    one = lambda v, title: F.concat(F.lit("<a:entry><a:id>http://arxiv.org/abs/2001."), k, F.lit("v"), v, F.lit("</a:id><a:title>"), title, F.lit("</a:title><summary>all of  "), "word", F.lit("</summary><author><name>Ada "), "word", F.lit("</name></author><author><name> B N</name></author></a:entry>"))
    xml = F.concat(F.lit('<feed xmlns:a="x">'), one(F.col("k") % 4 + 1, F.concat(F.lit("On"), n, "name")), one(F.lit("9"), F.lit("again")), F.lit("<entry><id>none</id></entry></feed>"))
    rows = landing.preprint_entries(t.derived(spark, d, _CUSTOMERS, "customer").select(F.concat(F.lit("q"), "k").alias("query"), xml.alias("xml")))
    return rows.select("query", "arxiv_id", "version", "title", "abstract", F.array_join("authors", ";").alias("authors"))


_TITLES = "select cast(p_partkey as string) as arxiv_id, case when p_partkey % 2 = 0 then 'Study of ' || p_name else p_type end as title, case when p_partkey % 2 = 0 then p_type else 'about ' || p_name end as abstract from part"


#: Queries: names, parts of two words, three words of a title with others, and five with one that is nowhere.
_ASKED = """select distinct case n when 0 then p_name when 1 then substr(p_name, 2, 3) || ' ' || lower(substr(p_type, 2, 4))
  when 2 then split_part(p_name, ' ', 2) || ' tudy ' || split_part(p_name, ' ', 1) || ' nowhere'
  else 'Study ' || p_name || ' stud ' || substr(split_part(p_name, ' ', 2), 1, 3) || ' ' || substr(p_name, 1, 3) || ' qqq' end as query
  from part join (select r_regionkey as n from region) on n < 4"""


@query(f"""
with p as (select *, lower(title || ' ' || abstract) as x, lower(title) as y from {_d(_TITLES)}),
a as (
  select query, list_filter(string_split_regex(lower(query), '[^a-z0-9.-]+'), lambda w: length(w) > 2 and not list_contains({T.STOP_WORDS!r}, w)) as w
  from {_d(_ASKED)}),
h as (
  select query, arxiv_id, title, case when contains(x, lower(query)) then 0 when list_bool_and(list_transform(w[1:8], lambda e: contains(x, e))) then 1
    when list_bool_and(list_transform(w[1:5], lambda e: contains(y, e))) then 2
    when len(w) > 3 and list_bool_and(list_transform(w[1:3], lambda e: contains(x, e))) then 3 end as tier
  from a, p where len(w) > 0),
b as (select query, min(tier) as tier from h group by 1),
n as (select h.*, row_number() over (partition by h.query order by h.arxiv_id, h.title) as n from h join b using (query, tier))
select query, tier::bigint as tier, arxiv_id from n where n <= 8""")
def found_by_title(spark, d):
    return landing.title_search(t.derived(spark, d, _TITLES, "part"), t.derived(spark, d, _ASKED, "part")).select("query", "tier", "arxiv_id")


@query(f"select 'own/' || k as repo, 'read ' || word || ' é' as readme, 3::bigint as n_files, 'a.py,b/' || word || '.md,c' as files from {_d(_CUSTOMERS)}")
def repository_content(spark, d):
    rows = t.derived(spark, d, _CUSTOMERS).withColumn("repo", F.concat(F.lit("own/"), "k"))
    text = F.concat(F.lit("read "), "word", F.lit(" é"))
    body = F.concat(F.lit('{"content":"'), F.regexp_replace(F.base64(F.encode(text, "utf-8")), "(.{6})", "$1\\\\n"), F.lit('"}'))
    tree = F.concat(F.lit('{"tree":[{"path":"a.py","type":"blob"},{"path":"b","type":"tree"},{"path":"b/'), "word", F.lit('.md","type":"blob"},{"path":"c","type":"blob"}]}'))
    readmes = landing.repo_readmes(rows.select("repo", body.alias("body")))
    files = landing.repo_trees(rows.select("repo", tree.alias("body"))).groupBy("repo").agg(F.count("*").alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda x: x["path"]), ",").alias("files"))
    return readmes.join(files, "repo").select("repo", "readme", "n_files", "files")


_ANSWERS = """select 's' || cast(s_suppkey as string) as id, '#MUNCH/1 tool=x' || chr(10) || '@1=pkg/' || s_name || chr(10) || 'total=' || cast(s_nationkey as string) || ' truncated=false __tables="s:symbols:id|sig;t:other:n"' || chr(10) || chr(10)
 || 's,@1::go,"def go(' || chr(10) || '  a, ""b"")"' || chr(10) || 't,' || cast(s_suppkey as string) || ',spare' || chr(10) || 'unknown,1' || chr(10) || 's,@2' as text from supplier"""


@query("""select 's' || s_suppkey as id, r.name, r.ordinal::bigint as ordinal, case r.p when 0 then 'pkg/' || s_name || '::go' when 1 then '@2' end as symbol, case r.p when 0 then 'def go(' || chr(10) || '  a, "b")' end as sig, case r.p when 2 then s_suppkey::string end as n, s_nationkey::bigint as total from supplier, (values ('symbols', 0, 0), ('symbols', 1, 1), ('other', 0, 2)) r(name, ordinal, p)""")
def compact_rows(spark, d):
    answers = q._kept(t.derived(spark, d, _ANSWERS))
    total = compact.scalars(answers).where("name = 'total'").select("id", F.col("number").alias("total"))
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    return compact.rows(answers).join(total, "id").select("id", "name", "ordinal", cell("id").alias("symbol"), cell("sig").alias("sig"), cell("n").alias("n"), "total")


# ── lookups ──────────────────────────────────────────────────────────────────


@query("""with a as (select p_partkey as k, 'P' || p_partkey || 'v1' as paper_version, r as ref from part, (values ('1.1'), ('A'), ('7')) x(r)) select paper_version, ref, ref = '1.1' or (ref = 'A' and k % 5 = 0) as found, case when ref = '1.1' then 'Model architecture' when ref = 'A' and k % 5 = 0 then 'Proofs' end as title,
case when not (ref = '1.1' or (ref = 'A' and k % 5 = 0)) then '*remarks,1,1.1,2,2.1' || case when k % 5 = 0 then ',A,A.1' else '' end end as available from a""")
def section_lookup(spark, d):
    s = q._kept(extract.sections(q._events(spark, d, "heading")))
    asked = q._papers(spark, d).select("paper_version", F.explode(F.array(*map(F.lit, ["1.1", "A", "7"]))).alias("ref"))
    return reads.lookup(s, asked, "section_path", ["title"])


@query(f"""with c as (select paper_version, slug, kind from {_d(t.COMPONENTS)}), a as (select paper_version, x as ref from c, (values ('c1'), ('nothing')) q(x)) select a.paper_version, a.ref, c.slug is not null as found, c.kind, case when c.slug is null then (select min(slug) from c b where b.paper_version = a.paper_version) end as available from a left join c on c.paper_version = a.paper_version and c.slug = a.ref""")
def component_lookup(spark, d):
    c = t.derived(spark, d, t.COMPONENTS)
    asked = c.select("paper_version", F.explode(F.array(F.lit("c1"), F.lit("nothing"))).alias("ref"))
    return reads.lookup(c, asked, "slug", ["kind"])


@query("""select 'P' || p_partkey || 'v1' as paper_version, 'values' as what, 'tau=' || p_size || 'e-4; dropout=0.' || lpad(p_size::string, 2, '0') || '; hidden size=' || p_size * 8 as listed from part union all select 'P' || p_partkey || 'v1', 'urls', 'https://github.com/lab' || p_partkey % 11 || '/tool' || p_partkey % 13 || '.git' from part""")
def values_and_urls(spark, d):
    e = q._kept(q._events(spark, d, "value", "url"))
    return reads.listed(extract.stated_values(e), "values", F.concat_ws("=", "symbol", "value_text")).unionByName(reads.listed(extract.declared_urls(e), "urls", F.col("url")))


# ── ingest ───────────────────────────────────────────────────────────────────

_TREE_FILES = f"""select 'P' || cast(p_partkey as string) as paper_version, f.path, case f.path
 when 'main.tex' then {_B} || 'documentclass{{x}}' || chr(10) || {_B} || 'newcommand{{' || {_B} || 'net}}{{Deep ' || p_name || '}}' || {_B} || 'def' || {_B} || 'two#1{{}}' || {_B} || 'newcommand{{' || {_B} || 'pair}}[2]{{<#2, {{#1}} of ' || {_B} || 'net>}}' || chr(10) || 'A ' || {_B} || 'input{{sec/a}} Z ' || {_B} || 'net{{}} ' || {_B} || 'network ' || {_B} || 'pair{{u}}{{v' || cast(p_size as string) || '}} % ' || {_B} || 'input{{gone}}' || chr(10) || {_B} || 'include{{ ./sec/b.tex }}!'
 when 'sec/a.tex' then '[a ' || {_B} || 'input{{sec/b}} a]% note' when 'sec/b.tex' then '(b' || cast(p_size as string) || {_B} || 'input{{main}}' || {_B} || 'input{{none}})' else 'never ' || {_B} || 'input{{sec/a}}' end as text
 from part join (select case n_nationkey when 0 then 'main.tex' when 1 then 'sec/a.tex' when 2 then 'sec/b.tex' else 'aside.tex' end as path from nation where n_nationkey < 4) f on true"""


@query(f"""select 'P' || p_partkey as paper_version, {_B} || 'documentclass{{x}}' || chr(10) || {_B} || 'def' || {_B} || 'two#1{{}}' || chr(10) || 'A [a (b' || p_size || ') a] Z Deep ' || p_name || ' ' || {_B} || 'network <v' || p_size || ', {{u}} of Deep ' || p_name || '> ' || chr(10) || '(b' || p_size || ')!' as tex from part""")
def flattened_sources(spark, d):
    return flatten.flattened(t.derived(spark, d, _TREE_FILES, "part"))


_RECORDS = "select c_custkey as k, c_name as name, c_nationkey as n, lower(c_mktsegment) as word from customer"


def _bodies(spark, d):
    """A registered work for each customer: every seventh without references, one reference without a DOI, one key twice."""
    refs = F.when(F.col("k") % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"key":"a","DOI":"10.2/A'), "k", F.lit('","article-title":"On '), "word", F.lit('","year":"1999"},{"unstructured":"Loose words","year":"about"},{"key":"c","article-title":"old"},{"key":"c","DOI":"10.2/c","article-title":"new","year":"2001a"}]')))
    body = F.concat(F.lit('{"message":{"title":["'), "name", F.lit('"],"author":[{"given":"Ada","family":"'), "word", F.lit('"}],"issued":{"date-parts":[['), F.col("n") + 2000, F.lit(',3]]},"reference":'), refs, F.lit("}}"))
    works = landing.work_records(t.derived(spark, d, _RECORDS).select(F.concat(F.lit("10.1/W"), "k").alias("doi"), body.alias("body")))
    return works, landing.work_references(works)


_REGISTERED = f"""select k, r.key, case r.key when 'a' then 'On ' || word else r.title end as title, r.year::bigint as year, case r.key when 'a' then '10.2/a' || k else r.doi end as doi from {_d(_RECORDS)}, (values ('a', null, 1999, null), ('ref1', 'Loose words', null, null), ('c', 'new', 2001, '10.2/c')) r(key, title, year, doi) where k % 7 > 0"""


@query(f"""select p.paper_version, p.title, p.published_at, 'UNAVAILABLE' as fidelity, r.key as bib_key, r.title as cited, r.year, r.doi, r.doi is not null as edge from (select k, '10.1/w' || k || 'v1' as paper_version, name as title, (2000 + n) || '-3' as published_at from {_d(_RECORDS)}) p left join ({_REGISTERED}) r using (k)""")
def metadata_only_papers(spark, d):
    got = ingest.metadata_only(*_bodies(spark, d))
    edges = got["lineage_edges"].select(F.concat("from_paper", F.lit("v1")).alias("paper_version"), F.col("to_paper").alias("doi"), F.lit(True).alias("edge"))
    entries = got["bib_entries"].select("paper_version", "bib_key", F.col("title").alias("cited"), "year", "doi").join(edges, ["paper_version", "doi"], "left")
    papers = got["papers"].select(F.col("latest_version").alias("paper_version"), "title", "published_at").join(got["paper_versions"].select("paper_version", "fidelity"), "paper_version")
    return papers.join(entries, "paper_version", "left").select("paper_version", "title", "published_at", "fidelity", "bib_key", "cited", "year", "doi", F.coalesce("edge", F.lit(False)).alias("edge"))


@query(f"""with r as ({_REGISTERED}) select 'V' || k as paper_version, key as bib_key, title, year, doi, case when doi is not null then 'V' || k || '->' || doi || ':CITES' end as edge from r where k % 3 > 0""")
def enriched_references(spark, d):
    _, references = _bodies(spark, d)
    versions = t.derived(spark, d, "select 'V' || cast(c_custkey as string) as paper_version, 'V' || cast(c_custkey as string) as paper, '10.1/w' || cast(c_custkey as string) as doi, c_custkey as k from customer")
    got = ingest.enriched(versions, versions.where("k % 3 = 0").select("paper_version"), references)
    edges = got["lineage_edges"].select(F.col("from_paper").alias("paper_version"), F.col("to_paper").alias("doi"), F.col("id").alias("edge"))
    return got["bib_entries"].select("paper_version", "bib_key", "title", "year", "doi").join(edges, ["paper_version", "doi"], "left")


@query(f"""select 'q' || n as query, i::bigint as place, '10.3/' || lower(x) || i as doi, case when i = 1 then '(untitled)' else 'T' || i || ' ' || x end as title, case when i % 2 = 0 then 'Venue' end as venue, case when i = 2 then null else (1990 + i)::bigint end as year, case when i = 3 then 'A0 B;A1 B;A2 B;A3 B;A4 B;A5 B' else 'Solo' end as authors from (select n_nationkey as n, n_name as x from nation), range(8) r(i)""")
def found_works(spark, d):
    def item(i):
        people = ",".join(f'{{"given":"A{j}","family":"B"}}' for j in range(7)) if i == 3 else '{"family":"Solo"}'
        title, venue, year = ("" if i == 1 else f'"title":["T{i} #"],'), ('"container-title":["Venue"],' if i % 2 == 0 else ""), ("" if i == 2 else f'"issued":{{"date-parts":[[{1990 + i}]]}},')
        return f'{{"DOI":"10.3/#{i}",{title}{venue}{year}"author":[{people}]}}'

    body = '{"message":{"items":[' + ",".join(map(item, range(10))) + "]}}"
    rows = t.derived(spark, d, "select n_nationkey as n, n_name as x from nation").select(F.concat(F.lit("q"), "n").alias("query"), F.replace(F.lit(body), F.lit("#"), F.col("x")).alias("body"))
    return landing.work_search(rows).select("query", "place", "doi", "title", "venue", "year", F.array_join("authors", ";").alias("authors"))


_SHELF = "select '2001.' || lpad(cast(p_partkey as string), 5, '0') as arxiv_id, 'Study of ' || p_name || ' zz' || cast(p_partkey as string) || 'z' as title, 'about ' || p_type as abstract, cast(null as string) as doi, '2001.' || lpad(cast(p_partkey as string), 5, '0') || 'v1' as latest_version, p_partkey as k from part"
_WANTED = "select case p_partkey % 4 when 0 then '2001.' || lpad(cast(p_partkey as string), 5, '0') when 1 then 'zz' || cast(p_partkey as string) || 'z' when 2 then '2009.' || lpad(cast(p_partkey as string), 5, '0') else 'qq' || cast(p_partkey as string) end as text from part"


@query(f"""with a as (select p_partkey as k, text from part, lateral (select case p_partkey % 4 when 0 then '2001.' || lpad(p_partkey::string, 5, '0') when 1 then 'zz' || p_partkey || 'z' when 2 then '2009.' || lpad(p_partkey::string, 5, '0') else 'qq' || p_partkey end as text) x)
select text, case k % 4 when 0 then 'CONFIRMED' when 1 then 'POSSIBLE' else 'UNKNOWN' end as confidence, case when k % 4 < 2 then '2001.' || lpad(k::string, 5, '0') end as arxiv_id, case when k % 4 < 2 then '2001.' || lpad(k::string, 5, '0') || 'v1' end as paper_version from a""")
def resolved_candidates(spark, d):
    return reads.candidates(t.derived(spark, d, _WANTED), t.derived(spark, d, _SHELF))
