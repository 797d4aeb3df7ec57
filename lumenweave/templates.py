"""Inputs derived from the fixture tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings"]

_BS, _NL = "chr(92)", "chr(10)"


def _lines(*lines: str) -> str:
    return f" || {_NL} || ".join(f"({x})" for x in lines)


_K = "cast(p_partkey as string)"

#: Papers: abstract, sections, values, displays, citations; every fifth has an appendix.
PAPERS = f"""select p_partkey as k, 'P' || {_K} || 'v1' as paper_version, {_lines(
    f"{_BS} || 'begin{{abstract}}'",
    "'A study of ' || p_name || '. Code at https://github.com/lab' || cast(p_partkey % 11 as string) || '/tool' || cast(p_partkey % 13 as string) || '.git here.'",
    f"{_BS} || 'end{{abstract}}'",
    f"{_BS} || 'section{{Introduction to ' || p_name || '}}'",
    f"'We extend earlier work ' || {_BS} || 'cite{{k' || cast(p_partkey % 7 as string) || ', k' || cast(p_partkey % 5 as string) || '}}. See also ' || {_BS} || 'citep{{z' || cast(p_partkey % 3 as string) || '}}.'",
    "''",
    "'Settings: dropout of 0.' || lpad(cast(p_size as string), 2, '0') || ', tau = ' || cast(p_size as string) || 'e-4, hidden size of ' || cast(p_size * 8 as string) || '.'",
    "''",
    f"{_BS} || 'subsection{{Model architecture}}' || {_BS} || 'label{{sec:m}}'",
    f"{_BS} || 'begin{{equation}} y = a_{{' || cast(p_partkey % 9 as string) || '}} x ' || {_BS} || 'end{{equation}}'",
    f"{_BS} || 'begin{{align}} a = b ' || {_BS} || {_BS} || ' c = d ' || {_BS} || 'nonumber ' || {_BS} || {_BS} || ' e = f ' || {_BS} || 'end{{align}}'",
    f"{_BS} || 'subsection*{{Remarks}}'",
    "'We found it necessary to use weight decay here. ' || case when p_partkey % 2 = 0 then 'With warmup too.' else 'Plain.' end",
    f"{_BS} || 'section{{Training}}'",
    f"{_BS} || 'subsection{{Loss}}'",
    f"{_BS} || '[ z < ' || cast(p_partkey % 4 as string) || ' ' || {_BS} || ']'",
    f"case when p_partkey % 5 = 0 then {_BS} || 'appendix' || {_NL} || {_BS} || 'section{{Proofs}}' || {_NL} || {_BS} || 'subsection{{Details}}' else 'No appendix.' end",
    f"{_BS} || 'begin{{algorithm}}'",
    f"{_BS} || 'caption{{Step ' || p_brand || '}}'",
    f"{_BS} || 'end{{algorithm}}'",
)} as tex from part"""

#: Lines of code by repository and file.
CODE_LINES = """select 'r' || cast(l_suppkey % 10 as string) as repo, 'src/m' || cast(l_linenumber as string) || '.py' as path,
  cast(row_number() over (partition by l_suppkey % 10, l_linenumber order by l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) as line,
  case when l_orderkey % 997 = 0 then 'tau = ' || cast(l_orderkey % 50 as string) || 'e-4' when l_partkey % 4 = 0 then 'x = 0.' || lpad(cast(cast(l_quantity as int) as string), 2, '0')
    when l_partkey % 4 = 1 then 'def fn_' || cast(l_partkey % 50 as string) || '(a):' when l_partkey % 4 = 2 then 'rate = 1.' || lpad(cast(l_partkey as string), 5, '0')
    else 'y = fn_' || cast(l_suppkey % 50 as string) || '(x) # ' || case when l_suppkey % 10 < 4 then 'weight_decay' else 'none' end end as text
  from lineitem"""

#: Symbols of that code.
SYMBOLS = """select 'r' || cast(p_partkey % 10 as string) as repo, 'src/m' || cast(1 + p_partkey % 7 as string) || '.py' as file_path, cast(p_partkey as int) as ordinal,
  'src/m' || cast(1 + p_partkey % 7 as string) || '.py::fn_' || cast(p_partkey as string) || '#' || case p_partkey % 3 when 0 then 'function' when 1 then 'method' else 'class' end as qualified_name,
  case p_partkey % 4 when 0 then 'encode_' || replace(p_name, ' ', '_') when 1 then 'Loss' || cast(p_size as string) else 'fn_' || cast(p_partkey as string) end as name,
  case p_partkey % 3 when 0 then 'function' when 1 then 'method' else 'class' end as kind, cast(p_size * 20 as int) as line_start, cast(p_size * 20 + 60 as int) as line_end
  from part"""

#: Which repository each paper is held against.
PAIRS = "select 'P' || cast(p_partkey as string) || 'v1' as paper_version, 'r' || cast(p_partkey % 10 as string) as repo from part"

#: Written-back components of papers.
COMPONENTS = """select 'P' || cast(p_partkey as string) || 'v1' as paper_version, 'P' || cast(p_partkey as string) || 'v1:comp:' || cast(p_size as string) as id,
  case p_partkey % 4 when 0 then p_name || ' Encoder' when 1 then 'Overall Module' when 2 then 'Quantum ' || p_brand else 'Loss' || cast(p_size as string) || ' Term' end as name, 'c' || cast(p_size as string) as slug,
  case p_partkey % 5 when 0 then 'loss' when 1 then 'architecture' when 2 then 'dataset' when 3 then 'optimizer' else 'evaluation' end as kind, cast(null as string) as description, cast(null as string) as section_id,
  case when p_partkey % 6 = 0 then 'DETERMINISTIC' else 'AGENT' end as source from part"""

#: Events as evidence signals.
SIGNALS = """select 'user' as subject_kind, cast(user_id as string) as subject_id, event_id as ord,
  case when event_type = 'purchase' and value > 150 then 'DECISIVE' when event_type = 'signup' and value > 120 then 'STRONG' when event_type = 'view' and value > 60 then 'WEAK' else 'NONE' end as weight,
  event_type || cast(event_id as string) as detail, event_type = 'error' or value < 1 as contradicted from events"""

#: Versions of papers: orders of a customer.
VERSIONS = """select 'C' || cast(o_custkey as string) as arxiv_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as version,
  'C' || cast(o_custkey as string) || 'v' || cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as string) as paper_version,
  case when o_orderkey % 4 = 0 then '2' else '3' end as parser_version, case when o_orderkey % 3 = 0 then 'NONE' else 'LATEX' end as source_kind from orders"""

#: Bibliographies and citation sites: parts cited by orders.
ENTRIES = """select distinct 'O' || cast(l_orderkey % 500 as string) as paper_version, 'k' || cast(l_partkey % 97 as string) as bib_key, 'T' || cast(l_partkey % 97 as string) as title, cast(1990 + l_partkey % 97 % 30 as int) as year,
  case when l_partkey % 97 % 2 = 0 then '2001.' || lpad(cast(l_partkey % 97 as string), 5, '0') end as arxiv_id, case when l_partkey % 97 % 5 = 0 then '10.1000/' || cast(l_partkey % 97 as string) end as doi from lineitem"""
SITES = """select 'O' || cast(l_orderkey % 500 as string) as paper_version, 'k' || cast(l_suppkey * 7 % 101 as string) as bib_key, 'says ' || cast(l_partkey as string) || ' of ' || l_returnflag || ' and ' || cast(l_orderkey as string) as context,
  cast(l_linenumber as int) as src_line, cast(row_number() over (partition by l_orderkey % 500 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as ordinal from lineitem"""

#: Requests to sources and a cache's puts and gets.
REQUESTS = "select event_type as source, cast(ts as timestamp) as ts, event_id as seq from events"
PUTS = "select 'u' || cast(user_id % 40 as string) as key, cast(ts as timestamp) as ts, case when event_id % 3 = 0 then cast(null as timestamp) else cast(ts as timestamp) + interval '90' minute end as expires_at, 'b' || cast(event_id as string) as body from events where event_type in ('purchase', 'signup')"
GETS = "select 'u' || cast(user_id % 40 as string) as key, cast(ts as timestamp) as ts, event_id as seq from events where event_type in ('view', 'click')"

#: Candidates for implementing papers: customers' papers, suppliers' repositories.
CANDIDATES = """select 'C' || cast(c_custkey as string) || 'v1' as paper_version, 'own' || cast(s_suppkey as string) || '/' || case s_suppkey % 4 when 0 then 'Net' || cast(c_custkey % 5 as string) when 1 then 'awesome-list' else 'tool' || cast(s_suppkey as string) end as repo,
  '2001.' || lpad(cast(c_custkey as string), 5, '0') as arxiv_id, 'Net' || cast(c_custkey % 5 as string) || ': Deep ' || lower(c_mktsegment) || ' Segmentation' as title, array_of_author as authors,
  c_custkey % 3 = 0 and s_suppkey % 2 = 0 as declared, c_custkey % 2 = 0 as in_abstract, 'own' || cast(s_suppkey as string) as owner, case when s_suppkey % 5 = 0 then 'Ada Lovelace' else 'someone' end as owner_name,
  case s_suppkey % 4 when 0 then 'Net' || cast(c_custkey % 5 as string) when 1 then 'awesome-list' else 'tool' || cast(s_suppkey as string) end as repo_name,
  case s_suppkey % 3 when 0 then 'see arXiv:2001.' || lpad(cast(c_custkey as string), 5, '0') when 1 then 'An unofficial port of things' else 'nothing' end as readme,
  case when s_suppkey % 7 = 0 then 'Point cloud registration' when s_suppkey % 7 = 1 then 'Deep ' || lower(c_mktsegment) || ' tool' end as description, s_suppkey % 6 = 0 as archived, cast(s_suppkey * 3 as bigint) as stars, cast(s_suppkey as int) as seed
  from customer join supplier on c_nationkey = s_nationkey and s_suppkey % 8 = c_custkey % 8"""

#: Papers and repositories of those candidates apart. They meet by nation, class and form: the method and segment that a repository is named and described by.
CANDIDATE_PAPERS = """select 'C' || cast(c_custkey as string) || 'v1' as paper_version, 'Net' || cast(c_custkey % 5 as string) || ': Deep ' || lower(c_mktsegment) || ' Segmentation' as title,
  c_nationkey as nation, c_custkey % 8 as class, concat_ws('/', cast(c_custkey % 5 as string), c_mktsegment) as form from customer"""
CANDIDATE_REPOS = """select 'own' || cast(s_suppkey as string) || '/' || case s_suppkey % 4 when 0 then 'Net' || cast(method as string) when 1 then 'awesome-list' else 'tool' || cast(s_suppkey as string) end as repo,
  case when s_suppkey % 7 = 0 then 'Point cloud registration' when s_suppkey % 7 = 1 then 'Deep ' || lower(segment) || ' tool' end as description, nation, class, form
  from supplier join (select /*+ repartition(64) */ distinct c_nationkey as nation, c_custkey % 8 as class, c_custkey % 5 as method, c_mktsegment as segment, concat_ws('/', cast(c_custkey % 5 as string), c_mktsegment) as form from customer)
    on nation = s_nationkey and s_suppkey % 8 = class"""

#: Files of those repositories.
TREES = """select 'own' || cast(s_suppkey as string) as owner, cast(n as int) as ordinal, case n % 5 when 0 then 'src/train_' when 1 then 'docs/loss_' when 2 then 'model' when 3 then 'data/dataset_' else 'README' end || cast(n as string) || case when n % 5 = 4 then '.md' else '.py' end as path
  from supplier join (select n_nationkey as n from nation) on n < 3 + s_suppkey % 20 where s_suppkey % 9 <> 0"""


#: Rows of a table, at most, in a task that makes long texts or many rows of each.
ROWS_EACH = 5_000


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def parts(df: DataFrame) -> int:
    return max(1, -(-df.count() // ROWS_EACH))


def spread(df: DataFrame) -> DataFrame:
    """The rows of small files over all cores, in tasks of bounded size: a file of a few MB is one task, whatever its rows grow to."""
    n = parts(df)
    return df.repartition(n) if n > 1 else df


def derived(spark: SparkSession, sf_dir: str, template: str, grows: str | None = None) -> DataFrame:
    """A template over the tables of a folder; grows: the table whose rows it makes long texts or many rows of."""
    import re

    tables(spark, sf_dir, *(t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b|\(select [a-z_]+ as [a-z] from {t}\)", template)))
    if grows:
        spread(spark.table(grows)).createOrReplaceTempView(grows)
    return spark.sql(template.replace("array_of_author", "array('Ada Lovelace', 'B. Noether')"))


def for_duckdb(template: str) -> str:
    return "(" + template.replace("array_of_author", "['Ada Lovelace', 'B. Noether']") + ")"
