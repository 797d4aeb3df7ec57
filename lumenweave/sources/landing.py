"""Landed responses and files as DataFrames. Fetching is no part of this library: readers start from what was landed."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grams


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's; a temporary one only where none is set and one machine does all the work."""
    context = spark.sparkContext
    got = context._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="shared-")
    context.setCheckpointDir(uri)
    return uri


def small_tasks(spark: SparkSession) -> None:
    """Tasks behind a shuffle read 2 MB, where there are as many partitions: built texts shrink to a thirtieth on the way, so the usual 64 MB are GBs in memory."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, for plans that read it more than once."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def preprint_entries(feeds: DataFrame) -> DataFrame:
    """feeds (query, xml: an Atom feed) to entries (query, arxiv_id, version, title, abstract, authors, published_at), one for each id."""
    clean = F.regexp_replace("xml", r"<(/?)(?:[a-z]+:)?([A-Za-z]+)(?:\s[^>]*?)?(/?)>", "<$1$2$3>")
    cut = feeds.select("query", F.posexplode(F.regexp_extract_all(clean, F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))).alias("place", "x"))
    id_, version = T.arxiv_parts(F.trim(F.expr("xpath_string(x, 'entry/id')")))
    text = lambda path: F.trim(F.regexp_replace(F.expr(f"xpath_string(x, '{path}')"), r"\s+", " "))
    rows = cut.select("query", "place", id_.alias("arxiv_id"), F.coalesce(version, F.lit(1)).alias("version"), text("entry/title").alias("title"), text("entry/summary").alias("abstract"), F.transform(F.expr("xpath(x, 'entry/author/name/text()')"), lambda x: F.trim(x)).alias("authors"), text("entry/published").alias("published_at"))
    rest = ["version", "title", "abstract", "authors", "published_at"]
    return rows.where("arxiv_id is not null").groupBy("query", "arxiv_id").agg(F.min_by(F.struct(*rest), "place").alias("x")).select("query", "arxiv_id", "x.*")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9.-]+"), lambda t: t != ""))


def _text_key() -> Column:
    # texts of one hash are checked each for itself
    return F.xxhash64("title", "abstract").alias("key")


def title_index(papers: DataFrame) -> tuple[DataFrame, grams.Index]:
    """The words of the distinct texts of papers (title, abstract) as (key: a hash of the text, name), and the letter index of those words."""
    texts = papers.select("title", "abstract").distinct()
    words = texts.select(_text_key(), F.explode(_words(F.concat_ws(" ", "title", "abstract"))).alias("name"))
    return words, grams.index(words, [], "name", 3)


def title_search(papers: DataFrame, queries: DataFrame, limit: int = 8, index: tuple[DataFrame, grams.Index] | None = None) -> DataFrame:
    """queries (query) over papers (arxiv_id, title, abstract): matches of the tightest form of each query that has any.

    Forms: the phrase; all terms anywhere (the first 8); all in the title (5); and of over three, the first 3 anywhere.
    Terms may be parts of words. All forms hold the first three terms, and a term lies in one word, so the longest of the
    three finds words through the letter index (made here if none is given), words find texts, and those are checked. A
    text that papers share is checked once, and stands for the first of its papers, as many as the limit.
    """
    words, letters = index or title_index(papers)
    q = queries.select("query", F.filter(F.split("query", r"[^A-Za-z0-9.\-]+"), lambda t: (F.length(t) > 2) & ~F.lower(t).isin(T.STOP_WORDS)).alias("terms")).where("size(terms) > 0").distinct()
    longest = F.array_max(F.transform(F.slice("terms", 1, 3), lambda t: F.struct(F.length(t).alias("n"), F.lower(t).alias("term"))))
    q = q.withColumn("term", longest["term"])
    near = q.join(grams.holding(letters, q), "term").join(grams.dealt(words), "name").select("query", "terms", "key").distinct()
    whole, title = F.lower(F.concat_ws(" ", "title", "abstract")), F.lower("title")
    every = lambda n, where: F.forall(F.slice("terms", 1, n), lambda t: F.contains(where, F.lower(t)))
    tier = F.when(F.contains(whole, F.lower("query")), 0).when(every(8, whole), 1).when(every(5, title), 2).when((F.size("terms") > 3) & every(3, whole), 3)
    place = F.row_number().over(Window.partitionBy("title", "abstract").orderBy("arxiv_id"))
    first = papers.select("arxiv_id", "title", "abstract").where("arxiv_id is not null").distinct().withColumn("n", place).where(F.col("n") <= limit)
    texts = first.groupBy("title", "abstract").agg(F.collect_list("arxiv_id").alias("ids")).select(_text_key(), "title", "abstract", "ids")
    rows = near.join(grams.dealt(texts), "key").withColumn("tier", tier).where("tier is not null").select("query", "tier", "title", "ids")
    best = rows.groupBy("query").agg(F.min("tier").alias("tier"))
    top = rows.join(best, ["query", "tier"]).select("query", "tier", "title", F.explode("ids").alias("arxiv_id"))
    top = top.groupBy("query", "tier").agg(F.slice(F.sort_array(F.collect_set(F.struct("arxiv_id", "title"))), 1, limit).alias("x"))
    return top.select("query", "tier", F.inline("x"))


def _json(raw: str | Column, schema: str) -> Column:
    return F.from_json(raw, schema)


def work_records(bodies: DataFrame) -> DataFrame:
    """bodies (doi, body: JSON of a registered work) to title, authors, venue, year, published, abstract without tags, references."""
    name = "given:string,family:string,name:string"
    schema = f"message struct<DOI:string,title:array<string>,author:array<struct<{name}>>,`container-title`:array<string>,issued:struct<`date-parts`:array<array<int>>>,abstract:string,reference:array<struct<key:string,DOI:string,`article-title`:string,unstructured:string,year:string,author:string>>>"
    m = bodies.select("doi", _json("body", schema).getField("message").alias("m")).where("m is not null")
    parts = F.try_element_at("m.issued.date-parts", F.lit(1))
    date = F.array_join(F.transform(parts, lambda p: p.cast("string")), "-")
    return m.select(
        "doi", F.try_element_at("m.title", F.lit(1)).alias("title"),
        F.transform("m.author", lambda a: F.coalesce(a["name"], F.trim(F.concat_ws(" ", a["given"], a["family"])))).alias("authors"),
        F.try_element_at("m.container-title", F.lit(1)).alias("venue"), F.try_element_at(parts, F.lit(1)).alias("year"), date.alias("published_at"),
        F.trim(F.regexp_replace(F.regexp_replace("m.abstract", "<[^>]+>", " "), r"\s+", " ")).alias("abstract"), F.col("m.reference").alias("references"),
    )


def work_search(bodies: DataFrame, limit: int = 8) -> DataFrame:
    """bodies (query, body: JSON of a list of registered works) to the first works of each query: (query, place, doi, title, venue, year, authors, six at most)."""
    name = "given:string,family:string"
    schema = f"message struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<{name}>>,`container-title`:array<string>,issued:struct<`date-parts`:array<array<int>>>>>>"
    rows = bodies.select("query", F.posexplode(F.slice(_json("body", schema).getField("message").getField("items"), 1, limit)).alias("place", "m"))
    return rows.select(
        "query", "place", F.lower("m.DOI").alias("doi"), F.coalesce(F.try_element_at("m.title", F.lit(1)), F.lit("(untitled)")).alias("title"), F.try_element_at("m.container-title", F.lit(1)).alias("venue"),
        F.try_element_at(F.try_element_at("m.issued.date-parts", F.lit(1)), F.lit(1)).alias("year"), F.slice(F.transform("m.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), 1, 6).alias("authors"),
    )


def work_references(works: DataFrame) -> DataFrame:
    """References of work_records, one row each: (doi, ordinal, key, ref_doi, title, year)."""
    cut = works.select("doi", F.posexplode("references").alias("ordinal", "r"))
    return cut.select("doi", "ordinal", F.coalesce("r.key", F.concat(F.lit("ref"), "ordinal")).alias("key"), F.lower("r.DOI").alias("ref_doi"), F.coalesce("r.article-title", "r.unstructured").alias("title"), F.regexp_extract(F.coalesce("r.year", F.lit("")), r"\d{4}", 0).try_cast("int").alias("year"))


def citing_papers(bodies: DataFrame) -> DataFrame:
    """bodies (arxiv_id, body: JSON of a citation list) to (cited, paper_id, arxiv_id, title, year, citation_count, is_influential, intents, contexts)."""
    schema = "data array<struct<contexts:array<string>,intents:array<string>,isInfluential:boolean,citingPaper:struct<paperId:string,title:string,year:int,citationCount:bigint,externalIds:struct<ArXiv:string>>>>"
    rows = bodies.select(F.col("arxiv_id").alias("cited"), F.explode(_json("body", schema).getField("data")).alias("x"))
    p = "x.citingPaper"
    return rows.select("cited", F.col(f"{p}.paperId").alias("paper_id"), F.col(f"{p}.externalIds.ArXiv").alias("arxiv_id"), F.col(f"{p}.title").alias("title"), F.col(f"{p}.year").alias("year"), F.col(f"{p}.citationCount").alias("citation_count"), F.col("x.isInfluential").alias("is_influential"), F.col("x.intents").alias("intents"), F.col("x.contexts").alias("contexts"))


def citing_works(bodies: DataFrame) -> DataFrame:
    """bodies (arxiv_id, body: JSON of a works list) to citing works with the preprint id of the first location that has one, else of the DOI."""
    schema = "results array<struct<title:string,publication_year:int,cited_by_count:bigint,doi:string,locations:array<struct<landing_page_url:string>>>>"
    rows = bodies.select(F.col("arxiv_id").alias("cited"), F.posexplode(_json("body", schema).getField("results")).alias("place", "x"))
    found = lambda u: T.arxiv_parts(F.coalesce(u, F.lit("")))[0]
    by_place = F.try_element_at(F.filter(F.transform("x.locations", lambda u: found(u["landing_page_url"])), lambda i: i.isNotNull()), F.lit(1))
    return rows.select("cited", "place", F.col("x.title").alias("title"), F.col("x.publication_year").alias("year"), F.col("x.cited_by_count").alias("cited_by_count"), F.coalesce(by_place, found(F.col("x.doi"))).alias("arxiv_id"))


def repo_records(bodies: DataFrame) -> DataFrame:
    """bodies (repo, status, body: JSON of a repository) to (repo, owner, name, description, stars, archived, license, owner_type); denied or missing ones are left out."""
    schema = "full_name string, name string, owner struct<login:string,type:string>, description string, stargazers_count bigint, archived boolean, license struct<spdx_id:string>, default_branch string"
    rows = bodies.where("status = 200").select("repo", _json("body", schema).alias("x")).where("x is not null")
    return rows.select("repo", F.col("x.owner.login").alias("owner"), F.col("x.name").alias("name"), F.col("x.description").alias("description"), F.col("x.stargazers_count").alias("stars"), F.col("x.archived").alias("archived"), F.col("x.license.spdx_id").alias("license"), F.col("x.owner.type").alias("owner_type"), F.col("x.default_branch").alias("default_branch"))


def repo_readmes(bodies: DataFrame) -> DataFrame:
    """bodies (repo, body: JSON with base64 content) to (repo, readme)."""
    return bodies.select("repo", F.decode(F.unbase64(F.regexp_replace(_json("body", "content string").getField("content"), r"\s", "")), "utf-8").alias("readme"))


def repo_trees(bodies: DataFrame) -> DataFrame:
    """bodies (repo, body: JSON of a tree) to files (repo, ordinal, path)."""
    rows = bodies.select("repo", F.posexplode(_json("body", "tree array<struct<path:string,type:string>>").getField("tree")).alias("ordinal", "x"))
    return rows.where("x.type = 'blob'").select("repo", "ordinal", F.col("x.path").alias("path"))


# Directories that a working tree's scan leaves out, and the largest file in bytes.
SKIPPED = [".git", "node_modules", "__pycache__", ".venv", "venv", "build", "dist", ".eggs", ".tox", ".mypy_cache", "site-packages"]
MOST_BYTES = 2_000_000


def code_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """Files under a folder as (repo, path, text), without those in directories left out and those too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "^/+", "")
    rows = files.where(F.col("length") <= MOST_BYTES).select(F.lit(repo).alias("repo"), relative.alias("path"), F.expr("try_validate_utf8(cast(content as string))").alias("strict"), F.col("content").cast("string").alias("loose"))
    kept = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    return kept.select("repo", "path", F.coalesce("strict", F.expr("make_valid_utf8(loose)")).alias("text"))


# Dependency manifests, in order of preference.
MANIFESTS = ["requirements.txt", "requirements-training.txt", "pyproject.toml", "setup.py", "environment.yml", "environment.yaml", "Pipfile"]


def manifest_dependencies(code_files: DataFrame, limit: int = 40) -> DataFrame:
    """Dependencies declared at the top of a repository: (repo, file, ordinal, dependency, pinned)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(#|-|name:)"))
    quoted = F.regexp_extract_all("text", F.lit(r"[\"']([A-Za-z0-9_.\-]+(?:[<>=!~]=?[^\"',]+)?)[\"']"), F.lit(1))
    found = F.when(F.col("path").rlike(r"\.(txt|ya?ml)$"), lines).otherwise(quoted)
    rows = code_files.where(F.col("path").isin(MANIFESTS)).select("repo", F.col("path").alias("file"), F.posexplode(F.slice(found, 1, limit)).alias("ordinal", "dependency"))
    return rows.withColumn("pinned", F.col("dependency").rlike("[<>=~]"))


def stated_environment(code_files: DataFrame) -> DataFrame:
    """Versions of Python and CUDA that a repository states: (repo, python, cuda)."""
    by = F.when(F.col("path") == "setup.py", 0).when(F.col("path") == "pyproject.toml", 1).when(F.col("path") == ".python-version", 2)
    python = F.regexp_extract("text", r"(?i)(?:python_requires|requires-python)\s*=\s*[\"']([^\"']+)", 1)
    cuda = F.nullif(F.regexp_extract("text", r"(?:CUDA|cuda)[\s=]*([0-9]+\.[0-9]+)", 1), F.lit(""))
    return code_files.groupBy("repo").agg(
        F.min_by(F.when(by.isNotNull() & (python != ""), F.trim(python)), F.when(by.isNotNull() & (python != ""), by)).alias("python"),
        F.max(F.when(F.col("path") == "README.md", cuda)).alias("cuda"),
    )
