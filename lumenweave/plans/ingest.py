"""Ingest: only what has changed goes through all tables, and counts at once; papers without a readable text by their registered record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import codeindex, correlate, extract, scan
from ..sources.landing import kept
from ..streaming.state import PARSER_VERSION
from .publish import Published

#: Tables of papers, of repositories and of pairs, with the columns of their keys.
PAPER_TABLES = ["papers_text", "sections", "equations", "algorithms", "stated_values", "declared_urls", "citation_sites", "components", "bib_entries", "errors"]
REPO_TABLES = ["code_files", "symbols", "index_errors"]
PAIR_TABLES = ["mappings", "differences"]
KEYS = {t: ["paper_version"] for t in PAPER_TABLES} | {t: ["repo"] for t in REPO_TABLES} | {t: ["paper_version", "repo"] for t in PAIR_TABLES}


def graph(spark, root: str) -> Published:
    return Published(spark, root, KEYS)


def _changed(wanted: DataFrame, valid: DataFrame, run: str) -> DataFrame:
    """Of wanted (key, stamp) the entries (key, stamp, run) that the list doesn't have with that stamp; written once."""
    same = wanted.join(valid.select("key", "stamp"), ["key", "stamp"], "left_anti")
    return kept(same.select("key", "stamp", F.lit(run).alias("run")))


def _papers(g: Published, run: str, sources: DataFrame, bibliographies: DataFrame | None, work: DataFrame, readers: dict) -> None:
    own = kept(sources.join(work.select(F.col("key").alias("paper_version")), "paper_version", "left_semi"))
    events = kept(scan.events(own.select("paper_version", "tex"), readers=readers))
    entries = None
    if bibliographies is not None:
        entries = scan.bibliography(bibliographies.join(own.select("paper_version"), "paper_version", "left_semi"))
    tables = extract.ingest(events, entries)
    tables |= {"components": extract.components(tables["sections"]), "errors": extract.errors(events)}
    tables["papers_text"] = own.select("paper_version", "tex", F.when(F.col("tex").isNull(), "NONE").otherwise("LATEX").alias("source_kind"), F.when(F.col("tex").isNull(), "UNAVAILABLE").otherwise("LATEX_EXACT").alias("fidelity"))
    for name in PAPER_TABLES:
        if name in tables:
            g.write(run, name, tables[name])


def _repos(g: Published, run: str, files: DataFrame, work: DataFrame) -> None:
    own = kept(files.join(work.select(F.col("key").alias("repo")), "repo", "left_semi").select("repo", "path", "text"))
    symbols = kept(codeindex.python_symbols(own))
    g.write(run, "code_files", own)
    g.write(run, "symbols", symbols.where("qualified_name is not null"))
    g.write(run, "index_errors", symbols.where("warning is not null").select("repo", F.col("file_path").alias("path"), F.lit("symbols").alias("step"), F.lit("SyntaxError").alias("error"), F.col("warning").alias("message")))


def _pairs(g: Published, run: str, pairs: DataFrame, work: DataFrame, plan: DataFrame) -> None:
    """Mappings and differences of the pairs to be done, from the tables as they will be."""
    own = kept(pairs.join(work.select("key"), F.concat_ws("|", "paper_version", "repo") == F.col("key"), "left_semi").select("paper_version", "repo"))
    of_papers = lambda name: g.read(name, plan).join(own.select("paper_version").distinct(), "paper_version", "left_semi")
    of_repos = lambda name: g.read(name, plan).join(own.select("repo").distinct(), "repo", "left_semi")
    tables = {name: of_papers(name) for name in ("stated_values", "components", "algorithms")}
    lines = kept(codeindex.lines(of_repos("code_files")))
    mapped = kept(correlate.map_papers(tables, own, of_repos("symbols"), lines))
    g.write(run, "mappings", mapped)
    g.write(run, "differences", correlate.differences(mapped, tables["components"], of_papers("papers_text"), own, lines))


def ingest_changed(g: Published, sources: DataFrame, files: DataFrame | None = None, commits: DataFrame | None = None, pairs: DataFrame | None = None, bibliographies: DataFrame | None = None, parser: str = PARSER_VERSION, readers: dict | None = None) -> dict[str, int]:
    """Brings a graph up to date with papers, repositories and pairs of them; how many of each had to be done.

    sources (paper_version, tex), each once; files (repo, path, text) at commits (repo, commit_sha); pairs (paper_version,
    repo); bibliographies (paper_version, file, kind, text). A paper is done again if its text, its bibliographies or the
    parser have changed, but a paper that has lost its text stays as it was; a repository if its commit has; a pair if
    either has. All goes into one run and counts at once, so readers see all tables before or after it. With nothing to
    do, nothing is written. A reader of marks that fails on a paper gives a row of errors, and the others go on. What is no
    longer among the sources stays.
    """
    spark, valid, run = g.spark, g.valid(), g.new_run()
    readers = readers or scan.READERS
    text = sources.select("paper_version", F.sha2(F.coalesce("tex", F.lit("")), 256).alias("sha"), F.col("tex").isNull().alias("bare"))
    if bibliographies is not None:
        listed = bibliographies.groupBy("paper_version").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat_ws("|", "file", "kind", "text"), 256))), ","), 256).alias("bib"))
        text = text.join(listed, "paper_version", "left").withColumn("sha", F.concat_ws("+", "sha", "bib"))
    had = valid.select(F.col("key").alias("paper_version"), F.lit(True).alias("had"))
    text = text.join(had, "paper_version", "left").where(~F.col("bare") | F.col("had").isNull())
    papers = _changed(text.select(F.col("paper_version").alias("key"), F.concat_ws("|", "sha", F.lit(parser)).alias("stamp")), valid, run)
    done = {"papers": papers.count(), "repos": 0, "pairs": 0}
    entries = papers
    if done["papers"]:
        _papers(g, run, sources, bibliographies, papers, readers)
    if commits is not None:
        repos = _changed(commits.select(F.col("repo").alias("key"), F.col("commit_sha").alias("stamp")), valid, run)
        done["repos"] = repos.count()
        if done["repos"]:
            _repos(g, run, files, repos)
        entries = entries.unionByName(repos)
    if pairs is not None:
        plan = kept(g.planned(entries, valid))
        stamp = lambda name, as_: plan.select(F.col("key").alias(name), F.col("stamp").alias(as_))
        wanted = pairs.select("paper_version", "repo").distinct().join(stamp("paper_version", "a"), "paper_version").join(stamp("repo", "b"), "repo")
        both = _changed(wanted.select(F.concat_ws("|", "paper_version", "repo").alias("key"), F.concat_ws("@", "a", "b").alias("stamp")), valid, run)
        done["pairs"] = both.count()
        if done["pairs"]:
            _pairs(g, run, pairs, both, plan)
        entries = entries.unionByName(both)
    if any(done.values()):
        g.publish(entries)
    return done


def _entries(references: DataFrame) -> DataFrame:
    """References (paper_version, key, ref_doi, title, year) as bibliography entries; of a repeated key the last counts."""
    last = references.groupBy("paper_version", "key").agg(F.max_by(F.struct("title", "year", "ref_doi"), "ordinal").alias("x"))
    text = lambda name: F.lit(None).cast("string").alias(name)
    return last.select(
        F.concat("paper_version", F.lit(":bib:"), "key").alias("id"), "paper_version", F.col("key").alias("bib_key"), text("raw"), text("authors"), F.col("x.title").alias("title"), F.col("x.year").cast("int").alias("year"),
        text("arxiv_id"), F.col("x.ref_doi").alias("doi"), F.lit(0).cast("bigint").alias("cite_count"),
    )


def _edges(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges of the citation graph to entries with a DOI, one for each paper and DOI; papers has (paper_version, paper)."""
    cited = entries.where("doi is not null and doi != ''").join(papers, "paper_version").select(F.col("paper").alias("from_paper"), F.col("doi").alias("to_paper")).distinct()
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return cited.select(
        F.concat("from_paper", F.lit("->"), "to_paper", F.lit(":CITES")).alias("id"), "from_paper", "to_paper", F.lit("CITES").alias("relation"), none("boolean", "is_influential"), none("array<string>", "intents"), none("array<string>", "contexts"),
        F.lit("CONFIRMED").alias("confidence"), F.lit("registry").alias("source"),
    )


def metadata_only(works: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """Tables of papers known by their registered record alone (work_records, work_references): no text, so fidelity UNAVAILABLE."""
    doi, version = F.lower("doi"), F.concat(F.lower("doi"), F.lit("v1"))
    papers = works.select(doi.alias("arxiv_id"), F.coalesce("title", F.lit("(untitled)")).alias("title"), "abstract", doi.alias("doi"), "published_at", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), version.alias("latest_version")).dropDuplicates(["arxiv_id"])
    versions = papers.select(F.col("latest_version").alias("paper_version"), "arxiv_id", F.lit(1).alias("version"), F.lit("NONE").alias("source_kind"), F.lit("UNAVAILABLE").alias("fidelity"))
    entries = _entries(references.withColumn("paper_version", version))
    return {"papers": papers, "paper_versions": versions, "bib_entries": entries, "lineage_edges": _edges(entries, papers.select(F.col("latest_version").alias("paper_version"), F.col("arxiv_id").alias("paper")))}


def enriched(versions: DataFrame, have: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """Registered references for versions (paper_version, paper, doi) that have no bibliography entries at all; the others get none."""
    bare = versions.where("doi is not null").select("paper_version", "paper", F.lower("doi").alias("doi")).join(have.select("paper_version").distinct(), "paper_version", "left_anti")
    entries = _entries(references.withColumn("doi", F.lower("doi")).join(bare, "doi"))
    return {"bib_entries": entries, "lineage_edges": _edges(entries, bare.select("paper_version", "paper"))}
