"""Addresses of every kind to what they name: one join of all that is asked with all that can be asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.grams import dealt
from .reads import route

#: Keys that a miss names, at most.
SHOWN = 40
#: Kinds of one thing by key, whose misses name the keys that there are; kinds of lists; kinds of repositories.
KEYED = ["section", "equation", "component", "algorithm", "file", "symbol"]
LISTS = ["values", "urls", "implementations", "references", "mapping", "difference", "plan", "lineage", "file"]
OF_REPO = ["repo", "file", "symbol"]
# Entities that a paper's header counts, and the order of severities.
COUNTED = ["sections", "equations", "algorithms", "stated_values", "declared_urls", "components"]
SEVERITIES = ["BLOCKING", "SIGNIFICANT", "MINOR"]


def _items(kind: str, rows: DataFrame, subject: Column | str, target: Column | str | None, place: Column | str, sort: Column | str, *columns: Column | str) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    item = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    key = F.lit("") if target is None else F.coalesce(text(target), F.lit(""))
    place = F.col(place) if isinstance(place, str) else place
    return rows.select(F.lit(kind).alias("kind"), text(subject).alias("subject"), key.alias("target"), place.cast("long").alias("place"), text(sort).alias("sort"), item.alias("item"))


def _papers(tables: dict[str, DataFrame]) -> DataFrame:
    n = lambda e: F.count_if(F.col("entity") == e).alias(e)
    rows = [tables[e].select("paper_version", F.lit(e).alias("entity")) for e in COUNTED if e in tables]
    head = tables["paper_versions"].select("paper_version", "arxiv_id", "fidelity").join(dealt(tables["papers"].drop("latest_version")), "arxiv_id")
    if rows:
        head = dealt(head).join(reduce(DataFrame.unionByName, rows).groupBy("paper_version").agg(*map(n, COUNTED)), "paper_version", "left")
    counts = F.struct(*((F.coalesce(F.col(e), F.lit(0).cast("long")) if rows else F.lit(0).cast("long")).alias(e) for e in COUNTED))
    return _items("paper", head, "paper_version", None, F.lit(0), "arxiv_id", "paper_version", "title", F.transform("authors", lambda a: a["name"]).alias("authors"), "published_at", "abstract", "fidelity", counts.alias("counts"))


def _with_evidence(rows: DataFrame, tables: dict[str, DataFrame], kind: str, subject: Column) -> DataFrame:
    """rows with the evidence on them: an array of (id, kind, uri, stance) in order."""
    empty = F.array().cast("array<struct<id:string,kind:string,uri:string,stance:string>>")
    if "evidence" not in tables:
        return rows.withColumn("evidence", empty)
    links = tables["evidence_links"].where(F.col("subject_kind") == kind).join(dealt(tables["evidence"].withColumnRenamed("id", "evidence_id")), "evidence_id")
    own = links.groupBy("subject_id").agg(F.array_sort(F.collect_set(F.struct(F.col("evidence_id").alias("id"), "kind", "uri", "stance"))).alias("evidence"))
    return rows.withColumn("subject_id", subject).join(dealt(own), "subject_id", "left").withColumn("evidence", F.coalesce("evidence", empty))


def contents(tables: dict[str, DataFrame]) -> DataFrame:
    """All that addresses can name, as (kind, subject, target, place, sort, item: JSON); tables that are not given have nothing.

    Tables are those of the graph by name, and `plans` (paper_version, repo, part, status, n, n_matched). A repository
    counts by its latest snapshot, an analysis by its latest.
    """
    t, parts = tables, [_papers(tables)]
    add = lambda name, make: parts.append(make(t[name])) if name in t else None
    add("sections", lambda r: _items("section", r, "paper_version", "section_path", "ordinal", "section_path", "section_path", "level", "title", "latex_label", F.array("src_line_start", "src_line_end").alias("src_lines"), "body"))
    if "equations" in t:
        same = F.count("*").over(Window.partitionBy("paper_version", "derived_number")) > 1
        fields = ["content_hash", "latex", "environment", "is_numbered", "derived_number", "number_conf", "latex_label", "section_id", "src_line"]
        numbered = t["equations"].where(F.col("derived_number").rlike(r"^\d+$")).withColumn("shared", same)
        hashed = t["equations"].where(~F.col("content_hash").rlike(r"^\d+$")).withColumn("shared", F.lit(False))
        parts += [_items("equation", r, "paper_version", key, "ordinal", "content_hash", *fields, "shared") for r, key in ((numbered, "derived_number"), (hashed, "content_hash"))]
    add("components", lambda r: _items("component", r, "paper_version", "slug", F.lit(0), "slug", "slug", "name", "kind", "description", "section_id", "source"))
    add("algorithms", lambda r: _items("algorithm", r, "paper_version", "slug", "src_line", "slug", "slug", "name", "presentation", "extractable", "body", "section_id", "src_line"))
    add("stated_values", lambda r: _items("values", r, "paper_version", None, "src_line", "id", "symbol", F.col("value_text").alias("value"), "section_id", "src_line", "context"))
    add("declared_urls", lambda r: _items("urls", r, "paper_version", None, "src_line", "url", "url", "host", "owner", "repo", "in_abstract", "section_id", "src_line", "context"))
    if "implementation_candidates" in t:
        rows = t["implementation_candidates"].drop("id").join(dealt(t["repos"].select(F.col("id").alias("repo_id"), "stars", "license", "archived")), "repo_id")
        rows = _with_evidence(rows, t, "implementation_candidate", F.concat_ws("|", "paper_version", "repo_id"))
        parts.append(_items("implementations", rows, "paper_version", None, "rank", "repo_id", "repo_id", "relation", "confidence", "rank", "stars", "license", "archived", "evidence"))
    if "bib_entries" in t:
        sites = t["citation_sites"].groupBy("paper_version", "bib_key").agg(F.count("*").alias("sites"))
        rows = t["bib_entries"].join(dealt(sites), ["paper_version", "bib_key"], "left").withColumn("cited_times", F.coalesce("sites", F.lit(0).cast("long")))
        parts.append(_items("references", rows, "paper_version", None, -F.col("cited_times"), "bib_key", "bib_key", "title", "authors", "year", "arxiv_id", "doi", "cited_times"))
    if "analyses" in t:
        last = t["analyses"].groupBy("paper_version").agg(F.max(F.struct("created_at", "id", "author", F.map_entries("fields").alias("fields"))).alias("x")).select("paper_version", "x.*")
        parts.append(_items("analysis", last, "paper_version", None, F.lit(0), "id", "id", "author", F.map_from_entries(F.array_sort("fields")).alias("fields")))
    repo = F.substring_index("snapshot_id", "@", 1)
    if "mappings" in t:
        rows = _with_evidence(t["mappings"].withColumn("repo", repo), t, "mapping", F.col("id"))
        parts.append(_items("mapping", rows, "paper_version", "repo", F.lit(0), F.concat_ws("|", "status", "anchor_kind", "id"), "id", "anchor_kind", "anchor_id", "status", "confidence", "method", "reasoning", "evidence"))
    severity = F.coalesce(F.nullif(F.array_position(T.strings(SEVERITIES), F.col("severity")), F.lit(0)), F.lit(4))
    add("differences", lambda r: _items("difference", r, "paper_version", repo, severity, "id", "kind", "paper_states", "code_does", "difference", "severity", "confidence"))
    add("plans", lambda r: _items("plan", r, "paper_version", "repo", F.lit(0), "part", "part", "status", "n", "n_matched"))
    if "lineage_edges" in t:
        ends = t["lineage_edges"].withColumn("end", F.explode(F.array_distinct(F.array("from_paper", "to_paper"))))
        parts.append(_items("lineage", ends, "end", None, F.lit(0), F.concat_ws("|", "from_paper", "to_paper", "relation"), "from_paper", "to_paper", "relation", "confidence", "source", "is_influential"))
    if "repo_snapshots" in t:
        last = t["repo_snapshots"].groupBy("repo_id").agg(F.max(F.struct("indexed_at", "id", "commit_sha", "indexer", "symbol_count", "file_count")).alias("x")).select("repo_id", "x.*")
        parts.append(_items("repo", last, "repo_id", None, F.lit(0), "id", "repo_id", "commit_sha", "indexer", "symbol_count", "file_count"))
        if "symbols" in t:
            s = t["symbols"].drop("id").join(dealt(last.select("repo_id", F.col("id").alias("snapshot_id"))), "snapshot_id")
            lines = F.array("line_start", "line_end").alias("lines")
            parts.append(_items("file", s, "repo_id", "file_path", "line_start", "qualified_name", "qualified_name", "name", "kind", lines, "signature"))
            n = F.coalesce("line_end", "line_start") - F.col("line_start") + 1
            source = F.array_join(F.slice(F.split("text", "\r\n|\n|\r"), F.col("line_start"), n), "\n") if "code_files" in t else F.lit(None).cast("string")
            if "code_files" in t:
                s = s.join(dealt(t["code_files"].select(F.col("repo").alias("repo_id"), F.col("path").alias("file_path"), "text")), ["repo_id", "file_path"], "left")
            parts.append(_items("symbol", s, "repo_id", "qualified_name", "line_start", "file_path", "qualified_name", "name", "kind", "file_path", lines, "signature", source.alias("source")))
    return reduce(DataFrame.unionByName, parts)


def papers_by_key(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, paper_version, arxiv_id, n): identifiers of papers, and how many papers each names; a version's own id names only itself."""
    versions = tables["paper_versions"].select(F.col("paper_version").alias("key"), "paper_version", "arxiv_id")
    p = tables["papers"].where("latest_version is not null")
    others = p.select(F.explode(F.array_distinct(F.array_compact(F.array("arxiv_id", "doi")))).alias("key"), F.col("latest_version").alias("paper_version"), "arxiv_id")
    rows = versions.unionByName(others.join(dealt(versions.select("key")), "key", "left_anti"))
    return rows.groupBy("key").agg(F.count_distinct("paper_version").alias("n"), F.min(F.struct("paper_version", "arxiv_id")).alias("x")).select("key", "n", "x.*")


def fetch(addresses: DataFrame, tables: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """addresses (uri) to (uri, kind, status, subject, target, n, content, available), one row for each distinct address.

    status: FOUND; EMPTY, a list of an ingested paper that has nothing; NOT_FOUND, with the keys that there are in
    available (none if the paper or repository isn't there either); AMBIGUOUS, an identifier of several papers;
    UNRECOGNISED, no kind fits. Papers are named by id, version or DOI, exactly. content is the JSON of the thing, or of the
    list in order; n is how many there are, so more than one under a key means that the first is shown. Null addresses
    are UNRECOGNISED. keep: what is read more than once (addresses with what they name, then with contents) goes through
    it, such as a write to the shared folder; without it, each reading derives the tables' items anew.
    """
    asked = route(addresses.select(F.trim("uri").alias("uri")).distinct())
    id_, version = T.arxiv_parts(F.col("subject"))
    key = F.coalesce(F.concat(id_, F.coalesce(F.concat(F.lit("v"), version), F.lit(""))), F.trim("subject"))
    of_repo = F.col("kind").isin(OF_REPO)
    found = asked.withColumn("key", F.when(~of_repo, key)).join(dealt(papers_by_key(tables).withColumnRenamed("n", "papers")), "key", "left")
    subject = F.when(of_repo, F.col("subject")).when(F.col("papers") == 1, F.when(F.col("kind") == "lineage", F.col("arxiv_id")).otherwise(F.col("paper_version")))
    found = keep(found.select("uri", "kind", "papers", subject.alias("subject"), F.coalesce("target", F.lit("")).alias("target")))
    items, on = contents(tables), ["kind", "subject", "target"]
    wanted = found.where("subject is not null").select(*on).distinct()
    met = items.join(dealt(wanted), on).groupBy(*on).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "sort", "item"))).alias("x"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("x", lambda i: i["item"]), ","), F.lit("]"))
    met = met.select(*on, "n", F.when(F.col("kind").isin(LISTS), listed).otherwise(F.col("x")[0]["item"]).alias("content"))
    out = keep(found.join(dealt(met), on, "left"))
    missed = out.where(F.col("n").isNull() & F.col("kind").isin(KEYED) & F.col("subject").isNotNull()).select("kind", "subject").distinct()
    keys = items.where(F.col("kind").isin(KEYED) & ~((F.col("kind") == "equation") & F.col("target").rlike(r"^\d+$"))).join(dealt(missed), ["kind", "subject"]).groupBy(*on).agg(F.min(F.struct("place", "sort")).alias("at"))
    place = F.row_number().over(Window.partitionBy("kind", "subject").orderBy("at", "target"))
    shown = keys.withColumn("p", place).where(F.col("p") <= SHOWN).groupBy("kind", "subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "target"))), lambda x: x["target"]), ",").alias("available"))
    out = out.join(dealt(shown), ["kind", "subject"], "left")
    there = F.col("n").isNotNull()
    status = (
        F.when(F.col("kind").isNull(), "UNRECOGNISED").when(F.col("papers") > 1, "AMBIGUOUS").when(there, "FOUND")
        .when(F.col("subject").isNotNull() & F.col("kind").isin([*LISTS, "analysis"]) & ~of_repo, "EMPTY").otherwise("NOT_FOUND")
    )
    return out.select("uri", "kind", status.alias("status"), "subject", F.nullif("target", F.lit("")).alias("target"), "n", "content", F.when(~there, F.col("available")).alias("available"))


def resolving(addresses: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The addresses (uri) that name something: what evidence is held against."""
    return fetch(addresses, tables).where("status in ('FOUND', 'EMPTY')").select("uri")
