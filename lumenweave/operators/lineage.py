"""What a paper builds on and what builds on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import kept
from . import grams

METHODOLOGY = "methodology"
FETCHED = 40
#: Words holding a method's term that are sent to all tasks.
MOST_WORDS = 100_000


def cited_counts(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """Entries with the number of their sites; sites are counted before they are joined."""
    n = sites.groupBy("paper_version", "bib_key").agg(F.count("*").alias("sites"))
    return entries.join(n, ["paper_version", "bib_key"], "left").withColumn("sites", F.coalesce("sites", F.lit(0)))


def predecessors(entries: DataFrame, sites: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries of each paper by sites and year, with up to three contexts; cited more than once: a predecessor."""
    rows = cited_counts(entries, sites).withColumn("rank", F.row_number().over(Window.partitionBy("paper_version").orderBy(F.desc("sites"), F.desc("year"), "bib_key")))
    if limit is not None:
        rows = rows.where(F.col("rank") <= limit)
    first = sites.withColumn("n", F.row_number().over(Window.partitionBy("paper_version", "bib_key").orderBy("ordinal"))).where("n <= 3")
    contexts = first.groupBy("paper_version", "bib_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "context"))), lambda x: x["context"]).alias("contexts"))
    out = rows.join(contexts, ["paper_version", "bib_key"], "left")
    return out.select("paper_version", "bib_key", F.coalesce("arxiv_id", F.concat(F.lit("bib:"), "bib_key")).alias("to_paper"), "title", "year", "sites", "rank", F.when(F.col("sites") > 1, "PREDECESSOR").otherwise("CITES").alias("relation"), F.lit("CONFIRMED").alias("confidence"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))


def forward(works: DataFrame, cited: DataFrame) -> DataFrame:
    """Citing works (cited, place, title, year, cited_by_count, arxiv_id) enriched by citations with contexts, found by id, else by the title's first 70 letters.

    Of citations that share a key the last counts. Works without an id are addressed by a hash of their title.
    """
    rest = F.struct("paper_id", "is_influential", "intents", "contexts")
    by_id = cited.where("arxiv_id is not null").groupBy("cited", "arxiv_id").agg(F.max_by(rest, "place").alias("a"))
    key = F.substring(F.lower("title"), 1, 70)
    by_title = cited.where("title is not null").groupBy("cited", key.alias("head")).agg(F.max_by(rest, "place").alias("t"))
    rows = works.withColumn("head", key).join(by_id, ["cited", "arxiv_id"], "left").join(by_title, ["cited", "head"], "left").withColumn("x", F.coalesce("a", "t"))
    influential, intents = F.coalesce("x.is_influential", F.lit(False)), F.coalesce("x.intents", F.array().cast("array<string>"))
    contexts = F.coalesce("x.contexts", F.array().cast("array<string>"))
    successor = influential | F.array_contains(intents, METHODOLOGY)
    address = F.coalesce("arxiv_id", "x.paper_id", F.concat(F.lit("title:"), F.substring(F.sha2(F.lower("title"), 256), 1, 12)))
    return rows.select("cited", address.alias("from_paper"), "title", "year", "cited_by_count", F.when(successor, "SUCCESSOR").otherwise("CITES").alias("relation"), F.when(successor, "LIKELY").when(F.size(contexts) > 0, "CONFIRMED").otherwise("LIKELY").alias("confidence"), F.col("x.is_influential").alias("is_influential"), intents.alias("intents"), F.slice(contexts, 1, 3).alias("contexts"), "place")


def successors(edges: DataFrame, limit: int) -> DataFrame:
    """Of each paper's first citing works, the strongest: influential, then methodology, then citations, then year."""
    fetched = edges.where(F.col("place") < F.greatest(F.lit(3 * limit), F.lit(FETCHED)))
    order = [F.desc(F.coalesce("is_influential", F.lit(False))), F.desc(F.array_contains("intents", METHODOLOGY)), F.desc(F.coalesce("cited_by_count", F.lit(0))), F.desc(F.coalesce("year", F.lit(0))), F.asc("place")]
    return fetched.withColumn("rank", F.row_number().over(Window.partitionBy("cited").orderBy(*order))).where(F.col("rank") <= limit)


def edges(back: DataFrame, ahead: DataFrame) -> DataFrame:
    """Edges both ways as rows of the lineage table, one for each (from, to, relation)."""
    b = back.select(F.col("paper_version").alias("from_paper"), "to_paper", "relation", F.lit(None).cast("boolean").alias("is_influential"), F.array().cast("array<string>").alias("intents"), "contexts", "confidence", F.lit("bibliography").alias("source"))
    a = ahead.select("from_paper", F.col("cited").alias("to_paper"), "relation", "is_influential", "intents", "contexts", "confidence", F.lit("citation_index").alias("source"))
    return b.unionByName(a).dropDuplicates(["from_paper", "to_paper", "relation"])


def _asked(methods: DataFrame) -> DataFrame:
    terms = F.filter(F.split(F.lower("method"), r"\s+"), lambda t: F.length(t) > 2)
    return methods.select("method", terms.alias("terms")).where("size(terms) > 0").distinct()


def _held(rows: DataFrame, text: Column, asked: DataFrame) -> DataFrame:
    """rows whose text holds the term of a method, once for each, with the method and its terms; asked: method, terms, term.

    A term lies within one word, so terms find words by their letters, and rows are looked through for those words. The
    words are sent to all tasks up to MOST_WORDS of them, so that no row is shuffled or keyed; beyond that rows and words
    are dealt by word.
    """
    words = F.array_distinct(F.split(F.lower(text), r"\s+"))
    names = kept(grams.holding(grams.index(rows.select(F.explode(words).alias("name")), [], "name", 3), asked.select("term")))
    names = F.broadcast(names) if names.count() <= MOST_WORDS else grams.dealt(names)
    met = rows.withColumn("name", F.explode(words)).join(names, "name")
    # of words that hold the same term the first counts
    met = met.where(F.col("name") == F.element_at(F.filter(words, lambda w: F.contains(w, F.lower("term"))), 1))
    return met.drop("name").join(F.broadcast(asked), "term").drop("term")


def told_sentences(sites: DataFrame, entries: DataFrame, methods: DataFrame) -> DataFrame:
    """methods (method) to the citing sentences that hold all its terms; the longest term finds them."""
    asked = _asked(methods)
    longest = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t), t.alias("t"))))["t"]
    said = _held(sites, F.col("context"), asked.withColumn("term", longest)).where(F.forall("terms", lambda t: F.contains(F.lower("context"), t)))
    said = said.join(entries.select("paper_version", "bib_key", "title", "year"), ["paper_version", "bib_key"], "left")
    return said.select("method", "paper_version", "bib_key", "title", "year", "context", "src_line")


def told_sections(sections: DataFrame, methods: DataFrame) -> DataFrame:
    """methods (method) to the first six sections of each paper that hold its first term."""
    asked = _asked(methods).withColumn("term", F.try_element_at("terms", F.lit(1)))
    told = _held(sections, F.concat_ws("\n", "title", "body"), asked)
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("method", "paper_version").orderBy("ordinal"))).where("n <= 6")
    return told.select("method", "paper_version", "section_path", "title")


def trace_method(sites: DataFrame, entries: DataFrame, sections: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """methods (method, stated ones) through the literature: told_sentences and told_sections."""
    return told_sentences(sites, entries, methods), told_sections(sections, methods)
