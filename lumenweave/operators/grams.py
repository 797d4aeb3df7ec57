"""Which names hold a term anywhere: postings of three letters, intersected by count, then checked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 3
#: Grams of a term, the rarest ones, whose postings are intersected.
PROBES = 3
#: Terms, at most, that each name is held against where a search allows it; more meet postings.
FEW_TERMS = 500


def grams(text: Column, n: Column | int = N) -> Column:
    """The distinct runs of n characters, in order of their first places; none if the text is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


@dataclass
class Index:
    """Postings (scope, gram, name) and sizes (scope, gram, n) of names in lower case, and the names (scope, name); made once, and asked often."""

    scope: list[str]
    postings: DataFrame
    sizes: DataFrame
    names: DataFrame
    shortest: int


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt by its keys and never sent whole: exploded rows and built texts look small to the planner, which takes the size of the files that they come from."""
    return df.hint("merge")


def _sizes(postings: DataFrame, scope: list[str]) -> DataFrame:
    return postings.groupBy(*scope, "gram").agg(F.count("*").alias("n"))


def index(names: DataFrame, scope: list[str], text: str, shortest: int = 1) -> Index:
    """The index of the distinct names of each scope, for terms of so many letters or more; shorter ones find nothing.

    Terms of one and two letters need postings of such runs.
    """
    lowered = names.where(F.col(text).isNotNull()).select(*scope, F.lower(text).alias("name")).distinct()
    name = F.col("name")
    postings = lowered.select(*scope, "name", F.explode(F.concat(*(grams(name, n) for n in range(min(shortest, N), N + 1)))).alias("gram"))
    return Index(scope, postings, _sizes(postings, scope), lowered, min(shortest, N))


def kept(found: Index, keep) -> Index:
    """The index with its postings kept by a function (such as a write to the shared folder), and their sizes counted from those."""
    postings = keep(found.postings)
    return Index(found.scope, postings, keep(_sizes(postings, found.scope)), found.names, found.shortest)


def _held_by_each(index: Index, asked: DataFrame, lowered: list[str]) -> DataFrame:
    """The same as holding, for few terms: one pass over the names, of which only hits are dealt, no postings."""
    scope = index.scope
    hits = index.names.select(*scope, "name", F.explode(F.filter(F.array(*map(F.lit, lowered)), lambda t: F.contains("name", t))).alias("lowered"))
    return hits.join(dealt(asked.withColumn("lowered", F.lower("term"))), [*scope, "lowered"]).select(*scope, "term", "name")


def holding(index: Index, terms: DataFrame, few: int = 0) -> DataFrame:
    """terms (scope, term) to (scope, term, name): the names of the scope that hold the term, in any case.

    A term meets the postings of its rarest grams only; names in all of them are checked. Empty and null terms find
    nothing. Names come in lower case. Up to few terms, over all scopes, are fetched and held against each name instead.
    """
    scope = index.scope
    asked = terms.where("term is not null and term != ''").select(*scope, "term").distinct()
    if few:
        long_enough = asked.where(F.length("term") >= index.shortest)
        lowered = [r.term for r in long_enough.select(F.lower("term").alias("term")).distinct().limit(few + 1).collect()]
        if 0 < len(lowered) <= few:
            return _held_by_each(index, long_enough, sorted(lowered))
    n = F.least(F.length("term"), F.lit(N))
    cut = asked.select(*scope, "term", F.explode(grams(F.lower("term"), n)).alias("gram"))
    sized = dealt(cut).join(dealt(index.sizes), [*scope, "gram"], "left")
    # a gram that no name has settles the term: it comes first, and meets nothing
    probes = sized.groupBy(*scope, "term").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, PROBES).alias("p"))
    probes = probes.where("p[0].n > 0").select(*scope, "term", F.size("p").alias("asked"), F.explode("p.gram").alias("gram"))
    met = probes.join(dealt(index.postings), [*scope, "gram"]).groupBy(*scope, "term", "name", "asked").agg(F.count("*").alias("met"))
    return met.where((F.col("met") == F.col("asked")) & F.contains("name", F.lower("term"))).select(*scope, "term", "name")


def containing(texts: DataFrame, key: str, text: str, terms: DataFrame, shortest: int = 1) -> DataFrame:
    """terms (term), none with white space in it or shorter than said, to (term, key): the texts that hold the term anywhere, in any case.

    A term lies within one word, so it finds words by their letters, and words find texts.
    """
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("name"))
    return holding(index(words, [], "name", shortest), terms).join(words, "name").select("term", key).distinct()
