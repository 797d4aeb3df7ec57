"""TeX source trees as one text for each paper: comments dropped, files put in where they are named, macros written out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.grams import dealt
from .landing import kept

#: Files within files, at most; and passes over macros, whose bodies may hold other macros.
DEPTH, PASSES = 8, 3

_NAMED = r"\\(?:input|include)\s*\{\s*([^{}]+?)\s*\}"
# a body may hold braces two levels deep
_GROUP = r"\{((?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+)\}"
_MACRO = r"\\(?:(?:re)?newcommand\*?|providecommand\*?|def)\s*\{?\\([A-Za-z]+)\}?\s*(?:\[(\d)\])?\s*" + _GROUP


def _pieces(files: DataFrame) -> DataFrame:
    """(paper_version, path, place, text, child): texts between the places where files are named, and the path named after each."""
    text = T.strip_comments(F.coalesce("text", F.lit("")))
    names = F.transform(F.regexp_extract_all(text, F.lit(_NAMED), F.lit(1)), lambda n: F.regexp_replace(n, r"^\./", ""))
    child = F.transform(names, lambda n: F.when(n.rlike(r"\.[A-Za-z]+$"), n).otherwise(F.concat(n, F.lit(".tex"))))
    one = files.groupBy("paper_version", "path").agg(F.min("text").alias("text"))
    cut = one.select("paper_version", "path", F.posexplode(F.split(text, _NAMED)).alias("place", "text"), child.alias("children"))
    return cut.select("paper_version", "path", "place", "text", F.get("children", F.col("place")).alias("child"))


def _roots(pieces: DataFrame) -> DataFrame:
    """The first file of each paper that opens a document, else its first file that no other names, else its first one."""
    named = pieces.where("child is not null").select("paper_version", F.col("child").alias("path")).distinct().withColumn("named", F.lit(1))
    by_file = pieces.groupBy("paper_version", "path").agg(F.max(F.col("text").rlike(r"\\documentclass|\\begin\{document\}").cast("int")).alias("opens"))
    rank = F.struct(-F.col("opens"), F.coalesce("named", F.lit(0)), F.col("path"))
    return by_file.join(named, ["paper_version", "path"], "left").groupBy("paper_version").agg(F.min_by("path", rank).alias("path"))


def _macros(text: Column) -> Column:
    """The macros that a text defines, as an array of (name, n, body); of several definitions of a name the first counts."""
    found = lambda i: F.regexp_extract_all(text, F.lit(_MACRO), F.lit(i))
    every = F.arrays_zip(found(1).alias("name"), found(2).alias("n"), found(3).alias("body"))
    first = lambda acc, m: F.when(F.exists(acc, lambda x: x["name"] == m["name"]), acc).otherwise(F.concat(acc, F.array(m)))
    return F.aggregate(every, F.array().cast("array<struct<name:string,n:string,body:string>>"), first)


def expand_macros(papers: DataFrame, text: str) -> DataFrame:
    """Papers with uses of a text's own macros written out, and their definitions dropped.

    Macros are gathered in a step of their own, once for each text; texts without any are left as they are.
    """

    def written_out(acc, m):
        n = F.coalesce(m["n"].try_cast("int"), F.lit(0))
        use = F.concat(F.lit(r"\\"), m["name"], F.when(n > 0, F.repeat(F.lit(r"\s*\{([^{}]*)\}"), n)).otherwise(F.lit(r"(?![A-Za-z])(?:\{\})?")))
        # an argument number that the macro doesn't take stays as it stands
        safe = F.regexp_replace(m["body"], r"([\\$])", r"\\$1")
        body = F.when(n > 0, F.regexp_replace(safe, F.concat(F.lit("#([1-"), F.greatest(n, F.lit(1)).cast("string"), F.lit("])")), F.lit(r"\$$1"))).otherwise(safe)
        return F.regexp_replace(acc, use, body)

    once = lambda acc: F.aggregate("_macros", acc, written_out)
    bare = F.regexp_replace(text, _MACRO, "")
    whole = F.when(F.size("_macros") > 0, reduce(lambda acc, _: once(acc), range(PASSES), bare)).otherwise(F.col(text))
    return papers.withColumn("_macros", _macros(F.col(text))).withColumn(text, whole).drop("_macros")


def flattened(files: DataFrame, macros: bool = True) -> DataFrame:
    """files (paper_version, path, text) to (paper_version, tex), one row for each paper.

    Only the tree of names is walked, level by level, and each level is written once; texts meet it once. A file that isn't there or that holds itself
    adds nothing, files deeper than DEPTH neither; of repeated paths the least text counts; null texts are empty.
    """
    pieces = kept(_pieces(files))
    links = pieces.where("child is not null").select("paper_version", "path", "place", "child")
    levels = [kept(_roots(pieces).select("paper_version", "path", F.array().cast("array<int>").alias("at"), F.array("path").alias("above")))]
    for _ in range(DEPTH):
        down = levels[-1].join(dealt(links), ["paper_version", "path"]).where(~F.array_contains("above", F.col("child")))
        down = kept(down.select("paper_version", F.col("child").alias("path"), F.concat("at", F.array(F.col("place") * 2 + 1)).alias("at"), F.concat("above", F.array("child")).alias("above")))
        if down.isEmpty():
            break
        levels.append(down)
    tree = reduce(DataFrame.unionByName, levels).select("paper_version", "path", "at")
    put = tree.join(dealt(pieces), ["paper_version", "path"]).select("paper_version", F.struct(F.concat("at", F.array(F.col("place") * 2)).alias("at"), "text").alias("x"))
    whole = put.groupBy("paper_version").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "").alias("tex"))
    return expand_macros(whole, "tex") if macros else whole
