"""Source trees: symbols of Python files, lines, literals, and searches over them."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.landing import kept
from . import grams, intervals, patterns

METHOD = "python-ast:symbol_search"
# Fixed value: suffixes of files that text searches read.
SEARCHED = r"\.(py|pyi|cfg|toml|yaml|yml|json|md|txt)$"
# Fixed value: suffixes that make a term's place a place in code.
SOURCE = r"\.(py|pyx|cpp|cc|c|h|hpp|cu|js|ts|java|go|rs|jl|m|swift|kt|prototxt|yaml|yml|json)$"

SYMBOLS = "repo string, file_path string, ordinal int, qualified_name string, name string, kind string, line_start int, line_end int, signature string, parent string, warning string"


def symbols_of(path: str, text: str) -> tuple[list[tuple], str | None]:
    """Classes, functions and capital constants of a Python file in order, or a warning."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return [], f"{path}: unparseable ({getattr(e, 'msg', e)})"
    out: list[tuple] = []
    todo: list[tuple[ast.AST, str | None]] = [(n, None) for n in reversed(list(ast.iter_child_nodes(tree)))]
    while todo:
        node, parent = todo.pop()
        inner = parent
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            inner = f"{parent}.{node.name}" if parent else node.name
            if isinstance(node, ast.ClassDef):
                kind, head = "class", f"class {node.name}"
            else:
                kind = "method" if parent else "function"
                head = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)})"
            out.append((f"{path}::{inner}#{kind}", node.name, kind, node.lineno, node.end_lineno, head, parent))
            todo += [(n, inner) for n in reversed(list(ast.iter_child_nodes(node)))]
        elif isinstance(node, ast.Assign) and parent is None:
            out += [(f"{path}::{t.id}#constant", t.id, "constant", node.lineno, node.end_lineno, None, None) for t in node.targets if isinstance(t, ast.Name) and t.id.isupper()]
    return out, None


def _parsed(batches):
    for b in batches:
        rows, parsed = [], {}  # files of one text are parsed once; only their paths differ
        for repo, path, text in zip(b["repo"], b["path"], b["text"]):
            text = text or ""
            if text not in parsed:
                parsed[text] = symbols_of("", text)
            found, warning = parsed[text]
            rows += [(repo, path, i, path + s[0], *s[1:], None) for i, s in enumerate(found)]
            if warning:
                rows.append((repo, path, -1, None, None, None, None, None, None, None, path + warning))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SYMBOLS.split(", ")]).astype({"line_start": "Int64", "line_end": "Int64"})


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files (repo, path, text); a file that doesn't parse gives one row with a warning."""
    return files.where(F.col("path").endswith(".py")).select("repo", "path", "text").mapInPandas(_parsed, SYMBOLS)


def languages(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"[^.]\.([^.]*)$", 1))
    return files.groupBy("repo", ext.alias("extension")).agg(F.count("*").alias("n"))


def lines(files: DataFrame) -> DataFrame:
    """Searchable lines (repo, path, line, text)."""
    return files.where(F.col("path").rlike(SEARCHED)).select("repo", "path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def search_text(lines: DataFrame, pattern: str, limit: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Lines that a pattern fits, trimmed and cut to 240; with a limit, the first of each repository by path and line.

    With an index of the lines (patterns.line_index) only blocks that hold the pattern's literals are read.
    """
    hits = patterns.search(lines, {"": pattern}, index).drop("name").withColumn("text", F.substring(F.trim("text"), 1, 240))
    if limit is None:
        return hits
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path", "line"))).where(F.col("n") <= limit).drop("n")


def literals(lines: DataFrame) -> DataFrame:
    """(repo, path, line, literal): maximal runs of word characters and dots, once a line.

    A literal with neither around it is such a run, so exact searches for values become equality joins. Runs joined by
    a hyphen after an e are kept whole as well, for numbers such as 1e-4.
    """
    runs = F.split("text", r"[^\w.]+")
    powers = F.regexp_extract_all("text", F.lit(r"(?<![\w.])([0-9.]+[eE]-[0-9]+)(?![\w.])"), F.lit(1))
    return lines.select("repo", "path", "line", F.explode(F.array_distinct(F.filter(F.concat(runs, powers), lambda x: x != ""))).alias("literal"))


def _hay() -> Column:
    return F.lower(F.concat_ws(" ", "name", "qualified_name"))


def symbol_index(symbols: DataFrame) -> grams.Index:
    """The index of the names of symbols by repository, for search_symbols."""
    return grams.index(symbols.where("qualified_name is not null").select("repo", _hay().alias("hay")), ["repo"], "hay")


def search_symbols(symbols: DataFrame, queries: DataFrame, limit: int, index: grams.Index | None = None) -> DataFrame:
    """queries (repo, query, terms: array) to the symbols that hold most terms: (repo, query, hits, rank, symbol columns).

    Terms are held anywhere in a name; a term given twice counts twice, an empty one never. They find names through the
    index of the repository, made here if none is given. Equal qualified names are ranked by their order.
    """
    index = index or symbol_index(symbols)
    asked = queries.select("repo", "query", "terms").distinct().select("repo", "query", F.explode("terms").alias("term")).groupBy("repo", "query", "term").agg(F.count("*").alias("times"))
    held = grams.holding(index, asked, grams.FEW_TERMS).groupBy("repo", F.col("name").alias("hay")).agg(F.array_sort(F.collect_set("term")).alias("held"))
    # symbols that hold the same terms are alike to every query, so only the first of them can be among its first
    order = ["qualified_name", *(c for c in ("ordinal",) if c in symbols.columns)]
    alike = grams.dealt(symbols.where("qualified_name is not null").withColumn("hay", _hay())).join(held, ["repo", "hay"]).drop("hay")
    first = kept(alike.withColumn("n", F.row_number().over(Window.partitionBy("repo", "held").orderBy(*order))).where(F.col("n") <= limit).drop("n"))
    each = first.select("repo", "held").distinct().select("repo", "held", F.explode("held").alias("term"))
    met = grams.dealt(asked).join(each, ["repo", "term"]).groupBy("repo", "query", "held").agg(F.sum("times").cast("int").alias("hits"))
    found = grams.dealt(first).join(met, ["repo", "held"]).drop("held")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "query").orderBy(F.desc("hits"), *order))).where(F.col("rank") <= limit)


def query_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"[\s_\-.]+"), lambda t: t != "")


def searched(symbols: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """queries (repo, query) to (repo, query, found, n, best, absence_ref): the best symbol, or a citable absence."""
    found = search_symbols(symbols, queries.select("repo", "query", query_terms(F.col("query")).alias("terms")), limit)
    best = found.groupBy("repo", "query").agg(F.count("*").alias("n"), F.min_by("qualified_name", "rank").alias("best"))
    out = queries.join(best, ["repo", "query"], "left")
    none = F.col("best").isNull()
    return out.select("repo", "query", (~none).alias("found"), F.coalesce("n", F.lit(0)).alias("n"), "best", F.when(none, T.absence_ref(F.col("repo"), F.col("query"), F.lit(METHOD))).alias("absence_ref"))


def _spans(symbols: DataFrame, rank: Column) -> DataFrame:
    return symbols.where("qualified_name is not null").select("repo", F.col("file_path").alias("path"), F.col("line_start").alias("start"), F.coalesce("line_end", "line_start").alias("last"), rank.alias("rank"), F.col("qualified_name").alias("value"))


def enclosing(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """places (repo, path, line, ...) with the symbol around each: the first function or method by order, else the first of any kind."""
    rank = F.col("ordinal").cast("long") + F.when(F.col("kind").isin("function", "method"), 0).otherwise(1 << 40)
    best = intervals.around(places, _spans(symbols, rank), ["repo", "path"], "line").withColumnRenamed("first", "symbol").drop("second")
    return places.join(best, ["repo", "path", "line"], "left")


def callers(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, callee, caller): symbols, first in order, around a line in which a callee's name is followed by a parenthesis; by name only.

    The first two symbols around a line are enough: the second is the caller where the first is the callee itself.
    """
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))
    callee = symbols.where("kind in ('function', 'method', 'class')").select("repo", "name", F.col("qualified_name").alias("callee"))
    calls = lines.select("repo", "path", "line", F.explode(names).alias("name")).join(callee.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    found = intervals.around(calls, _spans(symbols, F.col("ordinal").cast("long")), ["repo", "path"], "line")
    sites = calls.join(found, ["repo", "path", "line"]).select("repo", "name", "first", "second").distinct()
    caller = F.when(F.col("first") == F.col("callee"), F.col("second")).otherwise(F.col("first"))
    return sites.join(callee, ["repo", "name"]).select("repo", "callee", caller.alias("caller")).where("caller is not null").distinct()


def symbol_source(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, qualified_name, source): the lines of each symbol."""
    joined = grams.dealt(symbols.where("qualified_name is not null")).join(grams.dealt(files.select("repo", F.col("path").alias("file_path"), "text")), ["repo", "file_path"])
    n = F.coalesce("line_end", "line_start") - F.col("line_start") + 1
    return joined.select("repo", "qualified_name", F.array_join(F.slice(F.split("text", "\r\n|\n|\r"), F.col("line_start"), n), "\n").alias("source"))


def outline(symbols: DataFrame, files: int = 60, each: int = 6) -> DataFrame:
    """(repo, path, n, listed): the first symbols of each file by line, of the first files by path."""
    s = symbols.where("qualified_name is not null").withColumn("n", F.row_number().over(Window.partitionBy("repo", "file_path").orderBy("line_start", "ordinal")))
    f = s.groupBy("repo", F.col("file_path").alias("path")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= each, F.struct("n", "qualified_name")))), lambda x: x["qualified_name"]), ",").alias("listed"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).where(F.col("place") <= files).drop("place")
