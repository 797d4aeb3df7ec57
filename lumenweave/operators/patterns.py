"""Pattern search over lines of code through the literals that a pattern cannot do without."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grams import N, dealt, grams

#: Lines of a block, as a power of two: the postings name blocks, and the pattern reads the lines of those.
BLOCK = 5
#: Grams of a literal that are asked for.
PROBES = 4


def _best(options: list[set[str] | None]) -> set[str] | None:
    """Of sets one of which suffices, that whose shortest literal is longest; of equals the smaller."""
    sound = [s for s in options if s]
    return max(sound, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _needs(items) -> set[str] | None:
    """Literals of which every match holds one at least; None if nothing is known."""
    found: list[set[str] | None] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= N:
            found.append({run})
        run = ""

    for op, value in items:
        if op is K.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if op is K.IN and len(value) == 2 and all(k is K.LITERAL and v < 128 for k, v in value) and chr(value[0][1]).lower() == chr(value[1][1]).lower():
            run += chr(value[0][1]).lower()  # a letter in either case
            continue
        if op is K.AT:
            continue  # nothing stands between its neighbours
        close()
        if op is K.SUBPATTERN:
            found.append(_needs(value[-1]))
        elif op is K.BRANCH:
            parts = [_needs(x) for x in value[1]]
            found.append(set().union(*parts) if all(parts) else None)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_needs(value[2]))
        elif op is K.ATOMIC_GROUP:
            found.append(_needs(value))
    close()
    return _best(found)


def required(pattern: str) -> list[str] | None:
    """Literals in lower case, of three letters or more, one of which every line that the pattern fits must hold; None if there are none.

    The pattern's structure comes from Python's own reader. What that doesn't read as Java does (quotations, comments,
    classes within classes, flags other than i) gives None, so that every line is read.
    """
    if re.search(r"\\[QEGRhHXkpPzZNv0]|&&|\(\?(?!:|=|!|<=|<!|i\)|>)|\[\[|\[\^?\]", pattern):
        return None
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    found = _needs(tree)
    return sorted(found) if found else None


def may_fit(lowered: Column, pattern: str) -> Column:
    """Whether a text, given in lower case, holds a literal that the pattern needs; true if none is known."""
    needs = required(pattern) or []
    least = [x for x in needs if not any(y != x and y in x for y in needs)]
    return reduce(Column.__or__, (F.contains(lowered, F.lit(x)) for x in least)) if least else F.lit(True)


def line_index(lines: DataFrame) -> DataFrame:
    """lines (repo, path, line, text) to postings (gram, repo, path, block), in order of grams within each part when written.

    Grams are runs of three letters in lower case; a block's lines give each of its grams once.
    """
    block = F.shiftright(F.col("line").cast("long"), BLOCK)
    runs = F.filter(grams(F.lower("text")), lambda g: F.length(g) == N)
    return lines.select("repo", "path", block.alias("block"), F.explode(runs).alias("gram")).distinct().select("gram", "repo", "path", "block")


def written_index(lines: DataFrame, path: str) -> DataFrame:
    """The index as a Parquet table dealt and sorted by grams, so that a search reads the row groups of its own grams."""
    spark = lines.sparkSession
    line_index(lines).repartitionByRange("gram").sortWithinPartitions("gram", "repo", "path").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _probes(literal: str) -> list[str]:
    """Grams of a literal, spread over it."""
    own = [literal[i : i + N] for i in range(len(literal) - N + 1)]
    step = max(1, len(own) // PROBES)
    return sorted({*own[::step][:PROBES], own[-1]})


def candidates(index: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(name, repo, path, block): blocks that hold all grams asked for of a literal of the pattern. Patterns without literals have none."""
    rows = [(name, lit, g, len(_probes(lit))) for name, p in patterns.items() for lit in required(p) or [] for g in _probes(lit)]
    asked = index.sparkSession.createDataFrame(rows, "name string, literal string, gram string, probes int")
    wanted = sorted({r[2] for r in rows})
    met = index.where(F.col("gram").isin(wanted)).join(F.broadcast(asked), "gram") if wanted else index.join(asked, "gram")
    full = met.groupBy("name", "literal", "repo", "path", "block", "probes").agg(F.count("*").alias("n")).where("n = probes")
    return full.select("name", "repo", "path", "block").distinct()


def search(lines: DataFrame, patterns: dict[str, str], index: DataFrame | None = None) -> DataFrame:
    """lines (repo, path, line, text) to (name, repo, path, line, text): the lines that each pattern fits, as by reading all of them.

    With an index, a pattern with literals reads the blocks that hold them, all others every line. Null texts fit nothing;
    a line that is given twice is found twice. patterns are stated, so their grams are few and are broadcast.
    """
    free = {n: p for n, p in patterns.items() if index is None or required(p) is None}
    bound = {n: p for n, p in patterns.items() if n not in free}
    columns = ["name", "repo", "path", "line", "text"]
    parts = []
    if free:
        fits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in free.items())))
        parts.append(lines.select(F.explode(fits).alias("name"), "repo", "path", "line", "text").select(*columns))
    if bound:
        fit = reduce(lambda out, x: F.when(F.col("name") == x[0], F.col("text").rlike(x[1])).otherwise(out), bound.items(), F.lit(False))
        near = lines.withColumn("block", F.shiftright(F.col("line").cast("long"), BLOCK)).join(dealt(candidates(index, bound)), ["repo", "path", "block"])
        parts.append(near.where(fit).select(*columns))
    return reduce(DataFrame.unionByName, parts) if parts else _none(lines.sparkSession)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "name string, repo string, path string, line int, text string")
