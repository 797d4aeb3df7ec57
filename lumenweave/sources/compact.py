"""The compact text format of code indexes: aliases, scalars, and tables whose rows are CSV with cells over several lines.

A reader walks the lines with one state, whether it is still in the header. Header lines give facts; the one that names
the tables ends the header; then every cell is a fact of its own, (table, row, column, value). Rows are put together from
cells by DataFrame functions.
"""

from __future__ import annotations

import csv
import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = "#MUNCH/"
_KEY = re.compile(r"(\w[\w.]*)=")
_REFERENCE = re.compile(r"@\d+")
_STRING = json.JSONDecoder()


class Fact(NamedTuple):
    """A scalar (table and row are None) or a cell."""

    table: str | None
    row: int | None
    column: str
    value: str


class Table(NamedTuple):
    name: str
    columns: list[str]


def is_compact(text: str) -> bool:
    return text.lstrip().startswith(MAGIC)


def _settings(line: str) -> Iterator[tuple[str, str]]:
    """name=value settings of a header line; values are JSON strings or run to the next white space."""
    at = 0
    while m := _KEY.search(line, at):
        if line.startswith('"', m.end()):
            try:
                value, at = _STRING.raw_decode(line, m.end())
            except ValueError:  # a quote that isn't closed, or escapes that JSON lacks
                end = line.find('"', m.end() + 1)
                value, at = line[m.end() + 1 : end if end > 0 else None], end + 1 if end > 0 else len(line)
        else:
            word = line[m.end() :].split(maxsplit=1)
            value = word[0] if word and not line[m.end() : m.end() + 1].isspace() else ""
            at = m.end() + max(1, len(value))
        if value:
            yield m[1], value


def _tables(spec: str) -> dict[str, Table]:
    """tag:name:column|column|... of each table; those without columns are left out."""
    parts = (x.split(":") for x in spec.split(";"))
    return {tag: Table(name, columns.split("|")) for tag, name, columns, *_ in (p for p in parts if len(p) > 2)}


def facts(text: str) -> Iterator[Fact]:
    """Scalars, then cells in order; rows that are malformed or of an unknown table are left out."""
    lines, aliases, tables = iter(text.splitlines()), {}, None
    for line in lines:
        if line.startswith("@") and line[1:].partition("=")[0].isdigit():
            alias, _, whole = line.rstrip().partition("=")
            aliases[alias] = whole
        elif not line.startswith(MAGIC):
            for name, value in _settings(line):
                if name == "__tables":
                    tables = _tables(value)
                elif not name.startswith("__"):
                    yield Fact(None, None, name, value)
        if tables is not None:
            break
    seen: Counter[str] = Counter()
    try:
        for tag, *cells in filter(None, csv.reader(f"{line}\n" for line in lines)):
            if tag in (tables or {}):
                name, columns = tables[tag]
                for column, cell in zip(columns, cells):
                    yield Fact(name, seen[name], column, _REFERENCE.sub(lambda m: aliases.get(m[0], m[0]), cell))
                seen[name] += 1
    except csv.Error:  # what comes after a cell that never ends is no table
        return


def absence(text: str) -> str | None:
    """The reference to a search that found nothing, which an answer carries in its absence_evidence or as a field."""
    within = re.search(r"absence_evidence=.*?(absent:[0-9a-f]+)|\"ref\"\s*:\s*\"(absent:[0-9a-f]+)\"", text)
    return within and (within[1] or within[2])


def _facts_of(batches):
    for b in batches:
        out = [(i, *f) for i, t in zip(b["id"], b["text"]) for f in facts(t or "")]
        yield pd.DataFrame(out, columns=["id", "name", "ordinal", "column", "value"]).astype({"ordinal": "Int64"})


def read(answers: DataFrame) -> DataFrame:
    """answers (id, text) to facts (id, name, ordinal, column, value); scalars have neither name nor ordinal."""
    return answers.select("id", "text").mapInPandas(_facts_of, "id string, name string, ordinal int, column string, value string")


def rows(answers: DataFrame) -> DataFrame:
    """answers (id, text) to every table row as (id, name, ordinal, cells: map)."""
    cells = F.map_from_entries(F.collect_list(F.struct("column", "value")))
    return read(answers).where("name is not null").groupBy("id", "name", "ordinal").agg(cells.alias("cells"))


def scalars(answers: DataFrame) -> DataFrame:
    """answers (id, text) to (id, name, text, number, flag): a scalar's text, and what it is if that is a whole number or a truth value."""
    found = read(answers).where("name is null").select("id", F.col("column").alias("name"), F.col("value").alias("text"))
    return found.withColumns({"number": F.when(F.col("text").rlike("^[0-9]+$"), F.col("text").try_cast("long")), "flag": F.when(F.col("text").isin("true", "false"), F.col("text") == "true")})
