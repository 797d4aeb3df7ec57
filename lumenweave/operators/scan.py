"""One pass over paper sources: every marked place of a text as an event row.

Balanced braces and nested environments are beyond regular expressions. `Marks` notes all braces, commands and
environment edges of a text in one pass, and events are read off these marks. All numbering, deduplication and
attribution of events is left to DataFrame operators.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from functools import partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Environments by what they hold.
MATH_ONE, MATH_ROWS = {"equation", "multline"}, {"align", "gather", "eqnarray", "alignat", "flalign"}
LISTINGS = {"algorithm", "algorithmic", "algorithm2e", "lstlisting", "verbatim", "minted", "Verbatim"}
FIGURES = {"figure", "figure*"}
MATH = MATH_ONE | MATH_ROWS | {f"{x}*" for x in MATH_ONE | MATH_ROWS}
LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}

CITES = {"citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "cite"}

# Patterns of addresses and stated numbers.
_ADDRESS = re.compile(r"(?:\\url\{|\\href\{)?(https?://[^\s{}\\,;)\]]+|(?<![\w/])github\.com/[^\s{}\\,;)\]]+)")
_NUMBER = r"(?:\d+(?:\.\d+)?(?:\s*[eE]\s*-?\d+)?|\d*\.\d+)"
_NAME = r"\$?\\?([A-Za-z][A-Za-z0-9_\\{}^]{0,24})\$?\s*"
_STATED = [
    re.compile(_NAME + r"(?:was|is|were|are)?\s*(?:initiali[sz]ed|set)\s+to\s+(?:the\s+equivalent\s+of\s+)?(" + _NUMBER + ")", re.I),
    re.compile(_NAME + r"=\s*(" + _NUMBER + ")"),
    re.compile(r"\b([a-z][a-z\s\-]{2,30}?)\s+of\s+(" + _NUMBER + r")\b", re.I),
]
# what a paragraph must hold for each of them; the patterns themselves are slow
_SIGNS = [re.compile(r"(?i)set\s+to|initiali[sz]ed\s+to"), re.compile(r"=\s*[\d.]"), re.compile(r"(?i)\sof\s+[\d.]")]
_DISPLAY = re.compile(r"\\\[(.+?)\\\]", re.S)

EVENTS = "paper_version string, kind string, pos int, sub int, stop int, name string, arg string, body string, context string, flag boolean"
_COLUMNS = [x.split()[0] for x in EVENTS.split(", ")]

_MARK = re.compile(r"[{}]|\\(?P<edge>begin|end)\{(?P<env>[A-Za-z][A-Za-z0-9*]*)\}|\\(?P<command>[A-Za-z]+)(?P<star>\*?)")
_OPTIONS = re.compile(r"\s*(?:\[[^\]]*\]\s*)*")


class Span(NamedTuple):
    """An environment: where it starts and stops, and its body within."""

    start: int
    stop: int
    name: str
    inner: int
    outer: int


class Command(NamedTuple):
    at: int
    name: str
    star: bool
    after: int


class Marks:
    """Braces with their partners, commands, and environments of a text."""

    def __init__(self, text: str):
        self.text, self.partner, self.commands, self.spans = text, {}, [], []
        waiting, begun = [], defaultdict(list)
        for m in _MARK.finditer(text):
            if m["command"]:
                self.commands.append(Command(m.start(), m["command"], m["star"] == "*", m.end()))
            elif m["edge"] == "begin":
                begun[m["env"]].append(m.span())
            elif m["edge"]:
                if begun[m["env"]]:
                    start, inner = begun[m["env"]].pop()
                    self.spans.append(Span(start, m.end(), m["env"], inner, m.start()))
            elif m[0] == "{":
                waiting.append(m.start())
            elif waiting:
                self.partner[waiting.pop()] = m.start()
        self.spans.sort()
        self._at = [c.at for c in self.commands]

    def group(self, at: int) -> tuple[str, int]:
        """What the brace at a place encloses, and the place after its end; an open group runs to the end."""
        end = self.partner.get(at, len(self.text))
        return self.text[at + 1 : end], min(end + 1, len(self.text))

    def short_group(self, after: int, options: bool = False) -> tuple[str, int] | None:
        """The group that follows a command, up to the first closing brace, and the place after it; None if it is empty or isn't there."""
        at = _OPTIONS.match(self.text, after).end() if options else after
        end = self.text.find("}", at)
        return (self.text[at + 1 : end], end + 1) if self.text[at : at + 1] == "{" and end > at + 1 else None

    def named(self, *names: str, start: int = 0, stop: int | None = None) -> list[Command]:
        """Commands of some names between two places."""
        within = self.commands[bisect_left(self._at, start) : None if stop is None else bisect_left(self._at, stop)]
        return [c for c in within if c.name in names]

    def label(self, start: int, stop: int) -> str | None:
        """The first label between two places."""
        for c in self.named("label", start=start, stop=stop):
            end = self.text.find("}", c.after)
            if not c.star and self.text[c.after : c.after + 1] == "{" and 0 < end < stop:
                return self.text[c.after + 1 : end]
        return None

    def outermost(self, names: set[str]) -> list[Span]:
        """Environments of some names that lie in no other of them."""
        out: list[Span] = []
        for s in self.spans:
            if s.name in names and (not out or s.start >= out[-1].stop):
                out.append(s)
        return out


_IN_TITLE = re.compile(r"\\label\{[^}]*\}|\\[a-zA-Z]+\s*|[{}]")


def title_text(raw: str) -> str:
    """A heading without labels, command names and braces."""
    return _IN_TITLE.sub("", raw).strip()


def rows_of(body: str) -> list[str]:
    """Rows of a display, cut at double backslashes outside braces, each with its spacing argument; blank ones go."""
    cuts, depth, at, out = re.compile(r"\{|\}|\\\\(?:\s*\[[^\]]*\])?"), 0, 0, []
    for m in cuts.finditer(body):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(body[at : m.start()])
            at = m.end()
    return [r for r in [*out, body[at:]] if r.strip()]


def around(text: str, at: int, reach: int = 240) -> str:
    return " ".join(text[max(0, at - reach) : at + reach].split())


def sentence(text: str, at: int, reach: int = 260) -> str:
    """The sentence that holds a place, within reach of it."""
    low = max(0, at - reach)
    window = text[low : at + reach]
    starts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?])\s+", window))]
    begin = max(s for s in starts if s <= at - low)
    end = next((m.start() for m in re.finditer(r"(?<=[.!?])\s+", window) if m.start() >= at - low), len(window))
    return " ".join(window[begin:end].split())


def _headings(m: Marks):
    heads = []
    for c in m.named(*LEVELS):
        brace = len(m.text) - len(m.text[c.after :].lstrip()) if m.text[c.after : c.after + 1].isspace() else c.after
        if m.text[brace : brace + 1] == "{":
            heads.append((c, brace))
    late = m.named("appendix")[:1]
    for i, (c, brace) in enumerate(heads):
        raw, after = m.group(brace)
        end = heads[i + 1][0].at if i + 1 < len(heads) else len(m.text)
        body = m.text[after:end]
        gap = after + len(body) - len(body.lstrip())
        label = m.label(brace, after) or (m.label(gap, end) if m.text.startswith("\\label{", gap) else None)
        yield "heading", c.at, i, end, title_text(raw), label, body.strip(), str(LEVELS[c.name]) + ("a" if late and c.at > late[0].at else ""), c.star


def _displays(m: Marks):
    tex = m.text
    scheme = re.search(r"\\numberwithin\s*\{\s*equation\s*\}|\\renewcommand\s*\{?\s*\\theequation\s*\}?|\\def\s*\\theequation|\\counterwithin\s*\{\s*equation\s*\}", tex)
    shown = [(s.start, s.name, tex[s.inner : s.outer]) for s in m.outermost(MATH)]
    shown += [(d.start(), "displaymath", d[1]) for d in _DISPLAY.finditer(tex)]
    for i, (start, name, body) in enumerate(sorted(shown, key=lambda x: x[0])):
        numbered = not name.endswith("*") and name != "displaymath"
        guess = bool(scheme or re.search(r"\\tag\*?\{", body))
        for j, row in enumerate(rows_of(body) if name in MATH_ROWS else [body]):
            own = Marks(row)
            yield "equation", start, j, i, name, own.label(0, len(row)), row, "guess" if guess else None, numbered and not own.named("nonumber", "notag")


def _caption(m: Marks, s: Span, last_of_line: bool) -> str | None:
    """A caption's text up to the first closing brace, or to the first one that ends a line."""
    for c in m.named("caption", start=s.inner, stop=s.outer):
        end = m.text.find("}", c.after + 2, s.outer) if m.text[c.after : c.after + 1] == "{" else -1
        while last_of_line and end >= 0 and m.text[end + 1 : s.outer].split("\n")[0].strip():
            end = m.text.find("}", end + 1, s.outer)
        if end >= 0:
            return title_text(m.text[c.after + 1 : end])
    return None


def _pseudocode(m: Marks):
    """Listings, and figures that show an algorithm as an image."""
    for s in m.outermost(LISTINGS):
        yield "algorithm", s.start, 0, s.stop, s.name, _caption(m, s, True), m.text[s.inner : s.outer].strip(), None, True
    for s in m.outermost(FIGURES):
        caption = (_caption(m, s, False) or "") if m.named("includegraphics", start=s.inner, stop=s.outer) else ""
        if re.search(r"(?i)pseudo\s*-?code|algorithm", caption):
            yield "algorithm", s.start, 1, s.stop, "figure", caption, None, None, False


def _numbers(tex: str):
    at = 0
    for gap in [*re.finditer(r"\n\s*\n", tex), None]:
        paragraph = tex[at : gap.start() if gap else len(tex)]
        for k, (pattern, sign) in enumerate(zip(_STATED, _SIGNS)):
            for s in pattern.finditer(paragraph) if sign.search(paragraph) else ():
                yield "value", at + s.start(), k, at, re.sub(r"[\\${}]", "", s[1]).strip(), s[2].replace(" ", ""), None, around(paragraph, s.start()), True
        at = gap.end() if gap else at


def _addresses(m: Marks):
    abstract = m.outermost({"abstract"})[:1]
    for a in _ADDRESS.finditer(m.text):
        url = a[1].rstrip(".:")  # the pattern leaves out other marks
        full = url if "://" in url else f"https://{url}"
        yield "url", a.start(), 0, a.end(), full, None, None, around(m.text, a.start()), any(s.start <= a.start() <= s.stop for s in abstract)


def _citations(m: Marks):
    for c in m.named(*CITES):
        if found := m.short_group(c.after, options=True):
            keys = [k.strip() for k in found[0].split(",")]
            yield from (("cite", c.at, j, found[1], key, c.name, None, sentence(m.text, c.at), True) for j, key in enumerate(keys) if key)


#: Readers of marks by the kind of event that they give.
READERS = {"heading": _headings, "equation": _displays, "algorithm": _pseudocode, "value": lambda m: _numbers(m.text), "url": _addresses, "cite": _citations}


def events_of(tex: str, kinds=None, readers=None):
    """(kind, pos, sub, stop, name, arg, body, context, flag) of a text, of the asked kinds or all.

    A reader that fails gives one event of kind error (name: the reader, arg: the error, body: its message) instead of its own.
    """
    m = None
    for kind, read in (readers or READERS).items():
        if not kinds or kind in kinds:
            try:
                m = m or Marks(tex)
                found = list(read(m))
            except Exception as e:  # whatever a text does to one reader, the others and other papers go on
                found = [("error", 0, 0, 0, kind, type(e).__name__, str(e)[:1000], None, False)]
            yield from found


#: Papers whose events a worker holds at once.
AT_ONCE = 200


def _with_lines(kinds, readers, batches):
    for b in (x.iloc[i : i + AT_ONCE] for x in batches for i in range(0, max(len(x), 1), AT_ONCE)):
        rows = []
        for pv, tex in zip(b["paper_version"], b["tex"]):
            tex = tex or ""
            breaks = [m.start() for m in re.finditer("\n", tex)]
            for e in events_of(tex, kinds, readers):
                rows.append((pv, *e, bisect_left(breaks, e[1]) + 1, bisect_left(breaks, e[3]) + 1 if e[0] == "heading" else None))
        yield pd.DataFrame(rows, columns=[*_COLUMNS, "line", "last_line"]).astype({"last_line": "Int64"})


def events(papers: DataFrame, kinds: list[str] | None = None, readers: dict | None = None) -> DataFrame:
    """papers (paper_version, tex) to events, of some kinds or all, with line (of pos) and last_line (of a heading's end).

    A null text has none. Where a reader fails on a text there is an event of kind error in place of its events.
    """
    spark = papers.sparkSession
    rows = papers.select("paper_version", "tex")
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # parsing is slow for its bytes
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return rows.mapInPandas(partial(_with_lines, kinds, readers), EVENTS + ", line int, last_line int")


# Patterns of bibliographies, and commands whose group is kept as it is.
PREPRINT = r"(?i)arxiv[:\s]*(?:preprint\s*)?(?:arxiv:)?\s*(\d{4}\.\d{4,5})"
DOI, YEAR, EPRINT = r"\b(10\.\d{4,9}/[^\s,}]+)", r"\b(?:19|20)\d{2}\b", r"^\s*(\d{4}\.\d{4,5})"
_ITEM = re.compile(r"\\bibitem(?:\[[^\]]*\])?\s*\{([^}]+)\}|\\newblock")
_RECORD = re.compile(r"@\w+\s*\{\s*([^,\s]+)\s*,")
_FIELD = re.compile(r"(\w+)\s*=\s*[{\"]([^}\"]*)")
_MARKUP = re.compile(r"\\(?:emph|textit|textbf|url|href)\s*(?=\{)|(\\[a-zA-Z]+\s*|~)|[{}]")

BIB = "paper_version string, file string, bib_key string, ordinal int, fields array<string>, raw string, named map<string,string>"


def plain(text: str) -> str:
    """Text without markup, on one line."""
    return " ".join(_MARKUP.sub(lambda m: " " if m[1] else "", text).split())


def bbl_entries(text: str):
    """(key, ordinal, fields, None, None): an entry's fields lie between its marks."""
    marks = [*_ITEM.finditer(text)]
    entries: list[tuple[str, list[str]]] = []
    for m, after in zip(marks, [*(x.start() for x in marks[1:]), len(text)]):
        if m[1]:
            entries.append((m[1].strip(), []))
        if entries and (field := plain(text[m.end() : after])):
            entries[-1][1].append(field)
    yield from ((key, i, fields, None, None) for i, (key, fields) in enumerate(entries))


def bib_entries(text: str):
    """(key, ordinal, None, raw, named fields): records start with @, at the start of a line but for the first."""
    n = 0
    for i, piece in enumerate(text.split("\n@")):
        record = f"@{piece}" if i else piece
        if m := _RECORD.search(record):
            body = record[m.end() :]
            named = {"body": body}
            for name, value in _FIELD.findall(body):
                named.setdefault(name.lower(), plain(value))
            yield m[1].strip(), n, None, plain(body), named
            n += 1


def _bibliography(reader, batches):
    for b in batches:
        rows = [(pv, f, *e) for pv, f, t in zip(b["paper_version"], b["file"], b["text"]) for e in reader(t or "")]
        yield pd.DataFrame(rows, columns=["paper_version", "file", "bib_key", "ordinal", "fields", "raw", "named"])


def _found(text, pattern: str, group: int):
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _of_bbl(rows: DataFrame) -> DataFrame:
    """The first field names the authors; the title is the next of more than two words that names no preprint, else the next."""
    raw, later = F.array_join("fields", " "), F.slice("fields", 2, F.greatest(F.size("fields"), F.lit(1)))
    long = F.filter(later, lambda x: (F.size(F.split(x, " ")) > 2) & ~F.lower(x).startswith("arxiv"))
    title = F.coalesce(F.try_element_at(long, F.lit(1)), F.try_element_at(later, F.lit(1)))
    return rows.select(
        "paper_version", "file", "bib_key", "ordinal", F.substring(raw, 1, 1200).alias("raw"), F.try_element_at("fields", F.lit(1)).alias("authors"), F.nullif(F.rtrim(title, F.lit(".")), F.lit("")).alias("title"),
        _found(raw, YEAR, 0).cast("int").alias("year"), _found(raw, PREPRINT, 1).alias("arxiv_id"), F.rtrim(_found(raw, DOI, 1), F.lit(".")).alias("doi"),
    )


def _of_bib(rows: DataFrame) -> DataFrame:
    """A field is the first whose name ends as asked, so a book's title stands in for a title after it."""
    entry = lambda name: F.try_element_at(F.filter(F.map_entries("named"), lambda e: e["key"].endswith(name) & (e["key"] != "body")), F.lit(1))["value"]
    body, year = F.try_element_at("named", F.lit("body")), entry("year")
    return rows.select(
        "paper_version", "file", "bib_key", "ordinal", F.substring("raw", 1, 1200).alias("raw"), entry("author").alias("authors"), entry("title").alias("title"),
        F.when(year.rlike("^[0-9]+$"), year.try_cast("int")).alias("year"), F.coalesce(_found(entry("eprint"), EPRINT, 1), _found(body, PREPRINT, 1)).alias("arxiv_id"), entry("doi").alias("doi"),
    )


def bibliography(files: DataFrame) -> DataFrame:
    """files (paper_version, file, kind: bbl or bib, text) to entries: of a key the last by file and place; bib files only of papers without entries in bbl files."""
    read = lambda kind, f: files.where(F.col("kind") == kind).select("paper_version", "file", "text").mapInPandas(partial(_bibliography, f), BIB)
    first = _of_bbl(read("bbl", bbl_entries))
    second = _of_bib(read("bib", bib_entries)).join(first.select("paper_version").distinct(), "paper_version", "left_anti")
    rest = ["raw", "authors", "title", "year", "arxiv_id", "doi"]
    return first.unionByName(second).groupBy("paper_version", "bib_key").agg(F.max_by(F.struct(*rest), F.struct("file", "ordinal")).alias("x")).select("paper_version", "bib_key", "x.*")
