"""Entities of papers from scanned events: numbering is replayed by windows, firsts win by explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import MATH_ROWS  # noqa: F401  (named by callers that build displays)

# Words that aren't names of quantities, function words, typesetting options, residue of markup.
NOT_NAMES = ["one", "two", "table", "figure", "section", "equation", "which", "that", "the", "consists", "comprises", "contains", "includes", "uses", "requires", "consisting", "containing", "including", "total", "set", "number"]
FUNCTION_WORDS = ["to", "the", "a", "an", "and", "or", "is", "was", "were", "are", "be", "been", "that", "which", "from", "with", "by", "for", "in", "on", "at", "as", "it", "we", "our", "this", "these"]
LAYOUT_WORDS = [
    "width", "height", "scale", "trim", "clip", "angle", "columnwidth", "textwidth", "linewidth", "columnsep", "vspace", "hspace", "baselinestretch", "arraystretch", "tabcolsep", "fboxrule",
    "hsize", "vsize", "parskip", "parindent", "col", "row", "pt", "em", "aboverulesep", "belowrulesep", "heavyrulewidth", "lightrulewidth", "cmidrulewidth", "out",
]
MARKUP = r"(?i)^(begin|end|adjustbox|includegraphics|multirow|multicolumn|cmidrule|midrule|toprule|bottomrule)"
REPEATED = r"(?i)(times|frac|cdot|quad|hspace|vspace).*\1"
MOST_VALUES = 400

PAPER = "paper_version"


def _of(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind") == kind)


def sections(events: DataFrame) -> DataFrame:
    """Section rows with their spans (pos, stop).

    A number's last part counts numbered headings of its level since the last shallower one; counting starts anew in the
    appendix, whose top level prints as letters. Starred and run-in headings take a slug and count nothing.
    """
    h = _of(events, "heading").withColumns({"level": F.substring("context", 1, 1).cast("int"), "late": F.endswith("context", F.lit("a")), "ordinal": F.col("sub")})
    h = h.withColumn("counts", (~F.col("flag")) & (F.col("level") < 4))
    outer = [PAPER, "late"]
    running = lambda level, by: F.sum(F.when(F.col("counts") & (F.col("level") == level), 1).otherwise(0)).over(Window.partitionBy(*outer, *by).orderBy("ordinal"))
    h = h.withColumn("n1", running(1, [])).withColumn("n2", running(2, ["n1"])).withColumn("n3", running(3, ["n1", "n2"]))
    top = F.when(F.col("late"), F.char(F.lit(64) + F.col("n1"))).otherwise(F.col("n1").cast("string"))
    number = F.concat_ws(".", top, F.when(F.col("level") > 1, F.col("n2")), F.when(F.col("level") > 2, F.col("n3")))
    path = F.when(F.col("counts"), number).otherwise(F.concat(F.lit("*"), T.slugify(F.col("name"), 40)))
    return h.select(
        PAPER, path.alias("section_path"), "level", F.col("name").alias("title"), F.col("arg").alias("latex_label"), "body", F.col("line").alias("src_line_start"), F.col("last_line").alias("src_line_end"), "ordinal", "pos", "stop",
        F.concat(F.col(PAPER), F.lit(":sec:"), path).alias("id"),
    )


def located(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """rows (paper_version, pos, ...) with section_id of the heading before pos, by one pass in order of place (an as-of join)."""
    spans = sections.select(PAPER, "pos", F.lit(0).alias("_late"), F.col("id").alias("_section"))
    both = rows.withColumn("_late", F.lit(1)).unionByName(spans, allowMissingColumns=True)
    before = Window.partitionBy(PAPER).orderBy("pos", "_late").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section_id", F.last("_section", ignorenulls=True).over(before)).where("_late = 1").drop("_late", "_section")


def equations(events: DataFrame) -> DataFrame:
    """Displayed equations, row by row, with the number that counting would print and how far it can be trusted."""
    e = _of(events, "equation")
    in_order = Window.partitionBy(PAPER).orderBy("pos", "sub")
    number = F.when(F.col("flag"), F.sum(F.col("flag").cast("int")).over(in_order).cast("string"))
    e = e.withColumn("derived_number", number)
    trust = F.when(F.col("derived_number").isNull(), "UNKNOWN").when(F.col("context") == "guess", "POSSIBLE").otherwise("LIKELY")
    return e.select(PAPER, T.content_hash(F.col("body")).alias("content_hash"), F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")).alias("latex"), F.col("name").alias("environment"), F.col("flag").alias("is_numbered"), "derived_number", trust.alias("number_conf"), F.col("arg").alias("latex_label"), F.col("line").alias("src_line"), F.col("stop").alias("ordinal"), "sub", "pos")


def algorithms(events: DataFrame) -> DataFrame:
    """Algorithm blocks, then pictures of algorithms; repeated slugs are numbered from 2 in that order."""
    a = _of(events, "algorithm")
    title = F.nullif(F.col("arg"), F.lit(""))
    slug = T.slugify(F.coalesce(title, F.concat(F.col("name"), F.lit("-l"), F.col("line"))))
    a = a.withColumn("base", slug).withColumn("n", F.row_number().over(Window.partitionBy(PAPER, "base").orderBy("sub", "pos")))
    kind = F.when(~F.col("flag"), "figure_image").when(F.col("name").startswith("algorithm"), "latex_env").otherwise("listing")
    return a.select(PAPER, F.when(F.col("n") > 1, F.concat("base", F.lit("-"), "n")).otherwise(F.col("base")).alias("slug"), title.alias("name"), "body", kind.alias("presentation"), F.col("flag").alias("extractable"), F.col("line").alias("src_line"), "pos")


def stated_values(events: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """Named numbers of the prose; of equal (name, number) the first, up to most for each paper in order of paragraph, pattern and place."""
    v = _of(events, "value").select(PAPER, F.col("stop").alias("paragraph"), F.col("sub").alias("pattern"), "pos", F.col("name").alias("symbol"), F.col("arg").alias("value_text"), "context", F.col("line").alias("src_line"))
    words = F.split(F.trim(F.lower("symbol")), r"\s+")
    prose = (F.size(words) > 1) & F.arrays_overlap(words, T.strings(FUNCTION_WORDS))
    odd = F.col("symbol").rlike(MARKUP) | F.col("symbol").rlike(REPEATED) | ((F.length("symbol") > 18) & ~F.col("symbol").rlike("[_ -]"))
    good = (F.col("symbol") != "") & ~F.lower("symbol").isin(NOT_NAMES) & (F.length("symbol") <= 30) & ~prose & ~F.element_at(words, -1).isin(LAYOUT_WORDS) & ~odd
    order = ["paragraph", "pattern", "pos"]
    first = F.row_number().over(Window.partitionBy(PAPER, F.lower("symbol"), "value_text").orderBy(*order))
    kept = v.where(good).withColumn("n", first).where("n = 1").withColumn("ordinal", F.row_number().over(Window.partitionBy(PAPER).orderBy(*order)) - 1).where(F.col("ordinal") < most)
    return kept.select(PAPER, F.concat(F.col(PAPER), F.lit(":val:"), F.col("ordinal")).alias("id"), "ordinal", "symbol", "value_text", F.col("value_text").try_cast("double").alias("value_num"), "context", "src_line", "pos")


def declared_urls(events: DataFrame) -> DataFrame:
    """Addresses in a paper, each once, with the repository that it names."""
    u = _of(events, "url").withColumn("n", F.row_number().over(Window.partitionBy(PAPER, "name").orderBy("pos"))).where("n = 1")
    hub = r"(?i)github\.com/([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+)"
    part = lambda i: F.nullif(F.regexp_extract("name", hub, i), F.lit(""))
    order = F.row_number().over(Window.partitionBy(PAPER).orderBy("pos")) - 1
    return u.select(PAPER, order.alias("ordinal"), F.col("name").alias("url"), F.lower(F.substring_index(F.regexp_replace("name", "^https?://", ""), "/", 1)).alias("host"), part(1).alias("owner"), F.regexp_replace(part(2), r"\.git$", "").alias("repo"), "context", F.col("flag").alias("in_abstract"), F.col("line").alias("src_line"), "pos")


def citation_sites(events: DataFrame) -> DataFrame:
    c = _of(events, "cite")
    order = F.row_number().over(Window.partitionBy(PAPER).orderBy("pos", "sub")) - 1
    return c.select(PAPER, order.alias("ordinal"), F.col("name").alias("bib_key"), F.col("arg").alias("command"), "context", F.col("line").alias("src_line"), "pos")


def errors(events: DataFrame) -> DataFrame:
    """(paper_version, step, error, message): what failed on a paper, beside what didn't."""
    return _of(events, "error").select(PAPER, F.col("name").alias("step"), F.col("arg").alias("error"), F.col("body").alias("message"))


def bibliography_with_sites(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """Entries with cite_count; keys that are cited but not listed are kept as empty entries."""
    n = sites.groupBy(PAPER, "bib_key").agg(F.count("*").alias("cite_count"))
    return entries.join(n, [PAPER, "bib_key"], "full_outer").withColumns({"raw": F.coalesce("raw", F.lit("")), "cite_count": F.coalesce("cite_count", F.lit(0))})


def components(sections: DataFrame) -> DataFrame:
    """Sections whose title names a component kind; of equal slugs the first."""
    rows = sections.withColumns({"kind": T.kind_of_title(F.col("title")), "slug": T.slugify(F.col("title"))}).where("kind is not null")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(PAPER, "slug").orderBy("ordinal"))).where("n = 1")
    about = F.substring(F.trim(F.regexp_replace("body", r"\s+", " ")), 1, 400)
    return first.select(PAPER, F.concat(F.col(PAPER), F.lit(":comp:"), F.col("slug")).alias("id"), "slug", F.col("title").alias("name"), "kind", about.alias("description"), F.col("id").alias("section_id"), F.lit("DETERMINISTIC").alias("source"))


def ingest(events: DataFrame, bibliography: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of papers from their events, each located in its section."""
    s = sections(events)
    c = citation_sites(events)
    at = lambda rows, tag, key: located(rows, s).withColumn("id", F.concat(F.col(PAPER), F.lit(f":{tag}:"), F.col(key)))
    out = {"sections": s, "equations": at(equations(events), "eq", "content_hash"), "algorithms": at(algorithms(events), "algo", "slug"), "stated_values": located(stated_values(events), s), "declared_urls": at(declared_urls(events), "url", "ordinal"), "citation_sites": at(c, "cite", "ordinal"), "components": components(s)}
    if bibliography is not None:
        out["bib_entries"] = bibliography_with_sites(bibliography, c)
    return out


def paper_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(paper_version, entity, n), and numbered equations and algorithms without text as entities of their own."""
    parts = [t.groupBy(PAPER).agg(F.count("*").alias("n")).withColumn("entity", F.lit(name)) for name, t in sorted(tables.items())]
    if "equations" in tables:
        parts.append(tables["equations"].groupBy(PAPER).agg(F.count_if("is_numbered").alias("n")).withColumn("entity", F.lit("numbered_equations")))
    if "algorithms" in tables:
        parts.append(tables["algorithms"].groupBy(PAPER).agg(F.count_if(~F.col("extractable")).alias("n")).withColumn("entity", F.lit("unextractable_algorithms")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(PAPER, "entity", "n")
