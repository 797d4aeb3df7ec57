"""Papers against source trees: values, components and algorithms mapped, differences and gaps established."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.landing import kept
from . import codeindex, grams, patterns

PAIR = ["paper_version", "repo"]
MOST_HITS, MANY_HITS = 25, 6

# What a component's symbol is called, by kind.
SYMBOL_KINDS = {
    "loss": r"loss|criterion|objective", "training": r"train|fit|optimi[sz]", "dataset": r"data|dataset|loader|corpus", "architecture": r"model|net|module|layer|encoder|decoder|transformer",
    "preprocessing": r"preprocess|transform|augment|token", "evaluation": r"eval|test|benchmark|metric", "inference": r"infer|predict|generate|sample|decode|forward", "optimizer": r"optimi[sz]|schedul", "module": r"module|block|head|pool|embed",
}
# Behaviours as (name, in papers, in code, kind of difference, severity).
BEHAVIOURS = [
    ("value clipping", r"\bclipp?(?:ed|ing)\b|\bclamp(?:ed|ing)?\b", r"\bclamp\b|\.clip\(|np\.clip|torch\.clamp", "TRAINING", "SIGNIFICANT"),
    ("gradient clipping", r"gradient clipping|clip\w*\s+(?:the\s+)?gradients?", r"clip_grad|clip_grad_norm", "TRAINING", "SIGNIFICANT"),
    ("learning-rate warmup", r"warm-?up", r"warmup|warm_up", "TRAINING", "SIGNIFICANT"),
    ("weight decay", r"weight decay", r"weight_decay", "TRAINING", "SIGNIFICANT"),
    ("label smoothing", r"label smoothing", r"label_smooth", "TRAINING", "MINOR"),
    ("dropout", r"\bdropout\b", r"[Dd]ropout", "ARCHITECTURAL", "MINOR"),
    ("exponential moving average", r"exponential moving average|\bEMA\b", r"\bema\b|exponential_moving", "TRAINING", "MINOR"),
    ("mixed precision", r"mixed[- ]precision|\bfp16\b|half precision", r"fp16|autocast|GradScaler|\.half\(", "TRAINING", "MINOR"),
    ("data augmentation", r"data augmentation|augmentations?\b", r"augment|RandomCrop|RandomResized|RandomHorizontal", "TRAINING", "MINOR"),
    ("input normalization", r"normali[sz](?:ed|ation)", r"[Nn]ormalize|normali[sz]ation", "UNDOCUMENTED_PREPROCESSING", "MINOR"),
]
# Words of necessity, exact constants, addresses of weights.
NECESSITY = r"(?i)necessary|essential|critical|required|crucial|must\b|we found (?:it|this)"
EXACT = r"(?<![\w.])(\d\.\d{4,})(?![\w.])"
WEIGHTS = r"(https?://[^\s\"']+\.(?:pt|pth|bin|ckpt|safetensors|tar|gz))"
# Severities of missing components, orders of severities and gaps.
MISSING_SEVERITY = {"loss": "BLOCKING", "training": "BLOCKING", "optimizer": "SIGNIFICANT", "architecture": "SIGNIFICANT"}
SEVERITY_ORDER = ["BLOCKING", "SIGNIFICANT", "MINOR", "COSMETIC"]
GAP_ORDER = ["ABSENT_FROM_REPOSITORY", "EXTERNAL_DEPENDENCY", "CONFIG_HIDDEN"]
#: Tasks, at most, among which the papers of a file of constants are dealt.
FILE_PARTS = 16


def map_values(values: DataFrame, pairs: DataFrame, literals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Stated values of papers against the literals of their repositories.

    values (paper_version, id, symbol, value_text, context, section_id); pairs (paper_version, repo). Values meet
    literals by equality. The order of hits is that of (path, line).
    """
    v = values.join(grams.dealt(pairs), "paper_version").withColumn("value", F.trim(F.coalesce("value_text", F.lit(""))))
    asked = v.select("repo", F.col("value").alias("literal")).distinct()
    hits = literals.join(asked, ["repo", "literal"]).groupBy("repo", "literal").agg(F.count("*").alias("n_hits"), F.min(F.struct("path", "line")).alias("first"))
    hits = hits.select("repo", F.col("literal").alias("value"), F.least("n_hits", F.lit(MOST_HITS)).alias("n_hits"), F.col("first.path").alias("path"), F.col("first.line").alias("line"))
    sited = codeindex.enclosing(hits, symbols).select("repo", "value", "n_hits", "path", "line", F.col("symbol").alias("site_symbol"))
    out = v.join(sited, ["repo", "value"], "left")
    status = (
        F.when(F.col("value") == "", "UNKNOWN").when(T.looks_like_result(F.col("symbol"), F.col("context")), "UNKNOWN").when(~T.named_quantity(F.col("symbol")), "UNKNOWN")
        .when(F.col("n_hits").isNull(), "ABSENT").when(~T.distinctive_value(F.col("value")), "AMBIGUOUS").when(F.col("n_hits") > MANY_HITS, "AMBIGUOUS").otherwise("MATCHED")
    )
    matched = F.col("status") == "MATCHED"
    site = F.concat_ws(":", "path", "line")
    reason = F.when(matched, F.concat(F.lit("the identical literal appears at "), site)).when(F.col("status") == "ABSENT", F.concat(F.lit("the literal "), "value", F.lit(" does not appear in the repository"))).when(F.col("status") == "AMBIGUOUS", F.concat(F.lit("the literal appears "), "n_hits", F.lit(" time(s)"))).otherwise("not a named hyperparameter")
    out = out.withColumn("status", status)
    return out.select(*PAIR, F.lit("stated_value").alias("anchor_kind"), F.col("id").alias("anchor_id"), F.col("symbol").alias("label"), "status", F.when(matched, F.col("site_symbol")).alias("symbol_id"), F.when(matched, site).alias("site"), reason.alias("reasoning"), "section_id", "value_text", F.when(F.col("status") == "ABSENT", T.absence_ref(F.col("repo"), F.col("value"), F.lit(codeindex.METHOD))).alias("absence_ref"))


def component_queries(components: DataFrame) -> DataFrame:
    """(id, variant, terms): the name's tokens; of two or more also their verbs, turned round and in order."""
    verbs = F.transform("tokens", lambda t: F.coalesce(T.verb_form(t), t))
    one = F.struct(F.lit(0).alias("variant"), F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(codeindex.query_terms(F.col("name"))).alias("terms"))
    more = F.when(F.size("tokens") >= 2, F.array(F.struct(F.lit(1).alias("variant"), F.reverse(verbs).alias("terms")), F.struct(F.lit(2).alias("variant"), verbs.alias("terms")))).otherwise(F.array().cast("array<struct<variant:int,terms:array<string>>>"))
    return components.select("id", F.explode(F.concat(F.array(one), more)).alias("x")).select("id", "x.*")


def map_components(components: DataFrame, pairs: DataFrame, symbols: DataFrame, lines: DataFrame, values: DataFrame, index: grams.Index | None = None) -> DataFrame:
    """Components against symbols; values are the mapped stated values of the same papers.

    components (paper_version, id, name, slug, kind, description, section_id, source). Only components that were written
    back can be absent, and only if no distinctive word of the name occurs in code and no constant that they describe,
    or that their section states, was located.
    """
    c = grams.dealt(components).join(pairs, "paper_version").withColumn("name", F.coalesce("name", "slug")).withColumn("tokens", T.name_tokens(F.col("name")))
    key = [*PAIR, "id"]
    # what names find in a repository is found once, for all components of that name and kind
    c = c.withColumn("of_kind", F.coalesce("kind", F.lit("")))
    names = kept(c.where("name is not null").select("repo", "name", "of_kind", "tokens").distinct())
    queries = names.select("repo", F.col("name").alias("id")).distinct().join(grams.dealt(component_queries(names.select(F.col("name").alias("id"), "name", "tokens").distinct())), "id")
    # terms count in any order
    queries = queries.withColumn("terms", F.array_sort("terms")).withColumn("query", F.array_join("terms", " "))
    found = codeindex.search_symbols(symbols, queries.select("repo", "query", "terms").distinct(), 25, index).select("repo", "query", "qualified_name", F.col("name").alias("symbol_name"))
    meets = queries.join(found, ["repo", "query"]).select("repo", F.col("id").alias("name"), "qualified_name", "symbol_name").distinct()
    hay = F.lower(F.concat_ws(" ", "symbol_name", "qualified_name"))
    scored = names.join(grams.dealt(meets), ["repo", "name"]).withColumn("covered", F.size(F.filter("tokens", lambda t: F.contains(hay, T.prefix_stem(t)))))
    bonus = F.lit(0)
    for kind, pattern in SYMBOL_KINDS.items():
        bonus = F.when((F.col("of_kind") == kind) & F.col("symbol_name").rlike("(?i)" + pattern), 1).otherwise(bonus)
    best = scored.groupBy("repo", "name", "of_kind").agg(F.min(F.struct((-F.col("covered")).alias("c"), (-bonus).alias("b"), "qualified_name")).alias("best"))
    # words of names in code: names' distinctive tokens are looked for in the distinct words of a repository
    words = F.filter("tokens", lambda t: (F.length(t) >= 4) & ~t.isin(T.GENERIC_WORDS))
    tokens = names.select("repo", F.explode(words).alias("token")).distinct()
    in_code = lines.where(F.col("path").rlike(codeindex.SOURCE)).select("repo", "path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]{4,}"), F.lit(0)))).alias("word"))
    firsts = kept(in_code.groupBy("repo", "word").agg(F.min(F.struct("path", "line")).alias("at")))
    holding = grams.holding(grams.index(firsts, ["repo"], "word", 4), tokens.withColumnRenamed("token", "term"), grams.FEW_TERMS)
    places = holding.select("repo", F.col("term").alias("token"), F.col("name").alias("word")).join(grams.dealt(firsts), ["repo", "word"]).groupBy("repo", "token").agg(F.min("at").alias("at"))
    inside = names.select("repo", "name", F.posexplode(words).alias("place", "token")).distinct().join(grams.dealt(places), ["repo", "token"]).groupBy("repo", "name").agg(F.min_by(F.struct("token", "at.path", "at.line"), "place").alias("inside"))
    located = values.where("anchor_kind = 'stated_value' and status = 'MATCHED'")
    sections = located.where("section_id is not null").select(*PAIR, "section_id").distinct().withColumn("same", F.lit(True))
    names = located.select(*PAIR, F.lower("label").alias("word")).distinct()
    about = c.select(*key, F.explode(F.array_distinct(T.name_tokens(F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))))).alias("word")).join(names, [*PAIR, "word"]).select(*key).distinct().withColumn("described", F.lit(True))
    out = c.join(grams.dealt(best), ["repo", "name", "of_kind"], "left").join(grams.dealt(inside), ["repo", "name"], "left").join(sections, [*PAIR, "section_id"], "left").join(about, key, "left")
    share = -F.col("best.c") / F.nullif(F.size("tokens"), F.lit(0))
    derived = F.col("source") == "DETERMINISTIC"
    status = (
        F.when(F.col("best").isNotNull(), F.when(F.coalesce(share, F.lit(0.0)) < 0.5, "UNKNOWN").when(~derived & (share == 1) & (F.size("tokens") >= 2), "MATCHED").otherwise("AMBIGUOUS"))
        .when(derived | (F.size(words) == 0), "UNKNOWN").when(F.col("inside").isNotNull() | F.col("same") | F.col("described"), "AMBIGUOUS").otherwise("ABSENT")
    )
    out = out.withColumn("status", status)
    named = F.col("status").isin("MATCHED", "AMBIGUOUS") & F.col("best").isNotNull()
    absent = F.col("status") == "ABSENT"
    reason = F.when(named, F.concat(F.lit("matches "), -F.col("best.c"), F.lit("/"), F.size("tokens"), F.lit(" of its name"))).when(F.col("status") == "AMBIGUOUS", "present under another name").when(absent, F.concat(F.lit("no symbol resembles "), "name")).otherwise("its name identifies nothing")
    return out.select(*PAIR, F.lit("component").alias("anchor_kind"), F.col("id").alias("anchor_id"), F.col("name").alias("label"), "status", F.when(named, F.col("best.qualified_name")).alias("symbol_id"), F.when(~named & (F.col("status") == "AMBIGUOUS"), F.concat_ws(":", "inside.path", "inside.line")).alias("site"), reason.alias("reasoning"), "section_id", F.lit(None).cast("string").alias("value_text"), F.when(absent, T.absence_ref(F.col("repo"), F.col("name"), F.lit("search_variants"))).alias("absence_ref"))


def map_algorithms(algorithms: DataFrame, pairs: DataFrame, symbols: DataFrame, index: grams.Index | None = None) -> DataFrame:
    """Named algorithms with text against symbols; a name alone never settles one."""
    a = grams.dealt(algorithms).join(pairs, "paper_version").withColumn("tokens", T.name_tokens(F.coalesce("name", F.lit(""))))
    terms = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(codeindex.query_terms(F.coalesce("name", F.lit(""))))
    a = a.withColumn("query", F.array_join(terms, " "))
    best = codeindex.search_symbols(symbols, a.select("repo", "query", terms.alias("terms")).distinct(), 1, index).select("repo", "query", F.col("qualified_name").alias("best"))
    out = a.join(best, ["repo", "query"], "left")
    status = F.when(~F.col("extractable") | F.coalesce("name", F.lit("")).eqNullSafe(""), "UNKNOWN").when(F.col("best").isNull(), "ABSENT").otherwise("AMBIGUOUS")
    none = F.lit(None).cast("string")
    out = out.withColumn("status", status)
    return out.select(*PAIR, F.lit("algorithm").alias("anchor_kind"), F.col("id").alias("anchor_id"), F.col("name").alias("label"), "status", F.when(F.col("status") == "AMBIGUOUS", F.col("best")).alias("symbol_id"), none.alias("site"), F.lower("status").alias("reasoning"), "section_id", none.alias("value_text"), F.when(F.col("status") == "ABSENT", T.absence_ref(F.col("repo"), F.col("name"), F.lit(codeindex.METHOD))).alias("absence_ref"))


def graded(mapped: DataFrame) -> DataFrame:
    """Mappings with confidence: located values and proven absences are decisive, other matches strong, doubts weak."""
    level = F.when(F.col("status") == "ABSENT", "CONFIRMED").when((F.col("status") == "MATCHED") & (F.col("anchor_kind") == "stated_value"), "CONFIRMED").when(F.col("status").isin("MATCHED", "AMBIGUOUS"), "POSSIBLE").otherwise("UNKNOWN")
    # a doubt without a site or symbol has nothing that supports it
    held = (F.col("status") != "AMBIGUOUS") | F.col("symbol_id").isNotNull()
    return mapped.withColumns({"confidence": F.when(held, level).otherwise("UNKNOWN"), "id": F.concat_ws("|", *PAIR, "anchor_kind", "anchor_id")})


def map_papers(tables: dict[str, DataFrame], pairs: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """All anchors of papers against their repositories, graded."""
    values = map_values(tables["stated_values"], pairs, codeindex.literals(lines), symbols)
    index = grams.kept(codeindex.symbol_index(symbols), kept)
    parts = [values, map_components(tables["components"], pairs, symbols, lines, values, index), map_algorithms(tables["algorithms"], pairs, symbols, index)]
    return graded(reduce(DataFrame.unionByName, parts))


def histogram(mappings: DataFrame, by: list[str] = PAIR) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    return mappings.groupBy(*by).agg(*map(n, ["MATCHED", "ABSENT", "AMBIGUOUS", "UNKNOWN"]))


def _flags(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row for each key, with a flag for each behaviour's vocabulary in code, in one pass; a pattern reads only texts that hold a literal it needs."""
    rows = rows.select(*keys, column, F.lower(column).alias("lowered"))
    fits = lambda pattern: patterns.may_fit(F.col("lowered"), pattern) & F.col(column).rlike(pattern)
    return rows.groupBy(*keys).agg(*(F.bool_or(fits(b[2])).alias(f"b{i}") for i, b in enumerate(BEHAVIOURS)))


def behaviour_differences(papers: DataFrame, pairs: DataFrame, lines: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Behaviours that a paper (paper_version, tex) tells of and whose vocabulary its repository lacks.

    Without an index of the lines one pass flags all vocabularies; with one, only blocks that hold their literals are read.
    """
    spoken = [f"(?i){b[1]}" for b in BEHAVIOURS]
    place = lambda p: F.when(patterns.may_fit(F.col("lowered"), p), F.regexp_instr("tex", F.lit(p)))
    places = [F.struct(F.lit(i).alias("behaviour"), place(p).alias("at")) for i, p in enumerate(spoken)]
    told = papers.select("paper_version", "tex", F.lower("tex").alias("lowered")).select("paper_version", "tex", F.inline(F.array(*places))).where("at > 0")
    # the first place of a pattern with 95 characters on either side
    length = reduce(lambda out, x: F.when(F.col("behaviour") == x[0], F.length(F.regexp_extract("tex", x[1], 0))).otherwise(out), enumerate(spoken), F.lit(0))
    start = F.greatest(F.col("at") - 95, F.lit(1))
    quote = F.trim(F.regexp_replace(F.substring("tex", start, F.col("at") - start + length + 95), r"\s+", " "))
    told = told.select("paper_version", "behaviour", quote.alias("quote")).join(grams.dealt(pairs), "paper_version")
    if index is None:
        code = _flags(lines, "text", ["repo"])
        shown = code.select("repo", F.explode(F.array(*(F.struct(F.lit(i).alias("behaviour"), F.col(f"b{i}").alias("there")) for i in range(len(BEHAVIOURS))))).alias("x")).select("repo", "x.*").where("there")
    else:
        shown = patterns.search(lines, {str(i): b[2] for i, b in enumerate(BEHAVIOURS)}, index).select("repo", F.col("name").cast("int").alias("behaviour")).distinct()
    missing = told.join(shown, ["repo", "behaviour"], "left_anti")
    of = lambda k: F.element_at(F.array(*(F.lit(b[k]) for b in BEHAVIOURS)), F.col("behaviour") + 1)
    severity = F.when(F.col("quote").rlike(NECESSITY), "BLOCKING").otherwise(of(4))
    return missing.select(*PAIR, of(3).alias("kind"), of(0).alias("subject"), F.col("quote").alias("paper_states"), severity.alias("severity"), F.lit("LIKELY").alias("confidence"))


def missing_components(mappings: DataFrame, components: DataFrame) -> DataFrame:
    absent = mappings.where("anchor_kind = 'component' and status = 'ABSENT'").join(grams.dealt(components.select(F.col("id").alias("anchor_id"), F.col("kind").alias("ckind"))), "anchor_id")
    severity = F.lit("MINOR")
    for kind, s in MISSING_SEVERITY.items():
        severity = F.when(F.col("ckind") == kind, s).otherwise(severity)
    return absent.select(*PAIR, F.lit("MISSING_COMPONENT").alias("kind"), F.col("label").alias("subject"), F.concat(F.lit("a "), "ckind", F.lit(" component: "), "label").alias("paper_states"), severity.alias("severity"), "confidence")


def changed_values(mappings: DataFrame) -> DataFrame:
    absent = mappings.where("anchor_kind = 'stated_value' and status = 'ABSENT'")
    return absent.select(*PAIR, F.lit("CHANGED_HYPERPARAMETER").alias("kind"), F.col("label").alias("subject"), F.concat("label", F.lit(" = "), "value_text").alias("paper_states"), F.lit("SIGNIFICANT").alias("severity"), "confidence")


def differences(mappings: DataFrame, components: DataFrame, papers: DataFrame, pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Everything that sets papers and repositories apart, with severity_order to sort by."""
    rows = missing_components(mappings, components).unionByName(behaviour_differences(papers, pairs, lines)).unionByName(changed_values(mappings))
    return rows.withColumn("severity_order", F.array_position(T.strings(SEVERITY_ORDER), F.col("severity")).cast("int") - 1)


def _files_of_constants(papers: DataFrame, pairs: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact constants in settings and code, each where it comes first, and pairs with the files of their repository: (paper_version, repo, part, path, held, n, line).

    Constants have their place in the file's order, their bytes in the file's joined list, and the line of the next one.
    held are these of the constants that the paper holds, in order; n and line tell of those that it lacks. So no paper
    meets single constants of its repository but its own.
    """
    found = lines.where(T.is_config_source(F.col("path"))).select("repo", "path", "line", F.posexplode(F.regexp_extract_all("text", F.lit(EXACT), F.lit(1))).alias("place", "constant"))
    firsts = found.groupBy("repo", "constant").agg(F.min(F.struct("path", "line", "place")).alias("at")).select("repo", "at.*", "constant")
    order = Window.partitionBy("repo", "path").orderBy("line", "place")
    end = F.sum(F.length("constant").cast("long") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    firsts = kept(firsts.select("repo", "path", "line", "constant", (F.row_number().over(order) - 1).alias("ordinal"), (end - F.length("constant")).alias("start"), (end + 1).alias("end"), F.lead("line").over(order).alias("next")))
    files = firsts.groupBy("repo", "path").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    stated = papers.join(pairs, "paper_version").select(*PAIR, F.explode(F.array_distinct(F.regexp_extract_all("tex", F.lit(r"\d\.\d{4,}"), F.lit(0)))).alias("constant"))
    # a paper holds a constant if one of its numbers begins with it
    begins = stated.select(*PAIR, F.explode(F.transform(F.sequence(F.lit(6), F.length("constant")), lambda n: F.substring(F.col("constant"), F.lit(1), n))).alias("constant")).distinct()
    held = begins.join(grams.dealt(firsts), ["repo", "constant"]).groupBy(*PAIR, "path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end", "next"))).alias("held"))
    part = F.pmod(F.xxhash64("paper_version"), F.lit(FILE_PARTS))
    rows = pairs.select(*PAIR).distinct().withColumn("part", part).join(grams.dealt(_each_part(files)), ["repo", "part"]).join(grams.dealt(held), [*PAIR, "path"], "left")
    # the constants held from the first on without a gap: behind the last of them comes the first that the paper lacks
    leading = F.filter("held", lambda x, i: x["ordinal"] == i)
    line = F.when(F.size(leading) > 0, F.element_at(leading, -1)["next"]).otherwise(F.col("line"))
    n = F.col("n") - F.greatest(F.size("held"), F.lit(0))
    rows = rows.where(n > 0).select(*PAIR, "part", "path", "held", n.alias("n"), line.alias("line"))
    return firsts, rows


def _each_part(files: DataFrame) -> DataFrame:
    return files.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FILE_PARTS - 1)).cast("array<bigint>")))


def hidden_counts(papers: DataFrame, pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """hidden_constants without the constants: (paper_version, repo, path, n, line)."""
    return _files_of_constants(papers, pairs, lines)[1].select(*PAIR, "path", "n", "line")


def hidden_constants(papers: DataFrame, pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Exact constants in settings and code that the paper doesn't hold, one row for each file: the constants in order, each listed where it comes first.

    A file's constants are joined once, each with a comma behind it; a paper's list is that text without the bytes of the
    constants that it holds.
    """
    firsts, rows = _files_of_constants(papers, pairs, lines)
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "constant")))["constant"]
    files = firsts.groupBy("repo", "path").agg(F.concat(F.array_join(listed, ","), F.lit(",")).cast("binary").alias("whole"))
    # texts meet papers last: before, the rows are a pair and a path, so no text is shuffled or sorted for each paper
    met = rows.join(grams.dealt(_each_part(files)), ["repo", "path", "part"])
    size = F.octet_length("whole").cast("long")
    cut = lambda at, n: F.substring("whole", at.cast("int"), n.cast("int"))
    starts, ends = F.concat(F.array(F.lit(1).cast("long")), F.col("held.end")), F.concat(F.col("held.start"), F.array(size + 1))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: cut(a, b - a).cast("string")), "").cast("binary")
    text = F.when(F.col("held").isNull(), cut(F.lit(1), size - 1)).otherwise(F.substring(left, F.lit(1), F.octet_length(left) - 1))
    return met.select(*PAIR, "path", "n", "line", text.cast("string").alias("constants"))


def external_artifacts(lines: DataFrame) -> DataFrame:
    """Files that name weights to download: how many, and the first four."""
    hits = lines.withColumn("url", F.regexp_extract("text", WEIGHTS, 1)).where("url != ''")
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("repo", "path").orderBy("line")))
    return ranked.groupBy("repo", "path").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 4, F.struct("line", "url")))), lambda x: F.concat_ws(": ", x["line"], F.substring(x["url"], 1, 120))), "; ").alias("listed"))


def gaps(mappings: DataFrame, papers: DataFrame, pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """What would stop a reproduction: (paper_version, repo, kind, subject, n, confidence, gap_order)."""
    hidden = hidden_counts(papers, pairs, lines).select(*PAIR, F.lit("CONFIG_HIDDEN").alias("kind"), F.concat_ws(":", "path", "line").alias("subject"), "n", F.lit("CONFIRMED").alias("confidence"))
    absent = mappings.where("anchor_kind = 'component' and status = 'ABSENT'").select(*PAIR, F.lit("ABSENT_FROM_REPOSITORY").alias("kind"), F.col("label").alias("subject"), F.lit(1).cast("long").alias("n"), "confidence")
    outside = pairs.join(external_artifacts(lines), "repo").select(*PAIR, F.lit("EXTERNAL_DEPENDENCY").alias("kind"), F.col("path").alias("subject"), "n", F.lit("CONFIRMED").alias("confidence"))
    rows = absent.unionByName(outside).unionByName(hidden)
    return rows.withColumn("gap_order", F.array_position(T.strings(GAP_ORDER), F.col("kind")).cast("int") - 1)


def compare_repositories(mappings: DataFrame, differences: DataFrame) -> DataFrame:
    """Repositories of a paper by how close they come: (paper_version, repo, counts, place, closest); a tie at the top has no winner."""
    m = histogram(mappings)
    d = differences.groupBy(*PAIR).agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("BLOCKING", "SIGNIFICANT")))
    zero = F.lit(0)
    rows = m.join(d, PAIR, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_blocking", "n_significant")})
    place = F.rank().over(Window.partitionBy("paper_version").orderBy("n_blocking", "n_absent", "n_significant", F.desc("n_matched")))
    rows = rows.withColumn("place", place)
    winners = F.count_if(F.col("place") == 1).over(Window.partitionBy("paper_version"))
    return rows.withColumn("closest", (F.col("place") == 1) & (winners == 1))


def agreement(mappings: DataFrame) -> DataFrame:
    """Anchors of a paper over its repositories: whether all agree, and the statuses by repository (UNKNOWN where one lacks the anchor)."""
    repos = mappings.groupBy("paper_version").agg(F.array_sort(F.collect_set("repo")).alias("repos"))
    a = mappings.groupBy("paper_version", "anchor_kind", "label").agg(F.map_from_entries(F.collect_list(F.struct("repo", "status"))).alias("by"))
    full = F.transform("repos", lambda r: F.coalesce(F.try_element_at("by", r), F.lit("UNKNOWN")))
    rows = a.join(repos, "paper_version").withColumn("statuses", full)
    return rows.select("paper_version", "anchor_kind", "label", (F.size(F.array_distinct("statuses")) == 1).alias("agree"), F.array_join("statuses", ",").alias("statuses"))
