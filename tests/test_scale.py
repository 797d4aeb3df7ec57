"""Plans of joins whose sides look small to the planner, and results that growth brought to light."""

import pytest
from pyspark.sql import functions as F

from lumenweave import templates
from lumenweave.operators import codeindex, correlate, grams, lineage
from lumenweave.plans import fetch, reads


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


SYMBOLS = "repo string, file_path string, ordinal int, qualified_name string, name string, kind string, line_start int, line_end int"


@pytest.fixture()
def symbols(spark, tmp_path):
    rows = [("r", "f.py", i, f"f.py::encode_{i}#function", f"encode_{i}", "function", 1, 2) for i in range(50)]
    spark.createDataFrame(rows, SYMBOLS).write.parquet(str(tmp_path / "s"))
    return spark.read.parquet(str(tmp_path / "s"))


def test_postings_are_never_broadcast(spark, symbols):
    index = codeindex.symbol_index(symbols)
    terms = spark.createDataFrame([("r", "code")], "repo string, term string")
    found = grams.holding(index, terms)
    assert not broadcasts(found)
    assert found.count() == 50
    asked = spark.createDataFrame([("r", "code", ["code"])], "repo string, query string, terms array<string>")
    assert not broadcasts(codeindex.search_symbols(symbols, asked, 5, index))


def test_pairs_and_components_are_never_broadcast(spark, symbols):
    pairs = spark.createDataFrame([("P1", "r")], "paper_version string, repo string")
    columns = "paper_version string, id string, name string, slug string, kind string, description string, section_id string, source string"
    components = spark.createDataFrame([("P1", "c1", "Encode Ring", "c", "loss", None, None, "AGENT")], columns)
    algorithms = spark.createDataFrame([("P1", "a1", "Encode", True, None)], "paper_version string, id string, name string, extractable boolean, section_id string")
    assert not broadcasts(correlate.map_algorithms(algorithms, pairs, symbols))
    joined = grams.dealt(components).join(pairs, "paper_version")
    assert not broadcasts(joined)
    assert [x.status for x in correlate.map_algorithms(algorithms, pairs, symbols).collect()] == ["AMBIGUOUS"]


def test_lists_of_constants_meet_papers_last(spark):
    """Lists are never shuffled with papers: the join that brings them comes last, by file and part."""
    lines = spark.createDataFrame([("r", "a.py", i, f"rate = 1.{10000 + i}") for i in range(1, 40)] + [("r", "b.py", 1, "x = 2.55555")], "repo string, path string, line int, text string")
    papers = spark.createDataFrame([(f"P{i}", f"we use 1.{10000 + i}7") for i in range(1, 30)], "paper_version string, tex string")
    pairs = papers.select("paper_version", F.lit("r").alias("repo"))
    df = correlate.hidden_constants(papers, pairs, lines)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in next(x for x in plan.splitlines() if "Join" in x)
    got = {(r.paper_version, r.path): (r.n, r.constants) for r in df.collect()}
    assert len(got) == 58
    every = [f"1.{10000 + i}" for i in range(1, 40)]
    for i in range(1, 30):
        assert got[f"P{i}", "a.py"] == (38, ",".join(c for c in every if c != f"1.{10000 + i}"))
        assert got[f"P{i}", "b.py"] == (1, "2.55555")


def test_candidates_of_repeated_texts_and_ids(spark):
    """Each asked row has its answer, and papers that share id and version don't multiply it."""
    papers = spark.createDataFrame([("2001.10000", "Study zz1z", "", None, "2001.10000v1"), ("2001.10000", "Study zz2z", "", None, "2001.10000v1")], "arxiv_id string, title string, abstract string, doi string, latest_version string")
    asked = spark.createDataFrame([("2001.10000",), ("2001.10000",), ("zz1z",), ("qq",)], "text string")
    got = sorted((r.text, r.confidence) for r in reads.candidates(asked, papers).collect())
    assert got == [("2001.10000", "CONFIRMED"), ("2001.10000", "CONFIRMED"), ("qq", "UNKNOWN"), ("zz1z", "POSSIBLE")]


@pytest.mark.parametrize("most", [0, 100])
def test_methods_find_rows_without_keys(spark, monkeypatch, most):
    """Whether words are sent or dealt: a row that holds a term in two words comes once, an equal row comes for itself; sentences aren't hashed."""
    monkeypatch.setattr(lineage, "MOST_WORDS", most)
    sites = spark.createDataFrame([("p", "k", "essays says it", 1), ("p", "k", "essays says it", 1), ("p", "k", "none", 2), ("p", "k", None, 3)], "paper_version string, bib_key string, context string, src_line int")
    entries = spark.createDataFrame([("p", "k", "T", 2000)], "paper_version string, bib_key string, title string, year int")
    methods = spark.createDataFrame([("says",), ("says none",), ("of",)], "method string")
    df = lineage.told_sentences(sites, entries, methods)
    assert "sha2" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.method, r.context) for r in df.collect()] == [("says", "essays says it")] * 2


def test_lookup_sends_no_table_whole(spark, symbols):
    asked = symbols.select(F.lit("p").alias("paper_version"), F.col("name").alias("ref"))
    rows = symbols.select(F.lit("p").alias("paper_version"), "name", "kind")
    df = reads.lookup(rows, asked, "name", ["kind"])
    assert not broadcasts(df)
    assert df.count() == 50


def test_rows_that_grow_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(templates, "ROWS_EACH", 40)
    df = templates.derived(spark, "/root/testdata/sf0.001", templates.PAPERS, "part")
    assert df.rdd.getNumPartitions() == 5
    assert df.count() == 200


CANDIDATE = "paper_version string, repo string, arxiv_id string, title string, authors array<string>, declared boolean, in_abstract boolean, owner string, owner_name string, repo_name string, readme string, description string, archived boolean, stars long, seed int"


def test_candidates_are_judged_row_by_row(spark):
    """No join by candidate: signals, relation and given coverage come from the row, and equal those with a table of coverages."""
    from lumenweave.operators import discover

    rows = [
        ("p", "a/Net1", "2001.00001", "Net1: Deep Rings", ["Ada Lovelace"], True, True, "a", "Ada Lovelace", "Net1", "see arXiv:2001.00001", None, True, 1, 1),
        ("p", "b/tool", "2001.00001", "Net1: Deep Rings", ["Ada Lovelace"], False, True, "b", None, "tool", "an unofficial port of it", "Rings", False, 2, 2),
        ("p", "c/Net1", "2001.00001", "Net1: Deep Rings", ["Ada Lovelace"], False, True, "c", "Ada Li", "Net1", None, "Point clouds, 3d", None, 3, 3),
        (None, "d/none", None, None, None, False, None, None, None, None, None, None, None, 4, 4),
    ]
    c = spark.createDataFrame(rows, CANDIDATE)
    own = discover.assessed(c.withColumns({"n_files": F.lit(20).cast("long"), "score": F.lit(0.5), "checked": F.lit("SHALLOW")}))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan
    table = c.select("paper_version", "repo", F.lit(20).cast("long").alias("n_files"), F.lit(0.5).alias("score"), F.lit("SHALLOW").alias("checked"))
    assert [tuple(r) for r in own.collect()][:3] == sorted((tuple(r) for r in discover.assessed(c, table).where("paper_version is not null").collect()), key=lambda r: r[2])
    assert [(r.relation, r.confidence, r.name_contradicted) for r in own.collect()] == [("OFFICIAL", "LIKELY", False), ("REPRODUCTION", "UNKNOWN", False), ("ORGANIZATION", "POSSIBLE", True), ("UNRELATED", "UNKNOWN", False)]


def test_levels_of_source_trees_are_written_once(spark):
    """A level's joins are no part of the next one's plan, and a search stops at the last level there is."""
    from lumenweave.sources import flatten

    files = [("p", "main.tex", "\\documentclass{x}\\newcommand{\\n}{A}\\newcommand{\\n}{B}\\n \\input{a}%c"), ("p", "a.tex", "(\\input{b})"), ("p", "b.tex", None), ("q", "x.tex", "bare")]
    df = flatten.flattened(spark.createDataFrame(files, "paper_version string, path string, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in x for x in plan.splitlines()) == 1
    assert {r.paper_version: r.tex for r in df.collect()} == {"p": "\\documentclass{x}A ()", "q": "bare"}


def test_texts_that_papers_share_are_checked_once(spark):
    from lumenweave.sources import landing

    rows = [(f"{i:02d}", "Study of rings", "of things") for i in range(30)] * 2 + [("05", "Study of rings", None), (None, "Study of rings", "of things")]
    papers = spark.createDataFrame(rows, "arxiv_id string, title string, abstract string")
    assert landing.title_index(papers)[0].select("key").distinct().count() == 2
    asked = spark.createDataFrame([("study of rings",), ("tudy thing",), ("nothing",)], "query string")
    got = sorted((r.query, r.tier, r.arxiv_id) for r in landing.title_search(papers, asked, 3).collect())
    assert got == [("study of rings", 0, f"0{i}") for i in range(3)] + [("tudy thing", 1, f"0{i}") for i in range(3)]


@pytest.mark.parametrize("name", ["fetched_addresses", "evidence_by_address", "source_of_symbols", "equation_by_number"])
def test_built_rows_are_never_broadcast(spark, name):
    """A broadcast side stands in the memory of every task, and grows with the tables."""
    from lumenweave import composites, queries, served  # noqa: F401

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    built = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and not any(k in x for k in ("_nationkey", "_regionkey"))]
    assert not built, built[:3]


def test_workers_hold_few_papers_at_once(monkeypatch):
    import pandas as pd

    from lumenweave.operators import scan

    monkeypatch.setattr(scan, "AT_ONCE", 2)
    batch = pd.DataFrame({"paper_version": [f"p{i}" for i in range(5)], "tex": ["\\section{A} tau = 3.", None, "", "\\section{B}", "x"]})
    frames = list(scan._with_lines(["heading"], None, [batch, batch.iloc[:0]]))
    assert len(frames) == 4 and max(x["paper_version"].nunique() for x in frames) <= 2
    assert [x for f in frames for x in f["paper_version"]] == ["p0", "p3"]


def test_files_of_one_text_are_parsed_once(monkeypatch):
    import pandas as pd

    calls, parse = [], codeindex.ast.parse
    monkeypatch.setattr(codeindex.ast, "parse", lambda text: calls.append(text) or parse(text))
    texts = ["def go(a):\n    pass\n"] * 3 + ["oops ("] * 2 + [None]
    batch = pd.DataFrame({"repo": ["r"] * 6, "path": [f"f{i}.py" for i in range(6)], "text": texts})
    got = next(codeindex._parsed([batch]))
    assert len(calls) == 3
    assert list(got["qualified_name"][:3]) == [f"f{i}.py::go#function" for i in range(3)]
    assert [w.split(" (")[0] for w in got["warning"][3:]] == ["f3.py: unparseable", "f4.py: unparseable"]


def test_texts_of_candidates_are_split_before_they_meet(spark, tmp_path):
    """A pair only compares topics, and the rows are those of each candidate judged by its own texts, with nulls, negative and repeated keys."""
    from lumenweave import queries
    from lumenweave.functions import text as T

    segments = ["BUILDING", None, "Cloud", "", "building"]
    customers = [(k, f"c{k}", 1 if k % 3 else None, 0.0, segments[k % 5]) for k in range(-9, 40)] + [(8, "again", 1, 0.0, "BUILDING"), (None, "none", 1, 0.0, "BUILDING")]
    suppliers = [(k, f"s{k}", 1 if k % 5 else None, 0.0) for k in range(-20, 60)] + [(8, "again", 1, 0.0), (None, "none", 1, 0.0)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        df = queries.QUERIES["description_contradicts"](spark, d)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan[: plan.index("Join ")]
        c = templates.derived(spark, d, templates.CANDIDATES)
        want = c.select("paper_version", "repo", T.description_contradicts(F.col("description"), F.col("title")))
        key = lambda x: sorted(map(tuple, x.collect()), key=str)
        assert key(df) == key(want) and {x[2] for x in key(want)} == {True, False}


def test_topics_of_the_method_do_not_count(spark):
    from lumenweave.functions import text as T

    rows = [("Deep Ring tool", "Net1: Deep Rings", True), ("rings of Net1", "Net1: Deep Rings", False), ("the net1", "Net1: Deep Rings", True), ("", "Net1: x", False), (None, "Net1: x", False), ("clouds", None, True), ("of", "of", True), ("rings", "rings", True)]
    df = spark.createDataFrame(rows, "d string, t string, want boolean")
    assert [x.got for x in df.select(T.description_contradicts(F.col("d"), F.col("t")).alias("got")).collect()] == [x[2] for x in rows]


def test_behaviours_are_read_where_their_literals_are(spark):
    """Patterns read only texts that hold a literal they need; what they find is what each finds in every text, in any case."""
    words = ["WARM-up", "warmup", "Weight Decay", "dropout", "Dropouts", "remark", "EMA", "exponential moving Average", "clipped", "unclipped", "CLAMPing", "clip the  gradients", "fp16", "half Precision", "Normalised", "augmentations", "é", "İ", "K", "\n\n", "necessary", "x" * 60]
    texts = [" ".join(words[(i * k + i // 7) % len(words)] for k in range(1, 9)) for i in range(120)] + ["", None]
    papers = spark.createDataFrame([(f"P{i}", x) for i, x in enumerate(texts)], "paper_version string, tex string")
    pairs = papers.select("paper_version", F.lit("r").alias("repo")).union(spark.createDataFrame([("P1", "s"), ("P2", None)], "paper_version string, repo string"))
    code = ["warm_up = 1", "x.CLIP(", "Dropout(", "schema", "ema", None, "GRADSCALER", "GradScaler", "Normalize"]
    lines = spark.createDataFrame([("r" if i % 2 else "s", "a.py", i, x) for i, x in enumerate(code)], "repo string, path string, line int, text string")
    df = correlate.behaviour_differences(papers, pairs, lines)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(tex#" not in plan and "Contains(lowered#" in plan
    parts = []
    for name, spoken, written, *_ in correlate.BEHAVIOURS:
        p = F.lit("(?i)" + spoken)
        at = F.regexp_instr("tex", p)
        cut = F.substring("tex", F.greatest(at - 95, F.lit(1)), at - F.greatest(at - 95, F.lit(1)) + F.length(F.regexp_substr("tex", p)) + 95)
        shown = lines.where(F.col("text").rlike(written)).select("repo").distinct()
        rows = papers.where(F.col("tex").rlike("(?i)" + spoken)).join(pairs, "paper_version").join(shown, "repo", "left_anti")
        parts.append(rows.select("paper_version", "repo", F.lit(name).alias("subject"), F.trim(F.regexp_replace(cut, r"\s+", " ")).alias("paper_states")))
    want = correlate.reduce(lambda a, b: a.unionByName(b), parts)
    key = lambda x: sorted(map(repr, x.select("paper_version", "repo", "subject", "paper_states").collect()))
    assert key(df) == key(want) and len({x.subject for x in want.collect()}) >= 6


def test_constants_are_counted_without_lists(spark):
    """Gaps need how many constants a paper lacks and where the first is: no list of a file's constants is made, and lists are cut, not searched, for each paper."""
    text = ["rate = 1.10001", "a = 1.10002, 1.10003", "b = 1.10001", "c = 1.10004"]
    lines = spark.createDataFrame([("r", "a.py", i, x) for i, x in enumerate(text, 1)] + [("r", "b.py", 7, "x = 2.55555")], "repo string, path string, line int, text string")
    stated = {"none": "", "first": "1.100019", "gap": "1.10001 1.10003", "leading": "1.10001 1.10002", "most": "1.10001 1.10002 1.10003", "last": "1.10004", "all": "1.10001 1.10002 1.10003 1.10004"}
    papers = spark.createDataFrame(list(stated.items()), "paper_version string, tex string")
    pairs = papers.select("paper_version", F.lit("r").alias("repo"))
    whole, counts = correlate.hidden_constants(papers, pairs, lines), correlate.hidden_counts(papers, pairs, lines)
    assert "whole" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in whole._jdf.queryExecution().optimizedPlan().toString()
    got = {r.paper_version: (r.n, r.line, r.constants) for r in whole.where("path = 'a.py'").collect()}
    assert got == {
        "none": (4, 1, "1.10001,1.10002,1.10003,1.10004"), "first": (3, 2, "1.10002,1.10003,1.10004"), "gap": (2, 2, "1.10002,1.10004"), "leading": (2, 2, "1.10003,1.10004"),
        "most": (1, 4, "1.10004"), "last": (3, 1, "1.10001,1.10002,1.10003"),
    }
    assert {r.paper_version: (r.n, r.line) for r in counts.where("path = 'a.py'").collect()} == {k: v[:2] for k, v in got.items()}
    assert counts.where("path = 'b.py' and n = 1 and line = 7").count() == len(stated)


def test_names_are_searched_once_however_many_components(spark, symbols, monkeypatch):
    """Few terms meet names without postings, symbols alike to every query are cut before they meet it, and components of one name share what it finds."""
    asked = spark.createDataFrame([("r", "a b", ["code", "encode_4"]), ("r", "c", ["ENCODE", "x"])], "repo string, query string, terms array<string>")
    few = [(r.query, r.hits, r["rank"], r.name) for r in codeindex.search_symbols(symbols, asked, 12).orderBy("query", "rank").collect()]
    monkeypatch.setattr(grams, "FEW_TERMS", 1)
    assert few == [(r.query, r.hits, r["rank"], r.name) for r in codeindex.search_symbols(symbols, asked, 12).orderBy("query", "rank").collect()]
    assert [x[3] for x in few[:12]] == ["encode_4", *(f"encode_4{i}" for i in range(10)), "encode_0"]
    monkeypatch.undo()
    index = codeindex.symbol_index(symbols)
    terms = spark.createDataFrame([("r", "Code"), ("s", "code"), ("r", ""), ("r", None)], "repo string, term string")
    found = grams.holding(index, terms, 5)
    assert "gram" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.repo, r.term) for r in found.collect()} == {("r", "Code")} and found.count() == 50


def test_signals_are_not_sifted_by_lambdas(spark):
    """Owners' parts are intersected as they are, and signals that aren't there fall away behind the explode: only the parts of authors and preprint numbers are sifted."""
    from lumenweave.operators import discover

    rows = [("p", "a/Net1", "2001.00001", "Net1: Deep Rings", ["Ada M. Lovelace"], True, True, "ada-ada", "M. Lovelace", "Net-1", "see arXiv:2001.00001", None, True, 1, 1), ("p", "m/x", "2001.00001", "Net1: Deep Rings", ["Ada M. Lovelace"], False, True, "m", "m ada", "x", None, None, True, 1, 2)]
    df = discover.signals(spark.createDataFrame(rows, CANDIDATE))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(" filter(") + df._jdf.queryExecution().optimizedPlan().toString().count("(filter(") == 1
    assert [(r.repo, r.ord, r.name, r.weight) for r in df.collect()] == [("a/Net1", 1, "declared_in_paper", "DECISIVE"), ("a/Net1", 2, "author_owner_match", "STRONG"), ("a/Net1", 3, "name_affinity", "STRONG"), ("a/Net1", 4, "readme_backlink", "STRONG")]


def test_kept_addresses_read_the_items_once_more_for_keys_only(spark, tmp_path):
    sections = [("P1v1", "1", 1, 1, "Ring", None, 1, 2, "body"), ("P1v1", "2", 2, 1, None, None, 3, 4, "more"), ("P1v1", "2", 2, 1, None, None, 3, 4, "more")]
    columns = "paper_version string, section_path string, ordinal int, level int, title string, latex_label string, src_line_start int, src_line_end int, body string"
    spark.createDataFrame(sections, columns).write.parquet(str(tmp_path / "sections"))
    tables = {
        "paper_versions": spark.createDataFrame([("P1v1", "P1", "full")], "paper_version string, arxiv_id string, fidelity string"),
        "papers": spark.createDataFrame([("P1", "P1v1", None, "t", [("A",)], None, None)], "arxiv_id string, latest_version string, doi string, title string, authors array<struct<name:string>>, published_at string, abstract string"),
        "sections": spark.read.parquet(str(tmp_path / "sections")),
    }
    asked = ["evi://paper/P1v1/section/1", "evi://paper/P1v1/section/2", "evi://paper/P1v1/section/9", "evi://paper/P1v1/values", "evi://paper/P2v1", "evi://x/y", None]
    addresses = spark.createDataFrame([(a,) for a in asked], "uri string")
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
    n = 0

    def keep(df):
        nonlocal n
        n += 1
        path = str(tmp_path / f"kept{n}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    plain, once = fetch.fetch(addresses, tables), fetch.fetch(addresses, tables, keep)
    key = lambda r: str(r["uri"])
    assert sorted(plain.collect(), key=key) == sorted(once.collect(), key=key)
    assert once.where("status = 'FOUND'").count() == 2 and once.where("available = '1,2'").count() == 1
    assert n == 2 and scans(once) < scans(plain)
