"""Interval sweeps and letter postings against plain searches."""

import random
import time

import pytest

from lumenweave.operators import codeindex, correlate, grams, intervals, patterns
from lumenweave.sources import landing

SPANS = "repo string, path string, start int, last int, rank long, value string"


def plain_around(places, spans):
    out = {}
    for repo, path, line in set(places):
        if None in (repo, path, line):
            continue
        held = sorted((rank, value) for r, p, a, b, rank, value in spans if (r, p) == (repo, path) and a <= line <= b)
        if held:
            first = held[0][1]
            out[repo, path, line] = (first, next((v for _, v in held if v != first), None))
    return out


@pytest.mark.parametrize("seed,shift", [(1, 12), (2, 3), (3, 0)])
def test_spans_around_places(spark, monkeypatch, seed, shift):
    monkeypatch.setattr(intervals, "RANGE", shift)
    r = random.Random(seed)
    spans = []
    for _ in range(300):
        a = r.randint(-5, 60)
        spans.append((r.choice("ab"), r.choice("pq"), a, a + r.choice([0, 1, 5, 40, -1]), r.randint(0, 20), r.choice(["u", "v", "w", "x"])))
    places = [(r.choice(["a", "b", "c", None]), r.choice("pq"), r.choice([*range(-10, 110), None])) for _ in range(400)]
    df = intervals.around(spark.createDataFrame(places, "repo string, path string, line int"), spark.createDataFrame(spans, SPANS), ["repo", "path"], "line")
    got = {(x.repo, x.path, x.line): (x.first, x.second) for x in df.collect()}
    assert got == plain_around(places, spans)


def test_no_places_and_no_spans(spark):
    places, spans = spark.createDataFrame([], "repo string, path string, line int"), spark.createDataFrame([("a", "p", 1, 2, 0, "v")], SPANS)
    assert not intervals.around(places, spans, ["repo", "path"], "line").collect()
    assert not intervals.around(spark.createDataFrame([("a", "p", 1)], places.schema), spans.limit(0), ["repo", "path"], "line").collect()


SYMBOLS = "repo string, file_path string, ordinal int, qualified_name string, name string, kind string, line_start int, line_end int"


def test_a_long_file_is_many_tasks_and_no_product(spark):
    """50,000 lines and 2,000 symbols of one file, every fifth a class around the rest."""
    symbols = []
    for i in range(2000):
        a, kind = 1 + i * 25, "class" if i % 5 == 0 else "method"
        symbols.append(("r", "f.py", i, f"f.py::s{i}#{kind}", f"s{i}", kind, a, a + (124 if i % 5 == 0 else 20)))
    s = spark.createDataFrame(symbols, SYMBOLS)
    lines = spark.range(1, 50_001).selectExpr("'r' as repo", "'f.py' as path", "cast(id as int) as line", "concat('s', id % 2000, '()') as text")
    began = time.time()
    df = codeindex.enclosing(lines.select("repo", "path", "line"), s)
    got = {r.line: r.symbol for r in df.collect()}
    assert time.time() - began < 60
    for line in (1, 21, 22, 26, 120, 121, 122, 125, 126, 49_999, 50_000):
        held = [(k == "class", o, q) for _, _, o, q, _, k, a, b in symbols if a <= line <= b]
        assert got[line] == (min(held)[2] if held else None)
    assert len(got) == 50_000
    text = df._jdf.queryExecution().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text
    began = time.time()
    called = codeindex.callers(s, lines)
    pairs = {(r.callee, r.caller) for r in called.collect()}
    assert time.time() - began < 60
    want = set()
    for line in range(1, 50_001):
        callee = symbols[line % 2000]
        i = (line - 1) // 25
        around = [symbols[j] for j in {i, i - i % 5} if symbols[j][6] <= line <= symbols[j][7] and symbols[j][3] != callee[3]]
        if around:
            want.add((callee[3], min(around, key=lambda x: x[2])[3]))
    assert pairs == want


@pytest.mark.parametrize("seed", [1, 2])
def test_names_that_hold_terms(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abAé._") for _ in range(n))
    names = [(r.choice(["x", "y"]), r.choice([word(r.randint(0, 9)), None])) for _ in range(200)]
    terms = [(r.choice(["x", "y", "z"]), r.choice([word(r.randint(0, 5)), None])) for _ in range(200)]
    index = grams.index(spark.createDataFrame(names, "repo string, text string"), ["repo"], "text")
    got = {tuple(x) for x in grams.holding(index, spark.createDataFrame(terms, "repo string, term string")).collect()}
    want = {(s, t, n.lower()) for s, t in terms for q, n in names if t and n and s == q and t.lower() in n.lower()}
    assert got == want
    longer = grams.index(spark.createDataFrame(names, "repo string, text string"), ["repo"], "text", shortest=3)
    assert {tuple(x) for x in grams.holding(longer, spark.createDataFrame(terms, "repo string, term string")).collect()} == {x for x in want if len(x[1]) > 2}


def test_symbol_search_counts_terms_as_given(spark):
    symbols = [("r", "f", i, f"f::{n}#function", n, "function", 1, 2) for i, n in enumerate(["encode_ring", "Ring", "ringing_encoder", "other", "encode_ring"])] + [("r", "f", 9, None, None, None, None, None)]
    queries = [("r", "q", ["encode", "ring", "ring"]), ("r", "short", ["g"]), ("r", "none", ["zz", ""]), ("s", "q", ["ring"])]
    s, q = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(queries, "repo string, query string, terms array<string>")
    got = [(r.query, r.hits, r.ordinal, r["rank"]) for r in codeindex.search_symbols(s, q, 3).orderBy("query", "rank").collect()]
    assert got == [("q", 3, 0, 1), ("q", 3, 4, 2), ("q", 3, 2, 3), ("short", 1, 1, 1), ("short", 1, 0, 2), ("short", 1, 4, 3)]


def test_one_index_answers_many_searches(spark):
    symbols = spark.createDataFrame([("r", "f", i, f"f::n{i}#function", f"n{i}", "function", 1, 2) for i in range(50)], SYMBOLS)
    index = grams.kept(codeindex.symbol_index(symbols), landing.kept)
    for term in ("n1", "4", "f::n2"):
        q = spark.createDataFrame([("r", "q", [term])], "repo string, query string, terms array<string>")
        assert {r.name for r in codeindex.search_symbols(symbols, q, 99, index).collect()} == {f"n{i}" for i in range(50) if term in f"n{i} f::n{i}#function"}


def test_titles_by_parts_of_words(spark):
    papers = spark.createDataFrame([("1", "Self-adapting Framework", "segmentation nets"), ("2", "Language Models", None), ("3", "Volumetric Segmentations", "adapting method")], "arxiv_id string, title string, abstract string")
    q = spark.createDataFrame([("adapt segment",), ("LANGUAGE model",), ("volumetric segment adapt zzz",), ("the of",)], "query string")
    for index in (None, landing.title_index(papers)):
        got = {(r.query, r.tier, r.arxiv_id) for r in landing.title_search(papers, q, index=index).collect()}
        assert got == {("adapt segment", 1, "1"), ("adapt segment", 1, "3"), ("LANGUAGE model", 0, "2"), ("volumetric segment adapt zzz", 3, "3")}


# ── patterns ─────────────────────────────────────────────────────────────────

FREE = [
    r"(?i)warm-?up", r"foo(?:bar|baz)+", r"(?:opt)?ional", r"x|yonder", r"[Ll]oss\w*\(", r"^\s*$", r"a{3,}bcd", r"(?!never)ever", r"\Qa.b\E", r"(?<![\w.])(\d\.\d{4,})(?![\w.])",
    r"(?:ab|cd)(?:efg|hij)", r"é[a-z]+loss", r"(loss|gain)_\1", r"\bema\b|exponential_moving", r"end$", r"(?>atom)ic",
]


@pytest.mark.parametrize("pattern,needs", [
    (r"\bclamp\b|\.clip\(", {"clamp", ".clip("}), (r"[Dd]ropout", {"dropout"}), (r"warmup|warm_up", {"warm"}), (r"x|foobar", None), (r"(abc)?", None), (r"a(bcd){0,2}", None), (r"(?=seen)x", None),
    (r"\QIt\E", None), (r"[a&&b]abc", None), (r"(?x) abc d", None), (r"(", None), (r"foo.barbar", {"barbar"}), (r"(?:ab)(?:cd)", {"abcd"}), (r"(ab)(cd)", None),
])
def test_required_literals(pattern, needs):
    got = patterns.required(pattern)
    assert (set(got) if got else None) == needs


def test_patterns_through_the_index_find_what_a_full_scan_finds(spark, tmp_path):
    r = random.Random(5)
    parts = ["warmup", "warm_up", "WARM-UP", "foobarbaz", "optional", "ional", "yonder", "x", "Loss_a(", "  ", "aaabcd", "ever", "never", "a.b", "0.12345", "1.2", "abhij", "émyloss", "loss_loss", "ema", "schema", "end",
             "clamp", "torch.clamp", "clip_grad", "weight_decay", "label_smooth", "Dropout", "fp16", "RandomCrop", "normalise", "normalisation", "atomic"]
    rows = [(r.choice("ab"), r.choice(["p.py", "q.py"]), i // 3, r.choice([" ".join(r.choice(parts) for _ in range(r.randint(0, 4))), None])) for i in range(1500)]
    lines = spark.createDataFrame(rows, "repo string, path string, line int, text string")
    asked = {p: p for p in FREE} | {b[0]: b[2] for b in correlate.BEHAVIOURS}
    index = patterns.written_index(lines, str(tmp_path / "index"))
    key = lambda df: sorted(map(tuple, df.collect()))
    got, want = key(patterns.search(lines, asked, index)), key(patterns.search(lines, asked))
    assert got == want and len({x[0] for x in want}) >= len(asked) - 2
    assert "PushedFilters: [In(gram" in patterns.candidates(index, {"a": "warmup"})._jdf.queryExecution().toString()
    assert not patterns.search(lines, {}, index).collect()
    assert key(codeindex.search_text(lines, "clip_grad", 3, index)) == key(codeindex.search_text(lines, "clip_grad", 3))


def test_behaviours_through_the_index(spark):
    papers = spark.createDataFrame([("p", "We use warm-up, weight decay and dropout. " + "Gradient clipping is crucial.")], "paper_version string, tex string")
    pairs = spark.createDataFrame([("p", "r"), ("p", "s")], "paper_version string, repo string")
    lines = spark.createDataFrame([("r", "a.py", 1, "warm_up = 3"), ("s", "a.py", 90, "nn.Dropout()"), ("s", "b.py", 2, "clip_grad_norm(x)")], "repo string, path string, line int, text string")
    key = lambda index: sorted(map(tuple, correlate.behaviour_differences(papers, pairs, lines, index).collect()))
    assert key(patterns.line_index(lines)) == key(None) != []
