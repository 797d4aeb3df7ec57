"""Landed responses, files, the compact format and the catalog."""

from lumenweave import catalog
from lumenweave.operators import codeindex, discover
from lumenweave.plans import ingest
from lumenweave.sources import compact, flatten, landing

COMPACT = """#MUNCH/1 tool=x
@1=clip/model.py
total=2 truncated=false name="a b" __tables="s:symbols:id|file|sig;t:other:n"

s,@1::CLIP.forward#method,@1,"def forward(
    self, x)"
t,7
unknown,1
"""


def test_compact_format(spark):
    got = [*compact.facts(COMPACT)]
    assert [(f.column, f.value) for f in got if f.table is None] == [("total", "2"), ("truncated", "false"), ("name", "a b")]
    assert [f for f in got if f.table] == [("symbols", 0, "id", "clip/model.py::CLIP.forward#method"), ("symbols", 0, "file", "clip/model.py"), ("symbols", 0, "sig", "def forward(\n    self, x)"), ("other", 0, "n", "7")]
    assert compact.is_compact(COMPACT) and not compact.is_compact("{}")
    assert [*compact.facts("nothing here")] == [] and [*compact.facts('#MUNCH/1\n\na="x y" __tables="s:t"')] == [(None, None, "a", "x y")]
    answers = spark.createDataFrame([("1", COMPACT), ("2", None), ("3", '#MUNCH/1\n__tables="s:symbols:id"\n\ns,"open')], "id string, text string")
    rows = compact.rows(answers).collect()
    assert {(r.id, r.name, r.cells.get("n")) for r in rows if r.id == "1"} == {("1", "symbols", None), ("1", "other", "7")}
    assert {(r.name, r.text, r.number, r.flag) for r in compact.scalars(answers).collect()} == {("total", "2", 2, None), ("truncated", "false", None, False), ("name", "a b", None, None)}


def test_absence_of_an_answer():
    assert compact.absence('#MUNCH/1\ntotal=0 absence_evidence="{""ref"":""absent:0a1b""}"') == "absent:0a1b"
    assert compact.absence('{"ref": "absent:ff00"}') == "absent:ff00" and compact.absence("#MUNCH/1\ntotal=1") is None


def test_feed(spark):
    xml = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2103.00020v2</id><title>A
      Title</title><summary>S</summary><author><name>Ada L</name></author><author><name>B N</name></author><published>2021</published></entry>
      <entry><id>http://arxiv.org/abs/2103.00020v1</id><title>dup</title></entry><entry><id>nothing</id></entry></feed>"""
    got = landing.preprint_entries(spark.createDataFrame([("q", xml)], "query string, xml string")).collect()
    assert [(r.arxiv_id, r.version, r.title, r.authors) for r in got] == [("2103.00020", 2, "A Title", ["Ada L", "B N"])]


def test_title_search(spark):
    papers = spark.createDataFrame([("1", "Self-adapting Framework for Segmentation", "nets"), ("2", "Language Models", "few shot learners"), ("3", "Volumetric segmentation", "adapting method")], "arxiv_id string, title string, abstract string")
    q = spark.createDataFrame([("Language Models",), ("shot learners language",), ("unheard words",), ("volumetric segmentation nothing else",)], "query string")
    got = {(r.query, r.tier, r.arxiv_id) for r in landing.title_search(papers, q).collect()}
    assert got == {("Language Models", 0, "2"), ("shot learners language", 1, "2")}


def test_readmes_and_trees(spark):
    got = landing.repo_readmes(spark.createDataFrame([("a/b", '{"content":"aGVs\\nbG8="}')], "repo string, body string")).collect()
    assert [(r.repo, r.readme) for r in got] == [("a/b", "hello")]
    tree = '{"tree":[{"path":"x.py","type":"blob"},{"path":"d","type":"tree"},{"path":"d/y.md","type":"blob"}]}'
    assert [r.path for r in landing.repo_trees(spark.createDataFrame([("a/b", tree)], "repo string, body string")).orderBy("ordinal").collect()] == ["x.py", "d/y.md"]


def test_code_tree(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg" / "m.py").write_text('import x\n\nEOT = 49407\n\n\nclass Net:\n    def __init__(self):\n        self.t = 0.07\n\n    def forward(self, a):\n        return helper(a)\n\n\ndef helper(a):\n    return a\n')
    (root / "README.md").write_text("tau 0.07\n")
    (root / "bad.py").write_text("def (")
    (root / "node_modules" / "n.py").write_text("x = 1")
    (root / "big.py").write_text("#" * 2_000_001)
    files = landing.code_tree(spark, str(root), "o/r")
    assert sorted(r.path for r in files.collect()) == ["README.md", "bad.py", "pkg/m.py"]
    s = codeindex.python_symbols(files)
    assert [r.qualified_name for r in s.where("warning is null").orderBy("ordinal").collect()] == ["pkg/m.py::EOT#constant", "pkg/m.py::Net#class", "pkg/m.py::Net.__init__#method", "pkg/m.py::Net.forward#method", "pkg/m.py::helper#function"]
    assert [r.warning.split(":")[0] for r in s.where("warning is not null").collect()] == ["bad.py"]
    lines = codeindex.lines(files)
    hits = codeindex.search_text(lines, "0\\.07").orderBy("path").collect()
    assert [(r.path, r.line) for r in hits] == [("README.md", 1), ("pkg/m.py", 8)]
    assert {(r.caller) for r in codeindex.callers(s, lines).where("callee like '%helper%'").collect()} == {"pkg/m.py::Net#class"}
    source = {r.qualified_name: r.source for r in codeindex.symbol_source(s, files).collect()}
    assert source["pkg/m.py::helper#function"] == "def helper(a):\n    return a"
    assert {r.extension: r.n for r in codeindex.languages(files).collect()} == {"py": 2, "md": 1}


def test_seeds(spark):
    urls = spark.createDataFrame([("p", "Own", "Repo", True, 0), ("p", "own", "repo", False, 1), ("p", None, None, False, 2)], "paper_version string, owner string, repo string, in_abstract boolean, ordinal int")
    found = spark.createDataFrame([("p", "OWN/repo", 0), *(("p", f"x/{i}", i + 1) for i in range(12))], "paper_version string, repo string, place int")
    got = discover.seeds(urls, found).orderBy("seed").collect()
    assert [(r.repo, r.declared) for r in got][:2] == [("own/repo", True), ("x/0", False)] and len(got) == discover.MOST_CANDIDATES


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "graph"))
    assert c.read("components").count() == 0
    rows = spark.createDataFrame([("p1", "a", "loss"), ("p2", "b", "gadget"), ("p2", "c", "module")], "paper_version string, slug string, kind string")
    c.write("components", rows)
    assert sorted(r.slug for r in c.read("components").collect()) == ["a", "c"]
    c.write("components", spark.createDataFrame([("p2", "d", "loss", 1)], "paper_version string, slug string, kind string, extra int"))
    assert sorted(r.slug for r in c.read("components").collect()) == ["a", "d"]
    papers = spark.createDataFrame([("1", "t", "d1")], "arxiv_id string, title string, doi string")
    delta = spark.createDataFrame([("1", "t2", None, 1), ("2", "u", None, 1)], "arxiv_id string, title string, doi string, seq int")
    got = catalog.upsert("papers", papers, delta, "seq")
    assert {(r.arxiv_id, r.title, r.doi) for r in got.collect()} == {("1", "t2", "d1"), ("2", "u", None)}
    c.write("papers", papers)
    c.views()
    assert spark.table("papers").first().title == "t"


def test_entry_works_without_the_text_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _tex(spark, files, **options):
    rows = [("p", path, text) for path, text in files]
    return {r.paper_version: r.tex for r in flatten.flattened(spark.createDataFrame(rows, "paper_version string, path string, text string"), **options).collect()}


def test_flattened_sources(spark):
    # a file within itself, a missing one and a commented one add nothing; without \\documentclass the file that no other names is the root
    assert _tex(spark, [("b.tex", r"b\input{a}"), ("a.tex", "1\\input{c.tex}2\\input{gone}3 % \\input{c}\n4\\input b"), ("c.tex", r"<\include{a}>"), ("z.tex", None)]) == {"p": "b1<>23 \n4\\input b"}
    assert _tex(spark, [("a.tex", r"\begin{document}x"), ("b.tex", r"\input{a}")]) == {"p": r"\begin{document}x"}
    assert _tex(spark, []) == {}
    long = "w " * 200_000
    assert _tex(spark, [("a.tex", r"\input{b}\input{b}"), ("b.tex", long)]) == {"p": long + long}


def test_macros(spark):
    text = r"\newcommand{\x}{5\$ {a{b}}}\renewcommand\y[1]{(#1 #2 \x)}\newcommand{\x}{other}\x \xy \y{q}\y {\x}\x{}"
    assert _tex(spark, [("m.tex", text)]) == {"p": r"5\$ {a{b}} \xy (q #2 5\$ {a{b}})\y {5\$ {a{b}}}5\$ {a{b}}"}
    assert _tex(spark, [("m.tex", text)], macros=False) == {"p": text}


def test_registered_references(spark):
    works = spark.createDataFrame([("10.1/A", None, None, None, [], [("k", "10.2/X"), ("k", "10.2/Y"), (None, None)])], "doi string, title string, abstract string, published_at string, authors array<string>, references array<struct<key:string,DOI:string>>")
    refs = works.selectExpr("doi", "posexplode(references) as (ordinal, r)").selectExpr("doi", "ordinal", "coalesce(r.key, 'ref' || ordinal) as key", "lower(r.DOI) as ref_doi", "cast(null as string) as title", "cast(null as int) as year")
    got = ingest.metadata_only(works, refs)
    assert [(r.arxiv_id, r.title, r.latest_version) for r in got["papers"].collect()] == [("10.1/a", "(untitled)", "10.1/av1")]
    assert {(r.bib_key, r.doi) for r in got["bib_entries"].collect()} == {("k", "10.2/y"), ("ref2", None)}
    assert [r.id for r in got["lineage_edges"].collect()] == ["10.1/a->10.2/y:CITES"]
    versions = spark.createDataFrame([("v", "p", "10.1/a"), ("w", "q", "10.1/A"), ("n", "r", None)], "paper_version string, paper string, doi string")
    more = ingest.enriched(versions, versions.where("paper = 'q'"), refs)
    assert {r.paper_version for r in more["bib_entries"].collect()} == {"v"} and more["lineage_edges"].count() == 1
    for rows in ingest.metadata_only(works.limit(0), refs.limit(0)).values():
        assert rows.count() == 0


def test_json_export(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "graph"))
    rows = spark.createDataFrame([("p1", "a", None), ("p1", "b", 2), ("p2", "c", 3)], "paper_version string, slug string, n int")
    c.export_json({"values": rows, "components": rows.where("n = 3")}, str(tmp_path / "out"))
    c.export_json({"values": rows.where("slug = 'a'")}, str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out")).collect()
    assert {(r.paper_version, r.tool, r.value) for r in got} == {("p1", "values", '{"slug":"a","n":null}'), ("p2", "values", '{"slug":"c","n":3}'), ("p2", "components", '{"slug":"c","n":3}')}
