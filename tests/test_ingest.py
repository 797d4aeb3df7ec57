"""Incremental ingest: only what has changed is done, and it counts at once."""

import pytest

from lumenweave.operators import scan
from lumenweave.plans import ingest
from lumenweave.plans.publish import Published

TEX = r"""\section{Model architecture} We use warmup and tau = %s here. \begin{equation} y = x \end{equation}
\section{Loss} See \cite{k1}. Code at https://github.com/lab/tool."""
CODE = "tau = %s\nclass ModelArchitecture:\n    def run(self):\n        return %s\n"


def sources(spark, *rows):
    return spark.createDataFrame([(k, None if v is None else TEX % v) for k, v in rows], "paper_version string, tex string")


def code(spark, *rows):
    files = [(r, "m.py", CODE % (c, c)) for r, c in rows] + [(rows[0][0], "bad.py", "def oops(:")]
    return spark.createDataFrame(files, "repo string, path string, text string"), spark.createDataFrame([(r, f"sha{c}") for r, c in rows], "repo string, commit_sha string")


PAIRS = [("P1v1", "r/a"), ("P2v1", "r/a"), ("P2v1", "r/b")]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "paper_version string, repo string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_only_what_has_changed(spark, tmp_path):
    g = ingest.graph(spark, str(tmp_path / "graph"))
    files, commits = code(spark, ("r/a", "0.003"), ("r/b", "0.004"))
    papers = sources(spark, ("P1v1", "0.003"), ("P2v1", "0.004"), ("P3v1", None))
    run = lambda p=papers, f=files, c=commits, **k: ingest.ingest_changed(g, p, f, c, pairs(spark), **k)
    assert run() == {"papers": 3, "repos": 2, "pairs": 3}
    before = {t: rows(g.read(t)) for t in ("sections", "mappings", "symbols", "stated_values", "equations")}
    assert {r.paper_version: r.source_kind for r in g.read("papers_text").collect()} == {"P1v1": "LATEX", "P2v1": "LATEX", "P3v1": "NONE"}
    status = {(r.paper_version, r.repo): r.status for r in g.read("mappings").where("label = 'tau'").collect()}
    assert status == {("P1v1", "r/a"): "MATCHED", ("P2v1", "r/a"): "ABSENT", ("P2v1", "r/b"): "MATCHED"}
    assert [(r.repo, r.path, r.error) for r in g.read("index_errors").collect()] == [("r/a", "bad.py", "SyntaxError")]
    files_before = sorted(str(p) for p in tmp_path.rglob("*"))
    assert run() == {"papers": 0, "repos": 0, "pairs": 0}
    assert sorted(str(p) for p in tmp_path.rglob("*")) == files_before  # nothing was written

    changed = sources(spark, ("P1v1", "0.003"), ("P2v1", "0.005"), ("P3v1", None), ("P4v1", "1"))
    assert run(changed) == {"papers": 2, "repos": 0, "pairs": 2}
    new = {str(p) for p in tmp_path.rglob("*")} - set(files_before)
    assert all("/runs/" in p or "/valid/turn=2" in p for p in new) and set(files_before) <= {str(p) for p in tmp_path.rglob("*")}
    fresh = next(p for p in (tmp_path / "graph/runs").iterdir() if str(p) in new)
    assert {r.paper_version for r in spark.read.parquet(str(fresh / "sections")).collect()} == {"P2v1", "P4v1"}
    after = {t: rows(g.read(t)) for t in before}
    assert after["symbols"] == before["symbols"]
    assert [x for x in after["sections"] if "P1v1" in x] == [x for x in before["sections"] if "P1v1" in x]
    assert {(r.paper_version, r.value_text) for r in g.read("stated_values").where("symbol = 'tau'").collect()} == {("P1v1", "0.003"), ("P2v1", "0.005"), ("P4v1", "1")}
    assert {(r.paper_version, r.repo): r.status for r in g.read("mappings").where("label = 'tau'").collect()} == {("P1v1", "r/a"): "MATCHED", ("P2v1", "r/a"): "ABSENT", ("P2v1", "r/b"): "ABSENT"}

    files, commits = code(spark, ("r/a", "0.003"), ("r/b", "0.005"))
    assert run(changed, files, commits) == {"papers": 0, "repos": 1, "pairs": 1}
    assert {(r.paper_version, r.repo): r.status for r in g.read("mappings").where("label = 'tau'").collect()}["P2v1", "r/b"] == "MATCHED"
    lost = sources(spark, ("P1v1", None))
    assert run(lost, files, commits) == {"papers": 0, "repos": 0, "pairs": 0}  # what can't be read anew stays
    assert ingest.ingest_changed(g, changed, parser="next") == {"papers": 3, "repos": 0, "pairs": 0}


def test_a_run_that_stops_between_two_tables(spark, tmp_path, monkeypatch):
    g = ingest.graph(spark, str(tmp_path / "graph"))
    ingest.ingest_changed(g, sources(spark, ("P1v1", "0.1"), ("P2v1", "0.2")))
    before = {t: rows(g.read(t)) for t in ingest.PAPER_TABLES if g.read(t) is not None}
    assert len(before) == 9
    honest, written = Published.write, []

    def stops(self, run, name, df):
        if len(written) == 3:
            raise RuntimeError("power cut")
        honest(self, run, name, df)
        written.append(name)

    monkeypatch.setattr(Published, "write", stops)
    changed = sources(spark, ("P1v1", "0.7"), ("P2v1", "0.2"))
    with pytest.raises(RuntimeError):
        ingest.ingest_changed(g, changed)
    assert len(written) == 3 and {t: rows(g.read(t)) for t in before} == before and g.turn() == 1
    monkeypatch.setattr(Published, "write", honest)
    assert len(g.clear()) == 1 and {t: rows(g.read(t)) for t in before} == before
    assert ingest.ingest_changed(g, changed)["papers"] == 1
    assert {(r.paper_version, r.value_text) for r in g.read("stated_values").collect()} == {("P1v1", "0.7"), ("P2v1", "0.2")}
    assert g.clear(keep=1) == [] and g.turn() == 2


def test_an_unfinished_list_doesnt_count(spark, tmp_path):
    g = ingest.graph(spark, str(tmp_path / "graph"))
    assert g.read("sections") is None and g.valid().count() == 0
    ingest.ingest_changed(g, sources(spark, ("P1v1", "0.1")))
    (tmp_path / "graph/valid/turn=2").mkdir()
    (tmp_path / "graph/valid/turn=2/part-0.parquet").write_bytes(b"half a file")
    assert g.turn() == 1 and g.read("sections").count() == 2


def test_two_writers_of_the_same_turn(spark, tmp_path, monkeypatch):
    g = ingest.graph(spark, str(tmp_path / "graph"))
    ingest.ingest_changed(g, sources(spark, ("P1v1", "0.1")))
    monkeypatch.setattr(Published, "turn", lambda self: 0)
    with pytest.raises(Exception, match="already exists"):
        g.publish(spark.createDataFrame([("x", "s", "r")], "key string, stamp string, run string"))


def test_errors_are_rows_and_others_go_on(spark, tmp_path):
    def touchy(m):
        if "0.666" in m.text:
            raise KeyError("this text")
        return iter(())

    g = ingest.graph(spark, str(tmp_path / "graph"))
    papers = sources(spark, ("P1v1", "0.1"), ("P2v1", "0.666"))
    assert ingest.ingest_changed(g, papers, readers=scan.READERS | {"touchy": touchy})["papers"] == 2
    assert [tuple(r) for r in g.read("errors").collect()] == [("P2v1", "touchy", "KeyError", "'this text'")]
    assert {r.paper_version for r in g.read("sections").collect()} == {"P1v1", "P2v1"}
    broken = {k: touchy if k == "equation" else f for k, f in scan.READERS.items()}
    kinds = {(r.paper_version, r.kind) for r in scan.events(papers, readers=broken).select("paper_version", "kind").distinct().collect()}
    assert {("P1v1", "heading"), ("P2v1", "heading"), ("P2v1", "error"), ("P2v1", "cite")} <= kinds and ("P1v1", "error") not in kinds


def test_bibliographies_count_as_part_of_a_paper(spark, tmp_path):
    g = ingest.graph(spark, str(tmp_path / "graph"))
    papers = sources(spark, ("P1v1", "0.1"), ("P2v1", "0.2"))
    bib = lambda title: spark.createDataFrame([("P1v1", "a.bbl", "bbl", f"\\bibitem{{k1}} A B\n\\newblock {title} of very many words\n")], "paper_version string, file string, kind string, text string")
    assert ingest.ingest_changed(g, papers, bibliographies=bib("Title"))["papers"] == 2
    assert {(r.paper_version, r.bib_key, r.title) for r in g.read("bib_entries").collect()} == {("P1v1", "k1", "Title of very many words"), ("P2v1", "k1", None)}
    assert ingest.ingest_changed(g, papers, bibliographies=bib("Title"))["papers"] == 0
    assert ingest.ingest_changed(g, papers, bibliographies=bib("Other"))["papers"] == 1
    assert {r.title for r in g.read("bib_entries").collect()} == {"Other of very many words", None}
