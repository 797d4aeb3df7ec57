"""Source trees and bibliographies as a data source."""

import os

import pytest

from lumenweave.operators import scan
from lumenweave.sources import trees


@pytest.fixture()
def root(tmp_path):
    for owner in "ab":
        for n in range(3):
            repo = tmp_path / "code" / owner / f"r{n}"
            for path, data in {"src/m.py": f"x = {n}\n", "README.md": "é", "node_modules/deep/n.py": "no", ".git/config": "no", "bad.bin": b"\xff\xfe", "big.txt": "#" * 2_000_001, "src/inner/k.py": "k"}.items():
                p = repo / path
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_bytes(data if isinstance(data, bytes) else data.encode())
    (tmp_path / "code" / "a" / "empty").mkdir()
    (tmp_path / "code" / "stray.py").write_text("not in a tree")
    return tmp_path


def test_files_of_trees(spark, root):
    df = trees.code_trees(spark, str(root / "code"), levels=2)
    got = {(r.repo, r.path): r.text for r in df.collect()}
    assert {p for r, p in got if r == "a/r1"} == {"src/m.py", "README.md", "bad.bin", "src/inner/k.py"}
    assert len(got) == 24 and got["b/r2", "src/m.py"] == "x = 2\n" and got["a/r0", "README.md"] == "é" and got["a/r0", "bad.bin"] == "��"
    assert df.rdd.getNumPartitions() == 7


def test_names_choose_partitions(spark, root):
    df = trees.code_trees(spark, f"file://{root}/code", levels=2)
    assert df.where("repo = 'a/r1'").rdd.getNumPartitions() == 1
    assert df.where("repo in ('a/r1', 'b/r0', 'c/r9')").rdd.getNumPartitions() == 2
    assert df.where("repo = 'a/r1' and path = 'src/m.py'").count() == 1
    assert df.where("repo = 'nowhere'").count() == 0 and df.where("repo like 'a%'").count() == 12


def test_folders_left_out_are_never_listed(spark, root):
    hidden = root / "code" / "a" / "r0" / "node_modules"
    os.chmod(hidden, 0)  # listing it would fail (for users that permissions bind)
    os.symlink("/nowhere", root / "code" / "a" / "r1" / ".git" / "broken")
    listed = []
    honest = trees._listed
    reader = trees.TreeReader({"path": str(root / "code"), "levels": "2"}, trees.TreeSource({}).schema(), "repo")
    try:
        trees._listed = lambda store, folder: listed.append(folder) or honest(store, folder)
        store, _ = trees._filesystem(str(root))
        for t in reader.partitions():
            list(reader._files(store, t.folder))
    finally:
        trees._listed = honest
        os.chmod(hidden, 0o755)
    assert listed and not any("node_modules" in x or ".git" in x for x in listed)


def test_options(spark, root):
    got = trees.code_trees(spark, str(root / "code"), levels=1, suffixes=".py", skip="inner", maxBytes=10).where("repo = 'a'").collect()
    assert {r.path for r in got} == {f"r{n}/{p}" for n in range(3) for p in ("src/m.py", "node_modules/deep/n.py")}


def test_bibliographies(spark, root):
    for paper, files in {"P1v1": {"z.bbl": "\\bibitem{a} A B\n\\newblock Last file wins here.", "sub/b.bbl": "\\bibitem{a} A B\n\\newblock First of the two."}, "P2v1": {"x.bib": "@article{k, title = {Of a bib file}}", "notes.txt": "no"}, "P3v1": {}}.items():
        (root / "bib" / paper / "sub").mkdir(parents=True)
        for name, text in files.items():
            (root / "bib" / paper / name).write_text(text)
    df = trees.bibliography_files(spark, str(root / "bib"))
    assert {(r.paper_version, r.file, r.kind) for r in df.collect()} == {("P1v1", "z.bbl", "bbl"), ("P1v1", "sub/b.bbl", "bbl"), ("P2v1", "x.bib", "bib")}
    assert {(r.paper_version, r.bib_key, r.title) for r in scan.bibliography(df).collect()} == {("P1v1", "a", "Last file wins here"), ("P2v1", "k", "Of a bib file")}
    assert df.where("paper_version = 'P2v1'").rdd.getNumPartitions() == 1
