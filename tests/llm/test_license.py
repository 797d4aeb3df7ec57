import math
import re

from lumenweave.llm import license as lic

SCHEMA = "path string, text string, score string"


def plain_score(header):
    idf, other, vectors = lic.weights()
    own = re.findall(r"[a-z0-9]+(?:[.-][0-9a-z]+)*", header.lower())
    v = {t: own.count(t) * idf.get(t, other) for t in own}
    norm = math.sqrt(sum(x * x for x in v.values()))
    best = max(((sum(v[t] * x.get(t, 0) for t in v) / norm, -i, n) for i, (n, x) in enumerate(vectors)), default=None)
    return best if v else None


def test_templates_are_their_own_best():
    for name, text in lic.all_templates():
        score, _, best = plain_score(text)
        assert best == name and abs(score - 1) < 1e-9


def test_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    prose = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen. " * 3
    rows = [
        ("a/LICENSE", mit, "s"), ("a/x.py", prose, "s"), ("a/b/c/y.py", prose, "s"), ("a/b/COPYING", gpl, "s"), ("a/b/z.py", prose + "\n" + mit, "s"),
        ("top.py", prose, "s"), ("d/w.py", "no license here but the word license only", "s"), (None, mit, "s"), (None, prose, "s"), ("e/none.py", None, "s"), ("e/empty.py", "", "s"),
        ("f/LICENSE", gpl, "s"), ("f/LICENSE.txt", mit, "s"), ("f/g.py", prose, "s"), ("f/g.py", prose, "s"),
    ]
    got = lic.scan(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["path", "license", "score", "origin", "inherited_from"]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(rows)
    by = {r[0]: r for r in out if r[0]}
    m, g = round(plain_score(mit)[0], 6), round(plain_score(gpl)[0], 6)
    assert by["a/x.py"][1:] == ("MIT", m, "directory", "a")
    assert by["a/b/c/y.py"][1:] == ("GPL-3.0", g, "directory", "a/b")
    assert by["a/b/z.py"][1:] == ("MIT", m, "header", None)
    assert by["top.py"][1:] == by["e/none.py"][1:] == by["e/empty.py"][1:] == (None, None, "none", None)
    assert by["f/g.py"][1:] == (("GPL-3.0", g) if g >= m else ("MIT", m)) + ("directory", "f")
    assert sum(r[0] == "f/g.py" for r in out) == 2
    assert sorted(r[3] for r in out if r[0] is None) == ["header", "none"]


def test_clashing_columns_and_license_files(spark):
    names = ["own_license", "own_score", "near", "n_text", "header", "row", "own_dir", "stated_license", "above"]
    bsd = lic.FULL["BSD-3-Clause"].replace("Neither the name of the copyright holder", "The name of the project may not be used; nor the names of authors")
    rows = [("a/LICENSE", bsd), ("a/x.py", "x = 1"), ("b/COPYING", lic.FULL["GPL-3.0"]), ("b/c/y.py", None), ("d/LICENSE", "a shopping list: bread, milk and cheese"), ("d/z.py", "z")]
    df = spark.createDataFrame([(*r, *names) for r in rows], "path string, text string, " + ", ".join(f"{n} string" for n in names))
    got = lic.scan(df)
    assert got.columns == ["path", *names, "license", "score", "origin", "inherited_from"]
    found = {r.path: r for r in got.collect()}
    assert {p: r.license for p, r in found.items()} == {"a/LICENSE": "BSD-3-Clause", "a/x.py": "BSD-3-Clause", "b/COPYING": "GPL-3.0", "b/c/y.py": "GPL-3.0", "d/LICENSE": None, "d/z.py": None}
    assert all(r[n] == n for r in found.values() for n in names)


def test_empty(spark):
    assert lic.scan(spark.createDataFrame([], SCHEMA)).count() == 0
