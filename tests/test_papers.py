"""Extraction and evidence on small cases."""

import pytest

from lumenweave.operators import evidence, extract, scan


def frame(spark, tex):
    return scan.events(spark.createDataFrame([("p1v1", tex)], "paper_version string, tex string"))


def column(df, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.select(*names).collect()]


@pytest.mark.parametrize(
    "tex, paths",
    [
        (r"\section{A}\subsection{B}\subsubsection{C}\section{D}\subsection{E}", ["1", "1.1", "1.1.1", "2", "2.1"]),
        ("\\section{A}\n\\appendix\n\\section{P}\\section{Q}\\subsection{R}", ["1", "A", "B", "B.1"]),
        (r"\section{A}\section*{Thanks to all}\section{B}", ["1", "*thanks-to-all", "2"]),
        (r"\section{A}\subsection{B}\paragraph{Encoder:} x", ["1", "1.1", "*encoder"]),
        (r"\appendix\subsection{R}", ["@.1"]),
        ("", []),
    ],
)
def test_section_paths(spark, tex, paths):
    got = extract.sections(frame(spark, tex)).orderBy("ordinal")
    assert column(got, "section_path") == paths


def test_section_titles_labels_and_braces(spark):
    got = extract.sections(frame(spark, "\\section{The \\emph{big {x}} one}\\label{sec:b}\nbody\n\\section{Two \\label{sec:t}}")).orderBy("ordinal")
    assert column(got, "title", "latex_label") == [("The big x one", "sec:b"), ("Two", "sec:t")]


@pytest.mark.parametrize(
    "tex, numbers",
    [
        (r"\begin{equation}a\end{equation}\begin{equation*}b\end{equation*}\begin{equation}c\end{equation}", ["1", None, "2"]),
        (r"\begin{align}a\\b\\[2pt]c\end{align}", ["1", "2", "3"]),
        (r"\begin{align}a\\b\nonumber\\c\end{align}", ["1", None, "2"]),
        (r"\begin{align}\frac{a\\b}{c}\\d\end{align}", ["1", "2"]),
        (r"text \[x = 1\] $y$", [None]),
        (r"$a$ and $b$", []),
    ],
)
def test_equation_numbers(spark, tex, numbers):
    assert column(extract.equations(frame(spark, tex)).orderBy("pos", "sub"), "derived_number") == numbers


def test_equation_confidence_and_hash(spark):
    assert column(extract.equations(frame(spark, r"\begin{equation}a\tag{7}\end{equation}")), "number_conf") == ["POSSIBLE"]
    assert column(extract.equations(frame(spark, r"\numberwithin{equation}{section}\begin{equation}a\end{equation}")), "number_conf") == ["POSSIBLE"]
    both = extract.equations(frame(spark, "\\begin{equation}a  = b\\label{eq:1}\\end{equation}\\begin{equation} a =\n b \\end{equation}"))
    assert len(set(column(both, "content_hash"))) == 1


def test_stated_values(spark):
    tex = "The scale $\\tau$ was initialized to the equivalent of 0.07.\n\nWe set $\\beta_2 = 0.98$ and \\includegraphics[width=0.85\\linewidth]{x}, dropout of 0.1.\n\nIt consists of 30 subjects and $\\tau$ = 0.07."
    got = extract.stated_values(frame(spark, tex)).orderBy("ordinal")
    assert set(column(got, "symbol", "value_text")) == {("tau", "0.07"), ("beta_2", "0.98"), ("dropout", "0.1")}
    assert dict(column(got, "symbol", "src_line"))["beta_2"] == 3


def test_urls(spark):
    tex = "\\begin{abstract}See \\url{https://github.com/Own/Repo.git}.\\end{abstract} and github.com/b/c, again https://github.com/Own/Repo.git"
    got = extract.declared_urls(frame(spark, tex)).orderBy("ordinal")
    assert column(got, "owner", "repo", "host", "in_abstract") == [("Own", "Repo", "github.com", True), ("b", "c", "github.com", False)]


def test_algorithms(spark):
    tex = "\\begin{algorithm}x\n\\caption{Step One}\n\\end{algorithm}\\begin{verbatim}y\\end{verbatim}\\begin{figure}\\includegraphics{p.pdf}\\caption{Pseudo-code of Step One}\\end{figure}\\begin{figure}\\caption{A cat}\\end{figure}\\begin{algorithm}z\n\\caption{Step One}\n\\end{algorithm}"
    got = extract.algorithms(frame(spark, tex))
    assert set(column(got, "slug", "presentation", "extractable")) == {("step-one", "latex_env", True), ("step-one-2", "latex_env", True), ("verbatim-l3", "listing", True), ("pseudo-code-of-step-one", "figure_image", False)}


def test_citations_and_bibliography(spark):
    tex = r"First \cite{a}. Second \citep[see][page 2]{b, ghost}. Third \citet*{a}."
    sites = extract.citation_sites(frame(spark, tex))
    assert column(sites.orderBy("ordinal"), "bib_key", "context")[:2] == [("a", r"First \cite{a}."), ("b", r"Second \citep[see][page 2]{b, ghost}.")]
    bbl = "\\bibitem[x]{a} Wu, Z., Xiong, Y.\n\\newblock Some fine long title.\n\\newblock arXiv preprint arXiv:1805.01978, 2018.\n\\bibitem{b} Doe.\n\\newblock Short.\n\\newblock Venue of 2016, doi 10.1000/xy.z."
    bib = "@article{c,\n title = {A {B}}, year = 2001, doi = {10.1/2}, eprint = {2001.00001}\n}\n@misc{a, title = {no}}"
    files = spark.createDataFrame([("p1v1", "m.bbl", "bbl", bbl), ("p1v1", "m.bib", "bib", bib), ("p2v1", "m.bib", "bib", bib)], "paper_version string, file string, kind string, text string")
    entries = scan.bibliography(files)
    got = {(r.paper_version, r.bib_key): (r.title, r.year, r.arxiv_id, r.doi) for r in entries.collect()}
    assert got["p1v1", "a"] == ("Some fine long title", 2018, "1805.01978", None)
    assert got["p1v1", "b"] == ("Venue of 2016, doi 10.1000/xy.z", 2016, None, "10.1000/xy.z")
    assert got["p2v1", "c"][2:] == ("2001.00001", "10.1/2") and ("p1v1", "c") not in got
    joined = extract.bibliography_with_sites(entries.where("paper_version = 'p1v1'"), sites)
    assert {r.bib_key: (r.cite_count, r.raw == "") for r in joined.collect()} == {"a": (2, False), "b": (1, False), "ghost": (1, True)}


@pytest.mark.parametrize(
    "weights, level",
    [(["DECISIVE"], "CONFIRMED"), (["STRONG", "STRONG"], "LIKELY"), (["STRONG", "WEAK"], "LIKELY"), (["STRONG"], "POSSIBLE"), (["WEAK", "WEAK"], "POSSIBLE"), (["x"], "UNKNOWN")],
)
def test_assess(spark, weights, level):
    rows = [("s", "1", i, w, f"d{i}", w == "x") for i, w in enumerate(weights)] + [("s", "1", 9, "DECISIVE", "against", True)]
    got = evidence.assess(spark.createDataFrame(rows, "subject_kind string, subject_id string, ord int, weight string, detail string, contradicted boolean")).first()
    assert got.confidence == level
    if level == "LIKELY":
        assert got.rationale == "d0; d1"


def test_record_needs_support(spark):
    claims = spark.createDataFrame([("m", str(i), "CONFIRMED") for i in range(4)], "subject_kind string, subject_id string, confidence string")
    cited = [("m", "1", "k", "evi://a", None, None, "SUPPORTS"), ("m", "2", "k", "evi://a", None, None, "CONTRADICTS"), ("m", "3", "k", "evi://b", None, "x", "SUPPORTS")]
    e = spark.createDataFrame(cited, "subject_kind string, subject_id string, kind string, uri string, locator string, excerpt string, stance string")
    final, kept = evidence.record(claims, e, spark.createDataFrame([("evi://a",)], "uri string"))
    assert {r.subject_id: r.confidence for r in final.collect()} == {"0": "UNKNOWN", "1": "CONFIRMED", "2": "UNKNOWN", "3": "UNKNOWN"}
    assert sorted(r.subject_id for r in kept.collect()) == ["1", "2"]


def test_narrative_fields(spark):
    df = spark.createDataFrame([("1", {"problem": "x", "components": "", "other": "y"})], "id string, fields map<string,string>")
    got = evidence.narrative(df).first()
    assert got.fields == {"problem": "x"} and got.unknown_fields == ["other"]
