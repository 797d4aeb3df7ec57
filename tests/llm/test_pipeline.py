"""The whole pipeline against its stages applied plainly, and what it must catch and keep."""

import random

import pytest

import corpus_pipeline
from lumenweave.llm import decontaminate, pii, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    words = [a + b for a in "ba de fi go lu mo ne pa ri so".split() for b in "ran tel ving dor mas pel".split()]

    def prose(n):
        out = [""]
        while len(out) <= n:
            w = r.choice(words)
            if w != out[-1]:
                out.append(w)
        return " ".join(out[1:])

    item = prose(20)
    docs = [(i, prose(r.randint(60, 120)), "en", f"s{i % 3}") for i in range(500)]
    text = {i: t for i, t, _, _ in docs}
    changed = text[10].split()
    changed[5] = "edited"
    docs += [(600, text[3], "en", "s0"), (601, " ".join(changed), "en", "s1"), (602, prose(70) + " " + item + " " + prose(60), "en", "s2"), (603, item, "en", "s0")]
    docs += [(604, "&&& ".join(text[30].split()), "en", "s0"), (605, prose(300) + " write to a.b@site.org today", "en", "s1"), (606, None, "en", "s1"), (607, "", None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(400)] + [(604, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def test_stages(spark, folder):
    path, docs, item = folder
    rows = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in rows.collect()}
        rows = stage(spark, rows, path)
        if name != "mixing":
            assert rows.columns == COLUMNS
        rows = rows.checkpoint()
        after = {r.doc_id: r for r in rows.collect()}
        assert set(after) <= set(before)
        kept.append((before, after))
    quality, dedup, leaks, private, mixed = kept
    clean = set(range(500))
    assert 604 not in quality[1] and len(clean - set(quality[1])) < 15
    assert {600, 601}.isdisjoint(dedup[1]) and set(dedup[0]) - set(dedup[1]) <= {600, 601, 607, 606}
    window = " ".join(item.split()[:10])
    assert 603 not in leaks[1] and item not in leaks[1][602].text and window not in leaks[1][602].text
    assert all(leaks[1][i].text == leaks[0][i].text for i in clean & set(leaks[0]))
    assert private[1][605].text.endswith("write to <EMAIL> today")
    assert all(private[1][i].text == pii_free(private[0][i].text) for i in private[0])
    assert all(r.n_chars == len(r.text or "") for r in private[1].values())
    assert 0.35 < sum(r.mix_tokens for r in mixed[1].values()) / sum(len((r.text or "").split()) + 1 for r in mixed[0].values()) < 0.65


def pii_free(text):
    out, at = "", 0
    for _, spans in pii.select([text or ""], pii.model()):
        for s, e, k in spans:
            out, at = out + (text or "")[at:s] + f"<{k.upper()}>", e
    return text if text is None else out + text[at:]


def test_run_is_the_stages(spark, folder):
    path, _, _ = folder
    a = sorted((tuple(r) for r in corpus_pipeline.run(spark, path).collect()), key=str)
    rows = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, path).checkpoint()
    assert a == sorted((tuple(r) for r in rows.collect()), key=str)
    assert decontaminate.WINDOW == 10 and simhash.LIKE_TEXTS.segments == 5


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, folder, name, stage):
    path, _, _ = folder
    rows = spark.read.parquet(f"{path}/documents.parquet").limit(0).selectExpr("*", "1 as extra")
    got = stage(spark, rows, path)
    assert got.count() == 0 and {*COLUMNS, "extra"} <= set(got.columns)
