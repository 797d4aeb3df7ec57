import random

import numpy as np

from lumenweave.llm import likeness, simhash


def vocabulary(r, n):
    """Words by Zipf's law."""
    return r.choices([f"w{i}" for i in range(5000)], [1 / (i + 1) for i in range(5000)], k=n)


def jaccard(a, b, k=5):
    a, b = ({tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))} for x in (a, b))
    return len(a & b) / len(a | b)


def changed(r, words, how, share):
    n = int(len(words) * share)
    at = r.randrange(1, len(words) - n)
    if how == "appended":
        return words + vocabulary(r, n)
    if how == "truncated":
        return words[: len(words) - n]
    if how == "inserted":
        return words[:at] + vocabulary(r, n) + words[at:]
    return [("edited" if i % (len(words) * 2 // max(n, 1)) == 7 else w) for i, w in enumerate(words)]


def stays(spark, texts):
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    return {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}


def test_copies_with_one_passage_changed_go(spark):
    r = random.Random(1)
    texts, gone = [], set()
    for n in (60, 100, 300, 1000):
        for how in ("appended", "truncated", "inserted", "scattered"):
            for _ in range(12):
                a = vocabulary(r, n)
                b = changed(r, a, how, 0.17 if how != "scattered" else 0.04)
                if jaccard(a, b) >= 0.8:
                    gone.add(len(texts) + 1)
                texts += [a, b]
    assert len(gone) > 150
    assert set(range(len(texts))) - stays(spark, texts) == gone


def test_bands_meet_whatever_is_alike():
    r = random.Random(2)
    pairs = []
    while len(pairs) < 400:
        a = vocabulary(r, r.choice([12, 40, 200]))
        b = a + vocabulary(r, len(a) // 5)
        if jaccard(a, b) >= 0.8:
            pairs += [" ".join(a).encode(), " ".join(b).encode()]
    keys = likeness.bands(likeness.shingle_sets(pairs, 5))
    assert (keys[::2] == keys[1::2]).any(1).all()
    assert len(np.unique(keys[::2, 0])) > 190


def test_files_are_read_past_the_held_rows(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(likeness, "AT_ONCE", 50)
    base = vocabulary(r, 300)
    texts = [base[:i] + ["x"] + base[i:] for i in range(0, 300, 5)] + [vocabulary(r, 300) for _ in range(5)]
    assert stays(spark, texts) == {0, *range(60, 65)}


def test_simhash_finds_copies_that_share_no_band(spark):
    """The named method finds near copies by itself; what is within its distance and not alike stays apart."""
    r = random.Random(5)
    texts, pairs = [], set()
    while len(pairs) < 20:
        a = vocabulary(r, 2000)
        b = [*a[:1000], "edited", *a[1000:]]
        if (simhash.shingle_fingerprint(" ".join(a).encode()) ^ simhash.shingle_fingerprint(" ".join(b).encode())).bit_count() <= 3:
            pairs.add((len(texts), len(texts) + 1))
            texts += [a, b]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    found, uri = likeness.sets_of(docs, 5, simhash.shingle_fingerprint)
    classes = found.withColumnRenamed("doc_id", "rep").drop("bands").checkpoint()
    assert {(x.a, x.b) for x in simhash.alike_links(classes, uri).collect()} == pairs
    assert not simhash.alike_links(classes, uri, 0.9999).count()
    likeness.drop(uri)


def test_texts_travel_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "g h i j k l")], "doc_id long, text string")
    plan = simhash.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    assert sum("text#" in below for line, below in zip(plan.splitlines(), plan.splitlines()[1:]) if "Exchange hashpartitioning" in line) == 1
