import hashlib
import random
import re

import pytest

from lumenweave.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for i, t in items:
            x = words(t)
            n = min(window, len(x))
            for a in range(len(x) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, items string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = dc.matches(d, i).mapInArrow(dc._digest_batches, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return sorted((tuple(r) for r in got.collect()), key=str)


def cases(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3)] + ["É", "naïve"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 2, 5, 9, 10, 11, 14, 25])))) for i in range(14)]
    items += [(90, None), (91, items[3][1]), (10, "W0, w1!")]
    docs = [(i, ", ".join(r.choice([*vocabulary, "other"]).upper() for _ in range(r.randint(0, 90)))) for i in range(40)]
    docs += [(100 + i, "other " + (t or "") + " other") for i, t in items] + [(200, None), (201, ""), (201, ""), (None, items[7][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    docs, items = cases(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_many_automata_and_no_rows(spark, monkeypatch):
    docs, items = cases(4)
    monkeypatch.setattr(dc, "ITEM_WORDS", 60)
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert run(spark, docs[:5], []) == brute(docs[:5], [])


def test_passages_go(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, "Clean text stays."), (2, "Before it, " + item.upper() + "; after it there are a good many more words than in the passage"), (3, item + " end"), (4, None)]
    d = spark.createDataFrame([(*x, "en") for x in docs], "doc_id long, text string, spans string")
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.spans) for r in dc.decontaminate(d, i).collect()}
    assert got == {1: ("Clean text stays.", "en"), 2: ("Before it, ; after it there are a good many more words than in the passage", "en"), 4: (None, "en")}
