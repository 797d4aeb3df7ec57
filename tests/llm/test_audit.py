"""The filter audit against a plain simulation of every order, document by document."""

import random
import re
from itertools import permutations

import pytest

from lumenweave.llm import audit as A

DOCS, LABELS = "doc_id long, text string, lang string, n long, digest string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    texts = [t or "" for _, t, *_ in docs]
    least = {}
    for (d, *_), t in zip(docs, texts):
        if d is not None:
            least[t] = min(least.get(t, d), d)
    rows = []
    for (d, _, lang, *_), t in zip(docs, texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), d is not None and d > least[t])) if x}
        rows.append((lang or "", fails, d in good and d is not None, d in toxic and d is not None))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
                left = kept
        for p, order, step in out:
            if p == part:
                out[p, order, step].append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(spark, docs, labels):
    rows = A.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def sample(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["ABC", "É", "a|b", "x#", "\x0b", "\xa0", "\x1c"]
    texts = [" ".join(r.choice(words[: r.choice([5, 60, 300, 307])]) for _ in range(r.choice([0, 1, 99, 100, 101, 150]))) for _ in range(n)]
    texts += [None, "", " \t\r\n", "\n lead", "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, " ".join(["y"] * 25 + [f"z{i}" for i in range(100)])]
    ids = [None, None, *range(n)]
    docs = [(r.choice(ids), r.choice(texts), r.choice(["en", "de", "", None]), 0, "x") for _ in range(3 * n)]
    labels = [(r.choice(ids), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(n)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_order(spark, seed):
    docs, labels = sample(seed, 60)
    assert got(spark, docs, labels) == plain(docs, labels)


def test_a_text_of_a_third_of_all_rows(spark):
    docs = [(i, "same text" if i % 3 else f"own {i}", "en", 0, "") for i in range(600)]
    assert got(spark, docs, []) == plain(docs, [])


def test_repeated_rows_and_long_texts(spark):
    docs = [(2, "t", "en", 0, ""), (2, "t", "en", 0, ""), (1, "t", "de", 0, ""), (1, "t", "de", 0, ""), (3, "word " * 200_000, "en", 0, ""), (4, "word " * 200_000, None, 0, "")]
    labels = [(2, 1, 0), (2, 1, 1), (2, 0, 0), (None, 1, 1)]
    assert got(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}
    assert len(got(spark, [(1, None, None, None, None)], [])) == 600


def test_shares_and_sums(spark):
    """What a step removes and what was removed before is all that fails; all orders end with the same survivors."""
    docs, labels = sample(3, 40)
    rows = got(spark, docs, labels)
    for part in {k[0] for k in rows}:
        assert len({v[0] for k, v in rows.items() if k[0] == part and k[2] == 5}) == 1
        for f in "ABCDE":
            assert len({v[1] + v[2] for k, v in rows.items() if k[0] == part and k[1][k[2] - 1] == f}) == 1
