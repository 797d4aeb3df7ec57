import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenweave.llm import ngrams
from lumenweave.llm.blocks import mix

SCHEMA = "doc_id long, text string, payload string"


def tokens(text):
    return _split(text) + [None]


def _split(text):
    return [w.decode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]


def brute(rows, order=3):
    """Plain interpolated modified Kneser-Ney: raw counts of the longest runs, distinct words before for all shorter ones."""
    held = {i: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    runs = lambda x: list(zip(*([*["<s>"] * (order - 1), *x][i:] for i in range(order))))
    c, counts = Counter(), {order: Counter()}
    for i, (_, t) in enumerate(rows):
        if not held[i]:
            c.update(tokens(t))
            counts[order].update(runs(tokens(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {k: [0, *ngrams.discounts([sum(n == j for n in counts[k].values()) for j in (1, 2, 3, 4)])] for k in counts}
    total, free = defaultdict(int), defaultdict(float)
    for k in counts:
        for g, n in counts[k].items():
            total[k, g[:-1]] += n
            free[k, g[:-1]] += cuts[k][min(n, 3)]
    n_tokens, v = sum(c.values()), len(c)

    def p(g):
        if not g:
            return 1 / (v + 1)
        low, k = p(g[1:]), len(g)
        if not total[k, g[:-1]]:
            return low
        n = counts[k][g]
        return (n - cuts[k][min(n, 3)] + free[k, g[:-1]] * low) / total[k, g[:-1]]

    out = []
    for i, (d, t) in enumerate(rows):
        x = tokens(t)
        out.append((d, held[i], len(x), sum(c[w] > 0 for w in x), n_tokens, sum(math.log10((c[w] + 1) / (n_tokens + v + 1)) for w in x), sum(math.log10(p(g)) for g in runs(x))))
    vocabulary = [*c, "never seen"]
    for g in [("<s>",) * (order - 1), *list(counts[order])[:5]]:
        if c:
            assert math.isclose(sum(p((*g[-order + 1 :], w)) for w in vocabulary), 1)
    return sorted(out, key=str)


def rows_of(n, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) if r.random() < 0.7 else "The" for _ in range(r.randint(0, 80)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (7, "the same"), (7, "the same"), (None, "no id"), (502, "É x y ω\tz " + "the " * 700)]


@pytest.mark.parametrize(("chunk", "order", "most"), [(ngrams.CHUNK, 3, 0.5), (40, 3, 0.5), (200, 3, 1.0), (200, 4, 1.0), (90, 5, 0.2)])
def test_matches_brute_force(spark, monkeypatch, chunk, order, most):
    monkeypatch.setattr(ngrams, "CHUNK", chunk)
    monkeypatch.setattr(ngrams, "PEEK", most)
    monkeypatch.setattr(ngrams, "CODES", 20 if most < 1 else ngrams.CODES)
    monkeypatch.setattr(ngrams, "SCORED", 500)
    rows = rows_of(120, 1)
    docs = spark.createDataFrame([(*x, "p") for x in rows], SCHEMA)
    about = ngrams._peeked(docs.fillna(""), 2 * ngrams.width(spark), ngrams.width(spark))
    assert most < 1 or len(about.hot) and len(about.pairs)  # spread words and pairs are part of what is tested
    got = sorted((tuple(r) for r in ngrams.score(docs, order).collect()), key=str)
    want = brute(rows, order)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("kind", ["runs3", "words"])
def test_a_missing_shard_is_an_error(spark, kind):
    docs = spark.createDataFrame([(*x, "p") for x in rows_of(60, 2)], SCHEMA)
    about = ngrams.train(docs)
    name, shard = next(x for x in about["files"] if x[0] == kind)
    path = about["uri"].removeprefix("file://") + f"/{name}-{shard}"
    os.remove(path)
    with pytest.raises(FileNotFoundError):
        ngrams.Model(about).scores([t.encode() for _, t in rows_of(60, 2) if t])


def test_large_arrays_are_found(tmp_path):
    key = np.unique(mix(np.arange(50_000, dtype=np.uint64)))
    for whole in (False, True):
        for n in (0, 1, 5, 31, 32, 50_000):
            ngrams.put(f"{tmp_path}/{whole}-{n}", ngrams.sorted_keys(key[:n], whole))
            f = ngrams.File(f"{tmp_path}/{whole}-{n}")
            asked = np.concatenate((key[:n][::-1], mix(np.arange(60_000, 70_000, dtype=np.uint64))))
            at, found = f.find(0, asked)
            assert found[:n].all() and not found[n:].any() and (at[:n] == np.arange(n)[::-1]).all()


def test_few_rows(spark):
    assert ngrams.score(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(1, None)], [(i, "alone") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]):
        got = sorted((tuple(r) for r in ngrams.score(spark.createDataFrame([(*x, "") for x in rows], SCHEMA)).collect()), key=str)
        want = brute(rows)
        assert [x[:5] for x in got] == [x[:5] for x in want]
        assert [x[5:] for x in got] == [pytest.approx(x[5:]) for x in want]
