import random

import xxhash

from lumenweave.llm import simhash

SCHEMA = "doc_id long, text string"


def brute(rows, distance=3):
    def print_of(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, f[i], least[find(i)]) for i, (d, _) in enumerate(rows)}


def texts(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = [None, "", " \t", "A", "a b", "A  B"]
    while len(out) < n:
        base = [r.choice(words) for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(1, 6)):
            out.append(" ".join(base))
            base[r.randrange(len(base))] = r.choice(words)
    return list(enumerate(out[:n]))


def result(got):
    return {(x.doc_id, x.f0 & (2**64 - 1), x.component_id) for x in got.collect()}


def test_matches_brute_force(spark):
    rows = texts(300)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA + ", component_id string")
    assert result(simhash.near_copies(docs)) == brute(rows)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rows = texts(250, 2)
    got = simhash.near_copies(spark.createDataFrame(rows, SCHEMA))
    assert result(got) == brute(rows)


def test_long_runs(spark):
    import numpy as np

    r = np.random.default_rng(3)
    f = np.unique(r.integers(0, 1 << 12, 400).astype(np.uint64))
    got = simhash.run_links(np.zeros(len(f), np.int64), np.arange(len(f)), [f, np.zeros_like(f)], simhash.Cut(2, 32, 1))
    seen = {0}
    front = [0]
    while front:
        i = front.pop()
        for j in range(len(f)):
            if j not in seen and (int(f[i]) ^ int(f[j])).bit_count() <= 1:
                seen.add(j)
                front.append(j)
    assert {b for a, b in got.tolist() if a == 0} | {0} == seen


def test_empty_and_null_ids(spark):
    assert simhash.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words here now then")]
    got = sorted(((x.doc_id or 0, x.component_id or 0) for x in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5)]


def test_word_fingerprints_of_close_texts():
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    edit = list(base)
    for i in range(0, 400, 80):
        edit[i] = "new"
    a, b, c = simhash.word_fingerprints([" ".join(x).encode() for x in (base, edit, [f"w{r.randrange(5000)}" for _ in range(400)])])
    far = lambda x, y: sum(int(p ^ q).bit_count() for p, q in zip(x[:2], y[:2]))
    assert far(a, b) < 14 < far(a, c)


def test_one_of_each_group_stays(spark):
    r = random.Random(5)
    rows, kept = [], set()
    for i in range(30):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 4, 60, 300]))]
        rows.append((len(rows), " ".join(base), "en"))
        kept.add(len(rows) - 1)
        for _ in range(r.randrange(3)):
            copy = list(base)
            if len(base) >= 300:
                copy[r.randrange(len(copy))] = "edited"
            rows.append((len(rows), " ".join(copy), "fr"))
    rows += [(999, "", "x"), (1000, None, "x"), (0, rows[0][1], "en"), (None, "quite alone without an id", "y"), (None, "quite alone without an id", "y")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, own_id string"))
    assert got.columns == ["doc_id", "text", "own_id"]
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got.collect()) == sorted([(False, x) for x in kept | {999}] + [(True, 0)])
