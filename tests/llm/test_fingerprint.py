import hashlib
import math
from functools import reduce

import numpy as np
import pytest

from lumenweave.llm import fingerprint as fp

SCHEMA = "doc_id long, text string"
ALL = (1 << 64) - 1


def plain_mix(x):
    for up, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> up)) * by & ALL
    return x ^ (x >> 31)


def plain_hashes(text):
    """Distinct hashes of five-word shingles, in plain integers: a polynomial of bytes for a word, another of words for a shingle."""
    base, step = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    byte = [plain_mix((i + 1) * base & ALL) | 1 for i in range(256)]
    words = [plain_mix(sum(byte[c] * pow(base, i, 1 << 64) for i, c in enumerate(w)) & ALL) for w in text.encode().lower().split()]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        run = words[i : i + 5]
        h = run[0] if len(run) == 5 else len(words)
        for w in run[1:] if len(run) == 5 else run:
            h = (h * step + w) & ALL
        out.add(plain_mix(h))
    return out


def plain_print(text):
    own = plain_hashes(text)
    size = max(64, 1 << (8 * max(1, len(own)) - 1).bit_length())
    spots = lambda h, size: {(plain_mix((h + (i + 1) * 0x9E3779B97F4A7C15) & ALL) >> 32) * size >> 32 for i in range(4)}
    return own, {h for h in own if h < 1 << 61}, size, set().union(*(spots(h, size) for h in own)), spots


def plain_likeness(a, b):
    small = lambda x: (len(x[1]), x[2], len(x[0] - x[1]) if len(x[0]) <= 64 else 0)
    (own, kept, length, bits, _), (own2, kept2, size, bits2, spots) = (a, b) if small(a) <= small(b) else (b, a)
    if not own or not own2:
        return float(own == own2)
    every, every2 = (len(x) <= 64 or x == y for x, y in ((own, kept), (own2, kept2)))
    if len(kept) < 128 and every and every2:
        return len(own & own2) / min(len(own), len(own2))
    if len(kept) < 128 and every and (len(bits2) <= 0.75 * size or not kept):
        chance = (len(bits2) / size) ** 4
        hits = sum(spots(h, size) <= bits2 for h in own) / len(own)
        return min(1.0, max(0.0, (hits - chance) / (1 - chance)))
    if len(kept) < 128 and not every:
        m = min(length, size)
        x, y = {i * m // length for i in bits}, {i * m // size for i in bits2}
        if len(x | y) <= 0.9 * m:
            n, n2, both = (-math.log1p(-len(z) / m) for z in (x, y, x | y))
            return min(1.0, max(0.0, (n + n2 - both) / min(n, n2)))
    return len(kept & kept2) / len(kept) if kept else 0.0


def plain_text(x):
    own, kept, size, bits, _ = x
    hexes = lambda hs: "".join(f"{h:016x}" for h in sorted(hs))
    return f"{hexes(kept)}:{hexes(own - kept) if len(own) <= 64 else ''}:{int(''.join(str(int(i in bits)) for i in range(size)), 2):0{size // 4}x}"


def plain(rows):
    """By plain Python, over rows sorted as the operator says."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = map(plain_print, (t, e, nxt))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_text(a), plain_text(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None)],
        [(1, "only one here, and its own next")],
        [(3, "a b c d e f g h"), (1, "é ü 漢字 four five six seven"), (2, ""), (9, "x " * 3000), (9, "x"), (4, None), (None, "no id"), (7, "a b c d e f g h")],
        [(i * 7 % 101, f"text number {i} with some words of its own {i * i}") for i in range(101)],
        [(i, " ".join(f"w{j * j % (37 + i)}" for j in range(20 * i))) for i in range(12)],
        [(5, f"one very frequent id {i}") for i in range(300)],
    ],
)
def test_matches_plain_version(spark, rows):
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], SCHEMA + ", bucket string")
    assert sorted((tuple(r) for r in fp.edits(docs).collect()), key=str) == plain(rows)


def test_containment_of_a_part():
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 4000)]
    whole, part, other = fp.prints([" ".join(words).encode(), " ".join(words[100:900]).encode(), b"quite another text of a few words"])
    assert fp.likeness(whole, part) == 1.0
    assert fp.likeness(whole, other) == 0.0
    first, second = fp.prints([" ".join(words[:2004]).encode(), " ".join(words[2000:]).encode()])
    assert fp.merge(first, second).kept.tolist() == whole.kept.tolist()
    assert abs(len(whole.kept) / 3996 - 1 / fp.SCALE) < 0.02
    assert all((x == y).all() for x, y in zip(fp.read_back(fp.written_out(whole)), whole))


def test_short_texts_in_a_long_one():
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 2000)]
    cuts = [" ".join(words[i : i + 5 + i % 9]).encode() for i in range(0, 1800, 9)]
    strangers = [" ".join(f"v{x}" for x in rng.integers(0, 10**6, 5 + i % 9)).encode() for i in range(200)]
    whole, *rest = fp.prints([" ".join(words).encode(), *cuts, *strangers])
    assert [fp.likeness(x, whole) for x in rest[:200]] == [1.0] * 200
    assert np.mean([fp.likeness(x, whole) for x in rest[200:]]) < 0.03
    halves = fp.prints([" ".join(words[:1004]).encode(), " ".join(words[1000:]).encode()])
    assert [fp.likeness(x, fp.merge(*halves)) for x in rest[:200]] == [1.0] * 200


def test_general_form(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None)], SCHEMA)
    got = sorted(((r.doc_id or 0, r.sketch) for r in fp.fingerprints(docs).collect()))
    assert got[0] == (0, []) and got[1] == got[2]


def words_of(n, start=0):
    return " ".join(f"w{x}" for x in range(start, start + n))


def print_of(text):
    return fp.prints([text.encode()])[0]


def same_sets(a, b):
    return a.kept.tolist() == b.kept.tolist() and a.rest.tolist() == b.rest.tolist()


SIZES = [0, 1, 5, 7, 40, 68, 69, 200, 1000, 10_000]


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("m", SIZES)
def test_merges_of_any_two_sizes(n, m):
    """A merged fingerprint holds all of both parts: containment is 1 for each, and for short texts cut from either."""
    a, b = print_of(words_of(n)), print_of(words_of(m, 50_000))
    for x in (fp.merge(a, b), fp.merge(b, a)):
        assert same_sets(x, fp.merge(a, b)) and x.bits.tolist() == fp.merge(a, b).bits.tolist()
        for part in (a, b):
            if part.bits.any():
                assert fp.likeness(part, x) > 0.999
        for size, start in ((n, 0), (m, 50_000)):
            for i in range(0, size - 8, max(1, size // 20)):
                assert fp.likeness(print_of(words_of(8, start + i)), x) > 0.999
        strangers = [fp.likeness(print_of(words_of(12, 90_000 + 20 * i)), x) for i in range(60)]
        assert np.mean(strangers) < 0.1
    together = set(plain_hashes(words_of(n))) | set(plain_hashes(words_of(m, 50_000)))
    assert set(fp.merge(a, b).kept.tolist()) == {h for h in together if h < 1 << 61}
    assert fp.merge(a, b).bits.mean() < 0.7


def test_merges_in_any_order_and_grouping():
    texts = [words_of(n, 1000 * i) for i, n in enumerate([3, 500, 7, 0, 60, 30, 2000, 64, 65, 1])]
    parts = [print_of(t) for t in texts]
    one = reduce(fp.merge, parts)
    other = fp.merge(reduce(fp.merge, parts[5:][::-1]), reduce(fp.merge, parts[:5]))
    assert same_sets(one, other)
    for x in (one, other):
        assert all(fp.likeness(p, x) > 0.99 for p in parts if p.bits.any())
    assert same_sets(fp.merge(one, one), one) and fp.merge(one, one).bits.tolist() == one.bits.tolist()


def test_merging_very_many_small_parts_leaves_the_sketch():
    parts = [print_of(words_of(90, 1000 * i)) for i in range(200)]
    whole = reduce(fp.merge, parts)
    assert len(whole.kept) > 1500
    inside, outside = print_of(" ".join(words_of(90, 1000 * i) for i in range(20))), print_of(words_of(2000, 900_000))
    assert fp.likeness(inside, whole) > 0.95 and fp.likeness(outside, whole) < 0.05


@pytest.mark.parametrize("n,error", [(64, 0.001), (65, 0.08), (130, 0.06), (260, 0.05), (520, 0.04), (1020, 0.05), (2000, 0.04)])
def test_stated_error_of_likeness(n, error):
    """Texts of n shingles half taken from a longer one, and from one of like size."""
    rng = np.random.default_rng(n)
    off, near = [], []
    for i in range(60):
        own = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
        half = [f"v{x}" for x in rng.integers(0, 10**9, n + 4 - len(own) // 2)]
        one, two = print_of(" ".join(own)), print_of(" ".join(own[: len(own) // 2] + half))
        true = len(set(plain_hashes_fast(own)) & set(plain_hashes_fast(own[: len(own) // 2] + half))) / n
        off.append(fp.likeness(one, two) - true)
        near.append(fp.likeness(one, one))
    assert np.sqrt(np.mean(np.square(off))) <= error and abs(np.mean(off)) <= error / 2 and near == [1.0] * 60


def plain_hashes_fast(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_grouped_merge(spark):
    rows = [(k, words_of(n, 5000 * i)) for i, (k, n) in enumerate([("a", 700), ("a", 7), ("b", 3), (None, 40), ("a", 90), (None, 0), ("c", 0)] + [("hot", 30)] * 300)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, text string").selectExpr("*", "1 as bits").repartition(8)
    got = {r.k: (fp.read_back(r.fingerprint), r.n) for r in fp.merged(df, ["k"], held=2).collect()}
    assert {k: n for k, (_, n) in got.items()} == {"a": 3, "b": 1, None: 2, "c": 2, "hot": 300}
    for key in got:
        want = reduce(fp.merge, [print_of(t or "") for k, t in rows if k == key])
        assert same_sets(got[key][0], want)
    assert not fp.merged(df.limit(0), ["k"]).collect()
