"""Exponion search against a scan of all centroids."""

import hashlib

import numpy as np
import pytest

from lumenweave.llm import centroids as C


def plain(rows, k, rounds, dimensions, scale=256):
    """rows (vec_id, list) to {(vec_id, vector): (cluster, distance, inertia of cluster, of all, digest)}."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middle))  # noqa: E731, B023
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(middle)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                middle[c] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(v) for _, v in kept]
    sums = [sum(d for d, o in last if o == c) for c in range(len(middle))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted((str(i), c, d, sums[c], sum(sums), digest[c]) for (i, _), (d, c) in zip(kept, last))


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "'x' as ids", "2 as v")
    return sorted((str(r.vec_id), *r[1:]) for r in C.clustered(df, **options).collect())


def some(seed, n, dimensions, spread=3):
    """Vectors in knots, many of them equal, on a coarse grid so that ties are common."""
    r = np.random.default_rng(seed)
    knots = r.integers(-spread, spread + 1, (8, dimensions))
    x = (knots[r.integers(0, 8, n)] + r.integers(-1, 2, (n, dimensions))) / 256
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed,dimensions,k,rounds", [(1, 2, 7, 5), (2, 3, 40, 5), (3, 64, 12, 3), (4, 1, 5, 4), (5, 2, 1, 2), (6, 2, 2, 6)])
def test_against_all_centroids(spark, seed, dimensions, k, rounds):
    rows = some(seed, 300, dimensions)
    assert got(spark, rows, k=k, rounds=rounds, dimensions=dimensions) == plain(rows, k, rounds, dimensions)


def test_what_is_left_out_and_what_is_not(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (2, [nan, 1.0]), (3, [1.0, inf]), (4, [1.0, -inf]), (5, [1.0, None]), (6, [1.0]), (7, None), (8, []), (None, [0.25, 0.0]), (None, [0.25, 1.0]), (1, [0.5, -0.5]), (9, [-0.001, 0.001])]
    want = plain(rows, 3, 5, 2)
    assert len(want) == 5 and got(spark, rows, k=3, dimensions=2) == want


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = some(7, 5, 2)
    assert got(spark, rows, k=40, dimensions=2) == plain(rows, 40, 5, 2)
    assert got(spark, [(1, None)], k=40, dimensions=2) == []
    assert got(spark, [], dimensions=2) == []


def test_a_third_of_all_vectors_equal(spark):
    rows = [(i, [0.0, 0.0] if i % 3 else v) for i, v in some(8, 300, 2)]
    assert got(spark, rows, k=9, dimensions=2) == plain(rows, 9, 5, 2)


def test_large_components_are_exact_and_larger_ones_an_error(spark):
    r = np.random.default_rng(9)
    rows = [(i, (r.integers(-(2**27), 2**27, 4) / 256).tolist()) for i in range(60)]
    assert got(spark, rows, k=6, dimensions=4) == plain(rows, 6, 5, 4)
    with pytest.raises(Exception, match="beyond"):
        got(spark, [*rows, (99, [0.0, 0.0, 0.0, 1e6])], k=6, dimensions=4)


def test_the_ball_holds_the_nearest_two():
    """Bounds stay bounds, assignments exact, through random moves of centroids; most vectors are settled by bounds."""
    r = np.random.default_rng(10)
    for trial in range(30):
        d = int(r.integers(1, 5))
        x, c = r.integers(-40, 40, (200, d)), r.integers(-40, 40, (12, d))
        own, upper, lower = C.Search(c).first(x)
        for _ in range(6):
            new = c + r.integers(-3, 4, c.shape) * r.integers(0, 2, (12, 1))
            gap = new - c
            c = new
            own, upper, lower = C.Search(c, C._up(np.sqrt((gap * gap).sum(1)))).again(x, own, upper, lower)
            full = C.squared(x, c)
            assert (own == full.argmin(1)).all()
            rows = np.arange(len(x))
            assert (upper >= np.sqrt(full[rows, own])).all()
            full[rows, own] = np.iinfo(np.int64).max
            assert (lower <= np.sqrt(full.min(1))).all()


def test_blocks(spark, monkeypatch):
    rows = some(11, 2500, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), *r[1:]) for r in C.clustered(df, k=6, dimensions=2).collect()) == plain(rows, 6, 5, 2)
