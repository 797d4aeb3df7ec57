"""Centroid clustering of integer vectors with exponion search.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of that to all others. While the
first is below the second, or below half the way to the nearest other centroid, nothing is computed. Otherwise the exact
distance to its own centroid becomes the upper bound, and if that doesn't settle it, only centroids in a ball around its
own are scanned: twice the upper bound plus the way to the nearest other centroid, which holds the nearest two for sure.
The ball is a prefix of the centroid's list of others by distance; its edge belongs to it, so ties are kept.

Distances and sums are exact integers. A pass over the vectors is one pass over a table of blocks, from whose partial
sums, merged by centroid, come the next centroids; what goes to the driver is as large as the centroids. The next pass
reads the bounds from the table that the one before has written.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, fresh, prepare, table

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors of a block.
BLOCK = 8192
#: Components up to which products are exact in floating point, and up to which squared distances fit in 64 bits.
EXACT, LARGEST = 1 << 22, 1 << 27
#: Relative slack of bounds, far above the error of their few roundings.
SLACK = 1e-12

_STATE = "ids array<bigint>, x binary, own binary, upper binary, lower binary, sums binary, inertia binary"
_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("x", "own", "upper", "lower", "sums", "inertia"))])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two arrays of int64."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), np.int64)
    if max(np.abs(x).max(), np.abs(y).max()) <= EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.int64)
    for j, c in enumerate(y):
        d = x - c
        out[:, j] = (d * d).sum(1)
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


@dataclass
class Search:
    """What a pass needs of the centroids: themselves, their lists of others by distance, and how far they have moved."""

    centroids: np.ndarray
    moved: np.ndarray | None = None

    def __post_init__(self):
        d = np.sqrt(squared(self.centroids, self.centroids))
        self.near = np.argsort(d, axis=1, kind="stable")
        for i, row in enumerate(self.near):  # a centroid comes before its equals
            row[: (row == i).argmax() + 1] = [i, *row[: (row == i).argmax()]]
        self.ways = np.take_along_axis(d, self.near, 1)
        self.nearest = self.ways[:, 1] if len(d) > 1 else np.full(len(d), np.inf)
        if self.moved is not None and len(d) > 1:
            largest = np.argsort(self.moved)[-2:]
            self.others = np.where(np.arange(len(d)) == largest[1], self.moved[largest[0]], self.moved[largest[1]])

    def scan(self, x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest of some centroids, of equals the smallest number, its squared distance, and that of the next."""
        numbers = np.sort(numbers)
        d = squared(x, self.centroids[numbers])
        best = d.argmin(1)
        rows = np.arange(len(x))
        least = d[rows, best]
        d[rows, best] = np.iinfo(np.int64).max
        return numbers[best], least, d.min(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, least, second = self.scan(x, np.arange(len(self.centroids)))
        return own, _up(np.sqrt(least)), _down(np.sqrt(second))

    def again(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignments and bounds after the centroids have moved."""
        if len(self.centroids) == 1:
            return own, _up(upper + self.moved[own]), lower
        own, upper, lower = own.copy(), _up(upper + self.moved[own]), _down(lower - self.others[own])
        safe = np.maximum(lower, _down(self.nearest[own] / 2))
        doubt = np.flatnonzero(upper >= safe)
        gap = x[doubt] - self.centroids[own[doubt]]
        upper[doubt] = _up(np.sqrt((gap * gap).sum(1)))
        doubt = doubt[upper[doubt] >= safe[doubt]]
        order = doubt[np.argsort(own[doubt], kind="stable")]
        ends = np.searchsorted(own[order], np.arange(len(self.centroids) + 1))
        for c in np.flatnonzero(np.diff(ends)):
            group = order[ends[c] : ends[c + 1]]
            ball = np.searchsorted(self.ways[c], _up(2 * upper[group] + self.nearest[c]), "right")
            level = np.ceil(np.log2(np.maximum(ball, 2))).astype(int)  # balls grow by doubling, so few sizes are scanned
            for n in np.unique(level):
                rows = group[level == n]
                own[rows], least, second = self.scan(x[rows], self.near[c][: 1 << n])
                upper[rows], lower[rows] = _up(np.sqrt(least)), _down(np.sqrt(second))
        return own, upper, lower


def _sums(own: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of values by centroid."""
    order = np.argsort(own, kind="stable")
    present, starts = np.unique(own[order], return_index=True)
    out = np.zeros((k, values.shape[1]), np.int64)
    if len(present):
        out[present] = np.add.reduceat(values[order], starts, 0)
    return out


def _row(search: Search, ids: pa.Array, x: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    own, upper, lower = found
    k = len(search.centroids)
    gap = x - search.centroids[own]
    sums = _sums(own, np.column_stack((np.ones(len(x), np.int64), x)), k)
    inertia = _sums(own, (gap * gap).sum(1)[:, None], k)
    small = np.abs(x).max(initial=0) < 1 << 15
    row = {"ids": ids.to_pylist(), "x": x.astype("<i2" if small else "<i4").tobytes(), "own": own.astype("<i4").tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "sums": sums.tobytes(), "inertia": inertia.tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)


def _vectors(raw: bytes, n: int, dimensions: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * n * dimensions else "<i4").reshape(n, dimensions).astype(np.int64)


def _start(search: Search, dimensions: int, scale: int, batches):
    """Rows (vec_id, v) to blocks with their first assignment."""
    ids, parts, n = [], [], 0

    def block():
        x = np.floor(np.concatenate(parts) * scale)
        if np.abs(x).max(initial=0) > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST // scale}: distances would not fit in 64 bits")
        x = x.astype(np.int64)
        return _row(search, pa.concat_arrays(ids), x, search.first(x))

    for b in batches:
        ids.append(b.column(0))
        parts.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions))
        n += b.num_rows
        if n >= BLOCK:
            yield block()
            ids, parts, n = [], [], 0
    if n:
        yield block()


def _blocks(batches, dimensions: int):
    for b in batches:
        for i in range(b.num_rows):
            ids = b.column("ids")[i].values
            raw = lambda c: b.column(c)[i].as_py()  # noqa: B023, E731
            yield ids, _vectors(raw("x"), len(ids), dimensions), np.frombuffer(raw("own"), "<i4").astype(np.int64), np.frombuffer(raw("upper")), np.frombuffer(raw("lower"))


def _next(search: Search, dimensions: int, batches):
    for ids, x, own, upper, lower in _blocks(batches, dimensions):
        yield _row(search, ids, x, search.again(x, own, upper, lower))


def _partial(column: str, k: int, batches):
    """One row for each centroid: the sums over a task's blocks."""
    total = 0
    for b in batches:
        for raw in b.column(column).to_pylist():
            total = total + np.frombuffer(raw, np.int64).reshape(k, -1)
    if not isinstance(total, int):
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["c", "s"])


def _totals(state: DataFrame, column: str, k: int, width: int) -> list[list[int]]:
    """Exact sums by centroid over all blocks; k rows."""
    parts = state.select(column).mapInArrow(partial(_partial, column, k), "c int, s array<bigint>")
    rows = parts.groupBy("c").agg(*(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width))).collect()
    out = [[0] * width for _ in range(k)]
    for r in rows:
        out[r.c] = [int(v) for v in r[1:]]
    return out


def _labelled(dimensions: int, columns: list, centroids: np.ndarray, batches):
    for ids, x, own, *_ in _blocks(batches, dimensions):
        gap = x - centroids[own]
        inertia, total, sha = columns
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(own, pa.int32()), pa.array((gap * gap).sum(1)), pa.array([inertia[c] for c in own], pa.int64()), pa.array([total] * len(own), pa.int64()), pa.array([sha[c] for c in own])],
            names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        )


_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vectors (vec_id, column) to (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors count if they have as many components as asked, none of them null or not finite; a component x becomes
    floor(scale * x). The k vectors of least SHA-256 of "seed:vec_id" are the first centroids, of equal hashes (repeated or
    null ids) the least vector first; with fewer vectors all are. Repeated rows count each, and equal vectors share a
    cluster. A centroid without vectors stays. Sums of distances beyond 64 bits are the largest 64-bit integer. Components beyond
    524,288 in size (at scale 256) are an error, as squared distances would not fit. Empty tables give no rows.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(column)
    kept = vectors.where((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(sha, "v").limit(k).select("v").collect()  # k rows
    if not first:
        return spark.createDataFrame([], _OUT)
    centroids = np.floor(np.array([r.v for r in first]) * scale)
    if np.abs(centroids).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}: distances would not fit in 64 bits")
    centroids = centroids.astype(np.int64)
    k = len(centroids)

    def kept_as(df: DataFrame, old: str | None) -> tuple[DataFrame, str]:
        path = fresh(spark, "clusters")
        df.write.parquet(path)
        if old:
            discard(spark, old)
        return spark.read.schema(_STATE).parquet(path), path

    state, path = kept_as(kept.mapInArrow(partial(_start, Search(centroids), dimensions, scale), _STATE), None)
    for _ in range(rounds):
        sums = _totals(state, "sums", k, dimensions + 1)
        new = np.array([[x // n for x in s] if n else old for (n, *s), old in zip(sums, centroids.tolist())], np.int64)
        gap = new - centroids
        search = Search(new, _up(np.sqrt((gap * gap).sum(1))))
        state, path = kept_as(state.mapInArrow(partial(_next, search, dimensions), _STATE), path)
        centroids = new
    most = (1 << 63) - 1
    inertia = [min(s[0], most) for s in _totals(state, "inertia", k, 1)]
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return state.select("ids", "x", "own", "upper", "lower").mapInArrow(partial(_labelled, dimensions, [inertia, min(sum(inertia), most), texts], centroids), _OUT)


def op11_clusters(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))
