"""Near copies by exact Jaccard similarity of word shingles.

Candidates share a band of MinHash values of their shingles, or any other key that callers deal them by. The sets themselves lie in files of the shared folder, so a
row of a band carries only where its set lies, and whoever meets in a run of equal bands is compared set by set.
"""

from __future__ import annotations

import uuid
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, blocks, combine, mix, runs_of
from .shared import filesystem, fresh, text_column, width

#: Bands and MinHash values in each: at similarity 0.8 a pair shares no band in 7 of a million cases.
BANDS, ROWS = 30, 5
#: Least Jaccard similarity of near copies.
LIKE = 0.8
#: Rows that a task holds, and hashes that are compared at once.
HELD, AT_ONCE = 100_000, 1 << 21

U = np.uint64
_DRAWN = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U) * U(0xD1342543DE82EF95))
_TIMES = (_DRAWN[::2] >> U(32)).astype(np.uint32) | np.uint32(1)
_PLUS = (_DRAWN[1::2] >> U(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text; no words: none."""
    out: list[np.ndarray] = []
    for first, last in blocks(texts):
        h, owner = Words(texts[first:last]).shingles(k)
        out += [np.unique(x) for x in np.split(h, np.searchsorted(owner, np.arange(1, last - first)))]
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys for each set, which must not be empty."""
    low = (np.concatenate(sets) >> U(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = [np.minimum.reduceat(low * a + b, starts).astype(U) for a, b in zip(_TIMES, _PLUS)]
    return np.stack([combine([np.full(len(sets), i + 1, U), *least[i * ROWS : (i + 1) * ROWS]]) for i in range(BANDS)], 1)


def drop(uri: str) -> None:
    """Deletes the sets of sets_of, once the links are written."""
    store, path = filesystem(uri)
    if store.get_file_info(path).type.name == "Directory":
        store.delete_dir(path)


def _set_batches(uri: str, k: int, fingerprint, batches):
    """Rows (doc_id, own_hash, s0, s1, file, start, size, bands, f0): s0 and s1 stand for the set, which lies in the file."""
    file, out, at = uuid.uuid4().int >> 65, None, 0
    store, path = filesystem(f"{uri}/{file}")
    try:
        for b in batches:
            texts = [x.encode() for x in b.column(1).to_pylist()]
            prints = np.fromiter(map(fingerprint, texts), U, len(texts))
            sets = shingle_sets(texts, k)
            del texts
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            some = np.flatnonzero(size)
            s, keys = np.zeros((2, len(sets)), U), np.zeros((len(sets), BANDS), U)
            if len(some):
                full = np.concatenate(sets)
                starts = (np.cumsum(size) - size)[some]
                s[0, some], s[1, some] = (np.add.reduceat(mix(full ^ U(x)), starts) for x in (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47))
                for i in range(0, len(some), 64):
                    keys[some[i : i + 64]] = bands([sets[j] for j in some[i : i + 64]])
                if out is None:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(path)
                out.write(full.tobytes())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            columns = [b.column(0), b.column(2), *(pa.array(x.view(np.int64)) for x in s), pa.array(np.full(len(sets), file)), pa.array(at + np.cumsum(size) - size), pa.array(size), lists, pa.array(prints.view(np.int64))]
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "own_hash", "s0", "s1", "file", "start", "size", "bands", "f0"])
    finally:
        if out is not None:
            out.close()


def sets_of(docs: DataFrame, k: int, fingerprint) -> tuple[DataFrame, str]:
    """documents to (doc_id, own_hash, s0, s1, file, start, size, bands, f0), to be written once, and the folder of the sets; f0 is a function of the text, of 64 bits."""
    uri = fresh(docs.sparkSession, "sets")
    text = text_column(docs)
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("own_hash"))
    return rows.mapInArrow(partial(_set_batches, uri, k, fingerprint), "doc_id long, own_hash long, s0 long, s1 long, file long, start long, size long, bands array<long>, f0 long"), uri


@lru_cache(256)
def _opened(uri: str):
    store, path = filesystem(uri)
    return store.open_input_file(path)


def _read(uri: str, file: int, start: int, size: int) -> np.ndarray:
    return np.frombuffer(_opened(f"{uri}/{file}").read_at(8 * int(size), 8 * int(start)), U)


def alike(one: np.ndarray, others: list[np.ndarray], like: float = LIKE) -> np.ndarray:
    """Which of others have a Jaccard similarity to one of like or more."""
    size = np.fromiter(map(len, others), np.int64, len(others))
    full = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, full), len(one) - 1)
    common = np.add.reduceat((one[at] == full).astype(np.int64), np.cumsum(size) - size)
    return common >= like * (len(one) + size - common) - 1e-9


def _reached(uri: str, place: list[np.ndarray], like: float, distance: int = 64):
    """Links that span what is alike in a run: each member is compared only with those not yet reached, and of fitting size.

    With fingerprints behind the places, only those within the distance are compared.
    """
    place, prints = place[:3], place[3:]
    size = place[2]
    left, front = np.arange(len(size)), []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        i = front.pop()
        one = None
        fits = left[(size[left] >= like * size[i] - 1e-9) & (size[i] >= like * size[left] - 1e-9)]
        for f in prints:
            fits = fits[np.bitwise_count(f[fits] ^ f[i]) <= distance]
        hits = []
        while len(fits):
            n = max(1, int(np.searchsorted(np.cumsum(size[fits]), AT_ONCE)))
            now, fits = fits[:n], fits[n:]
            one = _read(uri, *(x[i] for x in place)) if one is None else one
            hits.append(now[alike(one, [_read(uri, *(x[j] for x in place)) for j in now], like)])
        if hits:
            hit = np.concatenate(hits)
            yield from ((i, j) for j in hit)
            front += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)


def _link_batches(uri: str, like: float, distance: int, batches):
    """Links of rows (key, rep, file, start, size, perhaps f0) sorted by key; the last run of a part waits for the rest of it."""

    def links(columns):
        edges = runs_of(columns[0])
        found = set()
        for e in np.flatnonzero(np.diff(edges) > 1):
            a, b = edges[e], edges[e + 1]
            rep = columns[1][a:b]
            found |= {(min(rep[i], rep[j]), max(rep[i], rep[j])) for i, j in _reached(uri, [x[a:b] for x in columns[2:]], like, distance)}
        if found:
            got = np.array(sorted(found), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    held, n = [], 0
    for b in batches:
        held.append([b.column(i).to_numpy() for i in range(b.num_columns)])
        n += b.num_rows
        if n < HELD:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        end = int(np.searchsorted(columns[0], columns[0][-1]))
        held, n = [[x[end:] for x in columns]], len(columns[0]) - end
        yield from links([x[:end] for x in columns])
    if held:
        yield from links([np.concatenate(x) for x in zip(*held)])
    _opened.cache_clear()  # so that the files' space is free once they are deleted


def links(sets: DataFrame, uri: str, like: float = LIKE) -> DataFrame:
    """(rep, file, start, size, bands) of distinct sets to links (a, b) between reps of a similarity of like or more, which join all that share a band."""
    return links_within(sets.where("size > 0").select(F.explode("bands").alias("key"), "rep", "file", "start", "size"), uri, like)


def links_within(rows: DataFrame, uri: str, like: float = LIKE, distance: int = 64) -> DataFrame:
    """Rows (key, rep, file, start, size, perhaps f0) to links (a, b) between reps of one key and a similarity of like or more, and fingerprints within the distance."""
    dealt = rows.repartition(width(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(partial(_link_batches, uri, like, distance), "a long, b long").distinct()
