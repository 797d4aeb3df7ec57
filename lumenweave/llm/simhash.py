"""Near copies by SimHash with deletion-variant signatures.

A fingerprint of up to 128 bits is cut into segments. Two fingerprints at distance d, with d below twice the number of
segments, have a segment that differs by one bit at most, so both have the same signature of that segment with that bit
deleted. Signatures are hashed, dealt out by key, and met by equality; every meeting is verified on all bits. A run of
equal keys gives links that span its groups, never all its pairs. Keys that thousands of fingerprints share are cut
again by exact pieces of their other bits, of which one is equal within the distance.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import likeness
from .blocks import SPACES, Words, blocks, combine, mix, runs_of
from .components import components, local_roots
from .shared import discard, fresh, prepare, text_column, unused, width, written

#: Fingerprints in a run of equal keys beyond which its keys are cut again, at least; it alters cost, not links.
HOT = 2048
#: Rows of equal keys up to which all pairs are compared at once, and rows that a task holds; longer runs are searched from member to member.
SMALL_RUN, HELD = 12, 100_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_digest = partial(xxhash.xxh64_intdigest, seed=42)
_CUT = 1 << 16


def shingle_fingerprint(text: bytes, k: int = 3) -> int:
    """64-bit SimHash of the k-word shingles of a text by XXH64 with seed 42; no words: 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    total = max(1, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, total, _CUT):
        n = min(_CUT, total - i)
        runs = map(b" ".join, zip(*(islice(words, i + j, i + j + n) for j in range(min(k, len(words))))))
        got = np.fromiter(map(_digest, runs), ">u8", n)
        ones += np.unpackbits(got.view(np.uint8).reshape(n, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half the rows of hashes, as 64-bit columns."""
    n, columns = hashes.shape
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8 * columns), axis=1).sum(0, dtype=np.int64)
    return np.frombuffer(np.packbits(2 * ones > n).tobytes(), ">u8")


def word_fingerprints(texts: list[bytes], k: int = 5) -> np.ndarray:
    """128-bit SimHash of the distinct words of each text and 64-bit SimHash of its k-word shingles, as 64-bit columns; no words: 0."""
    out = np.zeros((len(texts), 3), np.uint64)
    for first, last in blocks(texts):
        w = Words(texts[first:last])
        shingles, owner = w.shingles(k)
        cut = np.searchsorted(owner, np.arange(last - first + 1))
        for i in range(last - first):
            own = np.unique(w.hash[w.first[i] : w.first[i + 1]])
            if len(own):
                out[first + i, :2] = _majority(np.stack((own, mix(own + np.uint64(0x632BE59BD9B4E019))), 1))
                out[first + i, 2:] = _majority(np.unique(shingles[cut[i] : cut[i + 1]])[:, None])
    return out


def columns_of(kind: str) -> list[str]:
    return ["f0", "f1", "f2"] if kind == "words" else ["f0", "f1"]


def _fingerprint_batches(kind: str, k: int, batches):
    for batch in batches:
        texts = [x.encode() for x in batch.column(1).to_pylist()]
        if kind == "words":
            f = word_fingerprints(texts, k)
        else:
            f = np.zeros((len(texts), 2), np.uint64)
            f[:, 0] = np.fromiter((shingle_fingerprint(x, k) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "text"), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in f.T)], names=[*(n for n in batch.schema.names if n != "text"), *columns_of(kind)])


def fingerprints(docs: DataFrame, kind: str = "shingles", k: int = 3) -> DataFrame:
    """documents to (doc_id, f0, f1: long): 64 bits of k-word shingles in f0 (f1 zero); or of kind words, 128 of distinct words and in f2 64 of k-word shingles.

    Null and empty texts have no words and fingerprint zero. Rows stay one to one, repeated ids and null ids too.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", text_column(docs).alias("text")).mapInArrow(partial(_fingerprint_batches, kind, k), ", ".join(f"{c} long" for c in ["doc_id", *columns_of(kind)]))


class Cut:
    """Segments of a fingerprint: number, bits in each; the distances up to which pairs link, of f0 with f1 and of f2."""

    def __init__(self, segments: int, bits: int, distance: int, shingle_distance: int = 64):
        self.segments, self.bits, self.distance, self.shingle_distance = segments, bits, distance, shingle_distance

    def near(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        if len(a) == 1:
            return np.bitwise_count(a[0] ^ b[0]) <= self.distance
        out = np.bitwise_count(a[0] ^ b[0]).astype(np.int16) + np.bitwise_count(a[1] ^ b[1]) <= self.distance
        return out & (np.bitwise_count(a[2] ^ b[2]) <= self.shingle_distance) if len(a) > 2 else out

    def parts(self, f0: np.ndarray, f1: np.ndarray, widths: list[int]) -> list[np.ndarray]:
        """Consecutive groups of bits, from the top of f0 on."""
        out, at = [], 0
        for n in widths:
            word, up = (f0, at) if at + n <= 64 else (f1, at - 64) if at >= 64 else (None, 0)
            if word is None:
                high = f0 & np.uint64((1 << (64 - at)) - 1)
                low = f1 >> np.uint64(128 - at - n)
                out.append((high << np.uint64(at + n - 64)) | low)
            else:
                out.append((word >> np.uint64(64 - up - n)) & np.uint64((1 << n) - 1))
            at += n
        return out

    def segments_of(self, f0, f1):
        return self.parts(f0, f1, [self.bits] * self.segments)

    def pieces_of(self, f0, f1):
        """(segment, piece of it): so many that outside any segment there are more than 2 * segments - 1 bits can spoil."""
        each = -(-2 * self.segments // (self.segments - 1))
        widths = [self.bits // each + (i < self.bits % each) for i in range(each)]
        return list(zip(sorted([*range(self.segments)] * each), self.parts(f0, f1, widths * self.segments)))


def _bits(prints: list[np.ndarray]) -> list[np.ndarray]:
    """f0 and f1 of the columns of fingerprints; those of 64 bits may come without f1."""
    return prints[:2] if len(prints) > 1 else [prints[0], np.zeros_like(prints[0])]


def _segment_batches(cut: Cut, batches):
    for b in batches:
        for s, v in enumerate(cut.segments_of(*_bits([x.to_numpy().view(np.uint64) for x in b.columns]))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s, np.int32)), pa.array(v.view(np.int64))], names=["s", "v"])


def _variant_batches(cut: Cut, hot: dict[int, np.ndarray], batches):
    """Rows (key, rep, f0, f1, ...): one for each segment and deleted bit; for hot keys one for each piece outside the segment."""
    one = np.uint64(1)
    for b in batches:
        columns = [b.column(i).to_numpy().view(np.uint64) for i in range(b.num_columns)]  # rep first, if there
        names = ["key", *b.schema.names]
        prints = _bits(columns[1:] if "rep" in b.schema.names else columns)
        pieces = cut.pieces_of(*prints)
        for s, v in enumerate(cut.segments_of(*prints)):
            crowded = hot.get(s, np.empty(0, np.uint64))
            for i in range(cut.bits):
                bit = one << np.uint64(i)
                key = combine([np.full(len(v), s * 64 + i + 1, np.uint64), v & ~bit])
                full = np.isin(v, crowded) | np.isin(v ^ bit, crowded) if len(crowded) else np.zeros(len(v), bool)
                rows = [(key, ~full)]
                if full.any():
                    rows += [(combine([key, np.full(len(v), p + 1, np.uint64), x]), full) for p, (own, x) in enumerate(pieces) if own != s]
                for keys, chosen in rows:
                    if chosen.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[chosen].view(np.int64)) for x in (keys, *columns)], names=names)


def _reach(prints: list[np.ndarray], cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a run: each member is compared only with those not yet reached."""
    left, a, b = np.arange(len(prints[0])), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, (1 << 21) // len(left))
            now, front = front[:step], front[step:]
            near = cut.near([f[now, None] for f in prints], [f[left] for f in prints])
            hit = near.any(0)
            a.append(now[near.argmax(0)[hit]])
            b.append(left[hit])
            front, left = np.concatenate((front, left[hit])), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def run_links(key: np.ndarray, rep: np.ndarray, prints: list[np.ndarray], cut: Cut) -> np.ndarray:
    """Verified links of rows sorted by key, as (smallest, member) pairs of what they join."""
    edges = runs_of(key)
    size = np.diff(edges)
    a, b = [], []
    small = np.repeat(size, size) <= SMALL_RUN
    n = 1
    at = np.arange(len(key))
    ends = np.repeat(edges[1:], size)
    while n < min(SMALL_RUN + 1, size.max(initial=0)):
        i = at[small & (at + n < ends)]
        if n > 1 and not len(i):
            break
        near = cut.near([f[i] for f in prints], [f[i + n] for f in prints])
        a.append(i[near])
        b.append(i[near] + n)
        n += 1
    for j in np.flatnonzero(size > SMALL_RUN):
        x, y = _reach([f[edges[j] : edges[j + 1]] for f in prints], cut)
        a.append(x + edges[j])
        b.append(y + edges[j])
    if not a or not sum(map(len, a)):
        return np.empty((0, 2), np.int64)
    nodes, at = np.unique(np.concatenate((rep[np.concatenate(a)], rep[np.concatenate(b)])), return_inverse=True)
    root = local_roots(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack((nodes[root[member]], nodes[member]), 1)


def _link_batches(cut: Cut, batches):
    """Links of rows sorted by key; the last run of a part waits for the rest of it."""

    def links(columns):
        # without reps the one column of fingerprints stands for itself
        got = run_links(columns[0], columns[1], [x.view(np.uint64) for x in columns[2:] or columns[1:]], cut)
        if len(got):
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


def fingerprint_links(fps: DataFrame, cut: Cut) -> DataFrame:
    """Distinct fingerprints (rep, f0, f1, perhaps f2) to links (a, b) between their reps, which join what lies within the distance.

    Given as f0 alone, fingerprints of 64 bits are their own reps, and half as much is shuffled.
    """
    spark = fps.sparkSession
    n = fps.count()
    most = max(HOT, cut.segments * n // 50_000)  # so hot values are 50,000 at most
    crowded = fps.select(*(c for c in ("f0", "f1") if c in fps.columns)).mapInArrow(partial(_segment_batches, cut), "s int, v long").groupBy("s", "v").count().where(F.col("count") > most).select("s", "v").collect()
    hot = {s: np.array(sorted(x.v for x in crowded if x.s == s), np.int64).view(np.uint64) for s in {x.s for x in crowded}}
    schema = ", ".join(f"{c} long" for c in ["key", *fps.columns])
    dealt = fps.mapInArrow(partial(_variant_batches, cut, hot), schema).repartition(width(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(partial(_link_batches, cut), "a long, b long").distinct()


def groups(prints: DataFrame, cut: Cut) -> DataFrame:
    """(doc_id, f0, f1, perhaps f2, ...) with component_id added: the smallest doc_id reachable over links, itself included.

    Rows of equal fingerprints are one group, of one row before any shuffle of variants. A row without a doc_id belongs
    to the group of its fingerprint; the component is null if no row of that fingerprint has a doc_id. An empty table
    gives an empty table.
    """
    names = [c for c in ("f0", "f1", "f2") if c in prints.columns]
    distinct = written(prints.groupBy(*names).agg(F.min("doc_id").alias("rep")), "fingerprints")
    links = fingerprint_links(distinct.where("rep is not null").select("rep", *names), cut)
    roots = components(links)
    classes = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*names, F.coalesce("root", "rep").alias("component_id"))
    return prints.join(classes, names)


#: The cut of kind words by which near_copies estimates that five-word shingles are alike by about 0.8 or more.
LIKE_TEXTS = Cut(5, 24, 13, 13)


def alike_links(classes: DataFrame, uri: str, like: float = likeness.LIKE, cut: Cut | None = None) -> DataFrame:
    """(rep, file, start, size, f0) of distinct sets to links (a, b) between reps by SimHash: those within the distance of op3 whose sets are alike, each compared exactly.

    All of a run of variants link to its smallest fingerprint, so two that lie within the distance meet under that.
    """
    cut = cut or Cut(2, 32, 3)
    rows = classes.where("size > 0 and rep is not null").select("rep", "file", "start", "size", "f0")
    found = fingerprint_links(rows.select("f0").distinct(), cut).select(F.col("a").alias("key"), F.col("b").alias("f0"))
    met = rows.hint("merge").join(found, "f0").select("key", *rows.columns).union(rows.select(F.col("f0").alias("key"), "*"))
    return likeness.links_within(met, uri, like, cut.distance)


def one_of_each(docs: DataFrame, like: float = likeness.LIKE, k: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: that of its smallest doc_id; all columns as they were.

    Groups are joined by pairs whose sets of k-word shingles have a Jaccard similarity of like or more, each of them
    compared exactly. Pairs within the distance of op3 are found by SimHash; those beyond it, by bands of MinHash values.
    Of rows of one doc_id and text that with the least other columns stays (maps compare as JSON; a
    null text is behind an empty one), and of rows without a doc_id those that no row with one has the shingles of, one
    of each text.
    """
    prepare(docs.sparkSession)
    found, uri = likeness.sets_of(docs, k, shingle_fingerprint)
    full, ids = fresh(docs.sparkSession, "full"), ["doc_id", "own_hash", "s0", "s1"]
    found.write.parquet(full)
    sets = docs.sparkSession.read.schema(found.schema).parquet(full)
    first = F.min_by(F.struct("file", "start", "size", "bands", "f0"), F.struct("doc_id", "file", "start"))
    classes = written(sets.groupBy("s0", "s1").agg(F.min("doc_id").alias("rep"), first.alias("x")).select("s0", "s1", "rep", "x.*"), "classes")
    sets = written(sets.select(*ids), "sets")
    discard(docs.sparkSession, full)  # bands are in classes now
    roots = components(alike_links(classes, uri, like).union(likeness.links(classes.where("rep is not null"), uri, like)))
    likeness.drop(uri)
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("s0", "s1", F.coalesce("root", "rep").alias("component_id"))
    kept = sets.join(named, ["s0", "s1"]).where("doc_id = component_id or (doc_id is null and component_id is null)")
    # a null id is a number and a flag, so that the join and the groups are dealt by the same keys and texts travel once
    own = [unused(c, docs.columns) for c in ("own_id", "no_id", "own_hash")]
    key = lambda text: (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), text)
    kept = kept.select(*(x.alias(c) for x, c in zip(key(F.col("own_hash")), own))).distinct()
    rows = docs.withColumns(dict(zip(own, key(F.xxhash64(text_column(docs))))))
    column = {c: F.col(f"`{c}`") for c in docs.columns}
    others = [F.to_json(F.struct(column[c])) if "map<" in kind else column[c] for c, kind in docs.dtypes if c not in ("doc_id", "text")]
    # texts of one hash are alike, so they take no part in the order
    least = F.min_by(F.struct(*column.values()), F.struct(F.col("text").isNull(), *others))
    return rows.join(kept.hint("merge"), own, "left_semi").groupBy(*own).agg(least.alias("x")).select("x.*")


def near_copies(docs: DataFrame, kind: str = "shingles", k: int = 3, segments: int = 2, bits: int = 32, distance: int = 3) -> DataFrame:
    """documents to (doc_id, f0, f1, component_id) of `groups`, by fingerprints of `fingerprints`.

    With distance below 2 * segments no link is lost. Beyond that, pairs up to the distance link if a segment differs by
    one bit at most. Other columns of documents are not read, so clashing names do no harm.
    """
    prints = written(fingerprints(docs, kind, k), "prints")
    return groups(prints, Cut(segments, bits, distance))


def op3_simhash(spark, sf_dir):
    from .shared import table

    got = near_copies(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
