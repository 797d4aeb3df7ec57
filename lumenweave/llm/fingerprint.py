"""Document fingerprints: every hash of a five-word shingle below a fixed fraction of the hash range is kept.

Sketches of parts merge by union, and the share of common hashes among those of the smaller sketch estimates
containment, however unequal two documents are. Of n distinct shingles about n/8 are sampled, so the standard error is
sqrt(7 p (1 - p) / n) at containment p: 0.04 for 1,024 shingles and p = 1/2. Below that the samples say little. So beside
its sketch a fingerprint holds a bit filter of all shingles, about a byte for each, and a text of up to 64 shingles all
hashes. Two filters of like size estimate the overlap from the bits that both leave unset, with a standard error of about
0.06 for 65 shingles and 0.02 for 1,000 (see the tests); and the hashes of a short text are looked up in any other's filter,
less what chance holds there.

Filters of any two sizes compare and merge: a place is a fraction of the length, so a filter folds in halves, and unfolds
by repeating bits. A merged one is as long as the union needs; short texts are put in anew. After merging many parts that
are much smaller than their union the filter may be too full to tell anything; then the sketches alone count, which are
the same in whatever order parts are merged.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, blocks, mix
from .shared import prepare, table, text_column, width

WORDS = 5
#: One of so many hashes is kept.
SCALE = 8
#: A text of so many distinct shingles at most keeps them all beside its sketch; a sketch of fewer hashes is thin.
FEW, THIN = 64, 128
#: Shares of bits set beyond which a filter is too full for lookups, and two together for their overlap.
FULL, CROWDED = 0.75, 0.9
#: Bits of a filter for each distinct shingle, at least, and bits that a shingle sets.
ROOM, PROBES = 8, 4

U = np.uint64


class Print(NamedTuple):
    """kept: sorted hashes below the fraction; rest: those above it, of a text with few shingles; bits: the filter."""

    kept: np.ndarray
    rest: np.ndarray
    bits: np.ndarray


def _probes(h: np.ndarray) -> np.ndarray:
    """Places of shingles in a filter as 32-bit fractions of its length, so that halving a filter halves each place."""
    return np.stack([mix(h + U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U(32) for i in range(PROBES)])


def _length(n: int) -> int:
    """Bits of a filter for n shingles, a power of two."""
    return 1 << max(6, (ROOM * max(n, 1) - 1).bit_length())


def _places(h: np.ndarray, length: int) -> np.ndarray:
    return (_probes(h) >> U(33 - length.bit_length())).astype(np.int64)


def _filter(h: np.ndarray, length: int = 0) -> np.ndarray:
    out = np.zeros(length or _length(len(h)), bool)
    out[_places(h, len(out)).ravel()] = len(h) > 0
    return out


def prints(texts: list[bytes], k: int = WORDS, scale: int = SCALE) -> list[Print]:
    """The fingerprint of each text; no words: nothing kept."""
    out: list[Print] = []
    under = U((1 << 64) // scale)
    for first, last in blocks(texts):
        h, owner = Words(texts[first:last]).shingles(k)
        for own in np.split(h, np.searchsorted(owner, np.arange(1, last - first))):
            own = np.unique(own)
            cut = int(np.searchsorted(own, under))
            out.append(Print(own[:cut], own[cut:] if len(own) <= FEW else own[:0], _filter(own)))
    return out


def sketches(texts: list[bytes], k: int = WORDS, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text that lie below the fraction."""
    return [x.kept for x in prints(texts, k, scale)]


def _sized(bits: np.ndarray, length: int) -> np.ndarray:
    """A filter folded or unfolded to another length; unfolded, it holds what it held, and more by chance."""
    return bits.reshape(length, -1).any(1) if len(bits) > length else np.repeat(bits, length // len(bits))


def _all(x: Print) -> np.ndarray | None:
    """All hashes of a text that keeps them all, else None."""
    if len(x.rest):
        return np.concatenate((x.kept, x.rest))
    return x.kept if x.bits.sum() <= PROBES * len(x.kept) else None


def merge(a: Print, b: Print) -> Print:
    """The fingerprint of two parts' shingles together, of any sizes and in any order."""
    kept, hashes = np.union1d(a.kept, b.kept), [_all(x) for x in (a, b)]
    if all(h is not None for h in hashes):
        own = np.union1d(*hashes)
        return Print(kept, np.setdiff1d(own, kept, assume_unique=True) if len(own) <= FEW else own[:0], _filter(own))
    length = max(len(a.bits), len(b.bits), _length(SCALE * len(kept)))
    bits = [_sized(x.bits, length) if h is None else _filter(h, length) for x, h in zip((a, b), hashes)]
    return Print(kept, kept[:0], bits[0] | bits[1])


def _held(own: np.ndarray, other: Print) -> float:
    """Share of hashes that another text's filter holds, less what chance holds."""
    hits = other.bits[_places(own, len(other.bits))].all(0).mean()
    chance = float(other.bits.mean()) ** PROBES
    return min(1.0, max(0.0, (hits - chance) / (1 - chance))) if chance < 1 else 0.0


def _overlap(one: Print, two: Print) -> float | None:
    """Share of one's shingles that two has, from the bits of both that are not set; None if too few are left."""
    length = min(len(one.bits), len(two.bits))
    x, y = _sized(one.bits, length), _sized(two.bits, length)
    either = float((x | y).mean())
    if either > CROWDED:
        return None
    n, m, both = (-math.log1p(-v) for v in (float(x.mean()), float(y.mean()), either))
    return min(1.0, max(0.0, (n + m - both) / min(n, m)))


def likeness(a: Print, b: Print) -> float:
    """Estimated containment of the smaller in the larger, 0 to 1; both without shingles: 1, one: 0.

    The smaller is that of fewer kept hashes, of equally many that of the shorter filter. Texts that have all their
    hashes are compared exactly. Where the smaller sketch is thin its hashes are looked up in the other's filter, if it
    has them all, else the filters are compared; where these are too full, and for all larger texts, sketches are.
    """
    one, two = (a, b) if (len(a.kept), len(a.bits), len(a.rest)) <= (len(b.kept), len(b.bits), len(b.rest)) else (b, a)
    if not one.bits.any() or not two.bits.any():
        return float(one.bits.any() == two.bits.any())
    if len(one.kept) < THIN:  # a text without kept hashes has its filter lookups only
        own, other = _all(one), _all(two)
        if own is not None and other is not None:
            return len(np.intersect1d(own, other, assume_unique=True)) / min(len(own), len(other))
        if own is not None and (two.bits.mean() <= FULL or not len(one.kept)):
            return _held(own, two)
        if own is None and (found := _overlap(one, two)) is not None:
            return found
    return len(np.intersect1d(one.kept, two.kept, assume_unique=True)) / len(one.kept) if len(one.kept) else 0.0


def written_out(x: Print) -> str:
    """Kept hashes as 16 hexadecimal digits each, in order; then, after colons, the others of a short text, and the filter."""
    return ":".join((*(h.astype(">u8").tobytes().hex() for h in x[:2]), np.packbits(x.bits).tobytes().hex()))


def read_back(text: str) -> Print:
    kept, rest, bits = map(bytes.fromhex, text.split(":"))
    return Print(*(np.frombuffer(x, ">u8").astype(U) for x in (kept, rest)), np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool))


def edit(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucketed(bounds: list[float], batches):
    for b in batches:
        ids = b.column(0)
        n = np.searchsorted(bounds, ids.fill_null(-(1 << 63)).to_numpy(), side="right").astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(n), *b.columns], names=["bucket", *b.schema.names])


def _neighbours(batches):
    """Rows sorted by bucket, own rows before the row that follows them: each own row with the one after it."""
    last = None
    for b in batches:
        bucket, guest, ids, texts = (b.column(i).to_pylist() for i in range(4))
        rows = list(zip(bucket, guest, ids, texts, prints([x.encode() for x in texts])))
        if not rows:
            continue
        if last:
            rows.insert(0, last)
        pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
        last = rows[-1]
        edited = [edit(x[3], y[3]).encode() for x, y in pairs]
        after = prints(edited)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([x[2] for x, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(x).hexdigest() for x in edited],
                "fingerprint": [written_out(x[4]) for x, _ in pairs],
                "edited_fingerprint": [written_out(x) for x in after],
                "near_edited": pa.array([likeness(x[4], e) for (x, _), e in zip(pairs, after)], pa.float64()),
                "near_next": pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
            },
            schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]),
        )


def _sketch_batches(k: int, scale: int, batches):
    for b in batches:
        got = sketches([x.encode() for x in b.column(1).to_pylist()], k, scale)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64).tolist() for x in got], pa.list_(pa.int64()))], names=["doc_id", "sketch"])


def fingerprints(docs: DataFrame, k: int = WORDS, scale: int = SCALE) -> DataFrame:
    """documents to (doc_id, sketch: array of long, the kept 64-bit hashes in unsigned order).

    One row for each row, repeated and null ids too; null and empty texts have empty sketches. Other columns are not read.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")).mapInArrow(partial(_sketch_batches, k, scale), "doc_id long, sketch array<long>")


_MERGED = "fingerprint string, n long"


def _printed_batches(by: list[str], k: int, scale: int, batches):
    for b in batches:
        got = prints([x.encode() for x in b.column("text").to_pylist()], k, scale)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), pa.array(map(written_out, got), pa.string()), pa.array([1] * len(got), pa.int64())], names=[*by, "fingerprint", "n"])


def _merged_batches(by: list[str], held: int, batches):
    """Rows of a task merged by key; at most so many keys are held, so a key may come more than once."""
    own: dict[tuple, tuple[Print, int]] = {}

    def out():
        keys = list(own)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([written_out(x) for x, _ in own.values()], pa.string()), pa.array([n for _, n in own.values()], pa.int64())], names=[*by, "fingerprint", "n"])

    types: list = []
    for b in batches:
        types = [b.schema.field(c).type for c in by]
        for *key, text, n in zip(*(b.column(c).to_pylist() for c in (*by, "fingerprint", "n"))):
            x, key = read_back(text), tuple(key)
            if key not in own and len(own) >= held:
                yield out()
                own.clear()
            own[key] = (merge(own[key][0], x), own[key][1] + n) if key in own else (x, n)
    if own:
        yield out()


def merged(rows: DataFrame, by: list[str], k: int = WORDS, scale: int = SCALE, held: int = 1000) -> DataFrame:
    """rows (by, text) to (by, fingerprint, n): the fingerprint of all texts of a key together, and how many they are.

    Texts are fingerprinted where they lie and merged in their task first, then by key, so a key of many rows is shuffled
    as one row from each task. Null keys are a key, null and empty texts have no shingles. Empty tables give no rows; other
    columns are not read. Columns of by are not called text, fingerprint or n.
    """
    prepare(rows.sparkSession)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    each = rows.select(*by, text_column(rows).alias("text")).mapInArrow(partial(_printed_batches, by, k, scale), f"{kinds}, {_MERGED}")
    part = each.mapInArrow(partial(_merged_batches, by, held), f"{kinds}, {_MERGED}")
    return part.repartition(*by).sortWithinPartitions(*by).mapInArrow(partial(_merged_batches, by, 1), f"{kinds}, {_MERGED}")


def edits(docs: DataFrame) -> DataFrame:
    """Each document, its edited text and the next document by descending doc_id (after the last: the first), compared.

    Documents are dealt into ranges of doc_id and sorted there; the first row of the next lower range follows the last
    row of each, so whole texts are shuffled once. Equal ids follow in the order of their texts; null ids come last.
    An empty table gives an empty table; a single row is its own next.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text"))
    parts = width(spark)
    cuts = min(4096, 8 * parts)
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / cuts for i in range(1, cuts)], 0.25 / cuts)))
    deal = partial(_bucketed, np.array(bounds, float))
    firsts = {x.bucket: x.top for x in rows.select("doc_id").mapInArrow(deal, "bucket int, doc_id long").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    if not firsts:
        return spark.createDataFrame([], FIELDS)
    order = sorted(firsts)
    # the first row of range order[i - 1] follows the last of order[i]; of the highest range, the last of the lowest
    follows = [(order[i - 1], order[i]) for i in range(len(order))]
    leads = spark.createDataFrame([(firsts[low], high) for low, high in follows], "top long, bucket int")
    ids = [x for x in firsts.values() if x is not None]
    chosen = rows.where(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if None in firsts.values() else F.lit(False)))
    guests = chosen.join(F.broadcast(leads), F.col("doc_id").eqNullSafe(F.col("top"))).select("bucket", F.lit(True).alias("guest"), "doc_id", "text")
    own = rows.mapInArrow(deal, "bucket int, doc_id long, text string").select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    dealt = own.unionByName(guests).repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_neighbours, FIELDS)


def op1_fingerprint(spark, sf_dir):
    return edits(table(spark, sf_dir, "documents"))
