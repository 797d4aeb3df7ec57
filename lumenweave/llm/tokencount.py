"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus.

Texts are cut before each run of white space that precedes other characters. The tokenizer's own split never joins two
such pre-tokens, so a text has as many tokens as its pre-tokens together. A block of documents lists its distinct
pre-tokens, dealt out by hash, and keeps each document's frequencies as (place in the list, times). Where a pre-token
meets from all blocks its pieces are counted once; the counts go back to the blocks and are summed by document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, table, text_column, width, written

VOCABULARY = "byte_bpe_50k.json"
#: Code points of text in a block, about; a longer text is a block of its own.
BLOCK = 16 << 20
LIMIT = 512

#: White space as Unicode has it.
_SPACE = "\t-\r \x85\xa0  -     　"
_PRETOKEN = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

_ROWS = "block long, shard int, words binary, freqs binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("words", pa.binary()), ("freqs", pa.binary())])


def pretokens(text: str) -> list[str]:
    return _PRETOKEN.findall(text)


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(map(_one, arrays))


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit integers, all first ones, all second ones, and so on."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).reshape(-1)


def _from_planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(4, -1).T).view("<i4").reshape(-1)


def _one(x: np.ndarray) -> bytes:
    data = pa.Codec("zstd", compression_level=3).compress(x.tobytes(), asbytes=True)
    return np.array([x.nbytes, len(data)], np.int64).tobytes() + data


def _unpacked(data: bytes, *dtypes) -> list[np.ndarray]:
    out, at = [], 0
    for t in dtypes:
        size, n = np.frombuffer(data, np.int64, 2, at)
        out.append(np.frombuffer(pa.decompress(data[at + 16 : at + 16 + n], decompressed_size=int(size), codec="zstd", asbytes=True), t) if size else np.empty(0, t))
        at += 16 + int(n)
    return out


def _strings(words: list[bytes]) -> bytes:
    return _packed(np.fromiter(map(len, words), np.int32, len(words)), np.frombuffer(b"".join(words), np.uint8))


def _words(data: bytes) -> list[bytes]:
    size, raw = _unpacked(data, np.int32, np.uint8)
    raw, ends = raw.tobytes(), np.cumsum(size, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _block(number: int, shards: int, ids: list, texts: list[str]):
    """The rows of one block: a list of distinct pre-tokens for each shard, and a row (shard -1) of frequencies."""
    place: dict[str, int] = {}
    at, times, kinds, sizes = [], [], [], []
    for text in texts:
        freq = Counter(_PRETOKEN.findall(text))
        at.append(np.fromiter((place.setdefault(x, len(place)) for x in freq), np.int32, len(freq)))
        times.append(np.fromiter(freq.values(), np.int32, len(freq)))
        kinds.append(len(freq))
        sizes.append(len(text.encode()))
    raw = [x.encode() for x in place]
    shard = np.fromiter((zlib.crc32(x) % shards for x in raw), np.int32, len(raw))
    by_word = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)  # like words side by side pack well
    order = by_word[np.argsort(shard[by_word], kind="stable")]
    new = np.empty(len(raw), np.int32)
    new[order] = np.arange(len(raw), dtype=np.int32)  # places in the order in which the shards answer
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = [(number, s, _strings([raw[i] for i in order[a:b]]), None) for s, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
    own = np.array([-(1 << 63) if x is None else x for x in ids], np.int64)
    empty = [np.empty(0, np.int32)]
    spots, times = new[np.concatenate(at + empty)], np.concatenate(times + empty)
    order = np.lexsort((spots, np.repeat(np.arange(len(kinds)), kinds)))  # by document, so steps between places are small
    freqs = _packed(own, np.array([x is None for x in ids], np.uint8), np.array(sizes, np.int64), np.array(kinds, np.int32), _planes(np.diff(spots[order], prepend=np.int32(0))), _planes(times[order]))
    return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in [*rows, (number, -1, None, freqs)]], schema=_SCHEMA)


def _blocks(shards: int, size: int, batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, texts, total = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if texts and total + len(t) > size:
                yield _block(number, shards, ids, texts)
                number += 1
                ids, texts, total = [], [], 0
            ids.append(i)
            texts.append(t)
            total += len(t) + 64
    if texts:
        yield _block(number, shards, ids, texts)


def counter(path: str):
    """A function from strings to their numbers of tokens, as the tokenizers library gives them."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda words: [len(x) for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _counted(path: str, batches):
    """Rows of a shard: every distinct pre-token is counted once, and each list gets its counts."""
    count = counter(path)
    known: dict[bytes, int] = {}
    at = None
    for b in batches:
        out = []
        for block, shard, words in zip(*(b.column(i).to_pylist() for i in range(3))):
            if shard != at:
                known, at = {}, shard
            words = _words(words)
            new = [x for x in words if x not in known]
            for i in range(0, len(new), 10_000):
                part = new[i : i + 10_000]
                known.update(zip(part, count([x.decode() for x in part])))
            pieces = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            out.append((block, shard, _packed(np.minimum(pieces, 255).astype(np.uint8), pieces[pieces >= 255]), None))
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], schema=_SCHEMA)


def _summed(limit: int, batches):
    """Rows of a block in order: counts by shard, then frequencies."""
    pieces = []
    for b in batches:
        for shard, words, freqs in zip(*(b.column(n).to_pylist() for n in ("shard", "words", "freqs"))):
            if words is not None:
                small, large = _unpacked(words, np.uint8, np.int64)
                x = small.astype(np.int64)
                x[small == 255] = large
                pieces.append(x)
                continue
            ids, null, sizes, kinds, at, times = _unpacked(freqs, np.int64, np.uint8, np.int64, np.int32, np.uint8, np.uint8)
            at, times = np.cumsum(_from_planes(at), dtype=np.int64), _from_planes(times)
            each = np.concatenate([*pieces, np.empty(0, np.int64)])[at] * times
            pieces = []
            total = np.concatenate(([0], np.cumsum(each)))
            ends = np.cumsum(kinds)
            n = total[ends] - total[ends - kinds]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """documents to (doc_id, n_bytes, n_tokens, over_limit), one row for each row, by the tokenizer file at path.

    Null and empty texts have 0 bytes and tokens; repeated and null ids stay. Strings of special tokens inside texts
    count as the library's default has them. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = width(spark)
    rows = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text"))
    cut = written(rows.mapInArrow(partial(_blocks, 2 * n, block), _ROWS), "pretokens")
    words = cut.where("shard >= 0").drop("freqs").repartition(n, "shard").sortWithinPartitions("shard")
    counts = words.mapInArrow(partial(_counted, path), _ROWS)
    both = counts.unionByName(cut.where("shard < 0").drop("words"), allowMissingColumns=True)
    dealt = both.withColumn("last", F.col("shard") < 0).repartition(n, "block").sortWithinPartitions("block", "last", "shard").drop("last")
    return dealt.mapInArrow(partial(_summed, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_tokens(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
