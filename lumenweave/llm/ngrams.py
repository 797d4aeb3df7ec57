"""Language-model scores of documents: interpolated modified Kneser-Ney over runs of words, three unless asked otherwise.

Runs are counted in Spark: each task counts a few million tokens, and the sums meet by shard of a run's second word,
where both its contexts and its shorter suffixes lie whole (runs around very common words are spread further, and what
they share is summed in the next step). Each shard is stored as sorted arrays of hashes in the shared folder. Workers
map those files into memory and look up a block's runs shard by shard; a file that should be there and isn't is an error.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, blocks, combine, runs_of
from .shared import fresh, mapped, prepare, put_bytes, table, text_column, width, written
from .tokencount import _packed, _unpacked

U = np.uint64
START, END = U(0x9D39247E33776D41), U(0x2AF7398005AAA5C7)
#: Words in a run; three or more.
ORDER = 3
#: Tokens that a task counts before it passes the sums on, and bytes of text that are scored at once.
CHUNK, SCORED = 3_000_000, 4 << 20
#: Share of documents that shows which words are too common for one shard, and which have short codes on the way; it
#: alters balance and bytes, not counts.
PEEK = 0.01
#: Words with a short code, at most; the last code is for all others.
CODES = (1 << 16) - 1
#: A word has a short code if more than one of so many words of the sample is it.
LEAST_SHARE = 1 << 20
#: Entries of a sorted array for each slot of its index, about.
SLOT = 16


def sequence(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, places, owners): each text's lower-cased words between order - 1 starts and one end, and where its tokens are."""
    w = Words(texts)
    docs, pad = len(texts), order
    words = np.full(len(w.hash) + docs * pad, START)
    words[np.arange(len(w.hash)) + w.owner * pad + order - 1] = w.hash
    last = w.first[1:] + np.arange(docs) * pad + order - 1
    words[last] = END
    count = w.count + 1
    places = np.arange(int(count.sum())) + np.repeat(np.arange(docs) * (order - 1) + order - 1, count)
    return words, places, np.repeat(np.arange(docs), count)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By the top bits of a hash, in its order."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int32)


class Deal:
    """Which shard a run of words belongs to: that of its second word, so that its contexts and suffixes are there too.

    Runs of three with a hot second word are dealt by the first word, and those with a hot pair in front by the last.
    Longer runs with a hot second word are dealt by the first and the third.
    """

    def __init__(self, shards: int, wide: int, hot: list[int], pairs: list[int], codes: list[int]):
        self.shards, self.wide = shards, wide  # of runs, and of words
        self.hot, self.pairs, self.codes = (np.sort(np.array(x, np.int64).view(U)) for x in (hot, pairs, codes))

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        return np.isin(words, self.hot)

    def apart(self, columns: list[np.ndarray]) -> np.ndarray:
        """Runs of three whose first two words are a hot pair around a hot word: their contexts lie in many shards."""
        out = self.is_hot(columns[1]) if len(columns) == 3 and len(self.pairs) else np.zeros(len(columns[0]), bool)
        some = np.flatnonzero(out)
        out[some] = np.isin(combine([c[some] for c in columns[:2]]), self.pairs)
        return out

    def __call__(self, columns: list[np.ndarray]) -> np.ndarray:
        by = columns[1].copy()
        some = np.flatnonzero(self.is_hot(by))
        own = [c[some] for c in columns]
        by[some] = np.where(self.apart(own), own[2], own[0]) if len(columns) == 3 else combine([own[0], own[2]])
        return shard_of(by, self.shards)


def _coded(words: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """A column of words as low and high bytes of short codes, and the words without one."""
    if not len(codes):
        return [np.full(2 * len(words), 255, np.uint8), words]
    at = np.searchsorted(codes, words)
    at[codes[np.minimum(at, len(codes) - 1)] != words] = CODES
    return [np.concatenate((at & 255, at >> 8)).astype(np.uint8), words[at == CODES]]


def _uncoded(short: np.ndarray, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    low, high = short.reshape(2, -1).astype(np.int32)
    at = low | high << 8
    out = np.empty(len(at), U)
    known = at != CODES
    out[known], out[~known] = codes[at[known]], words
    return out


def _small(n: np.ndarray) -> list[np.ndarray]:
    small = np.minimum(n, 255).astype(np.uint8)
    return [small, n[small == 255].astype(np.int64)]


def _large(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    n = small.astype(np.int64)
    n[small == 255] = large
    return n


def _rows_out(columns: list[np.ndarray], sums: list[np.ndarray], codes: np.ndarray) -> bytes:
    """Columns of words with columns of numbers beside them."""
    return _packed(*(x for c in columns for x in _coded(c, codes)), *(x for n in sums for x in _small(n)))


def _rows_in(data: bytes, words: int, sums: int, codes: np.ndarray) -> list[np.ndarray]:
    got = _unpacked(data, *[np.uint8, U] * words, *[np.uint8, np.int64] * sums)
    out = [_uncoded(got[2 * i], got[2 * i + 1], codes) for i in range(words)]
    return out + [_large(got[2 * i], got[2 * i + 1]) for i in range(words, words + sums)]


def _gathered(payloads: list[bytes], words: int, sums: int, codes: np.ndarray) -> list[np.ndarray]:
    parts = [_rows_in(x, words, sums, codes) for x in payloads]
    empty = [np.empty(0, U)] * words + [np.empty(0, np.int64)] * sums
    return [np.concatenate([e, *x]) for e, x in zip(empty, zip(*parts))] if parts else empty


def _merged(key: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the place of one row of each, and the sums of its rows."""
    order = np.argsort(key)
    at = runs_of(key[order])[:-1] if len(key) else np.empty(0, int)
    return key[order][at], order[at], [np.add.reduceat(x[order], at) if len(at) else x[:0] for x in sums]


def _held_out(ids) -> np.ndarray:
    return np.array([zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i in ids], bool)


DEALT = "shard int, kind int, payload binary, totals string"
DEALT_NAMES = [x.split()[0] for x in DEALT.split(", ")]
#: Kinds of dealt rows: 3 and more for runs of so many words; and three that go to the shards of words.
CONTEXTS, WORDS, PAIRS = 0, 1, 2


def _batch(rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.string()))], names=DEALT_NAMES)


def _slices(kind: int, shard: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray], codes: np.ndarray) -> list[tuple]:
    """Dealt rows, one for each shard; rows of a shard keep their order."""
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    edges = runs_of(shard[order])
    return [(int(shard[order[a]]), kind, _rows_out([c[order[a:b]] for c in columns], [n[order[a:b]] for n in sums], codes), None) for a, b in zip(edges, edges[1:])]


def _counted(words: np.ndarray, places: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct runs of words that end at places, ordered by their second word, the ones after it, then the first; and their counts."""
    vocabulary, ids = np.unique(words, return_inverse=True)
    room, code, size = len(vocabulary), np.zeros(len(places), U), 1
    for i in [*range(1, order), 0]:
        if size * room >= 1 << 63:
            _, code = np.unique(code, return_inverse=True)
            code, size = code.astype(U), int(code.max()) + 1
        code, size = code * U(room) + ids[places - order + 1 + i].astype(U), size * room
    del ids
    by = np.argsort(code)
    edges = runs_of(code[by])
    first = places[by[edges[:-1]]]
    return [words[first - order + 1 + i] for i in range(order)], np.diff(edges)


def dealt_counts(deal: Deal, order: int, sequences):
    """Counts of the runs in blocks of (words, places), dealt out by shard."""
    parts, n = [], 0

    def out():
        skips = np.cumsum([0, *(len(w) for w, _ in parts)])
        words, places = np.concatenate([w for w, _ in parts]), np.concatenate([p + s for (_, p), s in zip(parts, skips)])
        parts.clear()
        columns, times = _counted(words, places, order)
        return _batch(_slices(order, deal(columns), columns, [times], deal.codes))

    for words, places in sequences:
        parts.append((words, places))
        n += len(places)
        if n >= CHUNK:
            yield out()
            n = 0
    if n:
        yield out()


def _count_batches(deal: Deal, order: int, batches):
    """Counts of the training documents' runs."""

    def training():
        for b in batches:
            train = ~_held_out(b.column(0).to_pylist())
            texts = [x.encode() for x, t in zip(b.column(1).to_pylist(), train) if t]
            for first, last in blocks(texts):
                yield sequence(texts[first:last], order)[:2]

    yield from dealt_counts(deal, order, training())


def _of_count(n: np.ndarray, most: int = 4) -> list[int]:
    return np.bincount(np.minimum(n, most + 1).astype(np.int64), minlength=most + 2)[1 : most + 1].tolist()


def sorted_keys(key: np.ndarray, whole: bool = False) -> list[np.ndarray]:
    """Sorted distinct hashes as (bits of the index, index, rest of each hash): 32 bits after those of the index, or all 64."""
    bits = max(0, min(32, (len(key) // SLOT).bit_length() - 1))
    top = key >> U(64 - bits) if bits else np.zeros(len(key), U)
    index = np.searchsorted(top, np.arange((1 << bits) + 1, dtype=U)).astype(np.uint32)
    return [np.array([bits, whole], np.int64), index, key if whole else ((key >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)]


def _numbers(n: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, and the large ones with their places."""
    small, large = _small(n)
    return [small, np.flatnonzero(small == 255).astype(np.uint32), large]


def _kinds(order: np.ndarray, edges: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Per run of rows: how many have count 1, 2 and more, and the sum of counts."""
    t = times[order]
    kinds = [np.add.reduceat(x, edges[:-1], dtype=np.int64) for x in (t == 1, t == 2, t > 2, t)] if len(t) else [np.empty(0, np.int64)] * 4
    return np.stack(kinds, 1)


def _contexts(kinds: np.ndarray) -> list[np.ndarray]:
    """Rows of _kinds: as a byte where few counts are 1 or 2 and none is more, else in full with their places."""
    short = (kinds[:, 2] == 0) & (kinds[:, 0] < 16) & (kinds[:, 1] < 15)
    code = np.where(short, kinds[:, 1] * 16 + kinds[:, 0], 255).astype(np.uint8)
    return [code, np.flatnonzero(~short).astype(np.uint32), kinds[~short].astype(np.int64).reshape(-1)]


def put(uri: str, sections: list[np.ndarray]) -> None:
    """A file of arrays: their number and bytes first, each at a multiple of eight."""
    sizes = np.array([len(sections), *(x.nbytes for x in sections)], np.int64)
    put_bytes(uri, b"".join([sizes.tobytes(), *(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 8) for x in sections)]))


class File:
    """A mapped file of put."""

    def __init__(self, uri: str):
        raw = mapped(uri, np.uint8)
        n = int(raw[:8].view(np.int64)[0])
        at, self.raw = 8 + 8 * n, []
        for size in raw[8 : 8 + 8 * n].view(np.int64).tolist():
            self.raw.append(raw[at : at + size])
            at += size + -size % 8

    def find(self, i: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in the sorted array of section i, and which are there."""
        bits, whole = self.raw[i].view(np.int64).tolist()
        index, rest = self.raw[i + 1].view(np.uint32), self.raw[i + 2].view(U if whole else np.uint32)
        if not len(rest):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        want = keys if whole else ((keys >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)
        low, stop = index[slot].astype(np.int64), index[slot + 1].astype(np.int64)
        high = stop.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            less = (rest[np.minimum(mid, len(rest) - 1)] < want) & (low < high)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        there = np.minimum(low, len(rest) - 1)
        return there, (low < stop) & (rest[there] == want)

    def numbers(self, i: int, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        small = self.raw[i]
        if not len(small):
            return np.zeros(len(at), np.int64)
        n = small[at].astype(np.int64) * found
        big = n == 255
        if big.any():
            n[big] = self.raw[i + 2].view(np.int64)[np.searchsorted(self.raw[i + 1].view(np.uint32), at[big])]
        return n

    def contexts(self, i: int, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        code = self.raw[i]
        if not len(code):
            return np.zeros((len(at), 4), np.int64)
        c = code[at].astype(np.int64) * found
        out = np.stack((c & 15, c >> 4, np.zeros_like(c), (c & 15) + 2 * (c >> 4)), 1)
        big = c == 255
        if big.any():
            out[big] = self.raw[i + 2].view(np.int64).reshape(-1, 4)[np.searchsorted(self.raw[i + 1].view(np.uint32), at[big])]
        return out


def _shards(batches):
    """(shard, rows) of batches sorted by shard."""
    own, held = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if row[0] != own and held:
                yield own, held
                held = []
            own = row[0]
            held.append(row)
    if held:
        yield own, held


def _merged_rows(parts: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Rows of columns of words and of numbers, with equal words as one."""
    columns = [np.concatenate(x) for x in zip(*parts)]
    _, first, sums = _merged(combine(columns[:words]) if words > 1 else columns[0], columns[words:])
    return [c[first] for c in columns[:words]] + sums


def _store_runs(uri: str, deal: Deal, k: int, order: int, batches):
    """Stores each shard's runs of k words with their contexts; passes on the runs of k - 1, or, from three on, the words."""
    last: dict[int, list] = {CONTEXTS: [], WORDS: [], PAIRS: []}  # what goes to the shards of words, once for a task
    for shard, rows in _shards(batches):
        passed = [x for x in rows if x[1] != k]
        payloads = [x[2] for x in rows if x[1] == k]
        if not payloads:
            yield _batch(passed)
            continue
        *columns, times = _gathered(payloads, k, 1, deal.codes)
        key, first, (times,) = _merged(combine(columns), [times])
        columns = [c[first] for c in columns]
        sections = [*sorted_keys(key), *_numbers(times)]
        away = deal.apart(columns)
        context = combine(columns[:-1])
        by = np.argsort(context)
        edges = runs_of(context[by])
        own, kinds, away = context[by[edges[:-1]]], _kinds(by, edges, times), away[by[edges[:-1]]]
        sections += [*sorted_keys(own[~away]), *_contexts(kinds[~away])]
        if away.any():
            last[CONTEXTS].append([own[away], *kinds[away].T])
        totals = {"k": k, "shard": shard, "of": _of_count(times)}
        if k == order:
            word, _, (raw,) = _merged(columns[-1], [times])
            last[WORDS].append([word, raw, np.zeros_like(raw)])
        _, first, (n,) = _merged(combine(columns[1:]), [np.ones_like(times)])
        rest = [c[first] for c in columns[1:]]
        del columns
        if k > 3:
            by = np.lexsort((rest[0], *rest[:1:-1], rest[1]))
            rest, n = [c[by] for c in rest], n[by]
            passed += _slices(k - 1, deal(rest), rest, [n], deal.codes)
        else:
            hot = deal.is_hot(rest[0])
            if hot.any():
                last[PAIRS].append([*(c[hot] for c in rest), n[hot]])
            before, after, n = rest[0][~hot], rest[1][~hot], n[~hot]
            suffix = combine([before, after])
            by = np.argsort(suffix)
            sections += [*sorted_keys(suffix[by]), *_numbers(n[by])]
            by = np.argsort(before)
            edges = runs_of(before[by])
            sections += [*sorted_keys(before[by[edges[:-1]]], True), *_contexts(_kinds(by, edges, n))]
            totals["of_pairs"] = _of_count(n)
            word, _, (distinct,) = _merged(after, [np.ones_like(n)])
            last[WORDS].append([word, np.zeros_like(distinct), distinct])
        put(f"{uri}/runs{k}-{shard}", sections)
        yield _batch([*passed, (shard, -1, None, json.dumps(totals))])
    for kind, parts in last.items():
        if parts:
            words = 2 if kind == PAIRS else 1
            columns = _merged_rows(parts, words)
            if words == 2:
                by = np.lexsort(columns[1::-1])
                columns = [c[by] for c in columns]
            yield _batch(_slices(kind, shard_of(columns[words - 1], deal.wide), columns[:words], columns[words:], deal.codes))


_FOUND = "what string, key long, n1 long, n2 long, n3 long, total long, totals string"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _store_words(uri: str, deal: Deal, batches):
    """Stores each shard's words, and its pairs whose first word is hot; gives parts of the contexts that lie in many shards, and totals."""
    for shard, rows in _shards(batches):
        said = [x[3] for x in rows if x[3] is not None]
        of = lambda kind: [x[2] for x in rows if x[1] == kind]  # noqa: E731, B023
        found = []
        words, raw, distinct = _gathered(of(WORDS), 1, 2, deal.codes)
        words, _, (raw, distinct) = _merged(words, [raw, distinct])
        before, after, n = _gathered(of(PAIRS), 2, 1, deal.codes)
        key, first, (n,) = _merged(combine([before, after]) if len(n) else before, [n])
        before, after = before[first], after[first]
        distinct = distinct + np.bincount(np.searchsorted(words, after), minlength=len(words))[: len(words)]
        by = np.argsort(before)
        edges = runs_of(before[by])
        found += [("word", h, *x) for h, x in zip(before[by[edges[:-1]]].view(np.int64).tolist(), _kinds(by, edges, n).tolist())]
        keys, *kinds = _gathered(of(CONTEXTS), 1, 4, deal.codes)
        keys, _, kinds = _merged(keys, kinds)
        found += [("pair", h, *x) for h, x in zip(keys.view(np.int64).tolist(), np.stack(kinds, 1).tolist())]
        if len(words):
            put(f"{uri}/words-{shard}", [*sorted_keys(words, True), *_numbers(raw), *_numbers(distinct), *sorted_keys(key), *_numbers(n)])
            said.append(json.dumps({"k": 1, "shard": shard, "of": _of_count(distinct), "of_pairs": _of_count(n), "tokens": int(raw.sum()), "words": len(words), "types": int(distinct.sum())}))
        found += [("totals", None, None, None, None, None, x) for x in said]
        found = [(*x, None)[: len(_FOUND_NAMES)] for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 7, [pa.string(), *[pa.int64()] * 5, pa.string()])], names=_FOUND_NAMES)


def discounts(of_count: list[int]) -> list[float]:
    """The three modified Kneser-Ney discounts of n1..n4; where a count is none, half of what a count of so many may lose at most."""
    n1, n2, n3, n4 = of_count
    if not (n1 and n2):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    each = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(each, 1)]


def _peeked(rows: DataFrame, shards: int, wide: int) -> Deal:
    """The deal that a sample of documents suggests: words and pairs that would fill a shard by themselves, and frequent words."""

    def counted(batches):
        for b in batches:
            texts = [x.encode() for x in b.column(0).to_pylist()]
            for first, last in blocks(texts):
                words, places, _ = sequence(texts[first:last], 3)
                before = words[places - 1]
                h, n = np.unique(before, return_counts=True)
                p, m = np.unique(combine([words[places - 2], before]), return_counts=True)
                much = m > len(places) / (8 * shards)
                columns = [np.concatenate((h, p[much], [U(0)])).view(np.int64), np.concatenate((n, m[much], [len(places)])), np.repeat([0, 1, 2], [len(h), int(much.sum()), 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "n", "kind"])

    sums = rows.sample(PEEK, 1).select("text").mapInArrow(counted, "h long, n long, kind long").groupBy("h", "kind").agg(F.sum("n").alias("n"))
    sums = written(sums, "ngram-peek")
    total = sums.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    much = sums.where(F.col("n") > F.lit(total / shards)).where("kind < 2").collect()  # fewer than shards of each kind
    often = sums.where("kind = 0 and n > 1").where(F.col("n") * LEAST_SHARE > total).select("h", "n").collect()  # fewer than LEAST_SHARE
    codes = [r.h for r in sorted(often, key=lambda r: (-r.n, r.h))[:CODES]]
    return Deal(shards, wide, [r.h for r in much if r.kind == 0], [r.h for r in much if r.kind == 1], codes)


def train(docs: DataFrame, order: int = ORDER) -> dict:
    """Counts the training part of documents (doc_id, text) and stores the model; gives what describes it.

    Documents whose crc32 of doc_id as text is 2 modulo 7 are left out (null doc_id: empty text, which is 0). Null texts
    are empty: they hold one token, the end. No training documents give a model of no tokens.
    """
    if order < 3:
        raise ValueError("runs have three words or more")
    prepare(docs.sparkSession)
    wide = width(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text"))
    deal = _peeked(docs, 2 * wide, wide)
    return stored(docs.mapInArrow(partial(_count_batches, deal, order), DEALT), deal, order)


def stored(rows: DataFrame, deal: Deal, order: int) -> dict:
    """Sums dealt counts of runs, stores the model's files in the shared folder, and gives what describes it."""
    spark, uri, n = rows.sparkSession, fresh(rows.sparkSession, "ngrams"), deal.wide
    for k in range(order, 2, -1):
        rows = rows.repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(partial(_store_runs, uri, deal, k, order), DEALT)
    found = written(rows.repartitionById(n, "shard").sortWithinPartitions("shard").mapInArrow(partial(_store_words, uri, deal), _FOUND), "ngram-totals")
    totals = [json.loads(r.totals) for r in found.where("what = 'totals'").select("totals").collect()]
    spread = found.where("what != 'totals'").groupBy("what", "key").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "total"))).collect()
    add = lambda k, name="of": [sum(x) for x in zip([0] * 4, *(t[name] for t in totals if k in (None, t["k"]) and name in t))]
    one = [t for t in totals if t["k"] == 1]
    whole = {x: sum(t[x] for t in one) for x in ("tokens", "words", "types")}
    return whole | {
        "uri": uri, "shards": deal.shards, "wide": n, "order": order, "hot": deal.hot.view(np.int64).tolist(), "pairs": deal.pairs.view(np.int64).tolist(),
        "spread": {what: [[r.key, r.n1, r.n2, r.n3, r.total] for r in spread if r.what == what] for what in ("word", "pair")},
        "files": [[f"runs{t['k']}" if t["k"] > 1 else "words", t["shard"]] for t in totals],
        "of_words": add(1), "discounts": [discounts(x) for x in (add(1), add(None, "of_pairs"), *(add(k) for k in range(3, order + 1)))],
    }


class Model:
    """A stored model, with its files mapped when first needed."""

    def __init__(self, about: dict):
        self.__dict__.update(about)
        self.deal = Deal(self.shards, self.wide, self.hot, self.pairs, [])
        self.there, self.open = {tuple(x) for x in self.files}, {}
        self.spread = {what: sorted((int(np.int64(h).view(U)), *x) for h, *x in rows) for what, rows in self.spread.items()}
        self.spread = {what: (np.array([x[0] for x in rows], U), np.array([x[1:] for x in rows], np.int64).reshape(-1, 4)) for what, rows in self.spread.items()}

    def by_shard(self, name: str, shard: np.ndarray):
        """(file, rows) for each shard that has one; into others no word fell."""
        order = np.argsort(shard.astype(np.uint32), kind="stable")
        edges = runs_of(shard[order])
        for a, b in zip(edges, edges[1:]):
            at = name, int(shard[order[a]])
            if at in self.there:
                if at not in self.open:
                    self.open[at] = File(f"{self.uri}/{at[0]}-{at[1]}")
                yield self.open[at], order[a:b]

    def _spread(self, what: str, keys: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        own, kinds = self.spread[what]
        if len(own) and len(rows):
            at = np.minimum(np.searchsorted(own, keys[rows]), len(own) - 1)
            found = own[at] == keys[rows]
            out[rows[found]] = kinds[at[found]]

    def words_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, numbers of distinct words before, and contexts (rows of _kinds) of distinct words."""
        c, cc, kinds = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros((len(words), 4), np.int64)
        for f, rows in self.by_shard("words", shard_of(words, self.wide)):
            at, found = f.find(0, words[rows])
            c[rows], cc[rows] = f.numbers(3, at, found), f.numbers(6, at, found)
        for f, rows in self.by_shard("runs3", shard_of(words, self.shards)):
            kinds[rows] = f.contexts(21, *f.find(18, words[rows]))
        self._spread("word", words, kinds, np.flatnonzero(self.deal.is_hot(words)))
        return c, cc, kinds

    def pairs_of(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of distinct words before pairs."""
        out, key = np.zeros(len(word), np.int64), combine([before, word])
        hot = self.deal.is_hot(before)
        for name, mine, by, shards, i in (("runs3", ~hot, before, self.shards, 12), ("words", hot, word, self.wide, 9)):
            own = np.flatnonzero(mine)
            for f, rows in self.by_shard(name, shard_of(by[own], shards)):
                out[own[rows]] = f.numbers(i + 3, *f.find(i, key[own[rows]]))
        return out

    def runs_of(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of runs of three or more words (numbers of distinct words before, below the model's order), and their contexts."""
        n, kinds = np.zeros(len(columns[0]), np.int64), np.zeros((len(columns[0]), 4), np.int64)
        key, context = combine(columns), combine(columns[:-1])
        for f, rows in self.by_shard(f"runs{len(columns)}", self.deal(columns)):
            n[rows] = f.numbers(3, *f.find(0, key[rows]))
            kinds[rows] = f.contexts(9, *f.find(6, context[rows]))
        self._spread("pair", context, kinds, np.flatnonzero(self.deal.apart(columns)))
        return n, kinds

    def log10(self, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the words at some places, each after order - 1 others; and the words' counts."""
        both, ids = np.unique(words, return_inverse=True)
        c, cc, kinds = self.words_of(both)
        cut = [np.array([0.0, *d]) for d in self.discounts]
        of = np.array([0, *self.of_words[:2], self.words - sum(self.of_words[:2])], float)
        rest = float(of @ cut[0]) / self.types if self.types else 1.0
        low = (cc - cut[0][np.minimum(cc, 3)]).clip(0) / max(self.types, 1) + rest / (self.words + 1)
        p = low[ids[places]]
        for k in range(2, self.order + 1):
            columns = [words[places - k + 1 + i] for i in range(k)]
            n, found = (self.pairs_of(*columns), kinds[ids[places - 1]]) if k == 2 else self.runs_of(columns)
            d, total = cut[k - 1], found[:, 3]
            mixed = ((n - d[np.minimum(n, 3)]).clip(0) + found[:, :3] @ d[1:] * p) / np.maximum(total, 1)
            p = np.where(total > 0, mixed, p)
        return np.log10(p), c[ids[places]]

    def scores(self, texts: list[bytes]):
        """Per text of a block: tokens, known tokens, base score, score."""
        words, places, owner = sequence(texts, self.order)
        p, c = self.log10(words, places)
        base = np.log10((c + 1) / (self.tokens + self.words + 1))
        total = lambda x: np.bincount(owner, x, len(texts))
        return np.bincount(owner, minlength=len(texts)), total((c > 0).astype(float)).astype(np.int64), total(base), total(p)


_models: dict[str, Model] = {}


def _score_batches(about: dict, batches):
    if about["uri"] not in _models:
        _models.clear()
        _models[about["uri"]] = Model(about)
    model = _models[about["uri"]]
    for b in batches:
        ids = b.column(0)
        texts = [x.encode() for x in b.column(1).to_pylist()]
        parts = [model.scores(texts[first:last]) for first, last in blocks(texts, SCORED)]
        n, known, base, score = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [], [])
        columns = [ids, pa.array(_held_out(ids.to_pylist())), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """documents to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row.

    base_score: add-one word probabilities; score: the model's; both log10, over the words and one end. Null and empty
    texts hold the end alone. With no training documents every word is unknown. Other columns are not read. A model file
    that was written and is missing later is an error, never a word without counts.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text"))
    about = train(rows, order)
    return rows.mapInArrow(partial(_score_batches, about), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(score: float, tokens: int) -> float:
    return math.pow(10, -score / tokens)


def op8_ngrams(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
