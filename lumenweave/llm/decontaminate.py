"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Document words stream through the automaton, which keeps the longest item passage that ends at each word. A passage of
WINDOW words (or a whole shorter item) marks its words. Words that no passage of two can hold are passed over before.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, blocks
from .shared import prepare, table, text_column

WINDOW = 10
#: Item words in one automaton (about 100 MB); more items make more automata, applied one after the other.
ITEM_WORDS = 100_000

#: Words are runs of digits, letters and non-ASCII characters.
BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[97:123] = BREAKS[128:] = False


class Automaton:
    """Suffix automaton of several word sequences, given as arrays of word hashes."""

    def __init__(self, items: list[np.ndarray], window: int = WINDOW):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([*items, np.empty(0, np.uint64)]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [np.searchsorted(self.vocabulary, x).tolist() for x in items]
        for words in numbered:
            last = 0
            for w in words:
                last = self._add(last, w)
        size = len(self.vocabulary)
        pairs = [np.array(x[:-1], np.int64) * size + np.array(x[1:], np.int64) for x in numbered if len(x) > 1]
        self.pairs = np.unique(np.concatenate([*pairs, np.empty(0, np.int64)]))
        self.shortest = min([window, *(len(x) for x in numbered if x)])
        self._number_windows(numbered)

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _number_windows(self, numbered: list[list[int]]) -> None:
        """holds[s]: items with the window that state s stands for; whole[s]: (length, item) of whole short items."""
        link, length, n = self.link, self.length, len(self.link)
        self.at = [-1] * n
        for s in sorted(range(n), key=length.__getitem__):
            if length[s] >= self.window:
                self.at[s] = s if length[link[s]] < self.window else self.at[link[s]]
        self.holds: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for i, words in enumerate(numbered):
            s = 0
            for k, w in enumerate(words):
                s = self.next[s][w]
                if k + 1 >= self.window:
                    self.holds.setdefault(self.at[s], set()).add(i)
            if 0 < len(words) < self.window:
                self.whole.setdefault(s, []).append((len(words), i))
        self.short = [-1] * n  # nearest state up the links, itself included, with whole short items
        if self.whole:
            for s in sorted(range(n), key=length.__getitem__):
                self.short[s] = s if s in self.whole else self.short[link[s]] if s else -1

    def stream(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, state) of every window or whole short item in a run of numbered words; (.., -item - 1) for short ones."""
        out, s, m = [], 0, 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for i, w in enumerate(words):
            while s and w not in nxt[s]:
                s = link[s]
                m = length[s]
            if w in nxt[s]:
                s = nxt[s][w]
                m += 1
            if m >= window:
                out.append((i + 1 - window, i + 1, self.at[s]))
            q = self.short[s]
            while q > 0:
                for n, item in self.whole[q]:
                    if n <= m:
                        out.append((i + 1 - n, i + 1, -item - 1))
                q = self.short[link[q]]
        return out

    def search(self, w: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words of a block are hit, and the items found in each of its texts."""
        n = len(w.hash)
        hit, found = np.zeros(n + 1, np.int64), {}
        size = len(self.vocabulary)
        if not n or not size:
            return np.zeros(n, bool), found
        number = np.searchsorted(self.vocabulary, w.hash)
        number[number == size] = 0
        known = self.vocabulary[number] == w.hash
        joined = np.zeros(n, bool)  # to the word before
        i = np.flatnonzero(known[1:] & known[:-1] & (w.owner[1:] == w.owner[:-1])) + 1
        if len(self.pairs):
            code = number[i - 1] * size + number[i]
            at = np.searchsorted(self.pairs, code)
            at[at == len(self.pairs)] = 0
            joined[i] = self.pairs[at] == code
        first = np.flatnonzero(known & ~joined)
        last = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = last - first >= self.shortest
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            for x, y, state in self.stream(number[a:b].tolist()):
                hit[a + x] += 1
                hit[a + y] -= 1
                found.setdefault(int(w.owner[a]), set()).update(self.holds[state] if state >= 0 else (-state - 1,))
        return np.cumsum(hit[:-1]) > 0, found


_built: dict[int, Automaton] = {}


def automaton(key: int, texts: list[bytes], window: int) -> Automaton:
    """Built once in a worker; the one before makes room."""
    if key not in _built:
        _built.clear()
        w = Words(texts, BREAKS)
        _built[key] = Automaton([w.hash[a:b] for a, b in zip(w.first, w.first[1:])], window)
    return _built[key]


def _item_blocks(items: DataFrame) -> list[tuple[list[str], list[bytes]]]:
    """Items in blocks of ITEM_WORDS words, or of one item; one partition at a time passes the driver."""
    out, size = [], ITEM_WORDS
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_column(items).alias("text")).orderBy("item_id", "text").toLocalIterator():
        text = row.text.encode()
        n = len(text) // 2 + 1
        if size + n > ITEM_WORDS:
            out.append(([], []))
            size = 0
        size += n
        out[-1][0].append(row.item_id)
        out[-1][1].append(text)
    return out


def _searched(ids: list[str], texts: list[bytes], window: int, batches):
    key = hash((tuple(ids), tuple(texts), window))
    for b in batches:
        a = automaton(key, texts, window)
        docs = [x.encode() for x in b.column("text").to_pylist()]
        spans, items = [], []
        for first, last in blocks(docs):
            w = Words(docs[first:last], BREAKS)
            hit, found = a.search(w)
            edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
            new = np.zeros(len(hit) + 1, bool)
            new[w.first[:-1][w.count > 0]] = True  # a run of hits ends with its text
            begin = np.flatnonzero((edge == 1) | (new & np.append(hit, False)))
            stop = np.flatnonzero((edge == -1) | (new & np.insert(hit, 0, False)))
            cut = np.searchsorted(begin, w.first)
            for i in range(last - first):
                o = w.first[i]
                spans.append([v for x, y in zip(begin[cut[i] : cut[i + 1]], stop[cut[i] : cut[i + 1]]) for v in (x - o, y - o)])
                items.append(sorted({ids[j] for j in found.get(i, ())}))
        old_spans, old_items = b.column("spans").to_pylist(), b.column("items").to_pylist()
        columns = {"spans": pa.array([(x or []) + y for x, y in zip(old_spans, spans)], pa.list_(pa.int32())), "items": pa.array([sorted({*(x or []), *y}) for x, y in zip(old_items, items)], pa.list_(pa.string()))}
        yield pa.RecordBatch.from_arrays([columns.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)


def _chained(first, second, batches):
    """Two steps in one Python worker."""
    yield from second(first(batches))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, then=None, schema=None) -> DataFrame:
    """docs (all columns but spans and items, if they have such) with spans and items.

    spans: word offsets start, end, start, end, ... of hit runs (from several automata they may overlap); items: the
    ids of items with a window in the text, sorted as strings (null ids: empty string). Null and empty texts have none, and so has every text
    if there are no items. Rows stay one to one. then turns the batches of the last pass into ones of schema.
    """
    prepare(docs.sparkSession)
    out = docs.withColumns({"text": F.col("text").cast("string"), "spans": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")})
    own = out.schema
    out = out.withColumn("text", text_column(out))
    passes = [partial(_searched, ids, texts, window) for ids, texts in _item_blocks(items) or [([], [])]]
    for p in passes[:-1]:
        out = out.mapInArrow(p, own)
    return out.mapInArrow(partial(_chained, passes[-1], then), schema or own) if then else out.mapInArrow(passes[-1], own)


def _merged(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip((spans or [])[::2], (spans or [])[1::2])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest_batches(batches):
    for b in batches:
        words, hits, shas = [], [], []
        docs = [x.encode() for x in b.column("text").to_pylist()]
        for first, last in blocks(docs):
            words += Words(docs[first:last], BREAKS, hashes=False).count.tolist()
        items = [x or [] for x in b.column("items").to_pylist()]
        hits = [sum(y - x for x, y in _merged(s)) for s in b.column("spans").to_pylist()]
        shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas, pa.string()), pa.array([x > 0 for x in hits], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _cleaned(coverage: float, batches):
    for b in batches:
        texts = b.column("text").to_pylist()
        keep, out = [], []
        for text, spans in zip(texts, b.column("spans").to_pylist()):
            if not spans:
                keep.append(True)
                out.append(text)
                continue
            raw = text.encode()
            w = Words([raw], BREAKS, hashes=False)
            cuts = _merged(spans)
            keep.append(sum(y - x for x, y in cuts) <= coverage * len(w.start))
            at, left = 0, []
            for x, y in cuts:
                left.append(raw[at : w.start[x]])
                at = w.end[y - 1]
            out.append(b"".join([*left, raw[at:]]).decode())
        columns = [pa.array(out, pa.string()) if n == "text" else b.column(n) for n in b.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep, pa.bool_()))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """docs without the passages that hold a window of an item; a text of which more than coverage of the words is hit goes whole.

    Columns and rows are else as they were; a null text is kept as null.
    """
    names = docs.columns
    own = {n: f"own_{n}" for n in ("spans", "items") if n in names}
    docs = docs.withColumnsRenamed(own)
    clean = matches(docs.where("text is not null"), items, window, partial(_cleaned, coverage)).drop("spans", "items")
    return clean.unionByName(docs.where("text is null")).withColumnsRenamed({v: k for k, v in own.items()}).select(*names)


def op5_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matches(docs, table(spark, sf_dir, "benchmark"), then=_digest_batches, schema="doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
