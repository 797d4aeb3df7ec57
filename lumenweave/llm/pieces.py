"""Encoding and decoding by merge-type vocabularies of sentencepiece model files.

A text becomes symbols, and an agenda holds all adjacent pairs that form a piece, the best score first, of equal ones the
leftmost. The best pair is merged, its new neighbours join the agenda, and pairs whose symbols have changed are passed
over. Where no piece has a word sign after another character, no merge crosses the start of a word, so words are encoded
by themselves and each word of a batch only once. The agendas of many short words are rows of one array, and a step takes
the best pair of every row; a long word has a heap.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, table, text_column

VOCABULARY = "piece_bpe_32k.model"
#: Encoded words that a worker keeps, more are encoded again; the length up to which words are kept and share an array.
KEPT, SHORT = 200_000, 64
#: Words of an array of agendas.
ROWS = 20_000

# Fixed values of the model format: the word sign, types of pieces, kinds of models, and what an unknown piece decodes to.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message; integers, or bytes."""
    at = 0

    def integer() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = integer()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, integer()
            continue
        size = {1: 8, 5: 4}.get(kind) or integer()
        yield tag >> 3, data[at : at + size]
        at += size


def _each(error: UnicodeDecodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("lumenweave-each", _each)


@dataclass
class Vocabulary:
    """A model file's pieces by string, and what its texts are made to before they are cut."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    prefix: bool
    squeeze: bool
    fallback: bool
    unknown_text: str
    known: dict[bytes, int] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        self.merged = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER_DEFINED, UNUSED)}
        self.reserved = {p: i for i, p in enumerate(self.pieces) if self.types[i] not in (NORMAL, USER_DEFINED, UNUSED)}
        self.unknown = self.types.index(UNKNOWN)
        self.of_byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        own = sorted((p for p, i in self.merged.items() if self.types[i] == USER_DEFINED), key=len, reverse=True)
        self.whole = set(own)
        self.symbols = re.compile("|".join([*map(re.escape, own), "."]), re.S)
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.merged)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else ".+", re.S)
        self.begin, self.end = self.reserved.get("<s>"), self.reserved.get("</s>")
        shown = {UNKNOWN: self.unknown_text, CONTROL: ""}
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else shown.get(t, p.replace(SPACE, " ")).encode() for p, t in zip(self.pieces, self.types)]

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", SPACE)

    def merge(self, word: str) -> list[str]:
        """The symbols of a word after all merges."""
        symbols = self.symbols.findall(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        fixed = [s in self.whole for s in symbols] if self.whole else None
        scores, merged = self.scores, self.merged
        agenda: list[tuple[float, int, int, int]] = []
        halves: dict[str, tuple[str, str]] = {}

        def offer(left: int, right: int) -> None:
            if left < 0 or right < 0 or fixed and (fixed[left] or fixed[right]):
                return
            piece = symbols[left] + symbols[right]
            i = merged.get(piece)
            if i is not None:
                heapq.heappush(agenda, (-scores[i], left, right, len(piece)))
                if self.types[i] == UNUSED:
                    halves[piece] = symbols[left], symbols[right]

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        out: list[str] = []
        todo = [s for s in reversed(symbols) if s]
        while todo:  # pieces that are not to be used fall back to their halves
            s = todo.pop()
            if s in halves and self.types[merged[s]] == UNUSED:
                todo += reversed(halves[s])
            else:
                out.append(s)
        return out

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(word):
            i = self.reserved.get(s)
            if i is None:
                i = self.merged.get(s, self.unknown)
            if i != self.unknown:
                out.append(i)
            elif self.fallback:
                out += [self.of_byte[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted keys of the pairs that form a piece, their pieces, the symbols of code points, and the number of symbols.

        Symbols are the pieces and, after them, single characters that are only parts of pieces.
        """
        number, found = dict(self.merged), {}
        for p in self.merged:
            for c in p:
                number.setdefault(c, len(self.pieces) + len(number))
        n = len(self.pieces) + len(number)
        for p, i in self.merged.items():
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    found[number[p[:k]] * n + number[p[k:]]] = i
        keys = np.array(sorted(found), np.int64)
        symbols = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in number.items():
            if len(p) == 1:
                symbols[ord(p)] = i
        return keys, np.array([found[k] for k in keys.tolist()], np.int32), symbols, n

    def _rows(self, symbols: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Symbols of short words after all merges, by word and place, -1 elsewhere; symbols: those of all words, end to end."""
        keys, pieces, _, n = self.pairs
        scores = np.array(self.scores, np.float64)
        count, wide = len(size), width + 2  # a place without a symbol on either side
        grid = np.full((count, wide), -1, np.int32)
        grid[:, 1:-1][np.arange(width) < size[:, None]] = symbols
        grid = grid.reshape(-1)
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), count)
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), count)
        agenda, makes = np.full(count * wide, -np.inf), np.full(count * wide, -1, np.int32)

        def offer(left: np.ndarray, right: np.ndarray) -> None:
            a, b = grid[left], grid[right]
            known = (a >= 0) & (a < n) & (b >= 0) & (b < n)
            key = np.where(known, a.astype(np.int64) * n + b, -1)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            fits = keys[at] == key
            makes[left] = np.where(fits, pieces[at], -1)
            agenda[left] = np.where(fits, scores[pieces[at]], -np.inf)

        if len(keys):
            inner = np.flatnonzero(grid >= 0)
            offer(inner, inner + 1)
        rows = np.arange(count)
        while len(rows):
            view = agenda.reshape(count, wide)[rows]
            best = view.argmax(1)
            rows, best = rows[live := view[np.arange(len(rows)), best] > -np.inf], best[live]
            base = rows * wide
            left = base + best
            right = base + after[left]
            third = after[right]
            grid[left] = makes[left]
            grid[right], agenda[right] = -1, -np.inf
            after[left] = third
            before[base + third] = best
            offer(left, base + third)
            first = before[left]
            some = first > 0
            offer((base + first)[some], left[some])
        return grid.reshape(count, wide)[:, 1:-1]

    def _short(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of up to SHORT characters."""
        _, _, table, n = self.pairs
        size = np.fromiter(map(len, words), np.int64, len(words))
        grid = self._rows(table[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")], size, int(size.max()))
        there = grid >= 0
        symbols, owner = grid[there], np.nonzero(there)[0]
        lone = np.flatnonzero(symbols >= len(self.pieces))
        if len(lone):  # characters without a piece
            chars = {i: p for p, i in zip(map(chr, np.flatnonzero(table < n).tolist()), table[table < n].tolist()) if i >= len(self.pieces)}
            plain = {i: self._unknown(chars.get(i) or chr(i - n)) for i in set(symbols[lone].tolist())}
            times = np.ones(len(symbols), np.int64)
            times[lone] = [len(plain[i]) for i in symbols[lone].tolist()]
            parts = [x for i in symbols[lone].tolist() for x in plain[i]]
            symbols, owner, own = np.repeat(symbols, times), np.repeat(owner, times), np.repeat(symbols >= len(self.pieces), times)
            symbols[own] = parts
        ends = np.cumsum(np.bincount(owner, minlength=len(words)) * 4).tolist()
        raw = symbols.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _unknown(self, char: str) -> list[int]:
        return [self.of_byte[b] for b in char.encode()] if self.fallback else [self.unknown]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct words."""
        out = {}
        even = not self.whole and UNUSED not in self.types and all(len(p) > 1 for p in self.reserved)
        words.sort(key=len)
        short = bisect_right(words, SHORT, key=len) if even else 0
        for i in range(0, short, ROWS):
            part = words[i : min(i + ROWS, short)]
            out |= zip(part, self._short(part))
        return out | {w: _packed(self.ids(w)) for w in words[short:]}

    def encode(self, texts: list[str], begin: bool = False, end: bool = False, seen=None) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers. seen, if given, is called with the words encoded anew and their ids."""
        parts = [self.cut.findall(self.normal(t)) for t in texts]
        if len(self.words) > KEPT:
            self.words.clear()
        new = self.learn(list(set().union(*parts).difference(self.words)))
        if seen:
            seen(new)
        self.words |= new
        packed = self.words.__getitem__
        out = [b"".join(map(packed, p)) for p in parts]
        for w in [w for w in new if len(w) > SHORT]:
            del self.words[w]
        if not self.fallback:  # a run of unknown symbols is one
            for n, body in enumerate(out):
                i = np.frombuffer(body, "<u4")
                out[n] = i[np.concatenate(([True], (i[1:] != self.unknown) | (i[:-1] != self.unknown)))[: len(i)]].tobytes()
        head, tail = (struct.pack("<I", i) if asked else b"" for i, asked in ((self.begin, begin), (self.end, end)))
        return [head + x + tail for x in out]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD one by one, and a word sign that starts the text goes."""
        numbers = memoryview(ids).cast("I").tolist() if ids else []
        raw = b"".join(map(self.surface.__getitem__, numbers))
        skip = 0
        if (self.prefix or self.squeeze) and raw.startswith(b" "):
            first = next(i for i in numbers if self.surface[i])
            skip = int(self.types[first] not in (BYTE, UNKNOWN))
        if raw.isascii() or not any(self.types[i] == CONTROL for i in numbers[1:-1]):
            return raw.decode("utf-8", "lumenweave-each")[skip:]
        runs = groupby(numbers, lambda i: self.types[i] == BYTE)  # bytes on both sides of a control piece don't meet
        return "".join(b"".join(self.surface[i] for i in run).decode("utf-8", "lumenweave-each") for _, run in runs)[skip:]


def vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary of a model file. Only merge-type models without a character map are read; others are an error."""
    pieces, scores, types, settings, norm = [], [], [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append(x[1].decode())
            scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
            types.append(x.get(3, NORMAL))
        elif number in (2, 3):
            (settings if number == 2 else norm).update(_fields(value))
    if settings.get(3, 1) != MERGES:
        raise ValueError("not a merge-type model")
    if norm.get(2) or settings.get(24) or not norm.get(5, 1):
        raise ValueError("character maps, word signs at the end and unescaped white space are not read")
    shown = settings[44].decode() if 44 in settings else UNKNOWN_TEXT
    return Vocabulary(pieces, scores, types, bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(settings.get(35, 0)), shown)


@lru_cache(2)
def loaded(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return vocabulary(f.read())


@lru_cache(2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _differ(path: str, own: Vocabulary, new: dict[str, bytes]) -> list[str]:
    """Of words just encoded those that the library encodes otherwise."""
    words = [w for w in new if not own.prefix or len(w) > 1 and w[0] == SPACE]  # the library puts the prefix before each
    asked = _library(path).encode([w[own.prefix :] for w in words], num_threads=1)
    return [w for w, ids in zip(words, asked) if _packed(ids) != new[w]]


def _encoded(path: str, begin: bool, end: bool, check: str | None, batches):
    own = loaded(path)
    for b in batches:
        texts = b.column("text").to_pylist()
        wrong: list[str] = []
        ids = own.encode(texts, begin, end, (lambda new: wrong.extend(_differ(path, own, new))) if check == "words" else None)
        names = [c for c in b.schema.names if c != "text"]
        columns = [*(b.column(c) for c in names), pa.array(ids, pa.binary())]
        if check:
            same = [True] * len(ids)
            if check == "texts" or wrong:
                same = [_packed(x) == y for x, y in zip(_library(path).encode(texts, add_bos=begin, add_eos=end, num_threads=1), ids)]
            for w in wrong:  # so that it is compared again in the next batch
                own.words.pop(w, None)
            columns.append(pa.array(same, pa.bool_()))
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", *["same_ids"] * bool(check)])


def _decoded(path: str, check: bool, batches):
    own = loaded(path)
    for b in batches:
        ids = b.column("ids").to_pylist()
        texts = [None if i is None else own.decode(i) for i in ids]
        columns, names = [*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"]
        if check:
            asked = _library(path).decode([memoryview(i).cast("I").tolist() if i else [] for i in ids], num_threads=1)
            columns.append(pa.array([x == (y or "") for x, y in zip(asked, texts)], pa.bool_()))
            names.append("same_text")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encoded(docs: DataFrame, path: str, begin: bool = True, end: bool = True, check: str | None = "words") -> DataFrame:
    """documents to (doc_id, ids), one row for each row: ids as little-endian 32-bit integers, by the model file at path.

    With check, same_ids says whether the library agrees, asked for each Arrow batch: for "texts" with all its texts, for
    "words" with the distinct words that the batch encodes, and with its texts where a word differs. Null and empty texts
    have no ids beside begin and end; repeated and null doc_ids stay, equal texts have equal ids, an empty table gives no
    rows. Texts are encoded whole, however long. Other columns are not read. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text"))
    return rows.mapInArrow(partial(_encoded, path, begin, end, check), "doc_id long, ids binary" + ", same_ids boolean" * bool(check))


def decoded(rows: DataFrame, path: str, check: bool = False) -> DataFrame:
    """rows with ids (as encoded gives them) and their text as decoded, all other columns kept; null ids have a null text.

    With check, same_text says whether the library decodes the ids of each Arrow batch to the same. Columns named decoded
    or same_text before are replaced.
    """
    prepare(rows.sparkSession)
    kept = rows.drop("decoded", *["same_text"] * check)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", decoded string" + ", same_text boolean" * check
    return kept.mapInArrow(partial(_decoded, path, check), schema)


def op13_pieces(spark, sf_dir):
    """Numbers of ids, digests of ids and decoded texts; agrees says whether the library gives the same ids."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    rows = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("same_ids").alias("agrees"))
