"""Words of many texts at once as NumPy arrays: positions, 64-bit hashes, owners.

A block is a list of UTF-8 texts laid end to end with a line feed after each. Word characters are given by a
256-entry byte table, so a class may hold any ASCII characters and all bytes of non-ASCII ones.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 1 << 20

U = np.uint64
_BASE, _UNBASE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2, _STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words: space and 0x09-0x0D; and all ASCII but digits and letters.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


#: An odd number for each byte, by the fixed formula above, so stored hashes stay comparable.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            x = np.full(size, base)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def blocks(texts: list[bytes], size: int = BLOCK):
    """(first, last) ranges of texts of about size bytes."""
    first = total = 0
    for i, x in enumerate(texts):
        if i > first and total + len(x) > size:
            yield first, i
            first, total = i, 0
        total += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of a block: start and end in the buffer, hash, and per text the range first[i]:first[i+1]."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES, lower: bool = True, hashes: bool = True):
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        self.buf = LOWER[buf] if lower else buf
        gap = np.ones(len(buf) + 1, bool)
        np.take(separators, self.buf, out=gap[1:])
        # texts end in a line feed, which need not be a separator of the class
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        gap[ends] = True
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        if hashes:
            up, down = powers(len(buf))
            total = np.zeros(len(buf) + 1, U)
            np.cumsum(_BYTES[self.buf] * up, out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words (of the whole text where it has fewer, but some), and their owners, in order of owner."""
        return shingles(self.hash, self.first, k)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several columns of hashes; depends on their order."""
    out = parts[0].copy()
    for x in parts[1:]:
        out = out * _STEP + x
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(first)
    runs = np.maximum(count - k + 1, 0)
    n = int(runs.sum())
    owner = np.repeat(np.arange(len(count)), runs)
    at = np.arange(n) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first[:-1], runs)
    out = combine([hashes[at + i] for i in range(k)]) if n else np.empty(0, U)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        more = np.empty(len(short), U)
        for j, i in enumerate(short):
            x = U(count[i])
            for h in hashes[first[i] : first[i + 1]]:
                x = U((int(x) * int(_STEP) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            more[j] = x
        owner, out = np.concatenate((owner, short)), np.concatenate((out, mix(more)))
        order = np.argsort(owner, kind="stable")
        owner, out = owner[order], out[order]
    return out, owner


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array, and its length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
