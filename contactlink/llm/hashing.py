"""Words, word hashes and window hashes of many texts at once, in numpy.

A word is a run of bytes other than space and the control characters 9 to 13. Each word gets two independent 64-bit
hashes: polynomials over random byte values, modulo 2**64, mixed at the end. Words over ``LONG_WORD`` bytes, for which
such polynomials can be made to collide, are hashed by BLAKE2.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

LONG_WORD = 64
#: Bytes of text hashed at once. Powers of a base are kept for twice as many, so a worker keeps a few MB of them.
BLOCK = 1 << 18
GOLDEN = 0x9E3779B97F4A7C15
SEEDS = (1, 2)
MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@functools.cache
def _bytes_values(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(seed * 0x51ED27 << 20))


def _base(seed: int) -> int:
    return (GOLDEN * (2 * seed + 1) & MASK) | 1


@functools.lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a batch: ``starts`` and ``ends`` in ``data``, and the first word of each text in ``first``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        inside = ~IS_SPACE[data]
        start = inside.copy()
        if len(data):
            start[1:] &= ~inside[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            start[heads] = inside[heads]
            end = inside.copy()
            end[:-1] &= ~inside[1:]
            tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            end[tails] = inside[tails]
        else:
            end = start
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash per word; with ``fold_case`` A-Z count as a-z."""
        values = _bytes_values(seed)
        if fold_case:
            values = values.copy()
            values[65:91] = values[97:123]
        base = _base(seed)
        out = np.empty(len(self), np.uint64)
        i = 0
        while i < len(self):
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + BLOCK, "right")))
            stop = self.ends[j - 1]
            size = max(2 * BLOCK, 1 << int(stop - at).bit_length())
            terms = values[self.data[at:stop]] * _powers(base, size)[: stop - at]
            sums = np.empty(len(terms) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(terms, out=sums[1:])
            a, b = self.starts[i:j] - at, self.ends[i:j] - at
            out[i:j] = (sums[b] - sums[a]) * _powers(pow(base, -1, 1 << 64), size)[a]
            i = j
        lengths = self.ends - self.starts
        out = mixed(out + lengths.astype(np.uint64) * np.uint64(GOLDEN))
        for k in np.flatnonzero(lengths > LONG_WORD):
            word = self.data[self.starts[k] : self.ends[k]].tobytes()
            word = word.lower() if fold_case else word
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([seed])).digest(), "little")
        return out

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values, by doubling; the order of values counts."""
    base = _base(seed + 7)
    if size == 1:
        return hashes
    if size % 2:
        shorter = windows(hashes, size - 1, seed)
        return shorter[: max(0, len(hashes) - size + 1)] * np.uint64(base) + hashes[size - 1 :]
    half = windows(hashes, size // 2, seed)
    n = max(0, len(hashes) - size + 1)
    return half[:n] * np.uint64(pow(base, size // 2, 1 << 64)) + half[size // 2 : size // 2 + n]


def window_hashes(words: Words, hashes: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the word each starts at."""
    h = windows(hashes, size, seed) if len(hashes) >= size else np.zeros(0, np.uint64)
    owner = words.owners()
    at = np.flatnonzero(owner[: len(h)] == owner[size - 1 :]) if len(h) else np.zeros(0, np.int64)
    return mixed(h[at]), at
