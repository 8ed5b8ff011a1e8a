"""Words and word windows of texts as 64-bit numbers, for use in executors' Python."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of which a worker keeps the hash, in each of two generations.
CACHED_WORDS = 150_000
#: Odd multiplier of the polynomials over words, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class WordHashes(dict):
    """Hash of each word, kept in two generations: when this one is full it becomes the old one, and
    what is met again moves back."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed, self.old = seed, {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive words, mixed; none if there are fewer."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = ids[:n].copy()
    for j in range(1, k):
        h *= np.uint64(BASE)
        h += ids[j : j + n]
    return mixed(h)


class Rolling:
    """Rabin-Karp hashes of long windows: prefix sums of words times powers of BASE, from which
    every window's polynomial follows by one subtraction and one division."""

    def __init__(self):
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, BASE, dtype=np.uint64))])
            self.down = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, INVERSE, dtype=np.uint64))])

    def windows(self, ids: np.ndarray, k: int) -> np.ndarray:
        n = len(ids) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        self.grow(len(ids))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ids * self.up[: len(ids)])])
        return mixed((sums[k:] - sums[:-k]) * self.down[:n])


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    """Least of every ``window`` consecutive numbers."""
    span, out = 1, x
    while span * 2 <= window:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = window - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence if there are fewer words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = hashes.of(words)
    if len(words) < k:
        return mixed(runs(ids, len(words)) + np.uint64(len(words)))
    return np.unique(runs(ids, k))
