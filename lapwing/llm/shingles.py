"""Word shingles as 64-bit hashes, and rolling hashes and window minima over long sequences."""

from __future__ import annotations

import numpy as np
import xxhash

from lapwing.llm.common import U64, mix64

BASE = U64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; emptied when it holds ``most`` words, so it stays bounded."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, in order."""
        words = text.split() if text else []
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def grams(v: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``n`` neighbours of ``v`` (by doubling: about log n passes)."""
    if len(v) < n:
        return np.empty(0, U64)
    block, size, power = v, 1, int(BASE)
    out, used = None, 0
    while True:
        if n & size:
            if out is None:
                out, used = block, size
            else:
                m = len(v) - used - size + 1
                out = out[:m] * U64(power) + block[used : used + m]
                used += size
        if used == n:
            return mix64(out)
        m = len(block) - size
        block = block[:m] * U64(power) + block[size : size + m]
        size *= 2
        power = power * power % 2**64


def window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    size = 1
    while 2 * size <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: -(w - size)], a[w - size :]) if w > size else a


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; a shorter text that has words is one shingle."""
    if len(words) == 0:
        return words
    return np.unique(grams(words, n)) if len(words) >= n else mix64(grams(words, len(words)) + U64(len(words)))


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of ``a * x + b`` modulo 2**64 for each pair (a, b)."""
    out = np.full(len(a), U64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[at : at + 2048, None] * a + b).min(axis=0))
    return out
