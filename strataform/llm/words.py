"""Hashes of words, word windows and sets of texts, for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from .common import only

#: Odd, and 5 modulo 8, so that powers of it differ by few factors of two.
BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words, kept for the process until there are too many."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


def hashed(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text starts (one more than texts)."""
    lists = list(texts)
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    out = np.empty(starts[-1], np.uint64)
    get = only("words", WordHashes).__getitem__
    for k, x in enumerate(lists):
        if x:
            out[starts[k] : starts[k + 1]] = np.fromiter(map(get, x), np.uint64, len(x))
    return out, starts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64, for k below n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        up[0] = 1
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    return _powers[base]


def rolling(words: np.ndarray, width: int, base: int = BASE[0]) -> np.ndarray:
    """A hash of each run of ``width`` words, by start; runs may cross texts, which callers leave out."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    return mixed((total[width:] - total[:-width]) * down[: n - width + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def shingles(words: np.ndarray, starts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text; of all its words if it has fewer."""
    every = rolling(words, width)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(mixed(rolling(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
