"""Word shingles as 64-bit hashes, and MinHash signatures over them, in numpy."""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_MEMO_WORDS = 200_000
_memo: dict[str, int] = {}
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word (\\w+, lower case) of the text."""
    words = WORD.findall(text.lower())
    try:
        return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_memo) > _MEMO_WORDS:
            _memo.clear()
        _memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in {w for w in words if w not in _memo})
        return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Hashes of the n-word shingles in order; a text of fewer words is one shingle, one without words has none."""
    w = word_hashes(text)
    if len(w) == 0:
        return w
    m = min(n, len(w))
    h = np.zeros(len(w) - m + 1, np.uint64)
    for i in range(m):
        h = mixed(h * _FACTORS[i % len(_FACTORS)] + w[i : len(w) - m + 1 + i])
    return h


def shingle_set(text: str, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, n))


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): as many rows as give `recall` at `threshold` within most_hashes hashes.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


class MinHash:
    """bands x rows minima of seeded 32-bit multiply-add hashes, joined to a 64-bit hash for each band."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 512):
            x = np.multiply.outer(self.a, h[i : i + 512])
            x += self.b[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            np.minimum(low, x.min(axis=1), out=low)
        rows = low.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.rows):
            out = mixed(out * _FACTORS[0] + rows[:, i])
        return out.view(np.int64)
