"""Word-shingle sets as 64-bit hashes, and their minima under many universal hashes."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

from .text import distinct

WORD_CACHE = 150_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words a worker has met; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text: A-Z lower-cased, split at ASCII white space (which bytes.split() and bytes.lower() do just so)."""
    words = text.lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; a shorter text is one shingle, one without words none."""
    h = word_hashes(text)
    n = min(width, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
    out ^= out >> np.uint64(32)
    return distinct(out)


@cache
def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-add-shift hashes: odd factors and summands."""
    draw = np.random.default_rng(0x5EED).integers(0, 2**64, (2, n), np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """One row of n 32-bit minima for each set; sets must not be empty."""
    out = np.empty((len(sets), n), np.uint32)
    if sets:
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        factors, summands = universal(n)
        held = np.empty_like(flat)
        for k in range(n):
            np.multiply(flat, factors[k], out=held)
            np.add(held, summands[k], out=held)
            out[:, k] = np.minimum.reduceat(held, starts) >> np.uint64(32)
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each row and band; the band's number is part of the key."""
    rows = signatures.shape[1] // bands
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    cut = signatures[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    for r in range(rows):
        keys = (keys ^ cut[:, :, r]) * _MIX[0]
        keys ^= keys >> np.uint64(31)
        keys *= _MIX[2]
    return keys.view(np.int64)
