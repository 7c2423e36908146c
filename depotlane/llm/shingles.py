"""Hashes of words and of runs of words, for tasks that work on many texts with numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: Words whose hashes a worker remembers; beyond it the memory starts anew.
REMEMBERED = 150_000
_KNOWN: dict[bytes, int] = {}

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (in place)."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    known = _KNOWN
    if len(known) > REMEMBERED:
        known.clear()
    for w in {w for w in words if w not in known}:
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n consecutive words; none of fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= FACTOR
        out += hashes[k : k + count]
        if k % 2:
            out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text with A-Z lower-cased.

    A text of fewer words has its whole sequence as its one shingle; one without words none.
    bytes.lower and bytes.split know ASCII alone, white space being 20 and 09 to 0D.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(run_hashes(hashes, n) if len(words) >= n else run_hashes(hashes, len(words)) ^ np.uint64(len(words)))


def digest(values: np.ndarray) -> bytes:
    """128 bits that stand for a sorted set of hashes."""
    return xxhash.xxh3_128_digest(values.tobytes())


def offsets(lengths: Iterable[int]) -> np.ndarray:
    """Where each of consecutive runs begins."""
    ends = np.cumsum(np.fromiter(lengths, np.int64))
    return np.concatenate([np.zeros(1, np.int64), ends[:-1]])
