"""Word-shingle sets as sorted 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Coordinates of a signature.
COORDINATES = 64
_CACHE = 500_000
_RNG = np.random.default_rng(20240229)
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Hashes()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of UTF-8 text; of the whole sequence if it has fewer words; empty without words.

    A-Z are lower-cased; words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
    """
    if len(_WORDS) > _CACHE:
        _WORDS.clear()
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return mix((w * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _SHORT[n : n + 1])
    h = w[: n - WORDS + 1] * _PLACE[0]
    for j in range(1, WORDS):
        h = h + w[j : n - WORDS + 1 + j] * _PLACE[j]
    return np.unique(mix(h))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that name the set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES minima, of the upper 32 bits of products with odd factors; s must not be empty."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, np.multiply.outer(_FACTORS, s[at : at + 4096]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, exactly."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)
