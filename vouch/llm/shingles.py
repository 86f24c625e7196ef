"""Word shingles of a text as sorted distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

# Odd multipliers, one for each position in a shingle, from a Weyl sequence.
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def split_words(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (multiply and shift)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the ``width``-word shingles, ascending (int64).

    Fewer words make one shingle of the whole sequence; no word, no shingle.
    """
    words = split_words(text)
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64)
    if n < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64).view(np.int64)
    h = word_hashes(words)
    acc = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        acc += h[i:n - width + 1 + i] * np.uint64((_STEP * (2 * i + 1) & _MASK) | 1)
    return np.unique(mixed(acc).view(np.int64))
