"""Words of UTF-8 texts as 64-bit hashes, for tasks that work on hashed sequences."""

from __future__ import annotations

import numpy as np
import xxhash

#: Makes A-Z lower case and leaves every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CACHED_WORDS = 200_000


class WordHashes(dict):
    """Hashes of words, remembered up to a number of words and then begun anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text in lower case; a null text has none."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + count]
    return mix(out)
