"""Word shingles of whole texts as 64-bit hashes, computed in batches inside tasks."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multiplier of the polynomial over word hashes, and multiplier of the finaliser.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINAL = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased; words are runs of anything but ASCII white space."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * FINAL
    return h ^ (h >> np.uint64(29))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; empty with fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * MULTIPLIER + words[i : n + i]
    return mix(h)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; the whole sequence as one shingle with fewer words, none without words."""
    if not len(words):
        return words
    return np.unique(grams(words, min(k, len(words))))


def release() -> None:
    """Gives free memory back at the end of a task; a worker that waits would keep it beside its executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        return
