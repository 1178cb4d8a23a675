"""Words, letters and hashes as the operators on text understand them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
import xxhash

#: Letters are Unicode letters and combining marks; a word also keeps numbers.
NOT_WORD = regex.compile(r"[^\p{L}\p{M}\p{N}\s]+")
NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_CACHE_LIMIT = 2_000_000


_ASCII_MARKS = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))


def words(text: str | None) -> list[str]:
    """Lower-cased pieces between blanks, without anything but letters, marks and numbers."""
    if not text:
        return []
    low = text.lower()
    if low.isascii():  # the same, at the speed of bytes
        return low.encode("ascii").translate(None, _ASCII_MARKS).decode("ascii").split()
    return NOT_WORD.sub("", low).split()


class WordHasher(dict):
    """64-bit hashes of words, remembered because words recur; the memory is bounded."""

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = self[w] = h - (1 << 64) if h >> 63 else h
        return h

    def __call__(self, ws: list[str]) -> np.ndarray:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.int64, len(ws)).view(np.uint64)


_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=64)
def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _C[0] + np.uint64(seed)) | np.uint64(1)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` consecutive words; fewer words make one run."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    mult = odd_multipliers(size, 7)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * mult[j]
    return np.unique(mix(total))
