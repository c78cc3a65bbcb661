"""Words `[^\\x20\\x09-\\x0D]+` of a text as 64-bit hashes, for operators that work on arrays of words in Python."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

CACHE = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (UTF-8) -> 64-bit hash; at most CACHE words are kept."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


@cache
def hashes() -> WordHashes:
    return WordHashes()


def split(text: str | None) -> list[bytes]:
    """bytes.split() splits at the six ASCII blanks and nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that scatters bits (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def times(n: int) -> np.uint64:
    """n times MULTIPLIER, modulo 2 ** 64."""
    return np.uint64(n * int(MULTIPLIER) & 0xFFFF_FFFF_FFFF_FFFF)


def windows(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each window of `size` consecutive words; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, times(seed)) + np.uint64(size)
    for k in range(size):
        h = (h + words[k : k + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return mix(h)
