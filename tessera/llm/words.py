"""Words as this project defines them: longest runs of letters and digits, case ignored."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    low = text.lower()
    if len(low) == len(text):
        return WORD.findall(low)
    return [w.lower() for w in WORD.findall(text)]  # a letter whose lower case is two characters splits no word


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it grows past ``limit`` so that a worker's memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), vectorised."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hashes of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out ^ hashes[i : i + n])
    return out
