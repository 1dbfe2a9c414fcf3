"""Hashes of words and of runs of consecutive words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import WORD
from .subwords import WordTable

WORDS = re.compile(WORD)
#: Two odd factors, for two independent polynomial hashes modulo 2**64.
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class RunHasher:
    """Polynomial hashes of all runs of k consecutive words of a text, from prefix sums."""

    def __init__(self) -> None:
        self.table = WordTable(lambda words: np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        self.size = 0

    def words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The words' own 64-bit hashes, text by text."""
        self.table.learn(texts)
        return [self.table.rows[self.table.numbers(words)] for words in texts]

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = 2 * n
            full = lambda x: np.cumprod(np.full(self.size, x, np.uint64))
            with np.errstate(over="ignore"):
                self.up = [full(f) for f in FACTORS]
                self.down = [full(pow(f, -1, 2**64)) for f in FACTORS]

    def runs(self, hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """One hash for each run, mixed so that it is uniform in every bit."""
        n = len(hashes) - k + 1
        if n < 1:
            return np.empty(0, np.uint64)
        self._powers(len(hashes))
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum(hashes * self.up[which][: len(hashes)]))
            out = (sums[k:] - sums[:-k]) * self.down[which][:n]
            out ^= out >> np.uint64(30)
            out *= _MIX
            out ^= out >> np.uint64(27)
        return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return np.empty(0, values.dtype)
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values
