"""Hashed word and character n-gram features of words, for many words at a time."""

from __future__ import annotations

import numpy as np

_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def subword_features(words: list[str], bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers below 2**bits of all words one after another, how many each word has).

    A word between boundary marks has one feature for each of its n-grams of ``least`` to ``most``
    characters, and one for the whole.
    """
    marked = [f"\x02{w}\x03" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(code))
    features, owners = [], []
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(code), np.uint64)
        for n in range(1, most + 1):
            fits = place + n <= ends
            rolling = rolling[: len(code) - n + 1] * _STEP + code[n - 1 :]
            if n >= least:
                ok = fits[: len(rolling)]
                features.append(rolling[ok] + np.uint64(n))
                owners.append(word[: len(rolling)][ok])
        whole = code * (place.astype(np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64) + _MIX) * _STEP
        whole ^= whole >> np.uint64(29)
        features.append(np.add.reduceat(whole * _MIX, np.cumsum(sizes) - sizes) if len(words) else np.empty(0, np.uint64))
        owners.append(np.arange(len(words)))
        flat, owner = np.concatenate(features), np.concatenate(owners)
        flat = (flat ^ (flat >> np.uint64(31))) * _MIX
        flat = ((flat ^ (flat >> np.uint64(29))) * _MIX) >> np.uint64(64 - bits)
    order = np.argsort(owner, kind="stable")
    return flat[order].astype(np.int64), np.bincount(owner, minlength=len(words))


class WordTable:
    """Numbers words and keeps, for each, what ``describe`` says of new ones; forgets all beyond a bound."""

    REMEMBER, BLOCK = 400_000, 1 << 15

    def __init__(self, describe) -> None:
        self.describe = describe  # list of words -> array with a row for each
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = self.describe([])
        self.used = 0

    def learn(self, documents: list[list[str]]) -> None:
        if len(self.number) > self.REMEMBER:
            self.forget()
        new = list({w for words in documents for w in words if w not in self.number})
        for k in range(0, len(new), self.BLOCK):
            part = new[k : k + self.BLOCK]
            more = self.describe(part)
            if self.used + len(part) > len(self.rows):
                grown = np.zeros((2 * (self.used + len(part)), *more.shape[1:]), more.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : self.used + len(part)] = more
            self.number.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def numbers(self, words) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def in_portions(texts: list[str], split, chars: int = 1_000_000):
    """Lists of split texts, each of about so many characters."""
    k = 0
    while k < len(texts):
        some, n = [], 0
        while k < len(texts) and (not some or n + len(texts[k]) < chars):
            some.append(split(texts[k]))
            n += len(texts[k])
            k += 1
        yield some
