"""Word shingles as 64-bit hashes, many texts at a time, for numpy code inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

#: Lower-cased runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
SIZE, CACHE = 5, 250_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered within a worker."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, listed: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts in a row, and the words of each text."""
        known, one = self.known, xxhash.xxh64_intdigest
        if len(known) > CACHE:
            known.clear()
        for w in set().union(*listed).difference(known):
            known[w] = one(w)
        lens = np.fromiter(map(len, listed), np.int64, len(listed))
        return np.fromiter(map(known.__getitem__, chain.from_iterable(listed)), np.uint64, int(lens.sum())), lens


def shingle_hashes(hashes: np.ndarray, lens: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in a row, and the shingles of each text.

    A text of one to size-1 words has one shingle, of all its words; a text without words has none.
    """
    n = np.where(lens >= size, lens - size + 1, np.minimum(lens, 1))
    begins = np.cumsum(lens) - lens
    first = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    width = np.repeat(np.minimum(lens, size), n)
    out = np.repeat(np.minimum(lens, size), n).astype(np.uint64)
    padded = np.append(hashes, np.zeros(size, np.uint64))
    for k in range(size):
        out = np.where(width > k, (out ^ padded[first + k]) * _GOLD + (out >> np.uint64(29)), out)
    return mix(out), n


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed)) | np.uint64(1)


def slices(texts: list[str | None], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of about `most` characters, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))
