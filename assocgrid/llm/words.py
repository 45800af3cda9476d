"""Words and hashed word shingles of texts, as numpy arrays.

A word is a run of characters other than the ASCII white space 0x20 and 0x09-0x0D; ``bytes.split``
cuts there, and ``bytes.lower`` folds A-Z only.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from itertools import chain

import numpy as np
import xxhash

U = np.uint64
CACHED_WORDS = 150_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


HASHES = WordHashes()


def words(text: str, lower: bool = True) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(lists: Sequence[Collection[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and the number of words of each list."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(map(HASHES.__getitem__, chain.from_iterable(lists)), U, int(counts.sum())), counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One value per run of ``width`` successive hashes."""
    if len(hashes) < width:
        return np.zeros(0, U)
    out = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        out = mixed(out) + hashes[k : len(hashes) - width + 1 + k]
    return mixed(out)


def shingle_sets(texts: Sequence[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as 64-bit hashes.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    lists = [words(t) for t in texts]
    flat, counts = word_hashes(lists)
    every = window_hashes(flat, width)
    out, start = [], 0
    for own, n in zip(lists, counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(every[start : start + n - width + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(own), n)] if n else [], U))
        start += n
    return out
