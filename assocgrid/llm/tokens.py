"""Token ids of whole texts with the ``tokenizers`` library, chunk by chunk from a cache.

A byte-level pre-tokenizer never joins a character other than a white space with a white space that
follows it, nor a letter with a point or comma behind it, so a text cut there encodes to the
concatenation of its chunks. Each distinct chunk is encoded once per worker by the library; a text
with other white space, or with an added token such as an end mark, is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
CHUNK = re.compile(rf" ?[{LETTERS}]++(?=[.,])|[ \n]*[^ \n]+|[ \n]+")
ONE_WORD = re.compile(rf" ?[{LETTERS}]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
CACHED_CHUNKS = 300_000  # of a worker; at the bound all but the first third, the common ones, are forgotten
END_ID = 0


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Chunks(dict):
    """Chunk -> number; chunks not met before are numbered and listed as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class Encoder:
    def __init__(self, path: str, cached: int = CACHED_CHUNKS) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.letters = byte_letters()
        self.cached = cached
        self.number = Chunks()
        self.first = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.known = self.used = 0

    def forget(self) -> None:
        """Drop the chunks learnt last; those met first are the common ones."""
        self.known = self.cached // 3
        self.used = int(self.first[self.known])
        for chunk in list(self.number)[self.known :]:
            del self.number[chunk]

    def chunk_ids(self, chunk: str) -> list[int]:
        if ONE_WORD.fullmatch(chunk):  # one word is one run of the merges
            return [t.id for t in self.tokenizer.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def learn(self, found: list[list[int]], odd: list[bool]) -> None:
        """Add the ids of the next numbers; an odd chunk has size -1."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        end, used = self.known + len(found), self.used + int(sizes.sum())
        self.first, self.size, self.flat = _room(self.first, end), _room(self.size, end), _room(self.flat, used)
        self.first[self.known : end] = self.used + np.cumsum(sizes) - sizes
        self.size[self.known : end] = np.where(odd, -1, sizes)
        self.flat[self.used : used] = np.fromiter(chain.from_iterable(found), np.uint32, used - self.used)
        self.known, self.used = end, used

    def encode(self, texts: Sequence[str], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array and the n + 1 positions where the texts begin and end."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.number) > self.cached:
            self.forget()
        lists = [CHUNK.findall(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        if new := self.number.new:
            self.learn([self.chunk_ids(c) for c in new], [bool(OTHER_SPACE.search(c)) for c in new])
            new.clear()
        sizes = self.size[codes]
        owner = np.repeat(np.arange(len(texts)), counts)
        odd = set(np.unique(owner[sizes < 0]).tolist()) | {k for k, t in enumerate(texts) if any(a in t for a in self.added)}
        held = np.bincount(owner, weights=np.maximum(sizes, 0), minlength=len(texts)).astype(np.int64)
        tail = [] if end is None else [np.array([end], np.uint32)]
        parts = []
        for k, own in enumerate(np.split(self.ids(codes, sizes), np.cumsum(held)[:-1])):
            if k in odd:  # the library cuts the whole text
                own = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            parts += [own, *tail]
            held[k] = len(own) + len(tail)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(held)])

    def ids(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        held = np.maximum(sizes, 0)
        before = np.cumsum(held) - held
        return self.flat[np.repeat(self.first[codes] - before, held) + np.arange(int(held.sum()))]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def portions(batches: Iterator, rows: int = 512) -> Iterator:
    """Record batches cut into smaller ones, so that few rows at a time become Python objects."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def slices(texts: Sequence[str], characters: int = 2_000_000):
    """Ranges of texts of about so many characters each, at least one text."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > characters:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
