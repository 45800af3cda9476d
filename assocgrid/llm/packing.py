"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

Attention over a piece of ``l`` tokens costs ``linear * l + quadratic * l * l``. A document is cut
into full pieces, each a sequence of its own, and a remainder. Remainders are taken in descending
order; each goes to the sequence of lowest cost that has room for it, and is cut only when none has.
A window has exactly as many open sequences as its remainders need, so at most one sequence of a
window has padding.

Windows are runs of documents of one input partition, bounded in documents and tokens. There is no
shuffle: a lost task is repeated from its input split with the same result.

Null texts are empty; an empty document is one end id. A repeated row is packed again as a document
of its own, a null id stays null, an empty table gives no rows, and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assocgrid.llm.tokens import END_ID, default_tokenizer, encoder, portions, slices

LENGTH = 1024
WINDOW_DOCUMENTS = 4096
WINDOW_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long"


def plan(totals: np.ndarray, length: int = LENGTH, linear: float = 1.0, quadratic: float = 1 / LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of so many tokens."""
    out, sequence = [], 0
    for d in np.flatnonzero(totals >= length):
        for start in range(0, int(totals[d]) // length * length, length):
            out.append((int(d), start, length, sequence, 0))
            sequence += 1
    rest = totals % length
    room = np.full(-(-int(rest.sum()) // length), length, np.int64)
    cost = np.zeros(len(room))
    for d in np.argsort(-rest, kind="stable"):
        left, start = int(rest[d]), int(totals[d] - rest[d])
        while left:
            fits = room >= left
            if fits.any():
                s = int(np.argmin(np.where(fits, cost, np.inf)))
                take = left
            else:  # no sequence has room for all of it
                s = int(np.argmax(room))
                take = int(room[s])
            out.append((int(d), start, take, sequence + s, length - int(room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            left, start = left - take, start + take
    return out


def pack(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID,
    linear: float = 1.0, quadratic: float = 1 / LENGTH, window_documents: int = WINDOW_DOCUMENTS, window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``; ``ids`` holds its ids, little-endian unsigned 32-bit."""
    path = tokenizer or default_tokenizer()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        names: list = []
        held: list[np.ndarray] = []
        total = 0
        for batch in portions(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                flat, bounds = encoder(path).encode(texts[a:b], end_id)
                for k in range(b - a):
                    names.append(ids[a + k])
                    held.append(flat[bounds[k] : bounds[k + 1]])
                    total += len(held[-1])
                    if len(names) >= window_documents or total >= window_tokens:
                        yield names, held
                        names, held, total = [], [], 0
        if names:
            yield names, held

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for names, held in windows(batches):
            pieces = plan(np.array([len(x) for x in held], np.int64), length, linear, quadratic)
            columns = [
                pa.array([names[p[0]] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([held[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces], pa.binary()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([len(held[p[0]]) for p in pieces], pa.int64()),
                pa.array([first + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            first += max(p[3] for p in pieces) + 1
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
