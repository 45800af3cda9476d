"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words hashed into ``BUCKETS`` with damped, length-normalised
counts, statistics of its form, and its recorded length against its text. The score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so all pairwise interactions cost time linear in the features. Weights are learnt by Adagrad from a
bounded sample of labelled rows that are not held out: tasks extract the features, the driver gets
those of the sample only. Every document is scored on its whole text.

Null and empty texts have form statistics only; a missing or null ``n_chars`` counts as the text's
length; without labels of both classes every score is the share of positive labels; repeated rows
score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assocgrid.llm import folds
from assocgrid.llm.quality_rules import COUNTS, measures, text_counts
from assocgrid.llm.tokens import portions, slices
from assocgrid.llm.words import U, word_hashes, words

BUCKETS = 1 << 16
FACTORS = 8
ROWS, LONGEST = 8_000, 200_000  # bounds of the training sample: documents, characters of a document
EPOCHS, BATCH, RATE, RIDGE = 12, 128, 0.08, 1e-4


def form(text: str, n_chars: int | None) -> list[float]:
    """Statistics of form and metadata, each about -1 to 1."""
    counts = text_counts(text)
    m = {k: float(v) for k, v in measures([np.float64(c) for c in counts]).items()}
    length = len(text)
    return [
        np.log1p(m["words"]) / 5 - 1, m["word_length"] / 8 - 1, min(1.0, 3 * m["symbols_per_word"]), min(1.0, m["repeated_lines"]), m["repeated_words"],
        np.log1p(m["words_per_line"]) / 4 - 1, m["upper_share"], min(1.0, 10 * m["digit_share"]), m["distinct_words"], counts[5] > 3,
        np.log1p(length if n_chars is None else max(0, n_chars)) / 8 - 1, float(n_chars is not None and n_chars != length),
    ]


FORM = 12


def features(texts: Sequence[str], lengths: Sequence[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, indices and values of the sparse vectors, the form statistics behind the words."""
    flat, counts = word_hashes([words(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), counts)
    key, many = np.unique(row.astype(U) * U(BUCKETS) + flat % U(BUCKETS), return_counts=True)
    row, index, value = (key // U(BUCKETS)).astype(np.int64), (key % U(BUCKETS)).astype(np.int64), 1 + np.log(many)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(texts)))
    value = value / np.maximum(norm, 1e-9)[row]
    extra = np.array([form(t, n) for t, n in zip(texts, lengths, strict=True)], float).reshape(-1, FORM)
    row = np.concatenate([row, np.repeat(np.arange(len(texts)), FORM)])
    index = np.concatenate([index, np.tile(np.arange(BUCKETS, BUCKETS + FORM), len(texts))])
    value = np.concatenate([value, extra.ravel()])
    order = np.argsort(row, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
    return bounds, index[order], value[order]


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    constant: float | None = None

    def margins(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = bounds[:-1]
        vx = self.v[index] * value[:, None]
        total, squares = np.add.reduceat(vx, at), np.add.reduceat(vx * vx, at)
        return self.w0 + np.add.reduceat(self.w[index] * value, at) + 0.5 * (total * total - squares).sum(1)

    def scores(self, texts: Sequence[str], lengths: Sequence[int | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(texts, lengths)), -40, 40)))


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], factors: int = FACTORS, seed: int = 3) -> Machine:
    """The machine from sampled (indices, values, label) rows."""
    y = np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Machine(0, np.zeros(0), np.zeros((0, 0)), float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    size = BUCKETS + FORM
    m = Machine(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(size), rng.normal(0, 0.02, (size, factors)))
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, factors), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            sizes = np.array([len(rows[i][0]) for i in own])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index, value = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            vx = m.v[index] * value[:, None]
            total = np.add.reduceat(vx, at)
            margin = m.w0 + np.add.reduceat(m.w[index] * value, at) + 0.5 * (total * total - np.add.reduceat(vx * vx, at)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[own]) / len(own)
            e = np.repeat(error, sizes)[:, None]
            seen, place = np.unique(index, return_inverse=True)
            dw, dv = np.zeros(len(seen)), np.zeros((len(seen), factors))
            np.add.at(dw, place, e[:, 0] * value)
            np.add.at(dv, place, e * value[:, None] * (np.repeat(total, sizes, axis=0) - vx))
            dw, dv = dw + RIDGE * m.w[seen], dv + RIDGE * m.v[seen]
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            m.w[seen] -= RATE * dw / np.sqrt(gw[seen])
            m.v[seen] -= RATE * dv / np.sqrt(gv[seen])
            g0 += float(error.sum()) ** 2
            m.w0 -= RATE * float(error.sum()) / np.sqrt(g0)
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def _inputs(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), length.alias("n_chars"))


def learned(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> Machine:
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            bounds, index, value = features([t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist())
            lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(3)], names=["doc_id", "index", "value", "label"])

    chosen = folds.sample(_inputs(docs), labels, "quality", rows, longest).select("doc_id", "text", "n_chars", F.col("_label").alias("label"))
    table = chosen.mapInArrow(extracted, "doc_id long, index array<int>, value array<float>, label int").toArrow()
    table = table.sort_by([("doc_id", "ascending")])
    columns = [table.column(k).combine_chunks() for k in range(4)]
    found = [(columns[1][k].values.to_numpy(), columns[2][k].values.to_numpy(), columns[3][k].as_py()) for k in range(len(table))]
    return fit(found)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    machine = learned(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts, lengths = [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
            for a, b in slices(texts):
                scores = machine.scores(texts[a:b], lengths[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores.astype(float), pa.float64())], names=["doc_id", "score"])

    table = _inputs(docs).mapInArrow(rows, "doc_id long, score double")
    return table.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
