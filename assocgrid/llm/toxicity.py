"""Toxicity by compression distance under two zstandard dictionaries.

Training keeps the words that mark toxic text: those with many distinct contexts in toxic documents
and few in ordinary ones, so that copies of one document count once. One dictionary is trained on
ordinary windows, another on the marking words in their order in toxic text. A window of ``WORDS``
words is compressed once after the ordinary dictionary and once after both; what the toxic one saves
is the window's score in bytes. A document's largest savings, with their shares and the number of its
windows, go through a logistic scale calibrated on training documents that no dictionary has seen.

Short matches are switched off in both compressors, so that chance likeness of ordinary words saves
nothing. Labels are learnt from a bounded sample of rows that are not held out; every document is
scored on its whole text. Null and empty texts have no windows and the score of no savings; without
labels of both classes every score is the share of toxic labels; repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assocgrid.llm import folds
from assocgrid.llm.tokens import portions

WORDS, STEP = 8, 4
ORDINARY_BYTES, TOXIC_BYTES = 16384, 16384
PER_CLASS, LONGEST = 2_000, 50_000  # bounds of the training sample: documents of each class, characters of a document
WINDOWS = 60_000  # of the ordinary dictionary's training
LEAST_CONTEXTS, CONTRAST = 4, 10
LEAST_MATCH = 6
SHARE = 1 / 2  # of the sample for the dictionaries; the rest calibrates
SAVINGS = (2, 4, 6, 8)  # bytes from which windows are counted


def windows(text: str, words: int = WORDS, step: int = STEP) -> list[bytes]:
    own = text.encode("utf-8", "surrogatepass").lower().split()
    return [b" " + b" ".join(own[k : k + words]) + b" " for k in range(0, max(1, len(own) - words + step), step)] if own else []


def contexts(texts: Sequence[str]) -> Counter:
    """Number of distinct preceding words of each word."""
    pairs: set[tuple[bytes, bytes]] = set()
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").lower().split()
        pairs.update(zip(own, [b"", *own[:-1]], strict=True))
    return Counter(word for word, _ in pairs)


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary's content; the samples themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8, level=9).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    constant: float | None = None

    def compressors(self):
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=LEAST_MATCH, strategy=zstandard.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):  # ordinary matches keep their distance
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress)
        return out

    def facts(self, texts: Sequence[str]) -> np.ndarray:
        """Savings of each text: the largest, sums of the 3 and 10 largest, log of the number of windows, and
        for each bound in SAVINGS the log of the number and the share of windows that save so much."""
        plain, both = self.compressors()
        rows = np.zeros((len(texts), 4 + 2 * len(SAVINGS)))
        for k, text in enumerate(texts):
            own = windows(text)
            saved = np.sort(np.fromiter((len(plain(w)) - len(both(w)) for w in own), np.int64, len(own)))[::-1]
            if len(saved):
                many = [int((saved >= s).sum()) for s in SAVINGS]
                rows[k] = [saved[0], saved[:3].sum(), saved[:10].sum(), np.log1p(len(saved)), *np.log1p(many), *(m / len(saved) for m in many)]
        return rows

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = self.facts(texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the constant first, by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale])


def fit(rows: Sequence[tuple[str, int]], negatives: int, positives: int) -> Model:
    """The model from sampled (text, label) rows and the numbers of both labels among all."""
    ordinary, toxic = [t for t, y in rows if y == 0], [t for t, y in rows if y == 1]
    if min(len(ordinary), len(toxic)) < 3:
        return Model(b"", b"", [], positives / max(1, positives + negatives))
    a, b = int(len(ordinary) * SHARE), int(len(toxic) * SHARE)
    plain, marked = contexts(ordinary[:a]), contexts(toxic[:b])
    ratio = b / a
    words = {w for w, n in marked.items() if n >= LEAST_CONTEXTS and n > CONTRAST * (plain[w] + 1) * min(1.0, ratio)}
    samples = []
    for text in toxic[:b]:
        own = [w for w in text.encode("utf-8", "surrogatepass").lower().split() if not words or w in words]
        samples += [b" " + b" ".join(own[k : k + WORDS]) + b" " for k in range(0, len(own), WORDS)]
    usual = [w for t in ordinary[:a] for w in windows(t, WORDS, WORDS)]
    usual = usual[:: -(-len(usual) // WINDOWS)] if usual else [b" "]
    model = Model(trained(usual, ORDINARY_BYTES, 32), trained(samples or [b" "], TOXIC_BYTES, 32), [])
    rest = [*ordinary[a:], *toxic[b:]]
    y = np.array([0] * (len(ordinary) - a) + [1] * (len(toxic) - b), float)
    w = logistic(model.facts(rest), y)
    # from the balance of the sample to that of all labels
    w[0] += np.log(max(positives, 1) / max(negatives, 1)) - np.log(y.sum() / (len(y) - y.sum()))
    model.weights = w.tolist()
    return model


def learned(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    chosen = folds.sample(docs.select("doc_id", "text"), labels, "toxic", per_class, longest, per_class=True)
    rows = sorted(((r["_label"], r["_id"], r["text"] or "") for r in chosen.select("_label", "_id", "text").collect()), key=lambda r: (hash_order(r[1]), r))
    return fit([(text, label) for label, _, text in rows], *folds.rates(labels, "toxic"))


def hash_order(doc_id: int) -> int:
    import zlib

    return zlib.crc32(f"order {doc_id}".encode())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            scores = model.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    table = scored(docs, learned(docs, labels))
    return table.select("doc_id", folds.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
