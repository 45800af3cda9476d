"""Token counts of whole texts; huge ones are encoded as overlapping chunks and spliced.

A byte-level pre-tokenizer scans from left to right and looks at nothing before the place where a
pre-token starts. If the chunk on the left and the chunk on the right both start a pre-token at one
place of their overlap, everything from there on is the same in both, so the left one's tokens before
the place and the right one's from it on are those of the whole text. On the left a place counts only
up to ``margin`` characters before the chunk's end: what the scan looks ahead (a contraction's
letters, the end of a run), and no added token can then reach across it from before.

A text of which some overlap has no common place (one run of letters longer than it) is cut anew with
longer chunks and overlaps, in the end as one chunk. Texts of ordinary length are encoded whole where
they are read and never shuffled; chunks of huge ones are dealt out evenly.

Null texts are empty and have 0 tokens; special strings inside texts are what the library makes of
them; a null id stays null; rows are counted one by one, repeated or not; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assocgrid.llm import links
from assocgrid.llm.tokens import default_tokenizer, portions, slices
from assocgrid.storage import materialize

CHUNK, OVERLAP = 32_768, 1_024  # characters
WIDER = 8  # times as long is the overlap of the next try
LOOK_AHEAD = 4  # characters that the scan may see beyond the end of a pre-token
LIMIT = 512
PLACES = "array<struct<at: long, tokens: long>>"
DIGEST = f"doc_id long, n_bytes long, key string, number int, pieces int, n_tokens long, head {PLACES}, tail {PLACES}"


@lru_cache(maxsize=2)
def library(path: str) -> tuple[Tokenizer, int]:
    """The tokenizer of a worker process and the margin of its splices."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    added = [len(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, max([LOOK_AHEAD, *added])


def cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of the pieces of a text: each goes ``overlap`` characters into the next."""
    begins = range(0, max(1, length - overlap), chunk)
    return [(b, min(length, b + chunk + overlap)) for b in begins]


def boundaries(words: list, offsets: list) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start in a piece (in characters), and how many tokens are before."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.array(words, np.int64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return np.array([offsets[k][0] for k in first], np.int64), first


def seams(tokenizer: Tokenizer, margin: int, piece: str, begin: int, head: int, tail: int) -> tuple[int, list, list]:
    """Tokens of a piece that begins at ``begin``; places of its first ``head`` characters with the tokens
    before them, and of its last ``tail`` characters with the tokens from them on."""
    found = tokenizer.encode(piece, add_special_tokens=False)
    n = len(found)
    at, before = boundaries(found.word_ids, found.offsets)
    heads = [(begin + int(a), int(b)) for a, b in zip(at, before) if a <= head] if head else []
    usable = (at >= len(piece) - tail) & (at <= len(piece) - margin)
    tails = [(begin + int(a), n - int(b)) for a, b in zip(at[usable], before[usable])] if tail else []
    return n, heads, tails


def pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The pieces of ``docs(doc_id, n_bytes, key, text)``, a row each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 8):
            for row in batch.to_pylist():
                places = cuts(len(row["text"]), chunk, overlap)
                for number, (a, b) in enumerate(places):
                    values = [row["doc_id"], row["n_bytes"], row["key"], number, len(places), a, row["text"][a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    names = ["doc_id", "n_bytes", "key", "number", "pieces", "begin", "piece"]
    return docs.select("doc_id", "n_bytes", "key", "text").mapInArrow(cut, "doc_id long, n_bytes long, key string, number int, pieces int, begin long, piece string")


def digests(cut: DataFrame, path: str, overlap: int) -> DataFrame:
    """Token count of each piece and the places at which it can be spliced with its neighbours."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, margin = library(path)
        for batch in portions(batches, 32):
            rows = batch.to_pylist()
            found = []
            for r in rows:
                last = r["number"] == r["pieces"] - 1
                found.append(seams(tokenizer, margin, r["piece"], r["begin"], overlap if r["number"] else 0, 0 if last else overlap))
            lists = [pa.array([[{"at": a, "tokens": n} for a, n in f[side]] for f in found], places) for side in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([f[0] for f in found], pa.int64()), *lists], names=names)

    places = pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))
    names = ["doc_id", "n_bytes", "key", "number", "pieces", "n_tokens", "head", "tail"]
    # round robin: the pieces of one text, or of copies of it, go to all tasks alike
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(tasks).mapInArrow(encoded, DIGEST)


def spliced(found: DataFrame) -> DataFrame:
    """key, n_tokens of every text; NULL where some overlap has no common place."""
    once = found.dropDuplicates(["key", "number"])
    heads = once.select("key", F.col("number").alias("seam"), F.explode("head").alias("p"), F.lit(1).alias("side"))
    tails = once.select("key", (F.col("number") + 1).alias("seam"), F.explode("tail").alias("p"), F.lit(2).alias("side"))
    places = heads.union(tails).groupBy("key", "seam", F.col("p.at").alias("at")).agg(F.sum("side").alias("sides"), F.sum("p.tokens").alias("twice"))
    first = places.filter("sides = 3").groupBy("key", "seam").agg(F.min_by("twice", "at").alias("twice"))
    joined = first.groupBy("key").agg(F.count(F.lit(1)).alias("seams"), F.sum("twice").alias("twice"))
    totals = once.groupBy("key").agg(F.max("pieces").alias("pieces"), F.sum("n_tokens").alias("all"))
    whole = totals.join(joined.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    done = F.coalesce("seams", F.lit(0)) == F.col("pieces") - 1
    return whole.select("key", F.when(done, F.col("all") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))


def huge_counts(spark: SparkSession, huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``huge(doc_id, n_bytes, key, text)``."""
    done, left = None, huge
    while True:
        found = materialize(digests(pieces(left, chunk, overlap), path, overlap), "token-pieces")
        totals = materialize(spliced(found), "token-splices")
        rows = found.filter("number = 0").select("doc_id", "n_bytes", "key")
        counted = rows.join(links.few(totals.filter("n_tokens IS NOT NULL")), "key").select("doc_id", "n_bytes", "n_tokens")
        done = counted if done is None else done.union(counted)
        again = totals.filter("n_tokens IS NULL").select("key")
        if again.isEmpty():
            return done
        left = huge.join(links.few(again), "key", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)  # seams of one piece never meet


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs(doc_id, text)``."""
    path = tokenizer or default_tokenizer()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = library(path)
        for batch in portions(batches):
            texts = batch.column(2).to_pylist()
            sizes = [len(e) for a, b in slices(texts) for e in own.encode_batch_fast(texts[a:b], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    ordinary = rows.filter(F.length("text") <= chunk + overlap).select("doc_id", "n_bytes", "text")
    huge = rows.filter(F.length("text") > chunk + overlap).withColumn("key", F.sha2("text", 256))
    table = ordinary.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").union(huge_counts(spark, huge, path, chunk, overlap))
    return table.withColumn("over_limit", F.col("n_tokens") > limit)
