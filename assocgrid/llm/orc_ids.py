"""Token ids of a corpus as ORC files in ascending document order.

Each row of a file is one document: its id, the number of the range of ids that the file holds, its
place there, its number of ids and the ids themselves. The ORC writer run-length encodes the integers in stripes of
bounded size, with a row index every ``ROW_INDEX`` rows and Bloom filters on ``doc_id``; readers
split files by stripes and skip stripes by their statistics and filters.

Texts are range-partitioned by id before they are encoded, so ids never cross a shuffle. Several
rows of one id stay together and are ordered by their text, in the file and in ``start``. Null texts are empty, null ids come
first, an empty table gives files without rows, and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assocgrid.llm.tokens import END_ID, default_tokenizer, encoder, portions, slices
from assocgrid.storage import materialize, new_path

STRIPE_BYTES = 16 << 20
ROW_INDEX = 1000
BLOOM_FALSE = 0.01
SCHEMA = "doc_id long, range int, place long, n_tokens long, ids array<int>"


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, ranges: int | None = None) -> None:
    """Write ``docs(doc_id, text)`` to the new folder ``path``; each task writes one range of ids."""
    source = tokenizer or default_tokenizer()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in portions(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in slices(texts):
                flat, bounds = encoder(source).encode(texts[a:b], end_id)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))
                places = pa.array(np.arange(place, place + b - a))
                part = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), places, pa.array(np.diff(bounds), pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(part, names=["doc_id", "range", "place", "n_tokens", "ids"])
                place += b - a

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_id = rows.repartitionByRange(ranges, "doc_id") if ranges else rows.repartitionByRange("doc_id")
    ordered = by_id.sortWithinPartitions("doc_id", "text").select("doc_id", F.spark_partition_id().alias("range"), "text")
    (
        ordered.mapInArrow(encoded, SCHEMA)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FALSE)
        .option("orc.compress", "zstd")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The written documents; a list of ids is looked up by stripe statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False))


def starts(counts: DataFrame) -> DataFrame:
    """``counts(doc_id, range, place, n_tokens, ...)`` plus ``start``: tokens of all documents before.

    Ranges are ordered by one total each; rows are ordered within their range only.
    """
    totals = counts.groupBy("range").agg(F.sum("n_tokens").alias("_tokens"))
    earlier = F.sum("_tokens").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(F.col("range").alias("_range"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    within = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    joined = counts.join(offsets, F.col("range") == F.col("_range")).drop("_range")
    start: Column = F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return joined.withColumn("start", start).drop("_before")


def digest(ids: DataFrame) -> DataFrame:
    """doc_id, range, place, n_tokens and the checksum of the ids as little-endian unsigned 32-bit integers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in portions(batches):
            column = batch.column(4)
            flat, at = column.values.to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_numpy()
            sums = [zlib.crc32(flat[at[k] : at[k + 1]].tobytes()) for k in range(len(column))]
            sizes = pa.array(np.diff(at), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, pa.array(sums, pa.int64())], names=["doc_id", "range", "place", "n_tokens", "ids_crc32"])

    return ids.select("doc_id", "range", "place", "n_tokens", "ids").mapInArrow(summed, "doc_id long, range int, place long, n_tokens long, ids_crc32 long")


def encode_corpus(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files to the shared folder, read them back, and return one digest row per document."""
    path = new_path(spark, "token-ids")
    write_ids(docs, path, tokenizer)
    return starts(materialize(digest(read_ids(spark, path)), "token-digests")).select("doc_id", "start", "n_tokens", "ids_crc32")
