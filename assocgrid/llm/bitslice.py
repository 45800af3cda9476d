"""Exact top-k inner products from a bit-sliced index.

Components are quantised to integers. The index cuts the rows into blocks of ``BLOCK`` and keeps,
for each component and each bit of its value above the block's least, one bitmap over the rows.
A query adds the bitmaps, shifted by the bits of its own components, with full adders that take
three bitmaps of one weight to one of that weight and one of the next; a negative component adds
complements and a constant. The sums are bitmaps again: the best rows are found by walking from the
most significant slice downward, keeping the rows that must be in and those still tied; ties at the
boundary go to the smallest id. A query's best rows of all blocks are merged at the end.

Blocks of rows meet blocks of queries by an equi-join on the row block's number; few row blocks are
dealt to several tasks each, with a share of the queries. Vectors that are null or hold a null or
non-finite component take no part, nor do rows without an id; a shorter vector counts as zero in the
components it lacks; rows of a repeated id are candidates each, and one query (of the least vector);
an empty table gives no rows; further columns are ignored. A row is no candidate of a query of its
own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assocgrid.storage import materialize

BLOCK = 16384
QUERY_BLOCK = 128
SCALE = 256
EVERY = 50
K = 5
U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)

INDEX = "block long, ids array<long>, least long, bits int, dims int, slices binary"
HITS = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and the integer components of the usable vectors."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    named = vectors.filter(F.col("vec_id").cast("long").isNotNull())
    return named.filter(usable(F.col("embedding").cast("array<double>"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.ListArray, dims: int | None = None) -> np.ndarray:
    """The rows of a list column, filled with zeros to the longest."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(int(lengths.max(initial=0)), dims or 0)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def sliced(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Least value, number of bits, and the bitmaps [component, bit, word] of a block of rows."""
    least = int(values.min(initial=0))
    bits = max(1, (int(values.max(initial=0)) - least).bit_length())
    raised = (values - least).astype(U)
    words = -(-len(values) // 64)
    out = np.zeros((values.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        plane = ((raised >> U(b)) & U(1)).astype(np.uint8)
        out[:, b, : -(-len(values) // 8)] = np.packbits(plane.T, axis=1, bitorder="little")
    return least, bits, out.view(U)


def build_index(vectors: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """One row per block of rows; blocks are runs of the rows of one partition."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block_row(rows: pa.Table) -> pa.RecordBatch:
            values = matrix(rows.column(1).combine_chunks())
            least, bits, slices = sliced(values)
            columns = [[number], [rows.column(0).to_pylist()], [least], [bits], [values.shape[1]], [slices.tobytes()]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "ids", "least", "bits", "dims", "slices"])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= block:
                rows = pa.Table.from_batches(held)
                yield block_row(rows.slice(0, block))
                number += 1
                held = rows.slice(block).to_batches()
        if sum(map(len, held)):
            yield block_row(pa.Table.from_batches(held))

    return quantised(vectors, scale).mapInArrow(blocks, INDEX)


def added(planes: dict[int, list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Sum of bitmaps by weight as one bitmap per bit, in ``width`` bits; planes[w] holds [m, words] arrays."""
    out = []
    carry: list[np.ndarray] = []
    for w in range(width):
        group = [*planes.get(w, []), *carry]
        carry = []
        stack = np.concatenate(group) if group else np.zeros((0, 0), U)
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carry.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            else:
                a, b = stack
                carry.append((a & b)[None])
                stack = (a ^ b)[None]
        out.append(stack[0] if len(stack) else None)
    return out


def query_slices(query: np.ndarray, bits: int, least: int, slices: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps of each row's inner product with the query less a constant, and the constant."""
    dims, words = min(len(query), slices.shape[0]), slices.shape[2]
    planes: dict[int, list[np.ndarray]] = {}
    constant = least * int(query[:dims].sum())
    positive, size = query[:dims] > 0, np.abs(query[:dims])
    constant -= int(size[~positive].sum()) * ((1 << bits) - 1)
    for a in range(int(size.max(initial=0)).bit_length()):
        has = (size >> a) & 1 == 1
        for b in range(bits):
            for own, rows in ((has & positive, False), (has & ~positive, True)):
                if own.any():
                    part = slices[:dims][own][:, b]
                    planes.setdefault(a + b, []).append(part ^ FULL if rows else part)
    width = max(1, int(int(size.sum()) * ((1 << bits) - 1)).bit_length())
    zero = np.zeros(words, U)
    return [zero if p is None else p for p in added(planes, width)], constant


def rows_of(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def best(slices: list[np.ndarray], alive: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are among the k best for certain, and rows tied at the boundary."""
    sure, tied, need = np.zeros_like(alive), alive, k
    if int(np.bitwise_count(alive).sum()) <= k:
        return rows_of(alive, n), np.zeros(0, np.int64)
    for plane in reversed(slices):
        high = tied & plane
        count = int(np.bitwise_count(high).sum())
        if count >= need:
            tied = high
        else:
            sure, tied, need = sure | high, tied & ~plane, need - count
        if not need:
            return rows_of(sure, n), np.zeros(0, np.int64)
    return rows_of(sure, n), rows_of(tied, n)


def search_block(queries: np.ndarray, query_ids: list, ids: np.ndarray, least: int, bits: int, slices: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of each query's k best rows of one block."""
    n, words = len(ids), slices.shape[2]
    everyone = np.zeros(words * 64, np.uint8)
    everyone[:n] = 1
    everyone = np.packbits(everyone, bitorder="little").view(U)
    out = []
    for q, query in zip(query_ids, queries, strict=True):
        planes, constant = query_slices(query, bits, least, slices)
        alive = everyone
        own = np.flatnonzero(ids == q)
        if len(own):
            alive = everyone.copy()
            np.bitwise_and.at(alive, own // 64, ~(U(1) << (own % 64).astype(U)))
        sure, tied = best(planes, alive, n, k)
        tied = tied[np.argsort(ids[tied], kind="stable")][: k - len(sure)]
        for row in [*sure, *tied]:
            score = sum(((int(p[row // 64]) >> int(row % 64)) & 1) << w for w, p in enumerate(planes))
            out.append((q, int(ids[row]), score + constant))
    return out


def in_order(index: DataFrame) -> tuple[DataFrame, int]:
    """The blocks numbered from 0 without gaps (``_block``), and how many there are.

    A block's name holds its task above 32 bits and its turn there below; only the tasks' totals are summed up.
    """
    task, turn = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    counts = index.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select("_task", "_n", before.alias("_before")), "row-blocks")
    total = offsets.agg(F.sum("_n")).first()[0] or 0
    named = index.withColumn("_task", task).join(offsets.select("_task", "_before"), "_task")
    return named.withColumn("_block", F.col("_before") + turn).drop("_task", "_before"), total


def search(index: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of the index for ``queries(vec_id, v)``."""
    blocks = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = blocks.withColumn("_part", F.spark_partition_id()).withColumn("_turn", F.floor(F.monotonically_increasing_id() / query_block))
    # written once: a task that is repeated must not deal the queries out anew
    packed = materialize(blocks.groupBy("_part", "_turn").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries")), "query-blocks")
    # as many tasks as the session has shuffle partitions: the rows are few, but each is much work
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered, total = in_order(index)
    deals = max(1, -(-2 * tasks // max(1, total)))
    # a stated query set against all rows, block by block: every query block is sent to every row block
    share = F.pmod(F.xxhash64("_part", "_turn"), F.lit(deals)).cast("int").alias("_deal")
    sent = packed.select("queries", share, F.explode(F.sequence(F.lit(0), F.lit(total - 1).cast("long"))).alias("_block")) if total else packed.select("queries", share, F.lit(0).cast("long").alias("_block"))
    rows = numbered.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    met = sent.repartition(tasks, "_block", "_deal").join(rows.repartition(tasks, "_block", "_deal"), ["_block", "_deal"])
    met = met.select("queries", "ids", "least", "bits", "dims", "slices")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                asked = batch.column(0)[row].values
                query_ids, vectors = asked.field(0).to_pylist(), matrix(asked.field(1))
                dims, bits = batch.column(4)[row].as_py(), batch.column(3)[row].as_py()
                ids = batch.column(1)[row].values.to_numpy()
                slices = np.frombuffer(batch.column(5)[row].as_py(), U).reshape(dims, bits, -1)
                found = search_block(vectors, query_ids, ids, batch.column(2)[row].as_py(), bits, slices, k)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(hits, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(spark: SparkSession, vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The k best other rows for every row whose id is divisible by ``every``."""
    index = materialize(build_index(vectors, scale, block), "slices")
    return search(index, quantised(vectors.filter(F.col("vec_id") % every == 0), scale), k)
