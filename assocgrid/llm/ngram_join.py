"""Jaccard self-join of documents on word shingles by prefixes under several global token orders.

Two documents of similarity ``t`` or more share all but a fraction ``1 - t`` of their shingles, so
under ANY global order of the shingles they share one among the first ``n - ceil(t * n) + 1`` of
each, and ``l`` among the first ``n - ceil(t * n) + l``. Three orders are used:

* by hash, with ``l`` a tenth of the set: a document with fewer than ``l`` prefix shingles that any
  other text has too cannot be linked and goes no further;
* rarest first, counted over the documents left, ties by hash: documents that share a prefix
  shingle meet, subject to their sizes and the position of the shingle;
* by order of magnitude of the count, ties by another hash: documents that met must share a prefix
  shingle here too, else they are not verified.

What passes is verified on the whole sets. Texts with equal sets are one class from the start, a node
with a number of its own whatever ids its texts have, and
``links.connect`` finds the groups without listing the pairs inside a group. Counts are partial
aggregates: before the shuffle a task sends a shingle that several of its texts share once only.

Shingles are compared as 64-bit hashes, whole sets as 128-bit ones. Null and blank texts have no
shingles and no links; a row without an id takes no part and has no component; repeated rows are
copies; rows of one id with different texts are documents of their own; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.llm import links
from assocgrid.llm.names import free
from assocgrid.llm.tokens import portions, slices
from assocgrid.llm.words import U, mixed, shingle_sets
from assocgrid.storage import materialize

WIDTH = 5
SIMILARITY = (75, 100)
SPARE = (1, 10)  # of a set: further shared shingles that the hash order asks for


def least_overlap(n: Column | np.ndarray, similarity: tuple[int, int]):
    """Fewest shingles that a set of n shares with any set it is linked to: ceil(t * n)."""
    top, bottom = similarity
    if isinstance(n, np.ndarray):
        return -(-top * n // bottom)
    return F.floor((n * top + (bottom - 1)) / bottom).cast("long")


def spare(n: Column | np.ndarray):
    top, bottom = SPARE
    if isinstance(n, np.ndarray):
        return np.maximum(1, top * n // bottom)
    return F.greatest(F.lit(1), F.floor(n * top / bottom + F.lit(1e-9))).cast("long")


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    low, high = mixed(tokens).sum(dtype=U), mixed(tokens ^ U(0x9E3779B97F4A7C15)).sum(dtype=U)
    return int(low.astype(np.int64)), int((high + U(len(tokens))).astype(np.int64))


def sketches(docs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """One row per document: a checksum of its text, set size and key, and its prefix under the hash order.

    ``tokens`` holds the prefix shingles to be counted, the lowest bit set where the document still
    needs to know; ``known`` counts those that another text of the same batch has been seen to share.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], width)
                n = np.array([len(s) for s in sets], np.int64)
                keys = [set_key(s) for s in sets]
                prefix = np.minimum(n, n - least_overlap(n, similarity) + spare(n))
                first = {key: k for k, key in reversed(list(enumerate(keys)))}
                own = [sets[k][: prefix[k]] | U(1) if first[keys[k]] == k else np.zeros(0, U) for k in range(len(sets))]
                flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
                _, at, inverse, count = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
                several = count[inverse] > 1
                told = np.zeros(len(flat), bool)
                told[at] = True
                known = np.bincount(owner[several], minlength=len(own))
                sent = ~several | told
                value = np.where(several, flat & ~U(1), flat)[sent].view(np.int64)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[sent], minlength=len(own)))]).astype(np.int32)
                columns = [
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array(known, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n", "low", "high", "known", "tokens"])

    schema = "doc_id long, mark string, n long, low long, high long, known long, tokens array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_mark().alias("mark")).mapInArrow(rows, schema)


def text_mark() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def shared_counts(rows: DataFrame) -> DataFrame:
    """low, shared: partial counts of a set's prefix shingles that another set has too.

    A shingle's rows follow each other in one sorted partition; a task of ``sketches`` sends at most
    one row per batch for a shingle that many texts share.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def counts(value: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
            token = value >> 1
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            differ = np.minimum.reduceat(low, starts) != np.maximum.reduceat(low, starts)
            asks = np.repeat(differ, np.diff(np.concatenate([starts, [len(token)]]))) & (value & 1 == 1)
            sets, many = np.unique(low[asks], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(sets), pa.array(many.astype(np.int64))], names=["low", "shared"])

        for batch in batches:
            value, low = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            if not len(value):
                continue
            cut = int(np.searchsorted(value >> 1, value[-1] >> 1))  # the last shingle may go on
            held = (value[cut:], low[cut:])
            if cut:
                yield counts(value[:cut], low[:cut])
        if len(held[0]):
            yield counts(*held)

    tokens = rows.select(F.explode("tokens").alias("value"), "low")
    return tokens.repartition(F.shiftright("value", 1)).sortWithinPartitions("value").mapInArrow(counted, "low long, shared long")


def shingled(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n, tokens of the sets of ``wanted(node, least, low, high)``; ``least`` is a document that has the set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], width)
                keys = [set_key(s) for s in sets]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets).view(np.int64)))
                columns = [batch.column(0).slice(a, b - a), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["least", "low", "high", "tokens"])

    ids = links.few(wanted.select(F.col("least").alias("_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text")).join(ids, F.col("_doc") == F.col("_id"), "left_semi")
    sets = texts.mapInArrow(rows, "least long, low long, high long, tokens array<long>")
    named = sets.join(wanted.select("node", "least", "low", "high"), ["least", "low", "high"]).dropDuplicates(["node"])
    return named.select("node", F.size("tokens").cast("long").alias("n"), "tokens")


def prefixes(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """node, n, rare (shingles of the rarest-first prefix with their positions) and other (those of the third order)."""
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_df")).filter(F.col("_df") > 1).select(F.col("token").alias("_token"), "_df")
    shared = tokens.join(counts, F.col("token") == F.col("_token")).groupBy("node", "n").agg(F.collect_list(F.struct("_df", "token")).alias("s"))
    # shingles of no other set come first in both rare-first orders
    alone = F.col("n") - F.size("s")
    length = (F.col("n") - least_overlap(F.col("n"), similarity) + 1 - alone).cast("int")
    by_count = F.transform(F.slice(F.sort_array("s"), F.lit(1), length), lambda x, i: F.struct(x["token"].alias("key"), (i + alone).cast("long").alias("at")))
    scale = F.transform("s", lambda x: F.struct(F.floor(F.log2(x["_df"])).alias("m"), F.xxhash64(x["token"]).alias("h"), x["token"].alias("t")))
    by_scale = F.transform(F.slice(F.sort_array(scale), F.lit(1), length), lambda x: x["t"])
    return shared.filter(length > 0).select("node", "n", by_count.alias("rare"), by_scale.alias("other"))


def placed_rows(spark: SparkSession, docs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, mark, n and component_id of every row, and the name of its component: a number, NULL without links."""
    rows = materialize(sketches(docs, width, similarity), "sketches")
    useful = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = useful.groupBy("low", "high").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))
    # numbered once, as written, in the order of the ids: the hub of near copies is then their oldest text
    ordered = classes.repartitionByRange("least", "low", "high").sortWithinPartitions("least", "low", "high")
    classes = materialize(ordered.withColumn("node", F.monotonically_increasing_id()), "classes")
    counts = shared_counts(useful.select("tokens", "low")).union(useful.filter(F.col("known") > 0).select("low", F.col("known").alias("shared")))
    counts = counts.groupBy(F.col("low").alias("_low")).agg(F.sum("shared").alias("shared"))
    wanted = classes.join(counts, F.col("low") == F.col("_low")).filter(F.col("shared") >= spare(F.col("n"))).select("node", "least", "low", "high")
    sets = materialize(shingled(docs, materialize(wanted, "wanted"), width), "sets")
    prefix = materialize(prefixes(sets, similarity), "prefixes")
    top, bottom = similarity

    def possible(x, y) -> Column:
        """Sizes, and what two sets can still share from the positions of a common shingle on."""
        both = F.least(x("n") - x("at"), y("n") - y("at"))
        return (x("n") * bottom >= y("n") * top) & (y("n") * bottom >= x("n") * top) & (both * (top + bottom) >= (x("n") + y("n")) * top)

    def verify(pairs: DataFrame) -> DataFrame:
        def side(c: str, table: DataFrame, *columns: str) -> DataFrame:
            return table.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])

        met = pairs.join(side("a", prefix, "other"), "a").join(side("b", prefix, "other"), "b").filter(F.arrays_overlap("other_a", "other_b")).select("a", "b")
        both = met.join(side("a", sets, "n", "tokens"), "a").join(side("b", sets, "n", "tokens"), "b")
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return both.filter(common * bottom >= (F.col("n_a") + F.col("n_b") - common) * top).select("a", "b").distinct()

    meetings = materialize(prefix.select("node", "n", F.explode("rare").alias("r")).select(F.col("r.key").alias("key"), "node", "n", F.col("r.at").alias("at")), "meetings")
    found = links.connect(spark, meetings, verify, possible, ["n", "at"])
    linked = materialize(classes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").drop("_node"), "class-groups")
    least = linked.filter(F.col("component").isNotNull()).groupBy(F.col("component").alias("_group")).agg(F.min("least").alias("_least"))
    together = linked.join(links.few(materialize(least, "group-ids")), F.col("component") == F.col("_group"), "left")
    placed = together.select("low", "high", F.coalesce("component", "node").alias("group"), F.coalesce("_least", "least").alias("component_id"))
    joined = rows.alias("r").join(placed.alias("p"), (F.col("r.low") == F.col("p.low")) & (F.col("r.high") == F.col("p.high")) & F.col("r.doc_id").isNotNull() & (F.col("r.n") > 0), "left")
    return joined.select("doc_id", "mark", "n", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def groups(spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links reach, of every row."""
    return placed_rows(spark, docs, width, similarity).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def distinct_documents(spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: the smallest id, of its texts the one of the smallest checksum.

    Rows without shingles are linked with nothing and stay, repeated ones once; rows without an id stay.
    """
    placed = materialize(placed_rows(spark, docs, width, similarity).filter(F.col("doc_id").isNotNull()), "placed")
    own = F.struct("doc_id", "mark")
    first = placed.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min(own).alias("first")).select("first.doc_id", "first.mark")
    kept = first.union(placed.filter(F.col("group").isNull()).select("doc_id", "mark")).distinct()
    doc, mark = free(docs.columns, "_doc", "_mark")
    named = docs.filter(F.col("doc_id").isNotNull()).withColumns({doc: F.col("doc_id").cast("long"), mark: text_mark()})
    chosen = kept.select(F.col("doc_id").alias(doc), F.col("mark").alias(mark))
    return named.join(chosen, [doc, mark], "left_semi").dropDuplicates([doc, mark]).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(F.col("doc_id").isNull()))
