"""Mixing sources to target weights by weighted fair queueing.

Every document of a source queues in shuffled order; its virtual finish time is the number of words
of its source up to and including itself, divided by the source's target. All sources reach time 1
exactly when each has given its target, so the mix is the time-sorted queue up to the total budget.
A source whose target exceeds its size queues again behind itself, up to ``max_repeats`` times.

Only DataFrame functions are used. Running sums are taken inside slices of bounded width (a source's
shuffle order, and the time axis) and carried between slices by one total each, so a source or a
stretch of time of any size is spread over many tasks. One row per source is ordered in one task.
The shuffle key is a hash of the id, so reruns agree.

Null and blank texts have size 0 and take nothing; a null source is a source of its own, placed
last; rows of one id and source share one place in the queue and one decision, and a null id hashes
as an empty text; equal finish times are taken together or not at all; a corpus without words has
targets 0 and takes nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assocgrid.llm.names import free
from assocgrid.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
KEY_DIGITS = 15  # hexadecimal digits of the shuffle key
SLICE_BITS = 12  # of the key: slices of a source's shuffle order
TIME_SLICES = 65536  # of the time until every source has given its target once


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """One row per source of ``sizes(source, source_size)`` with its target.

    A target is ``min(max_repeats * size, level * weight)``. Sources stop at their repeats in the
    order of ``size / weight``; the level is what those before a source leave for it and the rest.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    listed = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    weighed = sizes.withColumn("_weight", F.element_at(listed, (turn + 1).cast("int")))
    fullness = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, every = fullness.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.lit(float(max_repeats)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    levels = weighed.withColumn("_cap", cap).withColumn("_level", level)
    common = F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))).over(every)
    return levels.withColumn("_common", common).select("source", "source_size", F.least("_cap", F.col("_common") * F.col("_weight")).alias("target"))


def queue(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target and ``queued``: words of the source up to the document's end."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    key = shuffle_key(F.col("doc_id"), seed)
    rows = materialize(rows.withColumn("_key", key).withColumn("_slice", F.shiftright("_key", 4 * KEY_DIGITS - SLICE_BITS)), "mix-sizes")
    totals = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_repeats)
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "_slice", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("o.source").eqNullSafe(F.col("t.source"))
    facts = offsets.alias("o").join(targets.alias("t"), same).select("o.source", "_slice", "_before", "source_size", "target")
    inside = Window.partitionBy("source", "_slice").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("_words", F.sum("size").over(inside))
    on = F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d._slice") == F.col("f._slice"))
    queued = (F.col("_before") + F.col("_words")).alias("queued")
    return within.alias("d").join(facts.alias("f"), on).select("doc_id", "d.source", "size", "source_size", "target", queued)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """``queue`` with ``repeats``, the times that the mix takes the document, and the words ``taken``."""
    rows = materialize(queue(docs, weights, share, max_repeats, seed), "mix-queue")
    finishes = [F.try_divide(F.col("queued") + F.lit(turn) * F.col("source_size"), F.col("target")) for turn in range(max_repeats)]
    turns = rows.select("size", F.explode(F.array(*finishes)).alias("_finish")).filter((F.col("size") > 0) & F.col("_finish").isNotNull())
    timed = turns.withColumn("_time", F.floor(F.col("_finish") * TIME_SLICES))
    budget = rows.agg((F.lit(float(share)) * F.sum("size")).alias("b")).first()["b"] or 0.0
    upto = F.sum("_words").over(Window.orderBy("_time").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slices = timed.groupBy("_time").agg(F.sum("size").alias("_words")).withColumn("_upto", upto)
    # the slice of time in which the budget ends, and the words of all slices before it
    edge = slices.filter(F.col("_upto") > budget).agg(F.min_by(F.struct("_time", (F.col("_upto") - F.col("_words")).alias("_before")), "_time").alias("e")).first()["e"]
    if edge is None:
        last = F.lit(float("inf"))
    else:
        run = F.sum("size").over(Window.orderBy("_finish").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        fits = timed.filter(F.col("_time") == edge["_time"]).withColumn("_run", run).filter(F.col("_run") <= budget - edge["_before"])
        found = fits.agg(F.max("_finish").alias("f")).first()["f"]
        # without one that fits, all that finish before the slice are taken
        last = F.lit(found) if found is not None else None
    taken = [(f <= last) if last is not None else (F.floor(f * TIME_SLICES) < edge["_time"]) for f in finishes]
    repeats = sum((F.coalesce(t, F.lit(False)).cast("int") for t in taken), F.lit(0))
    return rows.withColumn("repeats", repeats).withColumn("taken", F.col("size") * F.col("repeats"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, in the columns of ``docs``."""
    taken = mix(docs, weights, share, max_repeats, seed).filter(F.col("taken") > 0)
    own_id, of, repeats, copy = free(docs.columns, "_id", "_of", "_repeats", "_copy")
    plan = taken.select(F.col("doc_id").alias(own_id), F.col("source").alias(of), F.col("repeats").alias(repeats)).distinct()
    on = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").cast("string").eqNullSafe(F.col(of))
    counted = docs.join(plan, on)
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(repeats)))).select(*[F.col(f"`{c}`") for c in docs.columns])
