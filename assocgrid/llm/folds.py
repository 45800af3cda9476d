"""Held-out rows and bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row are never learnt from: one in five, by the checksum of the id's text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int, per_class: bool = False) -> DataFrame:
    """``docs`` with the column ``_label`` for at most ``rows`` labelled rows (of each class, if asked) to learn from.

    The rows are those of the smallest hash among the ids that are not held out; ids with both labels
    and texts of more than ``longest`` characters are left out. Only the chosen ids are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    sure = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter(F.col("_label") == F.col("_other")).drop("_other")
    order = [F.xxhash64("_id"), F.col("_id")]
    if per_class:
        chosen = sure.filter("_label = 0").orderBy(*order).limit(rows).union(sure.filter("_label = 1").orderBy(*order).limit(rows))
    else:
        chosen = sure.orderBy(*order).limit(rows)
    short = docs.filter(F.length(F.coalesce(F.col("text"), F.lit(""))) <= longest)
    return short.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_id"))


def rates(labels: DataFrame, label: str) -> tuple[int, int]:
    """Numbers of labels 0 and 1 among all rows that are not held out."""
    row = labels.filter(~held_out(F.col("doc_id").cast("long"))).agg(F.count_if(F.col(label) == 0).alias("no"), F.count_if(F.col(label) == 1).alias("yes")).first()
    return row["no"], row["yes"]
