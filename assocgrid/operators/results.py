"""Multiple-testing adjustment and ranks over result tables (one row per test).

A result table is cut into range slices of the full sort key, whose positions are stored with
the rows; only one summary row per slice goes through a window.  NULL families are families
like any others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assocgrid.functions.finite import is_finite
from assocgrid.operators.ordered import null_safe_join
from assocgrid.storage import materialize


def adjust_window(df: DataFrame, p: str, out: str, family: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg in one task per family: for families whose size is known to be small."""
    within = Window.partitionBy(*family)
    descending = within.orderBy(F.col("_p").desc_nulls_last())
    tested = F.count("_p").over(within)
    # rank() counts the larger P values, so a row's rank from below is m - rank() + 1
    df = df.withColumn("_p", F.when(is_finite(p), F.col(p))).withColumn("_m", tested)
    df = df.withColumn("_raw", F.col("_p") * F.col("_m") / (F.col("_m") - F.rank().over(descending) + 1))
    running = descending.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = F.least(F.lit(1.0), F.min("_raw").over(running))
    return df.withColumn(out, F.when(F.col("_p").isNotNull(), adjusted)).drop("_p", "_m", "_raw")


class ResultTable:
    """A written result table with family-wise adjustments and ranks added to it."""

    def __init__(self, df: DataFrame, key: Sequence[str], family: Sequence[str] = ()):
        self.family = list(family)
        self.key = list(key)
        self.frame = materialize(df, "results")

    # ---- Benjamini-Hochberg ----

    def adjust(self, p: str, out: str) -> ResultTable:
        """Benjamini-Hochberg over the tested rows of each family; untested rows stay NULL."""
        value = F.when(is_finite(p), F.col(p))
        df, slices = self._slices(self.frame.withColumn("_p", value), [F.col("_p").asc_nulls_last()])
        family = self.family
        tested = df.groupBy(*family).agg(F.count("_p").alias("_m")) if family else df.agg(F.count("_p").alias("_m"))
        df = self._join(df, slices, [*family, "_slice"])
        df = self._join(df, tested, family)
        df = df.withColumn("_raw", F.col("_p") * F.col("_m") / (F.col("_seq") - F.col("_first") + F.col("_before") + 1))
        lows = df.groupBy(*family, "_slice").agg(F.min("_raw").alias("_low"))
        later = Window.partitionBy(*family).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
        lows = lows.select(*family, "_slice", F.min("_low").over(later).alias("_later"))
        df = self._join(df, lows, [*family, "_slice"])
        inside = (
            Window.partitionBy(*family, "_slice")
            .orderBy(F.col("_seq").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        adjusted = F.least(F.lit(1.0), F.min("_raw").over(inside), F.col("_later"))
        df = df.withColumn(out, F.when(F.col("_p").isNotNull(), adjusted))
        self.frame = df.drop("_p", "_m", "_raw", "_slice", "_seq", "_first", "_before", "_later")
        return self

    # ---- ranks ----

    def rank(self, out: str, order: Sequence[Column], where: Column | None = None, total: str | None = None) -> ResultTable:
        """Sequence 1..n by ``order`` (ties by key) within the family, among rows passing ``where``.

        ``total`` also adds the number of ranked rows of the family.
        """
        passing = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        df = self.frame.withColumn("_ok", passing)
        order = [F.col("_ok").desc(), *order, *[F.col(k).asc_nulls_first() for k in self.key]]
        placed, slices = self._slices(df, order)
        df = self._join(placed, slices, [*self.family, "_slice"])
        df = df.withColumn("_rank", F.col("_seq") - F.col("_first") + F.col("_before") + 1)
        df = df.drop("_slice", "_seq", "_first", "_before")
        if total:
            counted = placed.groupBy(*self.family).agg(F.count_if("_ok").alias(total))
            df = self._join(df, counted, self.family)
        self.frame = df.withColumn(out, F.when(F.col("_ok"), F.col("_rank").cast("long"))).drop("_ok", "_rank")
        return self

    # ---- helpers ----

    @staticmethod
    def _join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
        if keys:
            return null_safe_join(df, other, keys)
        column = other.columns[0]
        return df.withColumn(column, other.select(column).scalar())

    def _slices(self, df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
        """Rows stored in sort order with their slice and sequence, and one row per slice."""
        full = [*[F.col(f) for f in self.family], *order, *[F.col(k).asc_nulls_first() for k in self.key]]
        ordered = df.repartitionByRange(*full).sortWithinPartitions(*full)
        stored = materialize(
            ordered.withColumn("_slice", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()),
            "slices",
        )
        per_slice = stored.groupBy(*self.family, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
        earlier = Window.partitionBy(*self.family).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = per_slice.select(
            *self.family, "_slice", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
        )
        return stored, slices


def top_per_direction(df: DataFrame, effect: str, rank: str, n: int, below: str, above: str) -> DataFrame:
    """First ``n`` ranked rows with a negative and with a positive effect, labelled."""
    direction = F.when(F.col(effect) < 0, below).when(F.col(effect) > 0, above)
    labelled = df.where(F.col(rank).isNotNull()).withColumn("direction", direction).where("direction is not null")
    place = F.row_number().over(Window.partitionBy("direction").orderBy(rank))
    return labelled.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def top_correlations(df: DataFrame, r: str, feature: str, driver: str, n: int, positive: str, negative: str) -> DataFrame:
    """Strongest positive and negative correlations, the driver itself excluded."""
    kept = df.where((F.col(feature) != driver) & is_finite(r) & (F.col(r) != 0))
    kept = kept.withColumn("direction", F.when(F.col(r) > 0, positive).otherwise(negative))
    place = F.row_number().over(Window.partitionBy("direction").orderBy(F.abs(F.col(r)).desc(), feature))
    return kept.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def untested_before(df: DataFrame, fdr: str, rank: str, key: str, candidate: str) -> DataFrame:
    """How many untested rows the all-rows rank puts before one candidate."""
    place = df.where(F.col(key) == candidate).agg(F.max(rank).alias("place")).scalar()
    return df.agg(
        F.count_if(F.col(fdr).isNull()).alias("n_untested"),
        F.count_if(F.col(fdr).isNull() & (F.col(rank) < place)).alias("n_untested_before"),
    )


def significance_label(fdr: str, effect: str, alpha: float = 0.05) -> Column:
    hit = F.col(fdr) < alpha
    return F.when(hit & (F.col(effect) < 0), "lower").when(hit & (F.col(effect) > 0), "higher").otherwise("not significant")


def minus_log10(p: str, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(F.col(p), F.lit(floor)))
