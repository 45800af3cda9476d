"""Cohort building: baselines, states, prevalence, orders and the per-feature cohort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assocgrid.functions.finite import is_finite
from assocgrid.functions.states import STATES, TUMOUR_TYPES, relative_change, state_code, state_name
from assocgrid.operators.ordered import exact_quantiles, null_safe_join
from assocgrid.operators.quality import duplicate_keys, enforced, unique_rows
from assocgrid.operators.results import ResultTable
from assocgrid.storage import materialize


def modal_baseline(cells: DataFrame, entity: str, value: str) -> DataFrame:
    """Most frequent finite value per entity (ties: the smallest), its support and tie count.

    Two levels of partial aggregation: (entity, value) counts, then (entity, count).
    """
    counted = cells.where(is_finite(value)).groupBy(entity, value).agg(F.count(F.lit(1)).alias("n"))
    by_count = counted.groupBy(entity, "n").agg(
        F.min(value).alias("mode"), F.count(F.lit(1)).alias("ties"), F.sum("n").alias("total")
    )
    top = F.max_by(F.struct("mode", "ties"), "n")
    out = by_count.groupBy(entity).agg(top.alias("_top"), F.max("n").alias("support"), F.sum("total").alias("n_finite"))
    return out.select(entity, F.col("_top")["mode"].alias("baseline"), "support", F.col("_top")["ties"].alias("ties"), "n_finite")


def baseline_distribution(baselines: DataFrame) -> DataFrame:
    return baselines.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ties") > 1).alias("n_tied"))


def extreme_baselines(baselines: DataFrame, low: float = 1, high: float = 8) -> DataFrame:
    return baselines.where((F.col("baseline") < low) | (F.col("baseline") > high))


def classify(df: DataFrame, value: str = "value", baseline: str = "baseline") -> DataFrame:
    """Adds ``state_code``, ``state`` and ``relative_change``."""
    return df.withColumn("state_code", state_code(value, baseline)).withColumns(
        {"state": state_name("state_code"), "relative_change": relative_change(value, baseline)}
    )


def prevalence(df: DataFrame, strata: DataFrame, stratum: str, code: str = "state_code") -> DataFrame:
    """Count and percentage of every state in every listed stratum, zeros included."""
    counts = df.where(F.col(code).isNotNull()).groupBy(stratum, code).agg(F.count(F.lit(1)).alias("n"))
    grid = strata.select(stratum, F.explode(F.array(*[F.lit(c) for c in STATES])).alias(code))
    full = grid.join(counts, [stratum, code], "left").fillna({"n": 0})
    total = F.sum("n").over(Window.partitionBy(stratum))  # five rows per stratum
    return full.withColumn("denominator", total).select(
        stratum,
        code,
        state_name(code).alias("state"),
        "n",
        "denominator",
        F.when(F.col("denominator") > 0, 100 * F.col("n") / F.col("denominator")).alias("percentage"),
    )


def highest_loss(shares: DataFrame, stratum: str, codes: Sequence[int] = (-2, -1), k: int = 3) -> DataFrame:
    """The k strata with the largest summed percentage of the given states."""
    summed = shares.where(F.col("state_code").isin(*codes)).groupBy(stratum).agg(F.sum("percentage").alias("percentage"))
    return summed.where("percentage is not null").orderBy(F.col("percentage").desc(), stratum).limit(k)


def pie_shares(df: DataFrame, code: str = "state_code", labelled_from: float = 8.0) -> DataFrame:
    """Share of each state in one cohort; small slices get no label."""
    counts = df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    share = 100 * F.col("n") / total
    name = state_name(code)
    return counts.select(name.alias("state"), "n", share.alias("share"), F.when(share >= labelled_from, name).otherwise("").alias("label"))


def stratum_order(df: DataFrame, strata: DataFrame, stratum: str, change: str = "relative_change") -> DataFrame:
    """Listed strata numbered by median relative change, ties by name, empty strata last."""
    # counting, cutting and placing the rows of large strata each read them
    rows = materialize(df.where(F.col(stratum).isNotNull()).select(stratum, change), "changes")
    medians = exact_quantiles(rows, [stratum], change, {"median_change": 0.5})
    table = ResultTable(strata.select(stratum).join(medians, stratum, "left").fillna({"n": 0}), [stratum])
    return table.rank("position", [F.col("median_change").asc_nulls_last()]).frame


def waterfall_order(pair: DataFrame, value: str, entity: str = "entity") -> DataFrame:
    """Entities numbered by falling value, ties by entity."""
    return ResultTable(pair, [entity]).rank("position", [F.col(value).desc_nulls_last()]).frame


def near_zero_subset(df: DataFrame, value: str, below: float = 0.01, min_rows: int = 10) -> DataFrame:
    """Rows with 0 <= value < below, or none when there are too few of them to show."""
    subset = df.where((F.col(value) >= 0) & (F.col(value) < below))
    enough = subset.agg((F.count(F.lit(1)) >= min_rows).alias("ok")).scalar()
    return subset.where(enough)


def landscape(df: DataFrame, strata: Sequence[str], value: str) -> DataFrame:
    """Rows, finite values and median per stratum (and any other grouping column)."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(is_finite(value)).alias("n_finite"))
    medians = exact_quantiles(df, strata, value, {"median": 0.5}).drop("n")
    return null_safe_join(counts, medians, strata, "left")


def feature_cohort(
    values: DataFrame, baselines: DataFrame, chosen: DataFrame, expression: str, stratum: Column, types: Sequence[str] = TUMOUR_TYPES
) -> DataFrame:
    """One row per entity for one feature: value, baseline, state and representative expression.

    ``values(entity, value, sample_type, case_id, project_id...)`` joined one-to-one to the baseline and to
    the chosen representative ``chosen(entity, file_id, case_id, project_id, ...)``, kept for the given sample
    types. What ``cohort_problems`` lists ends the job; the checks ride on the joins' own shuffles.
    """
    joined = _cohort_rows(unique_rows(values, ["entity"], "repeated value"), unique_rows(baselines, ["entity"], "repeated baseline"), unique_rows(chosen, ["entity"], "repeated choice"), expression)
    problem = _cohort_problem()
    rows = enforced(joined, problem.isNull(), F.concat(problem, F.lit(": "), F.col("entity").cast("string"))).where(F.col("sample_type").isin(*types))
    rows = rows.withColumn("stratum", stratum).withColumn("expression", F.log2(F.col("_raw") + 1))
    return classify(rows).drop("_raw", "_case", "_project")


def _cohort_rows(values: DataFrame, baselines: DataFrame, chosen: DataFrame, expression: str) -> DataFrame:
    told = {"_raw": expression, "expression_file": "file_id", "_case": "case_id", "_project": "project_id"}
    extra = chosen.select("entity", *[F.col(source).alias(name) for name, source in told.items()])
    return values.join(baselines, "entity").join(extra, "entity", "left")


def _cohort_problem() -> Column:
    matched = F.col("expression_file").isNotNull()
    return (
        F.when(matched & ~F.col("case_id").eqNullSafe(F.col("_case")), "case differs")
        .when(matched & ~F.col("project_id").eqNullSafe(F.col("_project")), "project differs")
        .when(F.col("_raw") < 0, "negative expression")
    )


def cohort_problems(values: DataFrame, baselines: DataFrame, chosen: DataFrame, expression: str) -> DataFrame:
    """entity and problem of everything that keeps ``feature_cohort`` from being built."""
    tables = {"repeated value": values, "repeated baseline": baselines, "repeated choice": chosen}
    found = [duplicate_keys(df, ["entity"]).select("entity", F.lit(problem).alias("problem")) for problem, df in tables.items()]
    rows = _cohort_rows(values, baselines, chosen, expression).select("entity", _cohort_problem().alias("problem")).where("problem IS NOT NULL").distinct()
    return reduce(DataFrame.union, found, rows)
