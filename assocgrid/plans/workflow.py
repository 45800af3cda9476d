"""Whole analyses: the screen of one driver, the pair analysis, and the alignment report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import is_finite
from assocgrid.functions.states import prepare_driver
from assocgrid.operators.cohort import prevalence, stratum_order
from assocgrid.operators.models import adjusted_coefficients
from assocgrid.operators.ordered import exact_quantiles
from assocgrid.plans import screens
from assocgrid.plans.ledger import modules_of
from assocgrid.storage import materialize


def screen_workflow(matrix: DataFrame, driver_matrix: DataFrame, feature: str, cohort: DataFrame, strata: DataFrame) -> dict[str, DataFrame]:
    """Tables of the one-driver workflow: cohort tables, gated screen and covariation."""
    driver = prepare_driver(_one_feature(driver_matrix, feature), "level")
    status, screen = screens.gated_screen(matrix, driver, "level_log", screens.low_group())
    return {
        "stratum_order": stratum_order(cohort, strata, "stratum"),
        "prevalence": prevalence(cohort, strata, "stratum"),
        "stratum_correlations": screens.listed_stratum_correlations(cohort, strata, "stratum", "relative_change", "expression"),
        "screen_status": status,
        "feature_screen": screen,
        "covariation": screens.covariation(driver_matrix, feature),
    }


def _one_feature(matrix: DataFrame, feature: str) -> DataFrame:
    """One feature as driver, written so that joins are planned from its true size."""
    return materialize(matrix.where(F.col("feature") == feature).select("entity", F.col("value").alias("level")), "driver")


def pair_workflow(
    matrix: DataFrame, driver_matrix: DataFrame, feature: str, target: str, strata_of: DataFrame, cohort: DataFrame, strata: DataFrame
) -> dict[str, DataFrame]:
    """The screen workflow plus every table that depends on the target."""
    out = screen_workflow(matrix, driver_matrix, feature, cohort, strata)
    pair = screens.matched_pair(_one_feature(driver_matrix, feature), matrix.where(F.col("feature") == target))
    placed = pair.join(strata_of, "entity")
    out["targeted"] = screens.targeted_statistics(pair)
    out["stratified"] = screens.stratified_effects(placed, "stratum", screens.low_group())
    out["adjusted"] = adjusted_coefficients(placed, "level_log", "target", "stratum")
    out["adjusted_low"] = adjusted_coefficients(placed, screens.low_group().cast("double"), "target", "stratum", "low")
    out["threshold_sensitivity"] = screens.threshold_sensitivity(pair, "level_log", "target")
    return out


def workflow_modules(workflow: str) -> tuple[str, ...]:
    return modules_of(workflow)


def alignment(driver: DataFrame, expression: DataFrame, target: DataFrame, meta: DataFrame) -> DataFrame:
    """Driver entities with their expression, target value and metadata, all optional."""
    e = expression.select("entity", F.col("value").alias("expression"))
    t = target.select("entity", F.col("value").alias("target"))
    return driver.join(e, "entity", "left").join(t, "entity", "left").join(meta, "entity", "left")


def alignment_measures(driver: DataFrame, expression: DataFrame, target: DataFrame, level: str = "level") -> DataFrame:
    """Row counts, overlaps, missing and negative driver values as (metric, value) rows.

    One flag column per source and entity replaces separate intersections.
    """
    flags = (
        driver.select("entity", F.lit(True).alias("d"), F.lit(None).cast("boolean").alias("e"), F.lit(None).cast("boolean").alias("t"))
        .unionByName(expression.select("entity", F.lit(True).alias("e")), allowMissingColumns=True)
        .unionByName(target.select("entity", F.lit(True).alias("t")), allowMissingColumns=True)
    )
    per_entity = flags.groupBy("entity").agg(F.max("d").alias("d"), F.max("e").alias("e"), F.max("t").alias("t"))
    d, e, t = (F.coalesce(c, F.lit(False)) for c in ("d", "e", "t"))
    overlaps = per_entity.agg(
        F.count_if(d & t).alias("driver_target_overlap"),
        F.count_if(d & e).alias("driver_expression_overlap"),
        F.count_if(d & e & t).alias("all_three_overlap"),
    )
    counts = driver.agg(
        F.count(F.lit(1)).alias("driver_rows"),
        F.count_if(~is_finite(level)).alias("driver_missing"),
        F.count_if(F.col(level) < 0).alias("driver_negative"),
    )
    parts = [counts, expression.agg(F.count(F.lit(1)).alias("expression_rows")), target.agg(F.count(F.lit(1)).alias("target_rows")), overlaps]
    out = None
    for part in parts:
        entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in part.columns])
        rows = part.select(F.inline(entries))
        out = rows if out is None else out.unionByName(rows)
    return out


def driver_ranges(driver: DataFrame, columns: tuple[str, ...] = ("level", "level_log")) -> DataFrame:
    """Minimum, median and maximum of the raw and log driver."""
    out = None
    for c in columns:
        rows = exact_quantiles(driver, [], c, {"minimum": 0.0, "median": 0.5, "maximum": 1.0}).drop("n").withColumn("variable", F.lit(c))
        out = rows if out is None else out.unionByName(rows)
    return out


def tier_counts(driver: DataFrame) -> DataFrame:
    """Entities per tier with the two-group label of the tier."""
    valid = driver.where(is_finite("level") & is_finite("level_log"))
    return valid.groupBy("level_tier", "level_group").agg(F.count(F.lit(1)).alias("n"))
