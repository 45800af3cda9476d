"""Groups and states derived from one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import col, finite_or_null, is_finite, log2_plus_one

# fixed values: default cutoffs on log2(level + 1), group names, state codes and names
LOW_CUTOFF = 0.585
DEEP_CUTOFF = 0.35
TIERS = ("Non-Low", "Shallow Low", "Deep Low")
STATES = {-2: "Deep Deletion", -1: "Shallow Deletion", 0: "Diploid", 1: "Gain", 2: "Amplification"}
TUMOUR_TYPES = (
    "Primary Tumor",
    "Recurrent Tumor",
    "Metastatic",
    "Additional Metastatic",
    "Additional - New Primary",
    "Primary Blood Derived Cancer - Peripheral Blood",
    "Primary Blood Derived Cancer - Bone Marrow",
)
TUMOUR_CODES = ("01", "02", "03", "04", "05", "06", "07", "08", "09", "40")
NORMAL_CODES = ("10", "11", "12", "13", "14")
AUTOSOMES = tuple(str(i) for i in range(1, 23))


def prepare_driver(df: DataFrame, level: str, low: float = LOW_CUTOFF, deep: float = DEEP_CUTOFF) -> DataFrame:
    """Adds ``level_log``, the two-group label (NULL when unknown) and the three-tier label.

    The tier of an unknown level is the last one, as a three-way case with an else branch.
    """
    return (
        df.withColumn("level_log", log2_plus_one(finite_or_null(level)))
        .withColumn("level_group", F.when(F.col("level_log").isNull(), None).when(F.col("level_log") < low, "Low").otherwise("Non-Low"))
        .withColumn(
            "level_tier",
            F.when(F.col("level_log") < deep, TIERS[2]).when(F.col("level_log") < low, TIERS[1]).otherwise(TIERS[0]),
        )
    )


def state_code(value: Column | str, baseline: Column | str) -> Column:
    """Five states of a value against its entity's baseline; NULL when either is invalid."""
    v, b = col(value), col(baseline)
    valid = is_finite(v) & (v >= 0) & is_finite(b) & (b > 0)
    return F.when(
        valid,
        F.when(v == 0, -2).when(v < b, -1).when(v == b, 0).when(v < 2 * b, 1).otherwise(2),
    )


def state_name(code: Column | str) -> Column:
    out = None
    for number, name in STATES.items():
        out = (F if out is None else out).when(col(code) == number, name)
    return out


def relative_change(value: Column | str, baseline: Column | str) -> Column:
    return F.when(is_finite(value) & (col(baseline) > 0), col(value) / col(baseline) - 1)


def state_consistent(code: Column | str, value: Column | str, baseline: Column | str) -> Column:
    """Does the stored state agree with the recomputed one (both may be NULL)?"""
    return col(code).cast("int").eqNullSafe(state_code(value, baseline))


def sample_kind(label: Column | str) -> Column:
    """Tumour, Normal or Other from a sample-type label."""
    return F.when(col(label).isin(*TUMOUR_TYPES), "Tumour").when(col(label).contains("Normal"), "Normal").otherwise("Other")


def sample_kind_from_code(code: Column | str) -> Column:
    """The same from a two-digit sample-type code."""
    return F.when(col(code).isin(*TUMOUR_CODES), "Tumour").when(col(code).isin(*NORMAL_CODES), "Normal").otherwise("Other")


def mutation_group(value: Column | str) -> Column:
    """Mutant above zero, WT at zero; an unknown value stays unknown, a negative one is an error."""
    wrong = F.raise_error(F.concat(F.lit("negative mutation indicator: "), col(value).cast("string"))).cast("string")
    return F.when(is_finite(value), F.when(col(value) > 0, "Mutant").when(col(value) < 0, wrong).otherwise("WT"))


def on_autosome(chromosome: Column | str) -> Column:
    return F.regexp_replace(col(chromosome).cast("string"), "^chr", "").isin(*AUTOSOMES)
