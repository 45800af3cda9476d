"""Regressions of y on x with a level per stratum, in closed form.

The model is a one-way analysis of covariance, so the slope, its error and every stratum
coefficient follow from counts, means and centred sums per stratum.  Those are partial
aggregates: a stratum or feature of any size costs one row per map task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import is_finite
from assocgrid.functions.tails import t_two_sided
from assocgrid.storage import materialize

ALIASED = 1e-14  # squared ratio of residual to original column norm below which x is aliased
NEED_ROWS = "Need N >= {n} and at least two strata"
CONSTANT = "Constant outcome"
ALIAS_REASON = "Driver term aliased with strata"
NOT_ESTIMABLE = "Driver term not estimable after stratum adjustment"


def known_stratum(stratum: str) -> Column:
    return F.col(stratum).isNotNull() & (F.col(stratum) != "")


def stratum_sums(df: DataFrame, keys: Sequence[str], stratum: str, y: str, xs: dict[str, Column | str]) -> DataFrame:
    """n, means and centred sums of y and of every x per (keys, stratum); NULL y is not counted."""
    n = F.count(y)
    columns = [n.alias("n"), F.avg(y).alias("y_mean"), (F.var_pop(y) * n).alias("syy"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi")]
    for name, x in xs.items():
        columns += [
            F.avg(x).alias(f"{name}_mean"),
            (F.var_pop(x) * n).alias(f"{name}_sxx"),
            (F.covar_pop(x, y) * n).alias(f"{name}_sxy"),
        ]
    return df.groupBy(*keys, stratum).agg(*columns)


def slope_columns(name: str) -> list[Column]:
    """Aggregates over the strata of one key that give the adjusted slope of x ``name``."""
    return [
        F.sum(f"{name}_sxx").alias(f"{name}_sxx"),
        F.sum(f"{name}_sxy").alias(f"{name}_sxy"),
        (F.sum(f"{name}_sxx") + F.sum(F.col("n") * F.col(f"{name}_mean") * F.col(f"{name}_mean"))).alias(f"{name}_norm"),
    ]


def slope_terms(name: str) -> dict[str, Column]:
    """beta, se, t, df and aliased of x ``name`` from the sums of ``slope_columns``."""
    sxx, sxy, norm = F.col(f"{name}_sxx"), F.col(f"{name}_sxy"), F.col(f"{name}_norm")
    aliased = sxx <= F.lit(ALIASED) * norm
    df = F.col("n") - F.col("n_strata") - 1
    beta = F.when(~aliased, sxy / sxx)
    residual = F.greatest(F.col("syy") - beta * sxy, F.lit(0.0))
    se = F.when(df > 0, F.sqrt(F.try_divide(residual, df.cast("double")) / sxx))
    return {"beta": beta, "se": se, "t": F.try_divide(beta, se), "df": df, "aliased": aliased}


def adjusted_screen(
    df: DataFrame, feature: str, value: str, driver: str, stratum: str, low: Column, min_n: int = 20
) -> DataFrame:
    """Stratum-adjusted slope of every feature on the driver, continuous and binary.

    One row per feature; features that cannot be fitted carry the reason.  Unusable cells
    are blanked rather than dropped, so a feature without any usable cell is reported too.
    """
    usable = is_finite(value) & is_finite(driver) & F.coalesce(known_stratum(stratum), F.lit(False))
    cells = {"_s": F.col(stratum), "_y": F.col(value), "_x": F.col(driver), "_b": low.cast("double")}
    rows = df.select(feature, *[F.when(usable, c).alias(name) for name, c in cells.items()])
    sums = stratum_sums(rows, [feature], "_s", "_y", {"c": "_x", "b": "_b"})
    per = sums.groupBy(feature).agg(
        F.sum("n").alias("n"),
        F.count_if(F.col("n") > 0).alias("n_strata"),
        F.sum("syy").alias("syy"),
        F.coalesce(F.min("y_lo") < F.max("y_hi"), F.lit(False)).alias("varies"),
        *slope_columns("c"),
        *slope_columns("b"),
    )
    c, b = slope_terms("c"), slope_terms("b")
    enough = (F.col("n") >= min_n) & (F.col("n_strata") >= 2)
    usable = enough & F.col("varies")
    done_c = F.coalesce(usable & ~c["aliased"] & (c["se"] > 0), F.lit(False))
    done_b = F.coalesce(usable & ~b["aliased"] & (b["se"] > 0), F.lit(False))
    reason = (
        F.when(~enough, NEED_ROWS.format(n=min_n))
        .when(~F.col("varies"), CONSTANT)
        .when(c["aliased"] | b["aliased"], ALIAS_REASON)
        .when(~done_c | ~done_b, NOT_ESTIMABLE)
        .otherwise("")
    )
    fitted = per.select(
        feature,
        "n",
        *[F.when(done_c, c[k]).alias(f"{k}_driver") for k in ("beta", "se", "t")],
        *[F.when(done_b, b[k]).alias(f"{k}_low") for k in ("beta", "se", "t")],
        c["df"].alias("_df"),
        F.when(done_c, "completed").otherwise("skipped").alias("continuous_status"),
        F.when(done_b, "completed").otherwise("skipped").alias("binary_status"),
        reason.alias("skip_reason"),
    )
    return fitted.select(
        feature,
        "n",
        "beta_driver",
        "se_driver",
        "t_driver",
        t_two_sided("t_driver", "_df").alias("p_driver"),
        "beta_low",
        "se_low",
        "t_low",
        t_two_sided("t_low", "_df").alias("p_low"),
        "continuous_status",
        "binary_status",
        "skip_reason",
    )


def adjusted_coefficients(df: DataFrame, x: str | Column, y: str, stratum: str, x_term: str = "driver") -> DataFrame:
    """Full coefficient table of y on x and stratum; the first stratum is the reference.

    Terms: ``(Intercept)``, the driver term, and one per other stratum, with estimate,
    standard error, t and P.  Empty when x is aliased with the strata.
    """
    return coefficients_from_sums(_written_sums(df, x, y, stratum), x_term)


def _written_sums(df: DataFrame, x: str | Column, y: str, stratum: str) -> DataFrame:
    """Sums per stratum, written once because several scalars are read from them."""
    rows = df.select(
        (F.col(x) if isinstance(x, str) else x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
        F.col(stratum).alias("stratum"),
    ).where(is_finite("x") & is_finite("y") & known_stratum("stratum"))
    return materialize(stratum_sums(rows, [], "stratum", "y", {"x": "x"}), "strata")


def coefficients_from_sums(sums: DataFrame, x_term: str = "driver") -> DataFrame:
    model = sums.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_strata"),
        F.sum("syy").alias("syy"),
        *slope_columns("x"),
        F.min("stratum").alias("reference"),
        F.min_by(F.struct("n", "x_mean", "y_mean"), "stratum").alias("ref"),
    )
    term = slope_terms("x")
    fit = model.select(
        term["beta"].alias("beta"),
        term["df"].alias("df"),
        F.when(term["df"] > 0, F.greatest(F.col("syy") - term["beta"] * F.col("x_sxy"), F.lit(0.0)) / term["df"]).alias("sigma2"),
        F.col("x_sxx").alias("sxx"),
        "reference",
        "ref",
    )
    f = fit.select(F.struct("*")).scalar()  # one row, read by every stratum
    level = F.col("y_mean") - f["beta"] * F.col("x_mean")
    ref_level = f["ref"]["y_mean"] - f["beta"] * f["ref"]["x_mean"]
    is_ref = F.col("stratum") == f["reference"]
    shift = F.when(is_ref, F.col("x_mean")).otherwise(F.col("x_mean") - f["ref"]["x_mean"])
    spread = F.when(is_ref, 0.0).otherwise(1.0 / f["ref"]["n"])
    strata = sums.select(
        F.when(is_ref, "(Intercept)").otherwise(F.concat(F.lit("stratum="), F.col("stratum"))).alias("term"),
        F.when(is_ref, level).otherwise(level - ref_level).alias("estimate"),
        F.sqrt(f["sigma2"] * (1.0 / F.col("n") + spread + shift * shift / f["sxx"])).alias("std_error"),
        f["df"].alias("_df"),
    )
    slope = fit.select(
        F.lit(x_term).alias("term"), F.col("beta").alias("estimate"), F.sqrt(F.col("sigma2") / F.col("sxx")).alias("std_error"), F.col("df").alias("_df")
    )
    table = slope.unionByName(strata).where(F.col("estimate").isNotNull())
    table = table.withColumn("statistic", F.try_divide("estimate", "std_error"))
    return table.select("term", "estimate", "std_error", "statistic", t_two_sided("statistic", "_df").alias("p"))


def standardise(df: DataFrame, *columns: str) -> DataFrame:
    """Centre by the mean and scale by the sample SD of all rows; constant columns become NULL."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
    s = stats.select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.try_divide(F.col(c) - s[c]["m"], s[c]["s"]) for c in columns})


def standardised_sums(sums: DataFrame) -> DataFrame:
    """Stratum sums of x and y after both are centred and scaled over all rows.

    The whole-cohort mean and SD follow from the stratum sums, so rows are not read again.
    """
    means = sums.agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("x_mean")) / F.sum("n")).alias("mx"),
        (F.sum(F.col("n") * F.col("y_mean")) / F.sum("n")).alias("my"),
    )
    m = means.select(F.struct("*")).scalar()
    gap_x, gap_y = F.col("x_mean") - m["mx"], F.col("y_mean") - m["my"]
    spread = sums.agg(
        F.sqrt((F.sum("x_sxx") + F.sum(F.col("n") * gap_x * gap_x)) / (F.sum("n") - 1)).alias("sx"),
        F.sqrt((F.sum("syy") + F.sum(F.col("n") * gap_y * gap_y)) / (F.sum("n") - 1)).alias("sy"),
    )
    s = spread.select(F.struct("*")).scalar()
    sx, sy = s["sx"], s["sy"]
    return sums.select(
        "stratum",
        "n",
        F.try_divide(gap_x, sx).alias("x_mean"),
        F.try_divide(gap_y, sy).alias("y_mean"),
        F.try_divide("x_sxx", sx * sx).alias("x_sxx"),
        F.try_divide("x_sxy", sx * sy).alias("x_sxy"),
        F.try_divide("syy", sy * sy).alias("syy"),
    )


def pooled_model(df: DataFrame, x: str, y: str, stratum: str, min_n: int = 20, standardised: bool = False) -> tuple[DataFrame, DataFrame]:
    """(status, coefficients) of the pooled stratum-adjusted model, raw or standardised."""
    sums = _written_sums(df, x, y, stratum)
    norm = F.sum("x_sxx") + F.sum(F.col("n") * F.col("x_mean") * F.col("x_mean"))
    status = sums.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("n_strata"),
        (F.min("y_lo") < F.max("y_hi")).alias("y_varies"),
        ((F.sum("x_sxx") > 0) | (F.min("x_mean") < F.max("x_mean"))).alias("x_varies"),
        (F.sum("x_sxx") <= F.lit(ALIASED) * norm).alias("aliased"),
    )
    short = (F.col("n") < min_n) | (F.col("n_strata") < 2) | ~F.col("x_varies") | ~F.col("y_varies")
    reason = F.when(short, f"Need N >= {min_n}, two strata and variable driver and outcome").when(F.col("aliased"), ALIAS_REASON).otherwise("")
    status = status.select("n", reason.alias("reason")).withColumn("eligible", F.col("reason") == "")
    table = coefficients_from_sums(materialize(standardised_sums(sums), "strata") if standardised else sums)
    return status, table.where(status.select("eligible").scalar()).withColumn("n", status.select("n").scalar())
