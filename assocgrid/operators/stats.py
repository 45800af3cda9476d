"""Two-group effects, rank-sum tests and correlations per group of rows.

Every function takes long rows and returns one row per key (and comparison).  All of them
are aggregates over ``ordered_cells``: one pass gives counts, means, medians, the rank-sum
statistic with its tie correction and the Pearson moments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import col, finite_pairs, finite_sql, is_finite
from assocgrid.functions.tails import normal_two_sided, t_two_sided
from assocgrid.operators.ordered import (
    _grouped,
    average_ranks,
    exact_quantiles,
    null_safe_join,
    ordered_cells,
    ordered_rows,
    quantile_sql,
    split_by_size,
)



# ---- correlations -------------------------------------------------------------------


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation; NULL for a perfect one."""
    return F.when((F.abs(r) < 1) & (n > 2), r * F.sqrt((n - 2) / (1 - r * r)))


def correlation_p(r: Column | str, n: Column | str, perfect: float | None) -> Column:
    """Two-sided P of a correlation; ``perfect`` is the value reported at |r| = 1."""
    r, n = col(r), col(n)
    return F.when(F.abs(r) >= 1, F.lit(perfect).cast("double")).otherwise(t_two_sided(correlation_t(r, n), n - 2))


def _moment_payload(x: str, prefix: str) -> dict[str, str]:
    """Mean, centred square sum and range of x among the rows of one cell."""
    return {
        f"{prefix}mean": f"avg({x})",
        f"{prefix}m2": f"var_pop({x}) * count({x})",
        f"{prefix}lo": f"min({x})",
        f"{prefix}hi": f"max({x})",
    }


def _moment_totals(prefix: str, count: str) -> dict[str, str]:
    return {
        f"{prefix}sum": f"sum({count} * {{{prefix}mean}})",
        f"{prefix}m2_sum": f"sum({{{prefix}m2}})",
        f"min_{prefix}": f"min({{{prefix}lo}})",
        f"max_{prefix}": f"max({{{prefix}hi}})",
    }


def _bounded_r_sql(sxy: str, sxx: str, syy: str, usable: str) -> str:
    """Correlation from centred sums; rounding noise around a perfect fit is removed."""
    r = f"try_divide({sxy}, sqrt({sxx}) * sqrt({syy}))"
    return f"CASE WHEN {usable} THEN CASE WHEN abs({r}) > 1 - 1e-14D THEN signum({r}) ELSE {r} END END"


def _large_moments(rows: DataFrame, group: list[str]) -> DataFrame:
    """Moments of pairs and of their ranks for keys of any size.

    y is ranked first; the cells of x then carry the mean and spread of y and of its rank.
    """
    ranked = null_safe_join(rows, average_ranks(rows, group, "_y", "_ry"), [*group, "_y"])
    cells = ordered_cells(
        ranked,
        group,
        "_x",
        {"_n": "true"},
        {**_moment_payload("_y", "y_"), **_moment_payload("_ry", "r_")},
        {
            "x_sum": "sum(_n * _x)",
            "min_x": "min(_x)",
            "max_x": "max(_x)",
            **_moment_totals("y_", "_n"),
            **_moment_totals("r_", "_n"),
        },
    )
    dx, drx = "(_x - x_sum / _n_total)", "(_n_before + (_n + 1) / 2 - (_n_total + 1) / 2)"
    dy, dry = "(y_mean - y_sum / _n_total)", "(r_mean - r_sum / _n_total)"
    sums = {
        "n": "max(_n_total)",
        "sxy": f"sum(_n * {dx} * {dy})",
        "sxx": f"sum(_n * {dx} * {dx})",
        "syy": f"sum(_n * {dy} * {dy}) + max(y_m2_sum)",
        "rxy": f"sum(_n * {drx} * {dry})",
        "rxx": f"sum(_n * {drx} * {drx})",
        "ryy": f"sum(_n * {dry} * {dry}) + max(r_m2_sum)",
        "varies": "max(min_x) < max(max_x) AND max(min_y_) < max(max_y_)",
    }
    return cells.groupBy(*group).agg(*[F.expr(f"{sql} AS {name}") for name, sql in sums.items()])


def pair_correlations(
    df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3, prefix: str = "", sized: DataFrame | None = None
) -> DataFrame:
    """n, Pearson and Spearman with P per key; NULL below ``min_n`` or for a constant side.

    Ranks are taken among the finite pairs of each key; keys of any size are allowed.
    """
    rows, group = _grouped(finite_pairs(df, x, y), keys)
    names = [f"`{k}`" for k in group]
    rows = rows.selectExpr(*names, f"double(`{x}`) + 0.0D AS _x", f"double(`{y}`) + 0.0D AS _y")
    small, large = split_by_size(rows, group, sized)

    # small keys: both ranks from windows over the same partitioning, then built-in moments
    part = ", ".join(names)

    def rank(v: str) -> str:
        upto = f"count(*) OVER (PARTITION BY {part} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) + {upto}) / 2"

    ranked = small.selectExpr("*", f"{rank('_y')} AS _ry").selectExpr("*", f"{rank('_x')} AS _rx")
    moments = {
        "n": "count(*)",
        "sxy": "covar_pop(_x, _y)",
        "sxx": "var_pop(_x)",
        "syy": "var_pop(_y)",
        "rxy": "covar_pop(_rx, _ry)",
        "rxx": "var_pop(_rx)",
        "ryy": "var_pop(_ry)",
        "varies": "min(_x) < max(_x) AND min(_y) < max(_y)",
    }
    out = ranked.groupBy(*group).agg(*[F.expr(f"{sql} AS {name}") for name, sql in moments.items()])

    if large is not None:
        out = out.unionByName(_large_moments(large, group))
    usable = f"n >= {min_n} AND varies"
    out = out.selectExpr(
        *names,
        "n",
        f"{_bounded_r_sql('sxy', 'sxx', 'syy', usable)} AS pearson_r",
        f"{_bounded_r_sql('rxy', 'rxx', 'ryy', usable)} AS spearman_rho",
    ).select(
        *group,
        "n",
        F.col("pearson_r").alias(f"{prefix}pearson_r"),
        correlation_p("pearson_r", "n", 0.0).alias(f"{prefix}pearson_p"),
        F.col("spearman_rho").alias(f"{prefix}spearman_rho"),
        correlation_p("spearman_rho", "n", 0.0).alias(f"{prefix}spearman_p"),
    )
    return out if keys else out.drop("_all")


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 10) -> DataFrame:
    """n and Pearson r per key: one partially aggregated pass, no ranking.

    A perfect correlation keeps r = +-1 and has no P, as in the feature-wide screens; a key
    without any finite pair is reported with n = 0.
    """
    rows, group = _grouped(df, keys)
    pair = f"{finite_sql(x)} AND {finite_sql(y)}"
    rows = rows.selectExpr(
        *[f"`{k}`" for k in group], f"CASE WHEN {pair} THEN double(`{x}`) END AS _x", f"CASE WHEN {pair} THEN double(`{y}`) END AS _y"
    )
    sums = {
        "n": "count(_x)",
        "sxy": "covar_pop(_x, _y)",
        "sxx": "var_pop(_x)",
        "syy": "var_pop(_y)",
        "varies": "min(_x) < max(_x) AND min(_y) < max(_y)",
    }
    out = rows.groupBy(*group).agg(*[F.expr(f"{sql} AS {name}") for name, sql in sums.items()])
    r = _bounded_r_sql("sxy", "sxx", "syy", f"n >= {min_n} AND varies")
    out = out.selectExpr(*[f"`{k}`" for k in group], "n", f"{r} AS pearson_r")
    out = out.withColumn("pearson_p", correlation_p("pearson_r", "n", None))
    return out if keys else out.drop("_all")


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of y on x per key (NULL for a constant x)."""
    rows, group = _grouped(finite_pairs(df, x, y), keys)
    sums = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.covar_pop(x, y).alias("sxy"),
        F.when(F.min(x) < F.max(x), F.var_pop(x)).alias("sxx"),
    )
    slope = F.col("sxy") / F.col("sxx")
    out = sums.select(*group, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
    return out if keys else out.drop("_all")


# ---- two-group effects --------------------------------------------------------------


def group_effects(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    comparisons: Mapping[str, tuple[Column, Column]],
    min_n: int = 3,
    x: str | None = None,
    min_pairs: int = 10,
    gate_effects: bool = False,
    label: str | None = None,
    keep_empty: bool = False,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Effect of each comparison on the finite y of each key.

    ``comparisons`` maps a label to the conditions of its low and other group.  With ``x``
    the Pearson correlation of x and y over all rows of the key comes from the same pass.
    ``gate_effects`` hides means and medians of ineligible comparisons.  ``label`` names the
    output column holding the comparison label (left out when there is only one).
    ``keep_empty`` also reports keys without any finite y, with zero counts.
    ``sized`` is passed to ``split_by_size``.
    """
    rows, group = _grouped(df if keep_empty else df.where(is_finite(y)), keys)
    keys_sql = [f"`{k}`" for k in group]
    names = {c: (f"a{i}", f"b{i}") for i, c in enumerate(comparisons)}
    flags = {}
    for c, (low, other) in comparisons.items():
        flags[f"{names[c][0]}_is"], flags[f"{names[c][1]}_is"] = low, other
    finite = finite_sql(y) if keep_empty else "true"
    rows = rows.withColumns(flags).selectExpr(
        *keys_sql,
        f"CASE WHEN {finite} THEN double(`{y}`) + 0.0D END AS _v",
        *([f"CASE WHEN {finite} THEN double(`{x}`) END AS _x"] if x is not None else []),
        *[f"{finite} AND {flag} AS {flag}" for flag in flags],
    )
    counts = {flag.removesuffix("_is"): flag for flag in flags}
    sums: dict[str, str] = {}
    for a, b in names.values():
        cell = f"double({a}_cell + {b}_cell)"
        sums |= {
            f"{a}_n": f"max({a}_total)",
            f"{b}_n": f"max({b}_total)",
            f"{a}_sum": f"sum({a} * _v)",
            f"{b}_sum": f"sum({b} * _v)",
            f"{a}_median": quantile_sql("_v", a, 0.5),
            f"{b}_median": quantile_sql("_v", b, 0.5),
            f"{a}_ranks": f"sum({a} * ({a}_before + {b}_before + ({cell} + 1) / 2))",
            f"{a}_ties": f"sum(({a} + {b}) * ({cell} * {cell} - 1))",
        }
    row_moments: dict[str, str] = {}
    cell_moments: dict[str, str] = {}
    payload: dict[str, str] = {}
    totals: dict[str, str] = {}
    if x is not None:
        row_moments = {
            "n_pairs": "count(_x)",
            "sxy": "covar_pop(_x, _v)",
            "sxx": "var_pop(_x)",
            "syy": "var_pop(CASE WHEN _x IS NOT NULL THEN _v END)",
            "varies": "min(_x) < max(_x) AND min(_v) < max(_v)",
        }
        payload = {"x_n": "count(_x)", **_moment_payload("_x", "x_")}
        totals = {
            "n_sum": "sum({x_n})",
            "y_sum": "sum({x_n} * _v)",
            "min_y": "min(_v)",
            "max_y": "max(_v)",
            **_moment_totals("x_", "{x_n}"),
        }
        dy, dx = "(_v - y_sum / n_sum)", "(x_mean - x_sum / n_sum)"
        cell_moments = {
            "n_pairs": "bigint(max(n_sum))",
            "sxy": f"sum(x_n * {dx} * {dy})",
            "sxx": f"sum(x_n * {dx} * {dx}) + max(x_m2_sum)",
            "syy": f"sum(x_n * {dy} * {dy})",
            "varies": "max(min_x_) < max(max_x_) AND max(min_y) < max(max_y)",
        }
    small, large = split_by_size(rows, group, sized)
    wide = ordered_rows(small, group, "_v", counts).groupBy(*group).agg(*[F.expr(f"{sql} AS {name}") for name, sql in {**row_moments, **sums}.items()])
    if large is not None:
        by_cell = ordered_cells(large, group, "_v", counts, payload, totals)
        wide = wide.unionByName(by_cell.groupBy(*group).agg(*[F.expr(f"{sql} AS {name}") for name, sql in {**cell_moments, **sums}.items()]))

    entries = ", ".join(
        f"struct('{c}' AS comparison, {a}_n AS n_low, {b}_n AS n_other, {a}_sum AS s1, {b}_sum AS s2, "
        f"{a}_median AS m1, {b}_median AS m2, {a}_ranks AS ranks, {a}_ties AS ties)"
        for c, (a, b) in names.items()
    )
    moments = ["n_pairs", "sxy", "sxx", "syy", "varies"] if x is not None else []
    keep = [*[f"`{k}`" for k in group], *moments]
    out = wide.selectExpr(*keep, f"inline(array({entries}))")
    eligible = f"(n_low >= {min_n} AND n_other >= {min_n})"
    shown = eligible if gate_effects else "true"
    out = out.selectExpr(
        *keep,
        "comparison",
        "n_low",
        "n_other",
        f"CASE WHEN {shown} THEN try_divide(s1, n_low) END AS mean_low",
        f"CASE WHEN {shown} THEN try_divide(s2, n_other) END AS mean_other",
        f"CASE WHEN {shown} THEN m1 END AS median_low",
        f"CASE WHEN {shown} THEN m2 END AS median_other",
        f"CASE WHEN {eligible} THEN ranks - n_low * (n_low + 1) / 2 END AS rank_sum_w",
        # normal approximation with tie correction; n1 * n2 as double cannot overflow
        f"CASE WHEN {eligible} THEN double(n_low) * n_other / 12 * "
        "((n_low + n_other + 1) - try_divide(ties, double(n_low + n_other) * (n_low + n_other - 1))) END AS variance",
        f"{eligible} AS eligible",
    )
    distance = "(rank_sum_w - double(n_low) * n_other / 2)"
    usable = f"n_pairs >= {min_pairs} AND varies"
    out = out.selectExpr(
        *[f"`{k}`" for k in group],
        *(["n_pairs AS n", f"{_bounded_r_sql('sxy', 'sxx', 'syy', usable)} AS pearson_r"] if moments else []),
        *([f"comparison AS `{label}`"] if label else []),
        "n_low",
        "n_other",
        "mean_low",
        "mean_other",
        "median_low",
        "median_other",
        "mean_low - mean_other AS delta_mean",
        "median_low - median_other AS delta_median",
        "rank_sum_w",
        # continuity correction of one half towards the centre
        f"CASE WHEN variance > 0 THEN ({distance} - signum({distance}) * 0.5D) / sqrt(variance) END AS rank_sum_z",
        "eligible",
    ).withColumn("rank_sum_p", normal_two_sided("rank_sum_z"))
    if moments:
        out = out.withColumn("pearson_p", correlation_p("pearson_r", "n", None))
    return out if keys else out.drop("_all")


def split(low: Column) -> tuple[Column, Column]:
    """Low group and everything else where the condition is known."""
    return F.coalesce(low, F.lit(False)), F.coalesce(~low, F.lit(False))


# ---- summaries ----------------------------------------------------------------------


def group_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median and sample SD of the finite values per group."""
    rows, group = _grouped(df.where(is_finite(value)), keys)
    moments = rows.groupBy(*group).agg(
        F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).alias("sd"),
    )
    out = null_safe_join(exact_quantiles(rows, group, value, {"median": 0.5}), moments, group)
    out = out.select(*group, "n", "mean", "median", "sd")
    return out if keys else out.drop("_all")


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    return exact_quantiles(df, keys, value, {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0})


def finite_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(is_finite(value)).alias("n_finite")
    )


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the smallest and largest finite value; empty bins are kept."""
    rows = df.where(is_finite(value)).select(F.col(value).cast("double").alias("_v"))
    span = rows.agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    width = (high - low) / bins
    place = F.when(high > low, F.least(F.floor((F.col("_v") - low) / width).cast("int"), F.lit(bins - 1)))
    counted = rows.select(F.coalesce(place, F.lit(0)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = span.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("high") - F.col("low")) / bins
    return edges.join(counted, "bin", "left").select(
        "bin",
        (F.col("low") + step * F.col("bin")).alias("bin_from"),
        (F.col("low") + step * (F.col("bin") + 1)).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
