"""Association screens: one driver against one target or against every feature.

Inputs are long: ``matrix(entity, feature, value)`` and a driver with one row per entity.
The driver side of a join is never hinted as broadcast; adaptive execution does so at run
time when its measured size allows it, and splits skewed join partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import finite_pairs, is_finite
from assocgrid.functions.states import LOW_CUTOFF, TIERS, mutation_group, prepare_driver
from assocgrid.operators.bootstrap import bootstrap_median_difference
from assocgrid.operators.models import adjusted_screen, known_stratum
from assocgrid.operators.ordered import exact_quantiles
from assocgrid.operators.quality import duplicate_keys, one_to_one_join, recomputation_differences, require_none
from assocgrid.operators.results import ResultTable, adjust_window
from assocgrid.operators.select import first_per_key
from assocgrid.operators.stats import group_effects, pair_correlations, pearson, split
from assocgrid.storage import materialize

MIN_GROUP = 3
MIN_STRATUM = 20
THRESHOLDS = (0.585, 0.50, 0.40, 0.35)
QUANTILES = (0.10, 0.20)
NORMAL_975 = 1.959963984540054

SCREEN_SCHEMA = (
    "feature string, n long, pearson_r double, pearson_p double, n_low long, n_other long, "
    "mean_low double, mean_other double, median_low double, median_other double, delta_mean double, "
    "delta_median double, rank_sum_p double, pearson_fdr double, rank_sum_fdr double, rank long, "
    "eligible_rank long, eligible_n long"
)


# ---- feature-wide screens -----------------------------------------------------------


def one_per_entity(driver: DataFrame, order: Sequence[str] | None) -> DataFrame:
    """The first row of each entity by ``order``; without an order a repeated entity is an error."""
    if order:
        return materialize(first_per_key(driver, ["entity"], list(order)), "driver")
    require_none(duplicate_keys(driver, ["entity"]), "repeated driver entities")
    return driver


def feature_effects(
    matrix: DataFrame, driver: DataFrame, x: str, low: Column, min_n: int = MIN_GROUP, order: Sequence[str] | None = None
) -> DataFrame:
    """Correlation and two-group effect of every feature against the driver (no families).

    Features without any usable cell stay in the result, untested. Of repeated driver entities
    the first by ``order`` counts.
    """
    groups = one_per_entity(driver, order).where(is_finite(x)).select("entity", F.col(x).alias("_driver"), low.alias("_low"))
    rows = _matched_cells(matrix, groups).select("feature", "value", "_driver", "_low")
    return group_effects(
        rows, ["feature"], "value", {"low": split(F.col("_low"))}, min_n=min_n, x="_driver", gate_effects=True, keep_empty=True, sized=matrix
    )


def _matched_cells(matrix: DataFrame, driver: DataFrame) -> DataFrame:
    """All cells with their driver columns; the value of an unmatched entity is blanked, so that
    its feature is still known while its cell is not counted."""
    rows = matrix.join(driver, "entity", "left")
    return rows.withColumn("value", F.when(F.col("_driver").isNotNull(), F.col("value")))


def feature_screen(
    matrix: DataFrame, driver: DataFrame, x: str, low: Column, min_n: int = MIN_GROUP, order: Sequence[str] | None = None
) -> DataFrame:
    """The full screen: effects, two adjusted families, all-rows rank and eligible rank.

    ``rank`` orders untested rows first, as the published tables do; ``eligible_rank``
    numbers only rows with a finite adjusted P and effect.
    """
    table = ResultTable(feature_effects(matrix, driver, x, low, min_n, order), ["feature"])
    table.adjust("pearson_p", "pearson_fdr").adjust("rank_sum_p", "rank_sum_fdr")
    return with_ranks(table).select(*[field.split()[0] for field in SCREEN_SCHEMA.split(", ")])


def with_ranks(table: ResultTable, fdr: str = "rank_sum_fdr", delta: str = "delta_median") -> DataFrame:
    order = [F.col(fdr).asc_nulls_first(), F.col(delta).asc_nulls_first()]
    table.rank("rank", order)
    table.rank("eligible_rank", [F.col(fdr), F.col(delta), F.col("rank")], is_finite(fdr) & is_finite(delta), "eligible_n")
    return table.frame


def group_counts(matrix: DataFrame, driver: DataFrame, x: str, low: Column) -> DataFrame:
    """Group sizes among the matrix's entities; reads only the id columns."""
    entities = matrix.select("entity").distinct()
    flagged = driver.where(is_finite(x)).select("entity", low.alias("_low")).join(entities, "entity", "left_semi")
    return flagged.agg(F.count_if("_low").alias("n_low"), F.count_if(~F.col("_low")).alias("n_other"))


def screen_status(matrix: DataFrame, driver: DataFrame, x: str, low: Column, min_n: int = MIN_GROUP) -> DataFrame:
    counts = group_counts(matrix, driver, x, low)
    small = (F.col("n_low") < min_n) | (F.col("n_other") < min_n)
    return counts.withColumn("status", F.when(small, "SKIPPED").otherwise("computed"))


def strict_alignment(matrix: DataFrame, meta: DataFrame) -> DataFrame:
    """Cells with their metadata; repeated cells or metadata rows are an error, unmatched cells have none."""
    require_none(duplicate_keys(matrix, ["entity", "feature"]), "repeated matrix cells")
    require_none(duplicate_keys(meta, ["entity"]), "repeated metadata rows")
    return matrix.join(meta, "entity", "left")


def gated_screen(
    matrix: DataFrame, driver: DataFrame, x: str, low: Column, min_n: int = MIN_GROUP
) -> tuple[DataFrame, DataFrame]:
    """(status, result): an empty typed result, without reading values, when a group is too small."""
    counted = screen_status(matrix, driver, x, low, min_n)
    row = counted.first()
    status = matrix.sparkSession.createDataFrame([row], counted.schema)  # one row, not counted again
    if row["status"] == "SKIPPED":
        return status, matrix.sparkSession.createDataFrame([], SCREEN_SCHEMA)
    return status, feature_screen(matrix, driver, x, low, min_n)


def covariation(matrix: DataFrame, feature: str, min_n: int = 10) -> DataFrame:
    """Pearson correlation of one feature with every feature of the same matrix, itself included."""
    one = matrix.where((F.col("feature") == feature) & is_finite("value")).select("entity", F.col("value").alias("_driver"))
    # written first: the planner then knows its true size and broadcasts it only if it is small,
    # where a filter over the matrix would be planned as a shuffle of the whole matrix
    one = materialize(one, "driver")
    rows = matrix.join(one, "entity", "left")
    table = ResultTable(pearson(rows, ["feature"], "_driver", "value", min_n), ["feature"])
    return table.adjust("pearson_p", "fdr").frame


def quantile_screen(matrix: DataFrame, driver: DataFrame, x: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Every feature against groups cut at quantiles of the driver's own finite cohort.

    One row per (feature, quantile); rank-sum families per quantile, one correlation family.
    """
    cohort = driver.where(is_finite(x)).select("entity", F.col(x).alias("_driver"))
    cut = exact_quantiles(cohort, [], "_driver", {f"q{i}": q for i, q in enumerate(quantiles)})
    flags = cohort.withColumns(
        {f"_low{i}": F.col("_driver") <= cut.select(f"q{i}").scalar() for i in range(len(quantiles))}
    )
    # one row per entity, written once: its cutoffs are not computed again by every pass
    rows = strict_alignment(matrix, materialize(flags, "driver"))
    rows = rows.withColumn("value", F.when(F.col("_driver").isNotNull(), F.col("value")))
    groups = group_effects(
        rows, ["feature"], "value", {str(q): split(F.col(f"_low{i}")) for i, q in enumerate(quantiles)}, label="quantile", keep_empty=True, sized=matrix
    ).withColumn("quantile", F.col("quantile").cast("double"))
    table = ResultTable(groups, ["feature"], ["quantile"]).adjust("rank_sum_p", "rank_sum_fdr").frame
    pairs = ResultTable(pair_correlations(rows, ["feature"], "_driver", "value", sized=matrix), ["feature"])
    return table.join(pairs.adjust("pearson_p", "pearson_fdr").frame, "feature", "left").fillna({"n": 0})


def ranked_adjusted_screen(matrix: DataFrame, driver: DataFrame, x: str, stratum: str, low: Column) -> DataFrame:
    """Stratum-adjusted screen with two families and a rank by adjusted P, slope and name."""
    meta = driver.select("entity", F.col(x).alias("_driver"), F.col(stratum).alias("_stratum"), low.alias("_low"))
    rows = strict_alignment(matrix, meta)
    screen = adjusted_screen(rows, "feature", "value", "_driver", "_stratum", F.col("_low"))
    table = ResultTable(screen, ["feature"]).adjust("p_driver", "fdr_driver").adjust("p_low", "fdr_low")
    table.rank("eligible_rank", [F.col("fdr_driver"), F.col("beta_driver")], F.col("fdr_driver").isNotNull(), "eligible_n")
    return table.frame


# ---- one driver, one target ---------------------------------------------------------


def matched_pair(driver: DataFrame, target: DataFrame, level: str = "level", value: str = "value") -> DataFrame:
    """Entities with a finite driver level and target value, with the driver's groups.

    One row per entity, written once: every statistic of the pair reads it several times.
    """
    d = driver.select("entity", F.col(level).alias("level"))
    # the check for repeated entities and the join read it: a row of a matrix is often the sum of many others
    t = materialize(target.select("entity", F.col(value).alias("target")), "target")
    pair = prepare_driver(finite_pairs(one_to_one_join(d, t, ["entity"]), "level", "target"), "level").where(is_finite("level_log"))
    return materialize(pair, "pair")


def targeted_statistics(pair: DataFrame, min_n: int = MIN_GROUP, keys: Sequence[str] = ()) -> DataFrame:
    """Correlations on the log and the raw scale plus the two-group effect of a matched pair."""
    keyed = pair if keys else pair.withColumn("_pair", F.lit(1))
    keys_ = list(keys) or ["_pair"]
    core = pair_correlations(keyed, keys_, "level_log", "target")
    raw = pair_correlations(keyed, keys_, "level", "target", prefix="level_").drop("n")
    effect = group_effects(keyed, keys_, "target", {"low": split(F.col("level_group") == "Low")}, min_n)
    out = core.join(raw, keys_).join(effect, keys_)
    return out if keys else out.drop("_pair")


def both_directions(forward: DataFrame, reverse: DataFrame, min_n: int = MIN_GROUP) -> DataFrame:
    """Targeted statistics of A on B and B on A; a direction with a small group is left out."""
    pairs = forward.withColumn("direction", F.lit("forward")).unionByName(reverse.withColumn("direction", F.lit("reverse")))
    return targeted_statistics(pairs, min_n, ["direction"]).where("eligible")


def three_group_tests(pair: DataFrame, min_n: int = MIN_GROUP, tier: str = "level_tier") -> DataFrame:
    """Rank-sum test of every pair of tiers; nothing is tested unless every tier is large enough."""
    comparisons = {f"{a}|{b}": (F.col(tier) == a, F.col(tier) == b) for a, b in combinations(TIERS, 2)}
    tested = group_effects(pair, [], "target", comparisons, min_n, label="pair").where(F.col("eligible"))
    sizes = pair.agg(F.least(*[F.count_if(F.col(tier) == t) for t in TIERS]).alias("least"))
    tested = tested.where(sizes.select("least").scalar() >= min_n)
    out = tested.select(
        F.split("pair", r"\|")[0].alias("group1"),
        F.split("pair", r"\|")[1].alias("group2"),
        F.col("n_low").alias("n1"),
        F.col("n_other").alias("n2"),
        F.col("rank_sum_w"),
        F.col("rank_sum_z"),
        F.col("rank_sum_p").alias("p"),
    )
    return adjust_window(out, "p", "fdr")  # three rows


def threshold_sensitivity(pair: DataFrame, x: str, y: str, thresholds: Sequence[float] = THRESHOLDS, min_n: int = MIN_GROUP) -> DataFrame:
    """The two-group effect at several cutoffs; every cutoff comes from one pass over the pair."""
    rows = finite_pairs(pair, x, y)
    out = group_effects(rows, [], y, {str(t): split(F.col(x) < t) for t in thresholds}, min_n, label="threshold")
    return adjust_window(out.withColumn("threshold", F.col("threshold").cast("double")), "rank_sum_p", "rank_sum_fdr")


def quantile_groups(pair: DataFrame, x: str, y: str, quantiles: Sequence[float] = QUANTILES, min_n: int = MIN_GROUP) -> DataFrame:
    """The two-group effect below inclusive quantile cutoffs of the matched cohort."""
    rows = finite_pairs(pair, x, y)
    cut = materialize(exact_quantiles(rows, [], x, {f"q{i}": q for i, q in enumerate(quantiles)}), "cutoffs")
    limits = {q: cut.select(f"q{i}").scalar() for i, q in enumerate(quantiles)}
    out = group_effects(rows, [], y, {str(q): split(F.col(x) <= limit) for q, limit in limits.items()}, min_n, label="quantile")
    cutoff = None
    for q, limit in limits.items():
        cutoff = (F if cutoff is None else cutoff).when(F.col("quantile") == str(q), limit)
    out = out.withColumn("cutoff", cutoff).withColumn("quantile", F.col("quantile").cast("double"))
    return adjust_window(out, "rank_sum_p", "rank_sum_fdr")


def quantile_dependency(
    pair: DataFrame, x: str, y: str, quantiles: Sequence[float] = QUANTILES, min_n: int = MIN_GROUP
) -> tuple[DataFrame, DataFrame]:
    """(groups at the quantiles, the correlation of the same finite pairs): both halves of the analysis."""
    return quantile_groups(pair, x, y, quantiles, min_n), pair_correlations(finite_pairs(pair, x, y), [], x, y)


def chained_correlations(driver: DataFrame, middle: DataFrame, target: DataFrame) -> DataFrame:
    """Driver against middle and middle against target, each on its own matched cohort."""
    first = driver.select("entity", F.col("level").alias("x")).join(middle.select("entity", F.col("value").alias("y")), "entity")
    second = middle.select("entity", F.col("value").alias("x")).join(target.select("entity", F.col("value").alias("y")), "entity")
    rows = first.withColumn("analysis", F.lit("driver vs middle")).unionByName(second.withColumn("analysis", F.lit("middle vs target")))
    return pair_correlations(rows, ["analysis"], "x", "y")


def representative_correlation(values: DataFrame, chosen: DataFrame, entity: str, value: str) -> DataFrame:
    """Pooled correlation of an entity's value with that of its chosen representative."""
    a = values.select(entity, F.col(value).alias("value_a"))
    b = chosen.where("selected").select(entity, F.col(value).alias("value_b"))
    return pair_correlations(one_to_one_join(a, b, [entity]), [], "value_a", "value_b")


def target_row_differences(screen: DataFrame, targeted: DataFrame, feature: str) -> DataFrame:
    """Columns in which a screen's row of the target and the pair's own statistics disagree."""
    columns = ["rank_sum_p", "delta_median", "delta_mean"]
    row = screen.where(F.col("feature") == feature).select("feature", *columns)
    return recomputation_differences(row, targeted.withColumn("feature", F.lit(feature)), ["feature"], columns)


def mutation_comparison(
    flags: DataFrame, target: DataFrame, definitions: Sequence[str], min_n: int = MIN_GROUP
) -> tuple[DataFrame, DataFrame]:
    """(tested, skipped): mutant against WT entities per definition.

    ``flags(definition, entity, value)``; an entity without a flag is unknown, not WT.
    """
    rows = flags.join(target.select("entity", F.col("value").alias("target")), "entity")
    rows = finite_pairs(rows, "value", "target").withColumn("_group", mutation_group("value"))
    effects = group_effects(rows, ["definition"], "target", {"m": split(F.col("_group") == "Mutant")}, min_n)
    effects = effects.withColumnsRenamed(
        {"n_low": "n_mutant", "n_other": "n_wt", "median_low": "median_mutant", "median_other": "median_wt", "rank_sum_p": "p"}
    )
    tested = effects.where("eligible").select(
        "definition", "n_mutant", "n_wt", "median_mutant", "median_wt", "delta_median", "rank_sum_z", "p"
    )
    spark = target.sparkSession
    wanted = spark.createDataFrame([(d,) for d in definitions], "definition string")
    merged = wanted.join(effects.select("definition", "n_mutant", "n_wt", "eligible"), "definition", "left")
    reason = F.when(F.col("eligible").isNull(), F.concat("definition", F.lit(" absent; state unknown"))).otherwise(
        F.concat_ws(" ", "definition", F.lit("insufficient groups: mutant"), "n_mutant", F.lit("WT"), "n_wt")
    )
    skipped = merged.where(~F.coalesce("eligible", F.lit(False))).select("definition", reason.alias("reason"))
    return adjust_window(tested, "p", "fdr"), skipped  # one row per definition


# ---- per stratum --------------------------------------------------------------------


def stratified_effects(
    pair: DataFrame, stratum: str, low: Column, value: str = "target", min_n: int = MIN_GROUP, draws: int = 1000, seed: int = 1234
) -> DataFrame:
    """Two-group effect per stratum with a bootstrap interval, adjusted over eligible strata."""
    rows = pair.where(known_stratum(stratum)).withColumn("_low", low)
    effects = group_effects(rows, [stratum], value, {"low": split(F.col("_low"))}, min_n).where("eligible")
    table = ResultTable(effects, [stratum]).adjust("rank_sum_p", "fdr").frame
    intervals = bootstrap_median_difference(rows, stratum, value, F.col("_low"), min_n, draws, seed)
    return table.join(intervals, stratum, "left")


def stratum_eligibility(pair: DataFrame, stratum: str, low: Column, min_n: int = MIN_GROUP) -> DataFrame:
    counts = pair.where(known_stratum(stratum)).groupBy(stratum).agg(
        F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_other")
    )
    return counts.withColumn("eligible", (F.col("n_low") >= min_n) & (F.col("n_other") >= min_n))


def stratum_correlations(df: DataFrame, stratum: str, x: str, y: str, min_n: int = MIN_STRATUM) -> DataFrame:
    """Correlations per stratum with medians, a Fisher-z interval and two adjusted families."""
    rows = finite_pairs(df.where(known_stratum(stratum)), x, y)
    core = pair_correlations(rows, [stratum], x, y, min_n)
    medians = exact_quantiles(rows, [stratum], x, {"x_median": 0.5}).drop("n")
    medians = medians.join(exact_quantiles(rows, [stratum], y, {"y_median": 0.5}).drop("n"), stratum)
    r, half = F.col("pearson_r"), NORMAL_975 / F.sqrt(F.col("n") - 3)
    ends = {"ci_low": -half, "ci_high": half}
    out = core.join(medians, stratum).withColumns(
        {name: F.when(F.abs(r) >= 1, F.signum(r)).otherwise(F.tanh(F.atanh(r) + shift)) for name, shift in ends.items()}
    )
    out = out.withColumn("eligible", (F.col("n") >= min_n) & r.isNotNull())
    return ResultTable(out, [stratum]).adjust("pearson_p", "pearson_fdr").adjust("spearman_p", "spearman_fdr").frame


def listed_stratum_correlations(
    df: DataFrame, strata: DataFrame, stratum: str, x: str, y: str, min_n: int = MIN_STRATUM
) -> DataFrame:
    """The same over a given list of strata, each with a status; absent strata have n = 0.

    Rows of strata that are not listed, or unknown, go before anything is sorted.
    """
    rows = finite_pairs(df, x, y).join(strata.select(stratum).where(F.col(stratum).isNotNull()).distinct(), stratum, "left_semi")
    core = pair_correlations(rows, [stratum], x, y, min_n)
    medians = exact_quantiles(rows, [stratum], x, {"x_median": 0.5}).drop("n")
    out = strata.select(stratum).join(core, stratum, "left").join(medians, stratum, "left").fillna({"n": 0})
    status = (
        F.when(F.col("n") < min_n, "Insufficient N for correlation")
        .when(F.col("pearson_r").isNull(), "Constant driver or outcome; correlation unavailable")
        .otherwise("Eligible")
    )
    out = out.withColumn("status", status)
    return ResultTable(out, [stratum]).adjust("pearson_p", "pearson_fdr").adjust("spearman_p", "spearman_fdr").frame


def low_group(level: str = "level_log", cutoff: float = LOW_CUTOFF) -> Column:
    return F.col(level) < cutoff


def significant_counts(table: DataFrame, family: Sequence[str], fdr: str, alpha: float = 0.05) -> DataFrame:
    """Eligible rows below ``alpha`` and all rows per family."""
    hit = F.col("eligible") & (F.col(fdr) < alpha)
    return table.groupBy(*family).agg(F.count_if(hit).alias("n_significant"), F.count(F.lit(1)).alias("n_strata"))
