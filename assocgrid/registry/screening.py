"""Registered queries: screens, target pairs, strata and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.functions.finite import finite_pairs
from assocgrid.functions.tails import normal_two_sided, t_two_sided
from assocgrid.operators import models, stats
from assocgrid.operators.bootstrap import bootstrap_median_difference
from assocgrid.operators.ordered import average_ranks, exact_quantiles
from assocgrid.operators.results import (
    ResultTable,
    minus_log10,
    significance_label,
    top_correlations,
    top_per_direction,
    untested_before,
)
from assocgrid.operators.select import pick_representatives
from assocgrid.plans import screens
from assocgrid.registry.base import (
    DRV,
    M,
    REGISTRY,
    Tables,
    bh_sql,
    correlation_sql,
    driver,
    effects_sql,
    final,
    long_matrix,
    normal_p,
    prepared_matrix,
    rounded,
    t_p,
)
from assocgrid.storage import materialize

add = REGISTRY.add

EFFECT_INTS = ["n_low", "n_other"]
EFFECT_FLOATS = ["mean_low", "mean_other", "median_low", "median_other", "delta_mean", "delta_median"]
JOINED = "r AS (SELECT feature, value AS y, level_log AS x, level_log < 0.585 AS low, stratum FROM m JOIN drv USING (entity) WHERE level_log IS NOT NULL)"
SCREEN = f"""WITH {M}, {DRV}, {JOINED},
 e AS ({effects_sql('r', 'feature', 3, ', count(*) AS n, CASE WHEN count(*) >= 10 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson_r')}),
 p AS (SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p, {t_p('(pearson_r * sqrt((n - 2) / (1 - pearson_r * pearson_r)))', '(n - 2)')} AS pearson_p FROM e),
 f1 AS ({bh_sql('p', 'pearson_p', 'pearson_fdr')}), f2 AS ({bh_sql('f1', 'rank_sum_p', 'rank_sum_fdr')}),
 f3 AS (SELECT *, row_number() OVER (ORDER BY rank_sum_fdr NULLS FIRST, delta_median NULLS FIRST, feature) AS rank FROM f2),
 s AS (SELECT *, count(*) FILTER (WHERE rank_sum_fdr IS NOT NULL AND delta_median IS NOT NULL) OVER () AS eligible_n,
   CASE WHEN rank_sum_fdr IS NOT NULL AND delta_median IS NOT NULL THEN row_number() OVER (
     PARTITION BY rank_sum_fdr IS NOT NULL AND delta_median IS NOT NULL ORDER BY rank_sum_fdr, delta_median, rank) END AS eligible_rank FROM f3)
"""


def _screen(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return screens.feature_screen(prepared_matrix(t), driver(t), "level_log", screens.low_group())


@add("screen_effects", f"WITH {M}, {DRV}, {JOINED} " + final(
    effects_sql("r", "feature", 3, ", count(*) AS n, corr(x, y) AS pearson_r"), ["feature"], ["n", *EFFECT_INTS], ["pearson_r", *EFFECT_FLOATS]))
def screen_effects(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    out = screens.feature_effects(prepared_matrix(t), driver(t), "level_log", screens.low_group())
    return rounded(out.select("feature", "n", *EFFECT_INTS, "pearson_r", *EFFECT_FLOATS))


@add("screen_rank_sum", f"WITH {M}, {DRV}, {JOINED} " + final(
    f"SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p FROM ({effects_sql('r', 'feature', 3)})", ["feature"], EFFECT_INTS, ["rank_sum_w", "rank_sum_z", "rank_sum_p"]))
def screen_rank_sum(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    out = screens.feature_effects(prepared_matrix(t), driver(t), "level_log", screens.low_group())
    return rounded(out.select("feature", *EFFECT_INTS, "rank_sum_w", "rank_sum_z", "rank_sum_p"))


@add("feature_screen", SCREEN + final("SELECT * FROM s", ["feature"], ["n", *EFFECT_INTS, "rank", "eligible_rank", "eligible_n"],
     ["pearson_r", "pearson_p", *EFFECT_FLOATS, "rank_sum_p", "pearson_fdr", "rank_sum_fdr"]))
def feature_screen(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_screen(spark, folder))


M150 = M.replace("p_brand AS feature", "p_brand || '|' || p_type AS feature")


@add("feature_screen_150", SCREEN.replace(M, M150) + final("SELECT * FROM s", ["feature"], ["n", *EFFECT_INTS, "rank", "eligible_n"],
     ["pearson_r", "delta_median", "rank_sum_p", "pearson_fdr", "rank_sum_fdr"]))
def feature_screen_150(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    matrix = materialize(long_matrix(t, F.concat("p_brand", F.lit("|"), "p_type")), "matrix")
    out = screens.feature_screen(matrix, driver(t), "level_log", screens.low_group())
    return rounded(out.select("feature", "n", *EFFECT_INTS, "rank", "eligible_n", "pearson_r", "delta_median", "rank_sum_p", "pearson_fdr", "rank_sum_fdr"))


@add("screen_top", SCREEN + final("""SELECT feature, eligible_rank, delta_median, CASE WHEN delta_median < 0 THEN 'lower in low group' ELSE 'higher in low group' END AS direction
   FROM s WHERE eligible_rank IS NOT NULL AND delta_median <> 0 QUALIFY row_number() OVER (PARTITION BY delta_median < 0 ORDER BY eligible_rank) <= 5""",
   ["feature", "direction"], ["eligible_rank"], ["delta_median"]))
def screen_top(spark: SparkSession, folder: str) -> DataFrame:
    top = top_per_direction(_screen(spark, folder), "delta_median", "eligible_rank", 5, "lower in low group", "higher in low group")
    return rounded(top.select("feature", "direction", "eligible_rank", "delta_median"))


@add("screen_head", SCREEN + final("SELECT feature, rank, rank_sum_fdr FROM s WHERE rank_sum_fdr IS NOT NULL ORDER BY rank LIMIT 10", ["feature"], ["rank"], ["rank_sum_fdr"]))
def screen_head(spark: SparkSession, folder: str) -> DataFrame:
    tested = _screen(spark, folder).where("rank_sum_fdr is not null")
    return rounded(tested.orderBy("rank").limit(10).select("feature", "rank", "rank_sum_fdr"))


@add("screen_candidate", SCREEN + final("SELECT feature, rank, eligible_rank, eligible_n, rank_sum_p FROM s WHERE feature = 'Brand#7'",
     ["feature"], ["rank", "eligible_rank", "eligible_n"], ["rank_sum_p"]))
def screen_candidate(spark: SparkSession, folder: str) -> DataFrame:
    row = _screen(spark, folder).where(F.col("feature") == "Brand#7")
    return rounded(row.select("feature", "rank", "eligible_rank", "eligible_n", "rank_sum_p"))


@add("screen_volcano", SCREEN + final("""SELECT feature, delta_median, -log10(greatest(rank_sum_fdr, 1e-300)) AS minus_log10_fdr,
   CASE WHEN rank_sum_fdr < 0.5 AND delta_median < 0 THEN 'lower' WHEN rank_sum_fdr < 0.5 AND delta_median > 0 THEN 'higher' ELSE 'not significant' END AS direction,
   feature = 'Brand#7' OR eligible_rank <= 8 AS labelled FROM s""", ["feature", "direction", "labelled"], [], ["delta_median", "minus_log10_fdr"]))
def screen_volcano(spark: SparkSession, folder: str) -> DataFrame:
    out = _screen(spark, folder).select(
        "feature", "delta_median", minus_log10("rank_sum_fdr").alias("minus_log10_fdr"),
        significance_label("rank_sum_fdr", "delta_median", 0.5).alias("direction"),
        ((F.col("feature") == "Brand#7") | (F.col("eligible_rank") <= 8)).alias("labelled"),
    )
    return rounded(out)


@add("screen_gate", f"""WITH {M}, {DRV}, c AS (SELECT count(*) FILTER (WHERE level_log < -10) AS n_low, count(*) FILTER (WHERE NOT level_log < -10) AS n_other
   FROM drv WHERE level_log IS NOT NULL AND entity IN (SELECT entity FROM m))
   SELECT CAST(n_low AS BIGINT) AS n_low, CAST(n_other AS BIGINT) AS n_other, CASE WHEN n_low < 3 OR n_other < 3 THEN 'SKIPPED' ELSE 'computed' END AS status,
   CAST(0 AS BIGINT) AS n_result FROM c""")
def screen_gate(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    status, result = screens.gated_screen(long_matrix(t), driver(t), "level_log", screens.low_group(cutoff=-10))
    return rounded(status.withColumn("n_result", result.agg(F.count(F.lit(1))).scalar()))


@add("screen_group_counts", f"""WITH {M}, {DRV} SELECT count(*) FILTER (WHERE level_log < 0.585) AS n_low, count(*) FILTER (WHERE NOT level_log < 0.585) AS n_other
   FROM drv WHERE level_log IS NOT NULL AND entity IN (SELECT entity FROM m)""")
def screen_group_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return screens.group_counts(long_matrix(t), driver(t), "level_log", screens.low_group())


@add("untested_rows", f"""WITH {M}, {DRV}, r AS (SELECT feature, value AS y, level_log < -0.25 AS low FROM m JOIN drv USING (entity) WHERE level_log IS NOT NULL),
   e AS (SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p FROM ({effects_sql('r', 'feature', 3)})), f AS ({bh_sql('e', 'rank_sum_p', 'rank_sum_fdr')}),
   s AS (SELECT *, row_number() OVER (ORDER BY rank_sum_fdr NULLS FIRST, delta_median NULLS FIRST, feature) AS rank FROM f)
   SELECT count(*) FILTER (WHERE rank_sum_fdr IS NULL) AS n_untested,
   count(*) FILTER (WHERE rank_sum_fdr IS NULL AND rank < (SELECT rank FROM s WHERE feature = 'Brand#7')) AS n_untested_before FROM s""")
def untested_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    screen = screens.feature_screen(prepared_matrix(t), driver(t), "level_log", screens.low_group(cutoff=-0.25))
    return untested_before(screen, "rank_sum_fdr", "rank", "feature", "Brand#7")


@add("spearman_by_feature", f"WITH {M}, {DRV}, {JOINED} " + final(correlation_sql("r", "feature", 3), ["feature"], ["n"], ["pearson_r", "pearson_p", "spearman_rho", "spearman_p"]))
def spearman_by_feature(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = prepared_matrix(t).join(driver(t), "entity")
    return rounded(stats.pair_correlations(rows, ["feature"], "level_log", "value"))


COVARIATION = f"""WITH {M}, r AS (SELECT m.feature, d.value AS x, m.value AS y FROM m JOIN m AS d ON m.entity = d.entity AND d.feature = 'Brand#1'),
  c AS (SELECT feature, count(*) AS n, CASE WHEN feature = 'Brand#1' THEN 1.0 WHEN count(*) >= 10 THEN corr(x, y) END AS pearson_r FROM r GROUP BY feature),
  p AS (SELECT *, CASE WHEN abs(pearson_r) < 1 THEN {t_p('(pearson_r * sqrt((n - 2) / (1 - pearson_r * pearson_r)))', '(n - 2)')} END AS pearson_p FROM c),
  f AS ({bh_sql('p', 'pearson_p', 'fdr')}) """


@add("covariation", COVARIATION + final("SELECT * FROM f", ["feature"], ["n"], ["pearson_r", "pearson_p", "fdr"]))
def covariation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screens.covariation(prepared_matrix(Tables(spark, folder)), "Brand#1"))


@add("covariation_top", COVARIATION + final("""SELECT feature, pearson_r, CASE WHEN pearson_r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM f
   WHERE feature <> 'Brand#1' AND pearson_r <> 0 QUALIFY row_number() OVER (PARTITION BY pearson_r > 0 ORDER BY abs(pearson_r) DESC, feature) <= 5""",
   ["feature", "direction"], [], ["pearson_r"]))
def covariation_top(spark: SparkSession, folder: str) -> DataFrame:
    all_rows = screens.covariation(prepared_matrix(Tables(spark, folder)), "Brand#1")
    return rounded(top_correlations(all_rows, "pearson_r", "feature", "Brand#1", 5, "positive", "negative").select("feature", "direction", "pearson_r"))


@add("bh_family", f"""WITH {M}, {DRV}, r AS (SELECT stratum, feature, value AS y, level_log < 0.585 AS low FROM m JOIN drv USING (entity) WHERE level_log IS NOT NULL),
   e AS (SELECT *, {normal_p('rank_sum_z')} AS p FROM ({effects_sql('r', 'stratum, feature')})), f AS ({bh_sql('e', 'p', 'fdr', 'stratum')}) """
   + final("SELECT * FROM f", ["stratum", "feature"], [], ["p", "fdr"]))
def bh_family(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = prepared_matrix(t).join(driver(t), "entity").where("level_log is not null")
    effects = stats.group_effects(rows, ["stratum", "feature"], "value", {"low": stats.split(screens.low_group())})
    table = ResultTable(effects.select("stratum", "feature", F.col("rank_sum_p").alias("p")), ["feature"], ["stratum"])
    return rounded(table.adjust("p", "fdr").frame)


@add("eligible_rank", f"""WITH {M}, {DRV}, r AS (SELECT stratum, feature, value AS y, level_log < 0.585 AS low FROM m JOIN drv USING (entity) WHERE level_log IS NOT NULL),
   e AS ({effects_sql('r', 'stratum, feature')}) """ + final("""SELECT stratum, feature,
     CASE WHEN delta_median <> 0 THEN row_number() OVER (PARTITION BY stratum, delta_median <> 0 ORDER BY delta_median, feature) END AS place,
     count(*) FILTER (WHERE delta_median <> 0) OVER (PARTITION BY stratum) AS n_ranked FROM e""", ["stratum", "feature"], ["n_ranked"], ["place"]))
def eligible_rank(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = prepared_matrix(t).join(driver(t), "entity").where("level_log is not null")
    effects = stats.group_effects(rows, ["stratum", "feature"], "value", {"low": stats.split(screens.low_group())})
    table = ResultTable(effects.select("stratum", "feature", "delta_median"), ["feature"], ["stratum"])
    ranked = table.rank("place", [F.col("delta_median")], F.col("delta_median") != 0, "n_ranked").frame
    return rounded(ranked.select("stratum", "feature", F.col("place").cast("double").alias("place"), "n_ranked"))


PAIR = f"pr AS (SELECT entity, level, level_log AS x, value AS y, level_log < 0.585 AS low, stratum, 1 AS k FROM drv JOIN m USING (entity) WHERE feature = 'Brand#7' AND level_log IS NOT NULL)"
CORR_COLUMNS = ["pearson_r", "pearson_p", "spearman_rho", "spearman_p"]


def _pair(t: Tables, feature: str = "Brand#7") -> DataFrame:
    return screens.matched_pair(driver(t), long_matrix(t).where(F.col("feature") == feature))


@add("pair_targeted", f"WITH {M}, {DRV}, {PAIR}, raw AS (SELECT k, level AS x, y FROM pr) " + final(f"""SELECT * FROM ({correlation_sql('pr', 'k', 3)})
   JOIN ({correlation_sql('raw', 'k', 3, 'level_')}) AS l USING (k) JOIN (SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p FROM ({effects_sql('pr', 'k')})) USING (k)""".replace("SELECT * FROM (SELECT k, n", "SELECT * EXCLUDE (n_1) FROM (SELECT k, n", 0),
   [], ["n", *EFFECT_INTS], [*CORR_COLUMNS, *[f"level_{c}" for c in CORR_COLUMNS], *EFFECT_FLOATS, "rank_sum_p"]).replace("CAST(n AS BIGINT)", "CAST(n_low + n_other AS BIGINT)"))
def pair_targeted(spark: SparkSession, folder: str) -> DataFrame:
    out = screens.targeted_statistics(_pair(Tables(spark, folder)))
    return rounded(out.select("n", *EFFECT_INTS, *CORR_COLUMNS, *[f"level_{c}" for c in CORR_COLUMNS], *EFFECT_FLOATS, "rank_sum_p"))


@add("reverse_pair", f"""WITH {M}, a AS (SELECT entity, value / 100.0 AS level FROM m WHERE feature = 'Brand#1'), b AS (SELECT entity, value / 100.0 AS level FROM m WHERE feature = 'Brand#2'),
   pr AS (SELECT 'forward' AS direction, log2(a.level + 1) AS x, b.level * 100 AS y, log2(a.level + 1) < 0.585 AS low FROM a JOIN b USING (entity)
     UNION ALL SELECT 'reverse', log2(b.level + 1), a.level * 100, log2(b.level + 1) < 0.585 FROM a JOIN b USING (entity)) """ + final(
   f"SELECT c.*, e.* EXCLUDE (direction) FROM ({correlation_sql('pr', 'direction', 3)}) c JOIN (SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p FROM ({effects_sql('pr', 'direction')})) e USING (direction)",
   ["direction"], ["n"], [*CORR_COLUMNS, "delta_median", "rank_sum_p"]))
def reverse_pair(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    # written once: both directions check and join both features
    matrix = materialize(long_matrix(t).where(F.col("feature").isin("Brand#1", "Brand#2")), "matrix")
    a, b = (matrix.where(F.col("feature") == b).select("entity", (F.col("value") / 100).alias("level"), "value") for b in ("Brand#1", "Brand#2"))
    out = screens.both_directions(screens.matched_pair(a, b), screens.matched_pair(b, a))
    return rounded(out.select("direction", "n", *CORR_COLUMNS, "delta_median", "rank_sum_p"))


TIER = "CASE WHEN x < 0.35 THEN 'Deep Low' WHEN x < 0.585 THEN 'Shallow Low' ELSE 'Non-Low' END"


@add("three_group", f"""WITH {M}, {DRV}, {PAIR}, g AS (SELECT y, {TIER} AS tier FROM pr),
   q(group1, group2) AS (VALUES ('Non-Low', 'Shallow Low'), ('Non-Low', 'Deep Low'), ('Shallow Low', 'Deep Low')),
   r AS (SELECT group1, group2, y, tier = group1 AS low FROM g JOIN q ON tier = group1 OR tier = group2),
   e AS (SELECT *, {normal_p('rank_sum_z')} AS p FROM ({effects_sql('r', 'group1, group2')})), f AS ({bh_sql('e', 'p', 'fdr')}) """ + final(
   "SELECT *, n_low AS n1, n_other AS n2 FROM f", ["group1", "group2"], ["n1", "n2"], ["rank_sum_w", "rank_sum_z", "p", "fdr"]))
def three_group(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screens.three_group_tests(_pair(Tables(spark, folder))))


@add("threshold_sensitivity", f"""WITH {M}, {DRV}, {PAIR}, r AS (SELECT threshold, y, x < threshold AS low FROM pr, (SELECT unnest([0.585, 0.5, 0.4, 0.35]::DOUBLE[]) AS threshold)),
   e AS (SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p FROM ({effects_sql('r', 'threshold')})), f AS ({bh_sql('e', 'rank_sum_p', 'rank_sum_fdr')}) """ + final(
   "SELECT * FROM f", ["eligible"], EFFECT_INTS, ["threshold", *EFFECT_FLOATS, "rank_sum_p", "rank_sum_fdr"]))
def threshold_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    out = screens.threshold_sensitivity(_pair(Tables(spark, folder)), "level_log", "target")
    return rounded(out.select("threshold", "eligible", *EFFECT_INTS, *EFFECT_FLOATS, "rank_sum_p", "rank_sum_fdr"))


@add("quantile_groups", f"""WITH {M}, {DRV}, {PAIR}, c AS (SELECT quantile, (SELECT quantile_cont(x, quantile) FROM pr) AS cutoff FROM (SELECT unnest([0.1, 0.2]::DOUBLE[]) AS quantile)),
   c2 AS (SELECT 0.1::DOUBLE AS quantile, quantile_cont(x, 0.1) AS cutoff FROM pr UNION ALL SELECT 0.2, quantile_cont(x, 0.2) FROM pr),
   r AS (SELECT quantile, cutoff, y, x <= cutoff AS low FROM pr, c2),
   e AS (SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p FROM ({effects_sql('r', 'quantile, cutoff')})), f AS ({bh_sql('e', 'rank_sum_p', 'rank_sum_fdr')}) """.replace("c AS (SELECT quantile, (SELECT quantile_cont(x, quantile) FROM pr) AS cutoff FROM (SELECT unnest([0.1, 0.2]::DOUBLE[]) AS quantile)),\n   ", "") + final(
   "SELECT * FROM f", ["eligible"], EFFECT_INTS, ["quantile", "cutoff", *EFFECT_FLOATS, "rank_sum_p", "rank_sum_fdr"]))
def quantile_groups(spark: SparkSession, folder: str) -> DataFrame:
    out = screens.quantile_groups(_pair(Tables(spark, folder)), "level_log", "target")
    return rounded(out.select("quantile", "cutoff", "eligible", *EFFECT_INTS, *EFFECT_FLOATS, "rank_sum_p", "rank_sum_fdr"))


@add("quantile_screen", f"""WITH {M}, {DRV}, c AS (SELECT 0.1::DOUBLE AS quantile, quantile_cont(level_log, 0.1) AS cutoff FROM drv UNION ALL SELECT 0.2, quantile_cont(level_log, 0.2) FROM drv),
   j AS (SELECT feature, value AS y, level_log AS x FROM m JOIN drv USING (entity) WHERE level_log IS NOT NULL),
   r AS (SELECT feature, quantile, y, x <= cutoff AS low FROM j, c), e AS (SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p FROM ({effects_sql('r', 'feature, quantile')})),
   f AS ({bh_sql('e', 'rank_sum_p', 'rank_sum_fdr', 'quantile')}), k AS ({correlation_sql('j', 'feature', 3)}), kf AS ({bh_sql('k', 'pearson_p', 'pearson_fdr')}) """ + final(
   "SELECT * FROM f JOIN kf USING (feature)", ["feature"], ["n", *EFFECT_INTS], ["quantile", "median_low", "median_other", "delta_median", "rank_sum_p", "rank_sum_fdr", "pearson_r", "spearman_rho", "pearson_fdr"]))
def quantile_screen(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    out = screens.quantile_screen(prepared_matrix(t), driver(t), "level_log")
    return rounded(out.select("feature", "n", *EFFECT_INTS, "quantile", "median_low", "median_other", "delta_median", "rank_sum_p", "rank_sum_fdr", "pearson_r", "spearman_rho", "pearson_fdr"))


@add("chained_correlations", f"""WITH {M}, {DRV}, mid AS (SELECT entity, value FROM m WHERE feature = 'Brand#3'), tgt AS (SELECT entity, value FROM m WHERE feature = 'Brand#7'),
   r AS (SELECT 'driver vs middle' AS analysis, level AS x, value AS y FROM drv JOIN mid USING (entity)
     UNION ALL SELECT 'middle vs target', mid.value, tgt.value FROM mid JOIN tgt USING (entity)) """ + final(correlation_sql("r", "analysis", 3), ["analysis"], ["n"], CORR_COLUMNS))
def chained_correlations(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    matrix = long_matrix(t)
    middle, target = (matrix.where(F.col("feature") == b).select("entity", "value") for b in ("Brand#3", "Brand#7"))
    return rounded(screens.chained_correlations(driver(t), middle, target))


@add("representative_correlation", """WITH rep AS (SELECT o_custkey AS entity, o_totalprice AS y FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) = 1),
   r AS (SELECT 1 AS k, c_acctbal AS x, y FROM customer JOIN rep ON entity = c_custkey) """ + final(correlation_sql("r", "k", 3), [], ["n"], CORR_COLUMNS))
def representative_correlation(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    candidates = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("aliquot"), F.col("o_orderkey").alias("file_id"), F.col("o_totalprice").alias("value"))
    wish = t.customer.select(F.col("c_custkey").alias("entity"), F.lit("F").alias("aliquot"))
    chosen = pick_representatives(candidates, wish, "entity", "aliquot", "file_id")
    values = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("value"))
    return rounded(screens.representative_correlation(values, chosen, "entity", "value"))


@add("target_row_differences", f"WITH {M} SELECT DISTINCT feature, 'delta_mean' AS \"column\" FROM m WHERE feature = 'Brand#7'")
def target_row_differences(spark: SparkSession, folder: str) -> DataFrame:
    """The screen's row of a target against the pair's own statistics: only the column that is put off here differs."""
    t = Tables(spark, folder)
    screen = _screen(spark, folder).withColumn("delta_mean", F.col("delta_mean") + 0.001)
    return screens.target_row_differences(screen, screens.targeted_statistics(_pair(t)), "Brand#7")


# one flag per user and event type; users are matched to customers by key
FLAGS = """fl AS (SELECT user_id AS entity, event_type AS definition, CASE WHEN avg(value) > 50 THEN 1.0 ELSE 0.0 END AS value FROM events GROUP BY 1, 2)"""
# means of a few decimals meet the threshold exactly; the order of a sum must not decide then
EXACT_FLAGS = FLAGS.replace("avg(value)", "round(avg(value), 9)")
WANTED = ["click", "error", "purchase", "view", "hotspot"]


@add("mutation_groups", f"""WITH {M}, {EXACT_FLAGS}, tg AS (SELECT entity, value AS y FROM m WHERE feature = 'Brand#7'), r AS (SELECT definition, y, fl.value > 0 AS low FROM fl JOIN tg USING (entity)),
   e AS (SELECT *, {normal_p('rank_sum_z')} AS p FROM ({effects_sql('r', 'definition')}) WHERE eligible), f AS ({bh_sql('e', 'p', 'fdr')}) """ + final(
   "SELECT *, n_low AS n_mutant, n_other AS n_wt, median_low AS median_mutant, median_other AS median_wt FROM f",
   ["definition"], ["n_mutant", "n_wt"], ["median_mutant", "median_wt", "delta_median", "rank_sum_z", "p", "fdr"]))
def mutation_groups(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return rounded(screens.mutation_comparison(_flags(t), long_matrix(t).where("feature = 'Brand#7'"), WANTED)[0])


def _flags(t: Tables) -> DataFrame:
    flag = F.when(F.round(F.avg("value"), 9) > 50, 1.0).otherwise(0.0)
    return t.events.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("definition")).agg(flag.alias("value"))


@add("mutation_skipped", f"""WITH {M}, {FLAGS}, tg AS (SELECT entity, value AS y FROM m WHERE feature = 'Brand#7'), r AS (SELECT definition, y, fl.value > 0 AS low FROM fl JOIN tg USING (entity)),
   w AS (SELECT unnest(['click', 'error', 'purchase', 'view', 'hotspot']) AS definition), c AS (SELECT definition, count(*) FILTER (WHERE low) AS a, count(*) FILTER (WHERE NOT low) AS b FROM r GROUP BY 1)
   SELECT definition, CASE WHEN a IS NULL THEN definition || ' absent; state unknown' ELSE definition || ' insufficient groups: mutant ' || a || ' WT ' || b END AS reason
   FROM w LEFT JOIN c USING (definition) WHERE a IS NULL OR a < 3 OR b < 3""")
def mutation_skipped(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return screens.mutation_comparison(_flags(t), long_matrix(t).where("feature = 'Brand#7'"), WANTED)[1]


# ---- strata and models --------------------------------------------------------------

NATION = """nat AS (SELECT c_custkey AS entity, n_name AS stratum FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
NPAIR = f"""np AS (SELECT nat.stratum, level_log AS x, value AS y, level, level_log < 0.585 AS low FROM drv JOIN m USING (entity) JOIN nat USING (entity) WHERE feature = 'Brand#7' AND level_log IS NOT NULL)"""


def _nation_pair(t: Tables) -> DataFrame:
    nation = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    names = nation.select(F.col("c_custkey").alias("entity"), F.col("n_name").alias("stratum"))
    return _pair(t).join(names, "entity")


@add("stratum_correlations", f"""WITH {M}, {DRV}, {NATION}, {NPAIR}, k AS ({correlation_sql('np', 'stratum', 20)}), f1 AS ({bh_sql('k', 'pearson_p', 'pearson_fdr')}), f2 AS ({bh_sql('f1', 'spearman_p', 'spearman_fdr')}),
   md AS (SELECT stratum, median(x) AS x_median, median(y) AS y_median FROM np GROUP BY 1) """ + final("""SELECT *, n >= 20 AND pearson_r IS NOT NULL AS eligible,
     tanh(atanh(pearson_r) - 1.959963984540054 / sqrt(n - 3)) AS ci_low, tanh(atanh(pearson_r) + 1.959963984540054 / sqrt(n - 3)) AS ci_high FROM f2 JOIN md USING (stratum)""",
   ["stratum", "eligible"], ["n"], [*CORR_COLUMNS, "x_median", "y_median", "ci_low", "ci_high", "pearson_fdr", "spearman_fdr"]))
def stratum_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screens.stratum_correlations(_nation_pair(Tables(spark, folder)), "stratum", "level_log", "target"))


@add("listed_strata", f"""WITH {M}, {DRV}, {NATION}, {NPAIR}, nz AS (SELECT * FROM np WHERE low), k AS ({correlation_sql('nz', 'stratum', 20)}),
   l AS (SELECT n_name AS stratum FROM nation UNION ALL SELECT r_name FROM region), md AS (SELECT stratum, median(x) AS x_median FROM nz GROUP BY 1),
   j AS (SELECT l.stratum, coalesce(n, 0) AS n, pearson_r, pearson_p, spearman_rho, spearman_p, x_median FROM l LEFT JOIN k USING (stratum) LEFT JOIN md USING (stratum)),
   f1 AS ({bh_sql('j', 'pearson_p', 'pearson_fdr')}), f2 AS ({bh_sql('f1', 'spearman_p', 'spearman_fdr')}) """ + final("""SELECT *, CASE WHEN n < 20 THEN 'Insufficient N for correlation'
     WHEN pearson_r IS NULL THEN 'Constant driver or outcome; correlation unavailable' ELSE 'Eligible' END AS status FROM f2""",
   ["stratum", "status"], ["n"], [*CORR_COLUMNS, "x_median", "pearson_fdr", "spearman_fdr"]))
def listed_strata(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    names = t.nation.select(F.col("n_name").alias("stratum")).unionByName(t.region.select(F.col("r_name").alias("stratum")))
    low = _nation_pair(t).where("level_group = 'Low'")
    return rounded(screens.listed_stratum_correlations(low, names, "stratum", "level_log", "target"))


@add("stratum_eligibility", f"""WITH {M}, {DRV}, {NATION}, {NPAIR} SELECT stratum, count(*) FILTER (WHERE low) AS n_low, count(*) FILTER (WHERE NOT low) AS n_other,
   count(*) FILTER (WHERE low) >= 12 AND count(*) FILTER (WHERE NOT low) >= 12 AS eligible FROM np GROUP BY 1""")
def stratum_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    return screens.stratum_eligibility(_nation_pair(Tables(spark, folder)), "stratum", screens.low_group(), 12)


@add("stratified_effects", f"""WITH {M}, {DRV}, {NATION}, {NPAIR}, e AS (SELECT *, {normal_p('rank_sum_z')} AS rank_sum_p FROM ({effects_sql('np', 'stratum')}) WHERE eligible), f AS ({bh_sql('e', 'rank_sum_p', 'fdr')}) """
   + final("SELECT * FROM f", ["stratum"], EFFECT_INTS, ["median_low", "median_other", "delta_median", "rank_sum_p", "fdr"]))
def stratified_effects(spark: SparkSession, folder: str) -> DataFrame:
    out = screens.stratified_effects(_nation_pair(Tables(spark, folder)), "stratum", screens.low_group())
    return rounded(out.select("stratum", *EFFECT_INTS, "median_low", "median_other", "delta_median", "rank_sum_p", "fdr"))


@add("bootstrap_ci")  # seeded resampling has no SQL counterpart
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bootstrap_median_difference(_nation_pair(Tables(spark, folder)), "stratum", "target", screens.low_group()))


def coefficient_sql(rows: str, x: str, term: str) -> str:
    return f"""SELECT * FROM (WITH g AS (SELECT stratum, count(*) AS n, avg({x}) AS mx, avg(y) AS my, regr_sxx(y, {x}) AS sxx, regr_syy(y, {x}) AS syy, regr_sxy(y, {x}) AS sxy FROM {rows} GROUP BY 1),
      t AS (SELECT sum(sxx) AS sxx, sum(sxy) / sum(sxx) AS b, sum(n) - count(*) - 1 AS df, (sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*) - 1) AS s2, min(stratum) AS ref FROM g),
      r AS (SELECT g.* FROM g, t WHERE stratum = ref),
      c AS (SELECT '{term}' AS term, b AS estimate, sqrt(s2 / sxx) AS std_error, df FROM t
        UNION ALL SELECT '(Intercept)', r.my - b * r.mx, sqrt(s2 * (1.0 / r.n + r.mx * r.mx / t.sxx)), df FROM r, t
        UNION ALL SELECT 'stratum=' || g.stratum, (g.my - b * g.mx) - (r.my - b * r.mx), sqrt(s2 * (1.0 / g.n + 1.0 / r.n + (g.mx - r.mx) * (g.mx - r.mx) / t.sxx)), df FROM g, r, t WHERE g.stratum <> t.ref)
      SELECT term, estimate, std_error, estimate / std_error AS statistic, {t_p('(estimate / std_error)', 'df')} AS p FROM c)"""


COEF = ["estimate", "std_error", "statistic", "p"]


@add("adjusted_coefficients", f"WITH {M}, {DRV}, {NATION}, {NPAIR} " + final(coefficient_sql("np", "x", "driver"), ["term"], [], COEF))
def adjusted_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.adjusted_coefficients(_nation_pair(Tables(spark, folder)), "level_log", "target", "stratum"))


@add("adjusted_coefficients_low", f"WITH {M}, {DRV}, {NATION}, {NPAIR}, nb AS (SELECT stratum, y, CASE WHEN low THEN 1.0 ELSE 0.0 END AS x FROM np) " + final(coefficient_sql("nb", "x", "low"), ["term"], [], COEF))
def adjusted_coefficients_low(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.adjusted_coefficients(_nation_pair(Tables(spark, folder)), screens.low_group().cast("double"), "target", "stratum", "low"))


@add("pooled_standardised", f"""WITH {M}, {DRV}, {NATION}, {NPAIR}, ns AS (SELECT stratum, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM np) """
   + final(f"SELECT *, (SELECT count(*) FROM ns) AS n FROM ({coefficient_sql('ns', 'x', 'driver')})", ["term"], ["n"], COEF))
def pooled_standardised(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.pooled_model(_nation_pair(Tables(spark, folder)), "level_log", "target", "stratum", standardised=True)[1])


@add("pooled_status", f"""WITH {M}, {DRV}, {NATION}, {NPAIR} SELECT count(*) AS n, '' AS reason, true AS eligible FROM np""")
def pooled_status(spark: SparkSession, folder: str) -> DataFrame:
    return models.pooled_model(_nation_pair(Tables(spark, folder)), "level_log", "target", "stratum")[0]


def _slope_sql(x: str, name: str) -> str:
    return f"""sum(n) AS n, sum({name}xy) / sum({name}xx) AS beta_{x}, sqrt((sum(syy) - sum({name}xy) * sum({name}xy) / sum({name}xx)) / (sum(n) - count(*) - 1) / sum({name}xx)) AS se_{x}"""


ADJUSTED = f"""WITH {M}, {DRV}, {JOINED}, q AS (SELECT *, CASE WHEN low THEN 1.0 ELSE 0.0 END AS b FROM r),
   g AS (SELECT feature, stratum, count(*) AS n, regr_syy(y, x) AS syy, regr_sxx(y, x) AS cxx, regr_sxy(y, x) AS cxy, regr_sxx(y, b) AS bxx, regr_sxy(y, b) AS bxy FROM q GROUP BY 1, 2),
   a AS (SELECT feature, count(*) AS groups, {_slope_sql('driver', 'c')}, {_slope_sql('low', 'b').replace('sum(n) AS n, ', '', 1)} FROM g GROUP BY 1),
   p AS (SELECT *, beta_driver / se_driver AS t_driver, beta_low / se_low AS t_low, {t_p('(beta_driver / se_driver)', '(n - groups - 1)')} AS p_driver, {t_p('(beta_low / se_low)', '(n - groups - 1)')} AS p_low FROM a),
   f1 AS ({bh_sql('p', 'p_driver', 'fdr_driver')}), f2 AS ({bh_sql('f1', 'p_low', 'fdr_low')}) """


@add("adjusted_screen", ADJUSTED + final("""SELECT *, 'completed' AS continuous_status, 'completed' AS binary_status, '' AS skip_reason, count(fdr_driver) OVER () AS eligible_n,
     row_number() OVER (ORDER BY fdr_driver, beta_driver, feature) AS eligible_rank FROM f2""", ["feature", "continuous_status", "binary_status", "skip_reason"], ["n", "eligible_n", "eligible_rank"],
   ["beta_driver", "se_driver", "t_driver", "p_driver", "beta_low", "se_low", "t_low", "p_low", "fdr_driver", "fdr_low"]))
def adjusted_screen(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return rounded(screens.ranked_adjusted_screen(long_matrix(t), driver(t), "level_log", "stratum", screens.low_group()))


# ---- building blocks ----------------------------------------------------------------


@add("tail_probabilities", f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - 25.0) / 12.0 AS z, l_suppkey + 2 AS df FROM lineitem), d AS (SELECT DISTINCT z, df FROM v) """
   + final(f"SELECT z, df, {normal_p('z')} AS p_normal, {t_p('z', 'df')} AS p_t FROM d", [], ["df"], ["z", "p_normal", "p_t"]))
def tail_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    v = Tables(spark, folder).lineitem.select(((F.col("l_quantity") - 25.0) / 12.0).alias("z"), (F.col("l_suppkey") + 2).alias("df")).distinct()
    return rounded(v.select("z", "df", normal_two_sided("z").alias("p_normal"), t_two_sided("z", "df").alias("p_t")))


@add("average_ranks", "SELECT l_returnflag, l_quantity, CAST(min(rk) AS DOUBLE) AS rank FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rk FROM lineitem) GROUP BY 1, 2")
def average_rank_query(spark: SparkSession, folder: str) -> DataFrame:
    return average_ranks(Tables(spark, folder).lineitem, ["l_returnflag"], "l_quantity", "rank")


@add("group_summary", final("SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, median(l_extendedprice) AS median, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1", ["l_returnflag"], ["n"], ["mean", "median", "sd"]).replace(", 6)", ", 4)"))
def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.group_summary(Tables(spark, folder).lineitem, ["l_returnflag"], "l_extendedprice"), 4)


@add("five_numbers", final("""SELECT l_suppkey, count(*) AS n, min(l_extendedprice) AS q0, quantile_cont(l_extendedprice, 0.25) AS q25, median(l_extendedprice) AS q50,
   quantile_cont(l_extendedprice, 0.75) AS q75, max(l_extendedprice) AS q100 FROM lineitem GROUP BY 1""", ["l_suppkey"], ["n"], ["q0", "q25", "q50", "q75", "q100"]).replace(", 6)", ", 4)"))
def five_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.five_numbers(Tables(spark, folder).lineitem, ["l_suppkey"], "l_extendedprice"), 4)


@add("exact_quantiles", final("SELECT count(*) AS n, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.99) AS q99, max(value) AS high FROM events WHERE isfinite(value)", [], ["n"], ["q10", "q50", "q99", "high"]))
def exact_quantile_query(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(exact_quantiles(Tables(spark, folder).events, [], "value", {"q10": 0.1, "q50": 0.5, "q99": 0.99, "high": 1.0}))


@add("linear_fit", f"WITH {M}, {DRV}, {JOINED} " + final("SELECT feature, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM r GROUP BY 1", ["feature"], ["n"], ["slope", "intercept"]))
def linear_fit(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return rounded(stats.linear_fit(long_matrix(t).join(driver(t), "entity"), ["feature"], "level_log", "value"))


@add("histogram", f"""WITH v AS (SELECT c_acctbal AS x FROM customer), s AS (SELECT min(x) AS lo, max(x) AS hi FROM v), b AS (SELECT unnest(range(0, 50)) AS bin),
   c AS (SELECT least(CAST(floor((x - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin, count(*) AS n FROM v, s GROUP BY 1) """
   + final("SELECT bin, lo + (hi - lo) / 50 * bin AS bin_from, lo + (hi - lo) / 50 * (bin + 1) AS bin_to, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin), s", [], ["bin", "n"], ["bin_from", "bin_to"]))
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.histogram(Tables(spark, folder).customer, "c_acctbal"))


@add("finite_counts", f"WITH {DRV}, x AS (SELECT stratum, CASE WHEN level > 0 THEN log2(level) END AS v FROM drv) SELECT stratum, count(*) AS n_rows, count(v) AS n_finite FROM x GROUP BY 1")
def finite_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = driver(Tables(spark, folder)).withColumn("v", F.log2("level"))
    return stats.finite_counts(d, ["stratum"], "v")


@add("standardised_pair", f"WITH {DRV} " + final("SELECT entity, (level - avg(level) OVER ()) / stddev_samp(level) OVER () AS level, (level_log - avg(level_log) OVER ()) / stddev_samp(level_log) OVER () AS level_log FROM drv WHERE level_log IS NOT NULL", ["entity"], [], ["level", "level_log"]))
def standardised_pair(spark: SparkSession, folder: str) -> DataFrame:
    d = finite_pairs(driver(Tables(spark, folder)), "level", "level_log").select("entity", "level", "level_log")
    return rounded(models.standardise(d, "level", "level_log"))
