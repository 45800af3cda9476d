"""Statistics against brute force on small frames, on both the small and the sliced path."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assocgrid.operators.bootstrap import bootstrap_median_difference, median_positions
from assocgrid.operators.ordered import average_ranks, exact_quantiles
from assocgrid.operators.results import ResultTable, adjust_window
from assocgrid.operators.stats import group_effects, linear_fit, pair_correlations, pearson, split
from assocgrid.plans import screens


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def brute_rank_sum(a, b):
    both = np.concatenate([a, b])
    ranks = pd.Series(both).rank().to_numpy()
    n1, n2 = len(a), len(b)
    w = ranks[:n1].sum() - n1 * (n1 + 1) / 2
    _, counts = np.unique(both, return_counts=True)
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - (counts**3 - counts).sum() / (n * (n - 1)))
    d = w - n1 * n2 / 2
    return w, (None if variance <= 0 else (d - np.sign(d) * 0.5) / math.sqrt(variance))


def brute_bh(p):
    p = np.asarray(p, dtype=float)
    out = np.full(p.shape, np.nan)
    ok = np.flatnonzero(~np.isnan(p))
    order = ok[np.argsort(-p[ok], kind="stable")]
    running, m = 1.0, len(ok)
    for place, i in enumerate(order):
        running = min(running, p[i] * m / (m - place))
        out[i] = running
    return out


def test_group_effects_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(list("abc"), 400), "x": rng.normal(size=400).round(1), "y": rng.normal(size=400).round(1) * 100})
    pdf.loc[:4, "y"] = [np.nan, np.inf, -np.inf, np.nan, 1e9]
    df = spark.createDataFrame(pdf)
    got = group_effects(df, ["k"], "y", {"low": split(F.col("x") < 0.2)}, x="x").toPandas().set_index("k")
    for k, part in pdf[np.isfinite(pdf.y)].groupby("k"):
        a, b = part.y[part.x < 0.2].to_numpy(), part.y[part.x >= 0.2].to_numpy()
        w, z = brute_rank_sum(a, b)
        row = got.loc[k]
        assert (row.n_low, row.n_other) == (len(a), len(b))
        assert row.rank_sum_w == w and math.isclose(row.rank_sum_z, z, rel_tol=1e-12)
        assert math.isclose(row.median_low, np.median(a), abs_tol=1e-9) and math.isclose(row.median_other, np.median(b), abs_tol=1e-9)
        assert math.isclose(row.mean_low, a.mean(), rel_tol=1e-12)
        assert math.isclose(row.pearson_r, np.corrcoef(part.x, part.y)[0, 1], rel_tol=1e-10)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 2)), min_size=1, max_size=60))
def test_quantiles_and_ranks_of_any_values(spark, values):
    df = frame(spark, [("g", float(v)) for v in values], "k string, v double")
    q = exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.975}).first()
    for name, level in (("a", 0.1), ("b", 0.5), ("c", 0.975)):
        assert math.isclose(q[name], np.quantile(values, level), rel_tol=1e-9, abs_tol=1e-7)
    ranks = {r["v"]: r["rank"] for r in average_ranks(df, ["k"], "v", "rank").collect()}
    expected = pd.Series(values).rank()
    assert all(math.isclose(ranks[v + 0.0], r) for v, r in zip(values, expected))


def test_one_hot_key_and_one_hot_value(spark):
    """A key with most rows and a value with a third of them give the brute-force answer."""
    rng = np.random.default_rng(8)
    values = np.where(rng.random(9000) < 0.4, 0.0, rng.normal(size=9000))
    keys = np.where(rng.random(9000) < 0.9, "hot", "cold")
    pdf = pd.DataFrame({"k": keys, "x": rng.normal(size=9000).round(2), "y": values})
    got = pair_correlations(spark.createDataFrame(pdf), ["k"], "x", "y").toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert math.isclose(got.loc[k].spearman_rho, part.x.rank().corr(part.y.rank()), rel_tol=1e-9)
        assert math.isclose(got.loc[k].pearson_r, part.x.corr(part.y), rel_tol=1e-9)


def test_perfect_and_constant_correlations(spark):
    rows = [(float(i), 2.0 * i, -float(i), 5.0) for i in range(12)]
    df = frame(spark, rows, "x double, up double, down double, flat double")
    up = pair_correlations(df, [], "x", "up").first()
    assert up["pearson_r"] == 1 and up["pearson_p"] == 0 and up["spearman_rho"] == 1
    assert pearson(df, [], "x", "down").first()["pearson_r"] == -1
    assert pearson(df, [], "x", "down").first()["pearson_p"] is None
    flat = pair_correlations(df, [], "x", "flat").first()
    assert flat["pearson_r"] is None and flat["spearman_p"] is None
    assert linear_fit(df, [], "flat", "x").first()["slope"] is None



def test_adjustment_and_ranks(spark):
    rng = np.random.default_rng(5)
    p = np.where(rng.random(300) < 0.3, np.nan, rng.random(300).round(2))
    p[:40] = 1.0
    family = rng.choice(["a", "b"], 300)
    pdf = pd.DataFrame({"f": family, "i": np.arange(300), "p": p})
    df = spark.createDataFrame(pdf).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    table = ResultTable(df, ["i"], ["f"]).adjust("p", "fdr")
    table.rank("place", [F.col("p")], F.col("p").isNotNull(), "m").rank("all_rows", [F.col("p").asc_nulls_first()])
    got = table.frame.toPandas().sort_values("i").reset_index(drop=True)
    for f in ("a", "b"):
        part = got[family == f]
        np.testing.assert_allclose(part.fdr.to_numpy(dtype=float), brute_bh(p[family == f]), rtol=1e-12)
        tested = part[part.p.notna()].sort_values(["p", "i"])
        assert list(tested.place) == list(range(1, len(tested) + 1)) and set(part.m) == {len(tested)}
        first = part.assign(null=part.p.notna()).sort_values(["null", "p", "i"])
        assert list(first.all_rows) == list(range(1, len(part) + 1))


def test_published_adjustments(spark):
    rows = [(0.585, 1.15337648533155e-22), (0.5, 9e-9), (0.4, 0.00335166997952249), (0.35, None)]
    got = {r["t"]: r["fdr"] for r in adjust_window(frame(spark, rows, "t double, p double"), "p", "fdr").collect()}
    assert math.isclose(got[0.585], 3.46012945599466e-22, rel_tol=1e-12) and got[0.35] is None
    many = spark.range(18256).selectExpr("id", "CASE WHEN id = 0 THEN 1.15337648533155e-22D ELSE 0.5D END AS p")
    top = ResultTable(many, ["id"]).adjust("p", "fdr").frame.where("id = 0").first()
    assert math.isclose(top["fdr"], 2.10560411162129e-18, rel_tol=1e-13)


def test_threshold_pairs(spark):
    x = [0.2, 0.34, 0.35, 0.39, 0.40, 0.49, 0.50, 0.584, 0.585, 0.7, 0.8, 0.9, None, math.inf]
    y = [-2, -1.8, -1.5, -1.4, -1, -0.9, -0.8, -0.5, -0.3, 0, 0.1, 0.2, -10, -10]
    df = frame(spark, [(a, float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r["threshold"]: r for r in screens.threshold_sensitivity(df, "x", "y").collect()}
    assert [got[t]["n_low"] for t in (0.585, 0.5, 0.4, 0.35)] == [8, 6, 4, 2]
    assert not got[0.35]["eligible"] and got[0.35]["rank_sum_p"] is None and got[0.35]["rank_sum_fdr"] is None
    assert got[0.585]["median_low"] == pytest.approx(-1.2)


def test_quantile_pairs_and_ties(spark):
    x = [*map(float, range(1, 101)), None, math.inf, 2.0]
    y = [*[math.sin(i / 8) - i / 100 for i in range(1, 101)], -50.0, -50.0, None]
    got = screens.quantile_groups(frame(spark, list(zip(x, y)), "x double, y double"), "x", "y").orderBy("quantile").collect()
    assert [r["n_low"] for r in got] == [10, 20]
    ties = [(1.0, float(i + 1)) for i in range(30)] + [(float(v), float(i + 31)) for i, v in enumerate(range(2, 72))]
    got = screens.quantile_groups(frame(spark, ties, "x double, y double"), "x", "y").collect()
    assert [(r["cutoff"], r["n_low"]) for r in got] == [(1.0, 30), (1.0, 30)]


def test_bootstrap_distribution_and_determinism(spark):
    rng = np.random.default_rng(11)
    values = np.sort(rng.normal(size=24).round(2))
    for n in (23, 24):
        sample = values[:n]
        low, high = median_positions(n, 20000, np.random.default_rng(1))
        fast = (sample[low - 1] + sample[high - 1]) / 2
        slow = np.median(rng.choice(sample, (20000, n)), axis=1)
        np.testing.assert_allclose(np.quantile(fast, [0.1, 0.5, 0.9]), np.quantile(slow, [0.1, 0.5, 0.9]), atol=0.06)
    pdf = pd.DataFrame({"s": rng.choice(["p", "q"], 200), "v": rng.normal(size=200), "low": rng.random(200) < 0.5})
    df = spark.createDataFrame(pdf)
    first = bootstrap_median_difference(df, "s", "v", F.col("low")).orderBy("s").collect()
    second = bootstrap_median_difference(df.repartition(7), "s", "v", F.col("low")).orderBy("s").collect()
    assert first == second and all(r["ci_low"] < r["ci_high"] for r in first)
    for r in first:
        part = pdf[pdf.s == r["s"]]
        delta = part.v[part.low].median() - part.v[~part.low].median()
        assert r["ci_low"] <= delta <= r["ci_high"]


def test_hot_keys_give_the_same_results(spark, monkeypatch):
    """The counted-cell path of hot keys agrees with the row-window path of cold ones."""
    from assocgrid.operators import ordered

    rng = np.random.default_rng(21)
    keys = np.where(rng.random(4000) < 0.7, "hot", rng.choice(["c1", "c2"], 4000))
    values = np.where(rng.random(4000) < 0.35, 0.0, (rng.normal(size=4000) * 50).round(1))
    values[:5] = [np.nan, np.inf, -0.0, 0.0, 1e-300]
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "x": rng.normal(size=4000).round(2), "y": values}))

    def results():
        comparisons = {"a": split(F.col("x") < -0.2), "b": (F.col("x") < 0, F.col("x") > 1)}
        effects = group_effects(df, ["k"], "y", comparisons, x="x", label="c", keep_empty=True)
        return [
            sorted(effects.collect()),
            sorted(pair_correlations(df, ["k"], "x", "y").collect()),
            sorted(exact_quantiles(df, ["k"], "y", {"q": 0.37, "low": 0.0, "high": 1.0}).collect()),
        ]

    cold = results()
    monkeypatch.setattr(ordered, "SLICE_ROWS", 1000)
    mixed = results()
    for a, b in zip(sum(cold, []), sum(mixed, [])):
        for name, u, v in zip(a.__fields__, a, b):
            if isinstance(u, float):
                assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-12), (name, u, v)
            else:
                assert u == v, (name, u, v)


def test_one_scan_without_hot_keys(spark, tmp_path):
    """Rows are shuffled once by key, and the exchange of hot cells is shared by its branches."""
    path = str(tmp_path / "m")
    spark.range(2000).selectExpr("id % 7 AS k", "double(id % 5) AS x", "double(id * 37 % 101) AS y").write.parquet(path)
    out = group_effects(spark.read.parquet(path), ["k"], "y", {"a": split(F.col("x") < 2)}, x="x")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(k") <= 2  # one for the size count, one for the rows
