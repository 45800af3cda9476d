"""Screens, strata and models on small matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assocgrid.functions.states import prepare_driver
from assocgrid.operators.models import adjusted_coefficients, pooled_model
from assocgrid.operators.results import top_correlations, top_per_direction
from assocgrid.plans import screens
from assocgrid.operators.quality import QualityError
from assocgrid.plans.workflow import pair_workflow


def make_driver(spark, levels):
    return prepare_driver(spark.createDataFrame([(f"m{i + 1}", v) for i, v in enumerate(levels)], "entity string, level double"), "level")


@pytest.fixture(scope="module")
def matrix(spark):
    rows = []
    for i in range(12):
        b = float(i) if i < 6 else 10.0 + i
        rows += [(f"m{i + 1}", "B", b), (f"m{i + 1}", "C", -b), (f"m{i + 1}", "D", None)]
    return spark.createDataFrame(rows, "entity string, feature string, value double")


def test_driver_groups(spark):
    rows = make_driver(spark, [0.0, 0.4, 1.0, None, -2.0]).orderBy("entity").collect()
    assert [r["level_tier"] for r in rows] == ["Deep Low", "Shallow Low", "Non-Low", "Non-Low", "Non-Low"]
    assert [r["level_group"] for r in rows] == ["Low", "Low", "Non-Low", None, None]


def test_screen_ranks_untested_first(spark, matrix):
    driver = make_driver(spark, [0.2] * 6 + [1.0 + i / 6 for i in range(6)])
    got = {r["feature"]: r for r in screens.feature_screen(matrix, driver, "level_log", screens.low_group()).collect()}
    assert got["D"]["n"] == 0 and got["D"]["rank"] == 1 and got["D"]["rank_sum_p"] is None and got["D"]["eligible_rank"] is None
    assert got["B"]["rank"] == 2 and got["C"]["rank"] == 3
    assert got["B"]["delta_median"] < 0 < got["C"]["delta_median"]
    assert got["B"]["rank_sum_p"] == pytest.approx(got["C"]["rank_sum_p"], rel=1e-12)
    assert got["B"]["eligible_rank"] == 1 and got["B"]["eligible_n"] == 2
    assert got["B"]["pearson_r"] == pytest.approx(-got["C"]["pearson_r"], rel=1e-12)


@pytest.mark.parametrize("n_low", [0, 1, 2, 10, 11, 12])
def test_gate_skips_small_groups(spark, matrix, n_low):
    driver = make_driver(spark, [0.2] * n_low + [1.5] * (12 - n_low))
    status, result = screens.gated_screen(matrix, driver, "level_log", screens.low_group())
    assert status.first()["status"] == "SKIPPED" and result.count() == 0
    assert result.columns[:3] == ["feature", "n", "pearson_r"]


def test_covariation(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12):
        a = float(rng.normal())
        rows += [(f"m{i}", "A", a), (f"m{i}", "POS", 2 * a), (f"m{i}", "NEG", -a), (f"m{i}", "NOISE", float(rng.normal()))]
    m = spark.createDataFrame(rows, "entity string, feature string, value double")
    table = screens.covariation(m, "A")
    got = {r["feature"]: r for r in table.collect()}
    assert got["A"]["pearson_r"] == 1 and got["A"]["pearson_p"] is None and got["A"]["fdr"] is None
    assert got["POS"]["pearson_r"] == 1 and got["NEG"]["pearson_r"] == -1
    assert got["NOISE"]["fdr"] == pytest.approx(got["NOISE"]["pearson_p"])
    top = top_correlations(table, "pearson_r", "feature", "A", 1, "up", "down").collect()
    assert {(r["feature"], r["direction"]) for r in top} == {("POS", "up"), ("NEG", "down")}


def test_top_per_direction(spark):
    df = spark.createDataFrame([("a", -1.0, 1), ("b", 2.0, 2), ("c", -3.0, 3), ("d", 0.0, 4), ("e", -4.0, None)], "f string, d double, r int")
    got = top_per_direction(df, "d", "r", 1, "below", "above").collect()
    assert {(r["f"], r["direction"]) for r in got} == {("a", "below"), ("b", "above")}


def lstsq(x, y, strata):
    levels = sorted(set(strata))
    design = np.column_stack([np.ones(len(x)), x, *[(np.array(strata) == s).astype(float) for s in levels[1:]]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    residual = y - design @ beta
    df = len(y) - design.shape[1]
    covariance = residual @ residual / df * np.linalg.inv(design.T @ design)
    names = ["(Intercept)", "driver", *[f"stratum={s}" for s in levels[1:]]]
    return {n: (b, s) for n, b, s in zip(names, beta, np.sqrt(np.diag(covariance)))}


def test_adjusted_coefficients_equal_least_squares(spark):
    rng = np.random.default_rng(9)
    s = rng.choice(["p", "q", "r"], 90)
    x = rng.normal(size=90) + 5
    y = 0.4 * x + (s == "q") * 2 + rng.normal(size=90)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "x": x, "y": y}))
    got = {r["term"]: r for r in adjusted_coefficients(df, "x", "y", "s").collect()}
    want = lstsq(x, y, list(s))
    assert set(got) == set(want)
    for term, (beta, se) in want.items():
        assert got[term]["estimate"] == pytest.approx(beta, rel=1e-9) and got[term]["std_error"] == pytest.approx(se, rel=1e-9)
    _, scaled = pooled_model(df, "x", "y", "s", standardised=True)
    zx, zy = (x - x.mean()) / x.std(ddof=1), (y - y.mean()) / y.std(ddof=1)
    slope = next(r for r in scaled.collect() if r["term"] == "driver")
    assert slope["estimate"] == pytest.approx(lstsq(zx, zy, list(s))["driver"][0], rel=1e-9)


def test_pooled_model_reasons(spark):
    rows = [(f"s{i % 2}", float(i % 2), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    status, table = pooled_model(df, "x", "y", "s")
    assert "aliased" in status.first()["reason"] and table.count() == 0
    status, table = pooled_model(df.limit(5), "x", "y", "s")
    assert not status.first()["eligible"] and table.count() == 0


def test_adjusted_screen_reasons(spark):
    rng = np.random.default_rng(4)
    strata = ["p", "q", "r"] * 30
    meta = pd.DataFrame({"entity": [f"e{i}" for i in range(90)], "x": rng.random(90), "stratum": strata})
    cells = []
    for i in range(90):
        cells += [(f"e{i}", "G1", None if i < 2 else float(rng.normal())), (f"e{i}", "FLAT", 1.0), (f"e{i}", "NULL", None)]
        if i < 19:
            cells.append((f"e{i}", "SHORT", float(i)))
    m = spark.createDataFrame(cells, "entity string, feature string, value double")
    d = spark.createDataFrame(meta)
    got = {r["feature"]: r for r in screens.ranked_adjusted_screen(m, d, "x", "stratum", F.col("x") < 0.5).collect()}
    assert got["G1"]["n"] == 88 and got["G1"]["continuous_status"] == "completed" and got["G1"]["eligible_rank"] == 1
    assert got["NULL"]["n"] == 0 and got["NULL"]["skip_reason"].startswith("Need N >= 20")
    assert got["FLAT"]["skip_reason"] == "Constant outcome" and got["FLAT"]["fdr_driver"] is None
    assert got["SHORT"]["skip_reason"].startswith("Need N >= 20")
    aliased = d.withColumn("x", F.when(F.col("stratum") == "p", 0.1).otherwise(0.9))
    got = {r["feature"]: r for r in screens.ranked_adjusted_screen(m, aliased, "x", "stratum", F.col("x") < 0.5).collect()}
    assert "aliased" in got["G1"]["skip_reason"] and got["G1"]["binary_status"] == "skipped"


def test_stratum_correlations_gate(spark):
    rng = np.random.default_rng(7)
    rows = [(s, float(rng.normal()), float(rng.normal())) for s, n in (("A", 40), ("B", 30), ("C", 19), ("D", 20)) for _ in range(n)]
    rows += [("E", 1.0, float(rng.normal())) for _ in range(25)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    got = {r["s"]: r for r in screens.stratum_correlations(df, "s", "x", "y").collect()}
    assert not got["C"]["eligible"] and got["C"]["pearson_r"] is None and got["C"]["x_median"] is not None
    assert got["D"]["eligible"] and got["D"]["ci_low"] < got["D"]["pearson_r"] < got["D"]["ci_high"]
    assert got["E"]["pearson_p"] is None and not got["E"]["eligible"]


def test_three_groups_need_all_groups(spark):
    d = make_driver(spark, [0.1] * 4 + [0.4] * 4 + [1.0] * 4)
    t = spark.createDataFrame([(f"m{i + 1}", float((i * 7) % 12)) for i in range(12)], "entity string, value double")
    assert screens.three_group_tests(screens.matched_pair(d, t)).count() == 3
    assert screens.three_group_tests(screens.matched_pair(make_driver(spark, [0.1] * 2 + [0.4] * 5 + [1.0] * 5), t)).count() == 0


def test_pair_workflow_tables(spark):
    rng = np.random.default_rng(6)
    ids = [f"e{i}" for i in range(80)]
    cells = [(e, f, float(rng.random() * 2)) for e in ids for f in ("A", "B", "C")]
    m = spark.createDataFrame(cells, "entity string, feature string, value double")
    strata_of = spark.createDataFrame([(e, "pq"[i % 2]) for i, e in enumerate(ids)], "entity string, stratum string")
    cohort = spark.createDataFrame([("pq"[i % 2], float(i % 5 - 2), float(rng.random()), i % 5 - 2) for i in range(80)], "stratum string, relative_change double, expression double, state_code int")
    strata = spark.createDataFrame([("p",), ("q",), ("none",)], "stratum string")
    out = pair_workflow(m, m, "A", "B", strata_of, cohort, strata)
    counts = {name: table.count() for name, table in out.items()}
    assert counts["feature_screen"] == 3 and counts["covariation"] == 3 and counts["targeted"] == 1
    assert counts["prevalence"] == 15 and counts["stratum_order"] == 3 and counts["adjusted"] == 3
    assert counts["threshold_sensitivity"] == 4 and counts["stratified"] == 2


def test_repeated_entities(spark):
    """X9, X12 and pairs refuse repeated entities; X1 takes the first by an explicit order."""
    cells = [(f"e{i}", f, float(i * k % 7)) for i in range(30) for k, f in enumerate(("A", "B"), 2)]
    matrix = spark.createDataFrame(cells, "entity string, feature string, value double")
    rows = [(f"e{i}", i / 10, "s" if i % 2 else "t", 0) for i in range(30)]
    once = spark.createDataFrame(rows, "entity string, level_log double, stratum string, copy int")
    twice = spark.createDataFrame([*rows, ("e3", 9.0, "s", 1), ("e3", 9.5, "s", 2)], "entity string, level_log double, stratum string, copy int")
    low = screens.low_group()
    for refused in (
        lambda: screens.feature_screen(matrix, twice, "level_log", low),
        lambda: screens.quantile_screen(matrix, twice, "level_log"),
        lambda: screens.ranked_adjusted_screen(matrix, twice, "level_log", "stratum", low),
        lambda: screens.ranked_adjusted_screen(matrix.union(matrix.limit(1)), once, "level_log", "stratum", low),
        lambda: screens.matched_pair(twice.withColumnRenamed("level_log", "level"), matrix.where("feature = 'A'")),
    ):
        with pytest.raises(QualityError):
            refused()
    first = screens.feature_screen(matrix, twice, "level_log", low, order=["copy"])
    again = screens.feature_screen(matrix, once, "level_log", low)
    for a, b in zip(first.orderBy("feature").collect(), again.orderBy("feature").collect(), strict=True):
        assert all(u == v if not isinstance(u, float) else u == pytest.approx(v) for u, v in zip(a, b))
