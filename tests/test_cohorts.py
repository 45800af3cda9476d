"""Cohort building and choices among candidates, with the published small vectors."""

import pytest
from pyspark.sql import functions as F

from assocgrid.functions import labels, states
from assocgrid.operators import cohort, quality, select


def test_states(spark):
    cn = [0.0, 1.0, 3.0, 5.0, 6.0, None, -1.0, 2.0]
    rows = [(i, v, 0.0 if i == 7 else 3.0) for i, v in enumerate(cn)]
    df = spark.createDataFrame(rows, "i int, cn double, baseline double")
    got = [r["s"] for r in df.select("i", states.state_code("cn", "baseline").alias("s")).orderBy("i").collect()]
    assert got == [-2, -1, 0, 1, 2, None, None, None]


def test_modal_baseline(spark):
    rows = [("s1", 2.0), ("s1", 2.0), ("s1", 4.0), ("s2", 4.0), ("s2", 4.0), ("s2", 9.0), ("s3", 1.0), ("s3", 3.0), ("s3", None)]
    got = cohort.modal_baseline(spark.createDataFrame(rows, "e string, v double"), "e", "v").orderBy("e").collect()
    assert [r["baseline"] for r in got] == [2, 4, 1]
    assert [r["ties"] for r in got] == [1, 1, 2] and [r["n_finite"] for r in got] == [3, 3, 2]


def test_representatives_do_not_depend_on_order(spark):
    rna = [("s1", "a1", "f9"), ("s1", "a2", "f1"), ("s2", "b1", "f3"), ("s2", "b2", "f2")]
    wish = spark.createDataFrame([("s1", "a1"), ("s2", "zz")], "sample string, aliquot string")
    for rows in (rna, rna[::-1]):
        df = spark.createDataFrame(rows, "sample string, aliquot string, file string")
        got = select.pick_representatives(df, wish, "sample", "aliquot", "file")
        assert got.count() == 4
        assert {r["file"] for r in got.where("selected").collect()} == {"f9", "f2"}


PRIORITY = {"first": 0, "second": 1}


def test_priority_and_fallback(spark):
    files = spark.createDataFrame(
        [("s1", "second", "a", "f1"), ("s1", "first", "b", "f3"), ("s1", "first", "b", "f2"), ("s2", "second", "c", "f4")],
        "sample string, method string, aliquot string, file string",
    )
    got = {r["sample"]: r for r in select.pick_by_priority(files, "sample", "method", PRIORITY, ["aliquot", "file"]).collect()}
    assert got["s1"]["file"] == "f2" and got["s1"]["available_methods"] == "first;second" and got["s1"]["same_method_candidates"] == 2
    assert select.unknown_methods(files, "method", {"first": 0}).first()["method"] == "second"
    wanted = spark.createDataFrame([("s1", "first", "b"), ("s2", "first", "c"), ("s3", "first", "d")], "sample string, method string, aliquot string")
    chosen = {r["sample"]: r for r in select.tiered_fallback(wanted, files, "sample", "method", "aliquot", "file", PRIORITY).collect()}
    assert chosen["s1"]["chosen_file"] == "f2" and chosen["s1"]["reason"] == "same method and aliquot"
    assert chosen["s2"]["chosen_file"] == "f4" and not chosen["s2"]["method_match"]
    assert chosen["s3"]["chosen_file"] is None and chosen["s3"]["reason"] == select.NO_CANDIDATE
    with pytest.raises(ValueError, match="explicit choice"):
        select.preferred_methods(files, "method", ["absent"])


def test_latest_release(spark):
    names = ["Public 25Q3", "Public 26Q1", "Public 26Q3", "Public 26Q3 v2", "Other 27Q1"]
    df = spark.createDataFrame([(n,) for n in names], "release string")
    got = select.latest_release(df, "release").first()["latest"]
    assert got == "Public 26Q3 v2"


def test_resolve_ids_and_ambiguity(spark):
    rows = spark.createDataFrame([("ACH-000001",), ("P1",), ("P2",), ("C1",), ("??",)], "raw string")
    profiles = spark.createDataFrame([("P1", "ACH-000002", True), ("P2", "ACH-000002", False)], "key string, entity string, is_default boolean")
    conditions = spark.createDataFrame([("C1", "ACH-000003")], "key string, entity string")
    got = {r["raw"]: (r["via"], r["entity"]) for r in select.resolve_ids(rows, "raw", profiles, conditions, labels.ENTITY_PATTERN).collect()}
    assert got["ACH-000001"] == ("direct", "ACH-000001") and got["P1"] == ("profile", "ACH-000002")
    assert got["P2"] == ("skipped", None) and got["C1"] == ("condition", "ACH-000003") and got["??"] == ("unresolved", None)
    twice = spark.createDataFrame([("P1", "a"), ("P1", "b")], "key string, entity string")
    with pytest.raises(quality.QualityError, match="ambiguous"):
        quality.require_none(quality.ambiguous_keys(twice, "key", "entity"), "ambiguous profile")


def test_resolvers(spark):
    dim = labels.feature_dim(spark.createDataFrame([("AB (1)",), ("AB (2)",), ("CD|x",)], "l string"), "l")
    assert labels.resolve_feature(dim, "2") == "AB (2)" and labels.resolve_feature(dim, "CD") == "CD|x"
    assert labels.resolve_feature(dim, "ab", on_ambiguous="first") == "AB (1)"
    assert labels.resolve_feature(dim, "none", required=False) is None
    for name in ("AB", "none"):
        with pytest.raises(labels.ResolutionError):
            labels.resolve_feature(dim, name)
    ids = spark.createDataFrame([("E1.2", "AB"), ("E2.1", "AB"), ("E3.7", "X")], "feature_id string, feature_name string")
    assert labels.resolve_versioned(ids, "E3") == "E3.7" and labels.resolve_versioned(ids, "E1.2") == "E1.2"
    with pytest.raises(labels.ResolutionError):
        labels.resolve_versioned(ids, "AB")


def test_p_text_and_stars(spark):
    df = spark.createDataFrame([(None,), (1e-20,), (3.456e-5,), (0.0123456,), (0.5,), (1.0,)], "p double")
    got = [(r["t"], r["s"]) for r in df.select(labels.p_text("p").alias("t"), labels.star_code("p").alias("s")).collect()]
    assert got == [("NA", "NA"), ("<2e-16", "****"), ("3.46e-05", "****"), ("0.0123", "*"), ("0.5", "ns"), ("1", "ns")]


def test_table_compare_is_relative(spark):
    a = spark.createDataFrame([("s", True, 1e-180, None)], "id string, chosen boolean, p double, r double")
    b = a.withColumn("p", F.lit(0.0))
    got = {r["column"]: r for r in quality.compare_tables(a, b, ["id"]).collect()}
    assert got["p"]["n_different"] == 1 and got["r"]["n_different"] == 0 and got["chosen"]["n_different"] == 0
    assert quality.schema_differences(a, b) == []


def test_saved_selection_problems(spark):
    now = spark.createDataFrame([("f1", "s1"), ("f2", "s2")], "file string, sample string")
    saved = spark.createDataFrame([("f1", "s9"), ("f3", "s3")], "file string, sample string")
    got = {r["file"]: r["problem"] for r in select.selection_problems(now, saved, "file", ["sample"]).collect()}
    assert got == {"f1": "sample changed", "f2": "not in selection", "f3": "file gone"}


def test_saved_selection_must_fit(spark):
    candidates = spark.createDataFrame([(1, "a"), (2, "b")], "file int, entity string")
    saved = spark.createDataFrame([(1, "a", 1, True), (2, "b", 1, False)], "file int, entity string, matches int, selected boolean")
    assert [r.file for r in select.apply_selection(candidates, saved, "file", ["entity"]).collect()] == [1]
    for changed in (candidates.limit(1), candidates.withColumn("entity", F.lit("c"))):
        with pytest.raises(quality.QualityError):
            select.apply_selection(changed, saved, "file", ["entity"])


def test_cohort_stops_at_what_its_problems_list(spark):
    values = spark.createDataFrame([(1, 3.0, "T", 1, "p"), (2, 1.0, "T", 2, "p"), (3, 2.0, "N", 3, "q")], "entity int, value double, sample_type string, case_id int, project_id string")
    baselines = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0)], "entity int, baseline double")
    chosen = spark.createDataFrame([(1, "f1", 1, "p", 3.0), (3, "f3", 3, "q", None)], "entity int, file_id string, case_id int, project_id string, raw double")

    def built(v=values, b=baselines, c=chosen):
        return cohort.feature_cohort(v, b, c, "raw", F.col("project_id"), ("T",)).collect()

    assert {(r.entity, r.expression, r.state_code) for r in built()} == {(1, 2.0, 1), (2, None, -1)}
    faults = {
        "repeated baseline": {"b": baselines.union(baselines.limit(1))},
        "repeated value": {"v": values.union(values.limit(1))},
        "repeated choice": {"c": chosen.union(chosen.limit(1))},
        "case differs": {"c": chosen.withColumn("case_id", F.lit(9))},
        "project differs": {"c": chosen.withColumn("project_id", F.lit("z"))},
        "negative expression": {"c": chosen.withColumn("raw", F.lit(-0.5))},
    }
    for problem, parts in faults.items():
        with pytest.raises(Exception, match=problem):
            built(**parts)
        listed = cohort.cohort_problems(parts.get("v", values), parts.get("b", baselines), parts.get("c", chosen), "raw")
        assert {r.problem for r in listed.collect()} == {problem}
