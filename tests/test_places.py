"""Arrays filled by blocks of places, and pairs and strata whose rows are made once."""

import pytest

from assocgrid.operators import cohort
from assocgrid.plans import screens
from assocgrid.sources import readers


def counted(spark, rows, schema):
    """A table, and the counter of the rows made for it."""
    made = spark.sparkContext.accumulator(0)

    def row(r):
        made.add(1)
        return r

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(row), schema), made


def test_a_pair_makes_its_target_once(spark):
    driver = spark.createDataFrame([(k, k / 10) for k in range(12)], "entity long, level double")
    target, made = counted(spark, [(k, float(k * k)) for k in range(12)], "entity long, value double")
    assert screens.matched_pair(driver, target).count() == 12 and made.value == 12


def test_strata_are_ordered_from_rows_made_once(spark):
    rows, made = counted(spark, [("a", 3.0), ("a", 5.0), ("b", 1.0), (None, 0.0)], "stratum string, relative_change double")
    strata = spark.createDataFrame([("a",), ("b",), ("c",)], "stratum string")
    got = cohort.stratum_order(rows, strata, "stratum").orderBy("position").collect()
    assert [(r.stratum, r.n, r.median_change, r.position) for r in got] == [("b", 1, 1.0, 1), ("a", 2, 4.0, 2), ("c", 0, None, 3)]
    assert made.value == 4


def test_blocks_of_places_give_whole_arrays(spark, monkeypatch):
    monkeypatch.setattr(readers, "BLOCK", 3)
    samples = spark.createDataFrame([(k, f"s{k}") for k in range(8)], "sample_index int, sample_id string")
    cells = [("a", "s7", 7.0), ("a", "s0", 0.5), ("a", "s1", None), ("b", "s4", 4.0), (None, "s2", 2.0), ("a", "other", 9.0), ("c", "other", 9.0)]
    got = readers.feature_vectors(spark.createDataFrame(cells, "feature string, sample_id string, value double"), samples).collect()
    gap = [None]
    assert {r.feature: r["values"] for r in got} == {"a": [0.5] + gap * 6 + [7.0], "b": gap * 4 + [4.0] + gap * 3, None: gap * 2 + [2.0] + gap * 5}
    twice = spark.createDataFrame([("a", "s5", 1.0), ("a", "s5", 1.0)], "feature string, sample_id string, value double")
    with pytest.raises(Exception, match="repeated cells of feature a"):
        readers.feature_vectors(twice, samples).collect()
