"""Reused results, file order, positional arrays and scratch tables on small inputs."""

import pytest
from pyspark.sql import functions as F

from assocgrid import storage
from assocgrid.plans import reuse
from assocgrid.sources import readers, sinks


def test_only_what_changed_is_computed_again(spark, tmp_path):
    built = []

    def module(name, inputs, options):
        return reuse.Module(name, inputs, options, lambda i, o: built.append(name) or i[inputs[0]].withColumn("by", F.lit(str([o[x] for x in options]))))

    modules = [module("screen", ("a",), ("driver",)), module("pair", ("a", "b"), ("driver", "target"))]
    a, b = spark.range(5), spark.range(3)

    def run(**changed):
        built.clear()
        inputs = {"a": changed.get("a", a), "b": changed.get("b", b)}
        out = reuse.run(spark, modules, inputs, {"driver": "D", "target": changed.get("target", "T")}, str(tmp_path))
        return list(built), {k: v.count() for k, v in out.items()}

    assert run() == (["screen", "pair"], {"screen": 5, "pair": 5})
    assert run() == ([], {"screen": 5, "pair": 5})
    assert run(target="U")[0] == ["pair"]
    assert run(a=a.repartition(3))[0] == []  # the order and files of the rows do not count
    assert run(b=spark.range(4))[0] == ["pair"]
    assert run(a=spark.range(6)) == (["screen", "pair"], {"screen": 6, "pair": 6})
    path = reuse.ledger(spark, str(tmp_path)).where("module = 'screen' AND turn = 0").first()["path"]
    storage.remove(spark, path)
    assert run()[0] == ["screen"]  # its table is gone
    assert reuse.ledger(spark, str(tmp_path)).count() == 14


def test_first_row_of_the_file(spark, tmp_path):
    spark.createDataFrame([("e", "f", 5.0), ("e", "f", 2.0), ("g", "f", None), ("g", "f", 1.0)], "entity string, feature string, value double").coalesce(1).write.parquet(str(tmp_path / "m"))
    catalog = readers.Catalog(spark, {("current", "m"): str(tmp_path / "m")})
    assert {r.entity: r.value for r in catalog.feature("m", "f").collect()} == {"e": 5.0, "g": None}
    assert {r.entity: r.value for r in catalog.feature("m", "f", order=["value"]).collect()} == {"e": 2.0, "g": 1.0}


def test_metadata_accessor(spark, tmp_path):
    rows = spark.createDataFrame([("e", "x", 1), ("g", "y", 2)], "entity string, kind string, n int")
    rows.write.parquet(str(tmp_path / "meta"))
    rows.union(rows).write.parquet(str(tmp_path / "twice"))
    catalog = readers.Catalog(spark, {("current", "entity_metadata"): str(tmp_path / "meta"), ("current", "twice"): str(tmp_path / "twice")})
    assert catalog.entity_metadata(["kind"]).columns == ["entity", "kind"] and catalog.entity_metadata().count() == 2
    with pytest.raises(Exception, match="repeated entity metadata"):
        catalog.entity_metadata(name="twice").collect()


def test_positional_arrays(spark):
    samples = spark.createDataFrame([(0, "s0"), (1, "s1"), (2, "s2"), (3, "s3")], "sample_index int, sample_id string")
    cells = spark.createDataFrame([("f", "s2", 2.0), ("f", "s0", None), ("g", "s3", 3.0), ("g", "zz", 9.0)], "feature string, sample_id string, value double")
    got = {r.feature: r["values"] for r in readers.feature_vectors(cells, samples).collect()}
    assert got == {"f": [None, None, 2.0, None], "g": [None, None, None, 3.0]}
    with pytest.raises(Exception, match="repeated cells"):
        readers.feature_vectors(cells.union(cells.limit(1)), samples).collect()
    assert readers.feature_vectors(cells.limit(0), samples).count() == 0


def test_scratch_tables_go(spark):
    with storage.scratch(spark) as outer:
        kept = storage.materialize(spark.range(3), "t").count()
        with storage.scratch(spark) as inner:
            storage.materialize(spark.range(4), "t")
        assert kept == 3 and storage.exists(spark, outer[0]) and not storage.exists(spark, inner[0])
    assert not storage.exists(spark, outer[0]) and len(outer) == 2


def test_lookup_skips_absent_features(spark, tmp_path):
    cells = spark.range(2000).select((F.col("id") % 40).alias("entity"), F.concat(F.lit("f"), F.floor(F.col("id") / 40).cast("string")).alias("feature"), F.col("id").cast("double").alias("value"))
    matrix = sinks.write_matrix(cells, str(tmp_path / "m"))
    assert readers.lookup_feature(matrix, "f7", "v").count() == 40
    with pytest.raises(Exception, match="repeated entity"):
        readers.lookup_feature(matrix.union(matrix), "f7", "v").collect()
    import pyarrow.parquet as pq

    file = next(p for p in (tmp_path / "m").glob("*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).num_rows > 0
