"""Ingest of wide, vector, per-entity and nested inputs, and the sinks."""

import gzip

import pytest
from pyspark.sql import functions as F

from assocgrid.functions import labels
from assocgrid.operators import quality
from assocgrid.plans import ledger
from assocgrid.sources import ingest, nested, readers, sinks
from assocgrid.streaming import incremental


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(",GENEA (1),GENEB (2)\nPR-1,0.5,NA\nPR-2,1e-300,-2\n")
    got = {(r["entity"], r["feature"]): r["value"] for r in ingest.read_wide_text(spark, str(path)).collect()}
    assert got == {("PR-1", "GENEA (1)"): 0.5, ("PR-1", "GENEB (2)"): None, ("PR-2", "GENEA (1)"): 1e-300, ("PR-2", "GENEB (2)"): -2.0}
    path.write_text(",A,B\nx,1,2\ny,1\n")
    with pytest.raises(quality.QualityError, match="width"):
        ingest.read_wide_text(spark, str(path))
    path.write_text(",A,A\nx,1,2\n")
    with pytest.raises(quality.QualityError, match="ambiguous"):
        ingest.read_wide_text(spark, str(path))


def test_wide_parquet_of_many_columns(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    names = [f"g{i}" for i in range(1200)]
    values = np.arange(1200 * 3, dtype=float).reshape(3, 1200)
    table = pa.table({"id": ["a", "b", "c"], **{n: values[:, i] for i, n in enumerate(names)}})
    pq.write_table(table, tmp_path / "wide.parquet")
    long = ingest.melt_wide(spark, str(tmp_path / "wide.parquet"), "id", chunk=500)
    facts = long.agg(F.count("*"), F.count_distinct("feature"), F.sum("value")).first()
    assert tuple(facts) == (3600, 1200, float(values.sum()))
    assert long.where("entity = 'b' and feature = 'g7'").first()["value"] == 1207


def test_feature_vectors(spark, tmp_path):
    path = tmp_path / "m.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("gene\tTCGA-AB-0001-01\tTCGA-AB-0002-01\nX|1\t1.5\tNA\nY\t\t-2\n")
    vectors, samples = ingest.read_feature_vectors(spark, str(path))
    assert [r["n_known"] for r in vectors.orderBy("feature").collect()] == [1, 1]
    got = {r["sample_id"]: r["value"] for r in readers.vector_feature(vectors, samples, "X|1").collect()}
    assert got == {"TCGA-AB-0001-01": 1.5, "TCGA-AB-0002-01": None}
    with gzip.open(path, "wt") as f:
        f.write("gene\tbad\nX\t1\n")
    with pytest.raises(quality.QualityError, match="invalid sample ids"):
        ingest.read_feature_vectors(spark, str(path))


def test_entity_files_with_comments(spark, tmp_path):
    for name, extra in (("a.tsv", "ENSG2\t3\n"), ("b.tsv", "")):
        (tmp_path / name).write_text(f"# comment\ngene_id\tvalue\nN_total\t9\nENSG1\t1.5\n{extra}")
    rows = ingest.read_entity_files(spark, str(tmp_path), "gene_id string, value double")
    real, summary = ingest.split_summary_rows(rows, "gene_id", "ENSG")
    assert {(r["file_name"], r["gene_id"]) for r in real.collect()} == {("a.tsv", "ENSG1"), ("a.tsv", "ENSG2"), ("b.tsv", "ENSG1")}
    assert ingest.library_summary(summary, "file_name", "gene_id", "value", ["N_total"]).count() == 2


def test_leaves_and_null_leaf(spark):
    schema = "id string, portions array<struct<pid: string, analytes: array<struct<aid: string, aliquots: array<struct<qid: string>>>>>>"
    rows = [("full", [("p1", None), ("p2", [("a1", [("q1",), ("q2",)]), ("a2", [])])]), ("empty", []), ("none", None)]
    levels = [("portions", ["pid"]), ("analytes", ["aid"]), ("aliquots", ["qid"])]
    got = sorted(nested.leaf_rows(spark.createDataFrame(rows, schema), ["id"], levels).collect(), key=str)
    assert [tuple(r) for r in got] == [("empty", None, None, None), ("full", "p2", "a1", "q1"), ("full", "p2", "a1", "q2"), ("none", None, None, None)]


def test_catalog_layers_and_guard(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = [("e1", "A", 1.0), ("e1", "A", 2.0), ("e2", "A", 3.0), ("e2", "B", 4.0)]
    sinks.write_matrix(spark.createDataFrame(rows, "entity string, feature string, value double"), path)
    catalog = readers.standard_accessors(readers.Catalog(spark, {("reference", "tumour_state"): path}))
    assert {(r["entity"], r["value"]) for r in catalog.request("A", "tumour", "state").collect()} == {("e1", 1.0), ("e2", 3.0)}
    with pytest.raises(readers.DataUnavailable, match="not in layer"):
        catalog.request("A", "tumour", "driver")
    with pytest.raises(ValueError, match="unknown database"):
        catalog.request("A", "tumour", "other")
    with pytest.raises(readers.DataUnavailable, match="not available locally"):
        readers.scan(spark, str(tmp_path / "missing"))
    with pytest.raises(readers.DataUnavailable):
        readers.scan(spark, "raw.csv")
    with pytest.raises(quality.QualityError, match="repeated entities"):
        readers.read_feature_strict(catalog.table("tumour_state", "reference"), "A", "v")
    assert readers.table_schema(spark, path).fieldNames() == ["entity", "feature", "value"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_prepared(spark.range(1), path)


def test_id_column_choice():
    assert labels.pick_id_column(["X", "ModelID"]) == "ModelID" and labels.pick_id_column(["q", "r"]) == "q"
    assert labels.feature_columns(["id", "ProfileID", "G1"], "id") == ["G1"]
    assert labels.first_present(["b"], ["a", "b"]) == "b" and labels.first_present([], ["a"]) is None


def test_incremental_files_are_read_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for batch, total in ((range(3), 3), (range(3, 5), 5), ((), 5)):
        if batch:
            spark.createDataFrame([(i,) for i in batch], "i int").coalesce(1).write.mode("append").option("header", "true").csv(source)
        assert incremental.ingest_new_files(spark, source, "i int", out, state).count() == total
    listing = incremental.file_listing(spark, source, "*.csv")
    assert listing.count() == 2
    manifest = listing.withColumn("version", F.lit("v1"))
    assert incremental.stale_inputs(listing, manifest, "v1").count() == 0
    assert incremental.stale_inputs(listing, manifest, "v2").count() == 2


def test_ledger(spark):
    assert ledger.modules_of("pair")[:3] == ledger.SCREEN_MODULES
    with pytest.raises(ValueError, match="unsupported"):
        ledger.modules_of("other")
    shared = [ledger.parameter_text("feature_screen", "A", t, {}) for t in ("B", "C")]
    assert shared[0] == shared[1]
    assert ledger.parameter_text("targeted", "A", "B", {}) != ledger.parameter_text("targeted", "A", "C", {})
    a, b = (quality.content_hash(spark.range(5).repartition(n)).first() for n in (1, 3))
    assert a == b and quality.content_hash(spark.range(6)).first() != a


def test_quoted_fields(spark, tmp_path):
    """Separators and doubled quotes inside quotes belong to the field."""
    path = tmp_path / "q.csv"
    path.write_text('﻿id,"G, one",B\n"e,1",1,"2"\n"say ""hi""",,"3"\n', encoding="utf-8")
    got = {(r.entity, r.feature): r.value for r in ingest.read_wide_text(spark, str(path)).collect()}
    assert got == {("e,1", "G, one"): 1.0, ("e,1", "B"): 2.0, ('say "hi"', "G, one"): None, ('say "hi"', "B"): 3.0}


def test_melt_leaves_text_columns_out(spark, tmp_path):
    spark.createDataFrame([("a", "x", 1.0, 2)], "entity string, name string, g double, h int").write.parquet(str(tmp_path / "w"))
    got = {(r.feature, r.value) for r in ingest.melt_wide(spark, str(tmp_path / "w"), "entity").collect()}
    assert got == {("g", 1.0), ("h", 2.0)}


def test_unknown_values_come_last(spark):
    rows = spark.createDataFrame([("e", "f", None), ("e", "f", 5.0), ("e", "f", 2.0)], "entity string, feature string, value double")
    assert readers.read_feature(rows, "f", "v", ["value"]).first()["v"] == 2.0
