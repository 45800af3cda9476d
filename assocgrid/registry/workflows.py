"""Queries over reused results, file order and positional arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.operators.results import ResultTable
from assocgrid.plans import reuse
from assocgrid.registry.base import REGISTRY, M, Tables, prepared_matrix
from assocgrid.sources import readers
from assocgrid.storage import materialize, new_path

add = REGISTRY.add


@add("workflow_reuse", """SELECT module, turn, CASE WHEN turn = 0 OR (turn = 1 AND module IN ('targeted', 'threshold_sensitivity', 'adjusted')) OR (turn = 3 AND module <> 'covariation' AND module <> 'targeted' AND module <> 'threshold_sensitivity') THEN 'computed' ELSE 'cached' END AS status
   FROM (SELECT unnest(['covariation', 'targeted', 'threshold_sensitivity', 'adjusted']) AS module), (SELECT unnest([0::BIGINT, 1, 2, 3]) AS turn)""")
def workflow_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Four requests: a target, another one, the first again, and the first with other strata."""
    t, place = Tables(spark, folder), reuse.new_folder(spark)
    matrix = prepared_matrix(t)
    strata = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("stratum"))
    moved = strata.withColumn("stratum", F.when(F.col("entity") % 7 == 0, "OTHER").otherwise(F.col("stratum")))
    modules = reuse.standard_modules(["covariation", "targeted", "threshold_sensitivity", "adjusted"])
    for target, placed in (("Brand#7", strata), ("Brand#12", strata), ("Brand#7", strata), ("Brand#7", moved)):
        reuse.run(spark, modules, {"matrix": matrix, "driver_matrix": matrix, "strata": placed}, {"driver": "Brand#1", "target": target}, place)
    return reuse.ledger(spark, place).select("module", "turn", "status")


@add("first_in_file", """SELECT o_custkey AS entity, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT'
   QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def first_in_file(spark: SparkSession, folder: str) -> DataFrame:
    """A table whose files hold falling prices: each entity's first row is its largest, not its smallest."""
    path = new_path(spark, "in-order")
    falling = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    rows = Tables(spark, folder).orders.repartitionByRange(6, *falling).sortWithinPartitions(*falling)
    rows.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("feature"), F.col("o_totalprice").alias("value")).write.parquet(path)
    return readers.read_feature(readers.scan_in_order(spark, path), "1-URGENT", "price", readers.FILE_ORDER)


@add("vector_round_trip", f"""WITH {M}, g AS (SELECT feature, c_custkey FROM (SELECT DISTINCT feature FROM m), customer)
   SELECT g.feature, 'c' || c_custkey AS sample_id, CAST(value AS DOUBLE) AS value FROM g LEFT JOIN m ON m.feature = g.feature AND m.entity = c_custkey""")
def vector_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All features to arrays in the customers' order and back, gaps included."""
    t = Tables(spark, folder)
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    numbered = ResultTable(t.customer.select("c_custkey"), ["c_custkey"]).rank("n", [F.col("c_custkey")]).frame
    samples = materialize(numbered.select((F.col("n") - 1).cast("int").alias("sample_index"), name.alias("sample_id")), "samples")
    cells = prepared_matrix(t).select("feature", F.concat(F.lit("c"), F.col("entity").cast("string")).alias("sample_id"), "value")
    return readers.vector_feature(readers.feature_vectors(cells, samples), samples)
