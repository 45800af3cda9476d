"""Headline timings as one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Every query is run once, end to end, from the given tables to collected rows. The ``wide_`` entries
screen a matrix of about 18,000 features x 1,000 entities that is derived from part and customer and
written before the clock, as is the matrix that ``feature_lookup`` reads; ``per_million_cells`` is
their time for a million cells.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.functions.finite import log2_plus_one
from assocgrid.functions.tails import normal_two_sided
from assocgrid.plans import screens
from assocgrid.registry import REGISTRY
from assocgrid.registry.base import Tables, long_matrix
from assocgrid.session import local_session
from assocgrid.sources import readers, sinks
from assocgrid.storage import materialize, new_path

# registered query -> the screening step it times
HEADLINE = [
    "feature_screen",
    "feature_screen_150",
    "screen_gate",
    "covariation",
    "adjusted_screen",
    "quantile_screen",
    "spearman_by_feature",
    "pair_targeted",
    "three_group",
    "threshold_sensitivity",
    "quantile_groups",
    "stratum_correlations",
    "stratified_effects",
    "bootstrap_ci",
    "adjusted_coefficients",
    "sample_baseline",
    "prevalence",
    "feature_cohort",
    "wide_text_ingest",
    "table_compare",
]


FEATURES, ENTITIES = 18_000, 1_000


def wide_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(matrix, driver): every part a feature, every one of the first customers an entity."""
    t = Tables(spark, folder)
    entities = t.customer.where(F.col("c_custkey") <= ENTITIES)
    driver = materialize(
        entities.select(F.col("c_custkey").alias("entity"), log2_plus_one(F.col("c_acctbal") / 5000).alias("level_log"), F.col("c_mktsegment").alias("stratum")), "bench"
    )
    parts = t.part.where(F.col("p_partkey") <= FEATURES).select(F.concat(F.lit("P"), "p_partkey").alias("feature"), "p_retailprice")
    cells = parts.withColumn("entity", F.explode(F.sequence(F.lit(1), F.lit(ENTITIES)).cast("array<bigint>")))
    noise = F.pmod(F.xxhash64("feature", "entity"), F.lit(100_000)) / 1000
    return sinks.write_matrix(cells.select("entity", "feature", (noise + F.col("p_retailprice") / 1000).alias("value")), new_path(spark, "bench")), driver


def timed(spent: dict[str, float], name: str, frame) -> None:
    start = time.perf_counter()
    frame().collect()
    spent[name] = round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # start the JVM and the Python workers before the clock
    spark.range(1000).select(normal_two_sided(F.col("id") / 100).alias("p")).agg(F.sum("p")).collect()
    REGISTRY.queries["linear_fit"](spark, folder).collect()
    spent: dict[str, float] = {}
    for name in HEADLINE:
        timed(spent, name, lambda name=name: REGISTRY.queries[name](spark, folder))
    stored = sinks.write_matrix(long_matrix(Tables(spark, folder)), new_path(spark, "bench"))
    timed(spent, "feature_lookup", lambda: readers.lookup_feature(stored, "Brand#7", "level"))
    matrix, driver = wide_inputs(spark, folder)
    low = screens.low_group()
    timed(spent, "wide_feature_screen", lambda: screens.feature_screen(matrix, driver, "level_log", low))
    timed(spent, "wide_covariation", lambda: screens.covariation(matrix, "P7"))
    timed(spent, "wide_adjusted_screen", lambda: screens.ranked_adjusted_screen(matrix, driver, "level_log", "stratum", low))
    cells = matrix.count()
    line = {
        "metric": "association_screening_total",
        "value": round(sum(spent.values()), 3),
        "unit": "sec",
        "queries": spent,
        "wide_cells": cells,
        "per_million_cells": {name: round(1e6 * s / cells, 3) for name, s in spent.items() if name in ("wide_feature_screen", "wide_covariation", "wide_adjusted_screen")},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
