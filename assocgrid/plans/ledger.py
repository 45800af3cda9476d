"""Run ledger, reuse decisions and dataset manifests as tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.operators.select import last_per_key

# fixed values: modules of each workflow; pair modules also depend on the target
SCREEN_MODULES = ("cohort", "feature_screen", "covariation")
PAIR_MODULES = ("targeted", "stratified", "adjusted", "threshold_sensitivity")


def modules_of(workflow: str) -> tuple[str, ...]:
    if workflow == "screen":
        return SCREEN_MODULES
    if workflow == "pair":
        return SCREEN_MODULES + PAIR_MODULES
    raise ValueError(f"unsupported workflow: {workflow!r}")


def latest_runs(ledger: DataFrame, module: str = "module", order: Sequence[str] = ("finished", "run_id")) -> DataFrame:
    """The last record of every module."""
    return last_per_key(ledger, [module], list(order))


def reuse_key(parameters: Column, inputs: Column) -> Column:
    """Key of a result: hash of its parameters and its inputs' identity."""
    return F.sha2(F.concat_ws("|", F.to_json(parameters), inputs), 256)


def parameter_text(module: str, driver: str, target: str | None, options: Mapping[str, object]) -> str:
    """Parameters a module depends on; screen modules ignore the target, so all targets share them."""
    used = {"module": module, "driver": driver, **dict(options)}
    if module in PAIR_MODULES:
        used["target"] = target
    return json.dumps(used, sort_keys=True, default=str)


def reuse_decisions(requested: DataFrame, ledger: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each requested (module, key): ``reuse`` if a finished run has that key and its output is unchanged.

    ``ledger(module, key, output_hash, ...)`` one finished run per module and key;
    ``outputs(module, key, output_hash)`` as found now.
    """
    done = ledger.select("module", "key", F.col("output_hash").alias("_recorded"))
    now = outputs.select("module", "key", F.col("output_hash").alias("_found"))
    joined = requested.join(done, ["module", "key"], "left").join(now, ["module", "key"], "left")
    decision = (
        F.when(F.col("_recorded").isNull(), "compute: no run with this key")
        .when(F.col("_found").isNull(), "compute: output missing")
        .when(F.col("_found") != F.col("_recorded"), "compute: output changed")
        .otherwise("reuse")
    )
    return joined.withColumn("decision", decision).drop("_recorded", "_found")


def manifest_summary(manifest: DataFrame, kind: str = "kind", status: str = "status", size: str = "size") -> DataFrame:
    """Rows and bytes per kind and status."""
    return manifest.groupBy(kind, status).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_size"))


def outstanding(manifest: DataFrame, done: Sequence[str] = ("verified", "complete")) -> DataFrame:
    """Entries not known to be done; an unknown status is outstanding."""
    return manifest.where(~F.coalesce(F.col("status").isin(*done), F.lit(False)))


def stale_tables(saved: DataFrame, current: DataFrame, version: str) -> DataFrame:
    """Prepared tables whose inputs or algorithm version changed since they were written.

    ``saved(table, input, size, modified, version)``; ``current(input, size, modified)``.
    """
    now = current.select("input", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.lit(True).alias("_there"))
    joined = saved.join(now, "input", "left")
    reason = (
        F.when(~F.col("version").eqNullSafe(F.lit(version)), "algorithm version changed")
        .when(F.col("_there").isNull(), "input missing")
        .when(~F.col("_size").eqNullSafe(F.col("size")) | ~F.col("_modified").eqNullSafe(F.col("modified")), "input changed")
    )
    return joined.withColumn("reason", reason).where("reason is not null").select("table", "input", "reason")
