"""Analyses as modules whose results are kept and used again while nothing they depend on changes.

A module names the inputs and options that it reads. Its key is a hash of those alone: the options'
values and the contents of the inputs, whatever order or files their rows are in. A finished run is a
row of the ledger with the key and the content hash of its table; a later request with the same key
reads the table if it is still there and unchanged. A new target therefore leaves every module alone
that does not read the target.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.operators.models import adjusted_coefficients
from assocgrid.operators.quality import content_hash
from assocgrid.plans import screens
from assocgrid.plans.ledger import PAIR_MODULES
from assocgrid.sources.sinks import append_ledger, write_prepared
from assocgrid.storage import exists, materialize, new_path

RUNS = "module string, key string, status string, path string, output_hash string, seconds double, turn long"
Inputs = Mapping[str, DataFrame]
Options = Mapping[str, object]


@dataclass(frozen=True)
class Module:
    """A named table, the inputs and options it depends on, and how it is built from them."""

    name: str
    inputs: tuple[str, ...]
    options: tuple[str, ...]
    build: Callable[[Inputs, Options], DataFrame]

    def key(self, marks: Mapping[str, str], options: Options) -> str:
        used = {"module": self.name, "inputs": {i: marks[i] for i in self.inputs}, "options": {o: options[o] for o in self.options}}
        return hashlib.sha256(json.dumps(used, sort_keys=True, default=str).encode()).hexdigest()


def mark(df: DataFrame) -> str:
    """A table's columns, number of rows and content hash as one text."""
    row = content_hash(df).first()
    return f"{df.schema.simpleString()} {row['n_rows']} {row['row_hash']}"


def run(spark: SparkSession, modules: Sequence[Module], inputs: Inputs, options: Options, folder: str) -> dict[str, DataFrame]:
    """The modules' tables, computed or read again; every one adds a row to the ledger below ``folder``."""
    needed = dict.fromkeys(name for m in modules for name in m.inputs)
    marks = {name: mark(inputs[name]) for name in needed}
    path = f"{folder}/ledger"
    known = ledger(spark, folder) if exists(spark, path) else None
    keys = {m.name: m.key(marks, options) for m in modules}
    done, turn = {}, 0
    if known is not None:  # a row or two per module that is asked for
        turn = known.agg(F.max("turn")).first()[0] + 1
        found = known.where((F.col("status") == "computed") & F.col("key").isin(*keys.values()))
        done = {r["key"]: r for r in found.orderBy("turn").collect()}
    out, rows = {}, []
    for module in modules:
        start, key = time.perf_counter(), keys[module.name]
        old = done.get(key)
        if old is not None and exists(spark, old["path"]) and mark(spark.read.parquet(old["path"])) == old["output_hash"]:
            out[module.name], status, place, told = spark.read.parquet(old["path"]), "cached", old["path"], old["output_hash"]
        else:
            place = f"{folder}/{module.name}-{key[:16]}-{turn}"
            out[module.name], status = write_prepared(module.build(inputs, options), place), "computed"
            told = mark(out[module.name])
        rows.append((module.name, key, status, place, told, time.perf_counter() - start, turn))
    append_ledger(spark.createDataFrame(rows, RUNS).coalesce(1), path)
    return out


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{folder}/ledger")


def new_folder(spark: SparkSession) -> str:
    return new_path(spark, "workflow")


# ---- the standard modules -----------------------------------------------------------------


def _driver(inputs: Inputs, options: Options) -> DataFrame:
    rows = inputs["driver_matrix"].where(F.col("feature") == options["driver"])
    return materialize(rows.select("entity", F.col("value").alias("level")), "driver")


def _pair(inputs: Inputs, options: Options) -> DataFrame:
    return screens.matched_pair(_driver(inputs, options), inputs["matrix"].where(F.col("feature") == options["target"]))


def _placed(inputs: Inputs, options: Options) -> DataFrame:
    return _pair(inputs, options).join(inputs["strata"], "entity")


def _screen(inputs: Inputs, options: Options) -> DataFrame:
    driver = screens.prepare_driver(_driver(inputs, options), "level")
    return screens.gated_screen(inputs["matrix"], driver, "level_log", screens.low_group())[1]


BUILDERS: dict[str, tuple[tuple[str, ...], Callable[[Inputs, Options], DataFrame]]] = {
    "feature_screen": (("matrix", "driver_matrix"), _screen),
    "covariation": (("driver_matrix",), lambda i, o: screens.covariation(i["driver_matrix"], o["driver"])),
    "targeted": (("matrix", "driver_matrix"), lambda i, o: screens.targeted_statistics(_pair(i, o))),
    "stratified": (("matrix", "driver_matrix", "strata"), lambda i, o: screens.stratified_effects(_placed(i, o), "stratum", screens.low_group())),
    "adjusted": (("matrix", "driver_matrix", "strata"), lambda i, o: adjusted_coefficients(_placed(i, o), "level_log", "target", "stratum")),
    "threshold_sensitivity": (("matrix", "driver_matrix"), lambda i, o: screens.threshold_sensitivity(_pair(i, o), "level_log", "target")),
}


def standard_modules(names: Sequence[str] = tuple(BUILDERS)) -> list[Module]:
    """Modules of the screen and pair workflows over ``matrix``, ``driver_matrix`` (entity, feature, value) and
    ``strata`` (entity, stratum), with the options ``driver`` and, for pair modules, ``target``."""
    return [Module(n, BUILDERS[n][0], ("driver", "target") if n in PAIR_MODULES else ("driver",), BUILDERS[n][1]) for n in names]
