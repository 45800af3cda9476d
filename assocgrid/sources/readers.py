"""Reading tables, single features and layered datasets.

A matrix is stored long and sorted by feature (see ``sinks``), so reading one feature is
a filter that Parquet statistics answer without touching other features.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from assocgrid.functions.finite import log2_plus_one
from assocgrid.operators.quality import duplicate_keys, enforced, require_none, unique_rows
from assocgrid.operators.select import first_per_key, with_fallback

NOT_PREPARED = "Prepared table is not available locally; raw sources are not read here"


class DataUnavailable(FileNotFoundError):
    """A prepared table does not exist."""


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """A prepared Parquet table, optionally only some columns or the first rows."""
    if path.lower().endswith((".csv", ".tsv", ".gz", ".json")):
        raise DataUnavailable(f"{NOT_PREPARED}: {path}")
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        raise DataUnavailable(f"{NOT_PREPARED}: {path}") from error
    df = df.select(*columns) if columns else df
    return df.limit(rows) if rows is not None else df


FILE_ORDER = ("_file", "_row")


def scan_in_order(spark: SparkSession, path: str) -> DataFrame:
    """A prepared table with the place of each row: its file's name and its number there.

    Parquet knows a row's number without reading those before it, so the order costs no sort and no
    shuffle; files count in the order of their names.
    """
    rows = scan(spark, path)
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def table_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column names and types from the file footers; no data is read."""
    return scan(spark, path).schema


def read_feature(matrix: DataFrame, feature: str, value_name: str, order: Sequence[str]) -> DataFrame:
    """(entity, value) of one feature; of repeated entities the first by ``order`` is kept, unknowns last.

    ``FILE_ORDER`` on a table of ``scan_in_order`` keeps the file's first row, known or not.
    """
    rows = matrix.where(F.col("feature") == feature)
    known_first = [c for name in order for c in (F.col(name).isNull(), F.col(name))]
    rows = first_per_key(rows.select("entity", *dict.fromkeys(["value", *order])), ["entity"], known_first)
    return rows.select("entity", F.col("value").cast("double").alias(value_name))


def read_feature_strict(matrix: DataFrame, feature: str, value_name: str) -> DataFrame:
    """The same, but a repeated entity is an error."""
    rows = matrix.where(F.col("feature") == feature)
    require_none(duplicate_keys(rows, ["entity"]), f"repeated entities for feature {feature}")
    return rows.select("entity", F.col("value").cast("double").alias(value_name))


def lookup_feature(matrix: DataFrame, feature: str, value_name: str) -> DataFrame:
    """``read_feature_strict`` in one job: a repeated entity ends the job that reads the result."""
    rows = matrix.where(F.col("feature") == feature).select("entity", F.col("value").cast("double").alias(value_name))
    return unique_rows(rows, ["entity"], f"repeated entity of feature {feature}")


def vector_feature(vectors: DataFrame, samples: DataFrame, feature: str | None = None) -> DataFrame:
    """(feature, sample_id, value) from one-row-per-feature arrays and the ordered sample list."""
    rows = vectors if feature is None else vectors.where(F.col("feature") == feature)
    cells = rows.select("feature", F.posexplode("values").alias("sample_index", "value"))
    return cells.join(samples, "sample_index").select("feature", "sample_id", "value")


# places of an array that are put in order together
BLOCK = 4096


def feature_vectors(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(feature, values) from ``cells(feature, sample_id, value)``: one array per feature in the samples' order.

    ``samples(sample_index, sample_id)`` numbers the places from 0. A feature's array holds one value per
    sample whatever its cells are: gaps are NULL, a repeated cell ends the job, cells of unknown samples are
    left out. Blocks of places are filled on their own, so that all tasks share the work; then a feature's
    blocks meet in a row, never more values than there are samples.
    """
    width = samples.agg(F.coalesce(F.max("sample_index") + 1, F.lit(0)).cast("int")).scalar()
    index, size = F.col("sample_index").cast("int"), F.least(F.lit(BLOCK), F.col("_width") - F.col("_block") * BLOCK)
    place = F.struct((index % BLOCK).alias("at"), F.lit(0).alias("filled"), F.col("value").cast("double").alias("value"))
    placed = cells.join(samples, "sample_id").select("feature", F.floor(index / BLOCK).cast("int").alias("_block"), place.alias("c"))
    gathered = placed.groupBy("feature", "_block").agg(F.collect_list("c").alias("known")).withColumn("_width", width)
    repeated = F.size(F.array_distinct(F.transform("known", lambda c: c["at"]))) < F.size("known")
    message = F.concat(F.lit("repeated cells of feature "), F.col("feature").cast("string"))
    blocks = _by_place(enforced(gathered, ~repeated, message), size, lambda k: F.lit(None).cast("double"))

    block = F.struct(F.col("_block").alias("at"), F.lit(0).alias("filled"), F.col("values").alias("value"))
    whole = blocks.groupBy("feature").agg(F.collect_list(block).alias("known")).withColumn("_width", width)
    empty = F.lit(None).cast("double")
    whole = _by_place(whole, F.ceil(F.col("_width") / BLOCK).cast("int"), lambda k: F.array_repeat(empty, F.least(F.lit(BLOCK), F.col("_width") - k * BLOCK)))
    return whole.select("feature", F.flatten("values").alias("values"))


def _by_place(rows: DataFrame, count: Column, gap: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``values``: for each of ``count`` places from 0 the value that ``known(at, filled, value)`` has there, else its gap."""
    gaps = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.alias("at"), F.lit(1).alias("filled"), gap(k).alias("value")))
    merged = rows.withColumn("_all", F.array_sort(F.concat("known", gaps)))
    # the first entry of every place, found by its neighbour before it: the cell if there is one, else the gap
    before = F.concat(F.array(F.lit(-1)), F.transform("_all", lambda c: c["at"]))
    marked = F.zip_with("_all", before, lambda c, at: F.when(c["at"] != at, c))
    return merged.withColumn("values", F.transform(F.filter(marked, lambda c: c.isNotNull()), lambda c: c["value"])).drop("known", "_all")


def with_identity(cells: DataFrame, entity_dim: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Cells with those of the wanted identity columns the dimension really has."""
    present = [c for c in wanted if c in entity_dim.columns and c != "entity"]
    return cells.join(entity_dim.select("entity", *present), "entity")


@dataclass
class Catalog:
    """Datasets by (layer, name); layers are never mixed.

    ``paths`` maps (layer, name) to a Parquet path.  Asking for a dataset in a layer that
    does not have it is an error, never a silent switch to another layer.
    """

    spark: SparkSession
    paths: Mapping[tuple[str, str], str]
    accessors: dict[tuple[str, str], Callable[[str], DataFrame]] = field(default_factory=dict)

    def table(self, name: str, layer: str = "current") -> DataFrame:
        if (layer, name) not in self.paths:
            layers = sorted({k[0] for k in self.paths if k[1] == name})
            raise DataUnavailable(f"dataset {name!r} is not in layer {layer!r} (present in: {layers})")
        return scan(self.spark, self.paths[layer, name])

    def feature(
        self, name: str, feature: str, layer: str = "current", value_name: str = "value", order: Sequence[str] = FILE_ORDER
    ) -> DataFrame:
        """One feature of a layer; of repeated entities the file's first row, or the first by ``order``."""
        self.table(name, layer)  # an absent dataset or layer is an error
        rows = scan_in_order(self.spark, self.paths[layer, name])
        return read_feature(rows, feature, value_name, order).withColumn("layer", F.lit(layer))

    def entity_metadata(self, columns: Sequence[str] | None = None, layer: str = "current", name: str = "entity_metadata", key: str = "entity") -> DataFrame:
        """The metadata of all entities, or some of its columns with the key; a repeated entity ends the job."""
        rows = self.table(name, layer)
        return unique_rows(rows.select(*dict.fromkeys([key, *(columns or rows.columns)])), [key], "repeated entity metadata")

    def log_feature(self, name: str, feature: str, layer: str = "current", value_name: str = "value") -> DataFrame:
        df = self.feature(name, feature, layer, value_name)
        return df.withColumn(value_name, log2_plus_one(value_name))

    def feature_with_fallback(self, primary: str, fallback: str, feature: str, value_name: str = "value") -> DataFrame:
        first = self.feature(primary, feature, value_name=value_name)
        if ("current", fallback) not in self.paths:
            return first.withColumn("source", F.lit(primary))
        return with_fallback(first, self.feature(fallback, feature, value_name=value_name), "entity", (primary, fallback))

    def register(self, database: str, dataset: str, accessor: Callable[[str], DataFrame]) -> None:
        self.accessors[database, dataset] = accessor

    def request(self, feature: str, database: str, dataset: str) -> DataFrame:
        if (database, dataset) not in self.accessors:
            raise ValueError(f"unknown database and dataset: {database!r}, {dataset!r}")
        return self.accessors[database, dataset](feature)

    def create_views(self, layer: str = "current") -> list[str]:
        """A temporary SQL view per dataset of a layer."""
        names = [name for (where, name) in self.paths if where == layer]
        for name in names:
            self.table(name, layer).createOrReplaceTempView(name)
        return names


def standard_accessors(catalog: Catalog) -> Catalog:
    """Named accessors over whichever standard datasets the catalog has."""
    plain = {
        "expression": ("expression",),
        "dependency": ("dependency_effect",),
        "dependency_probability": ("dependency_probability",),
        "mutation_damaging": ("mutation_damaging",),
        "mutation_hotspot": ("mutation_hotspot",),
    }
    for dataset, (table,) in plain.items():
        catalog.register("cell", dataset, lambda f, t=table: catalog.feature(t, f))
    catalog.register("cell", "driver", lambda f: catalog.feature_with_fallback("driver", "driver_fallback", f))
    catalog.register("tumour", "driver", lambda f: catalog.feature("tumour_driver", f))
    catalog.register("tumour", "expression", lambda f: catalog.log_feature("tumour_expression", f))
    catalog.register("tumour", "state", lambda f: catalog.feature("tumour_state", f, layer="reference"))
    return catalog


def same_release(df: DataFrame, columns: Sequence[str], release: str) -> DataFrame:
    """Rows whose provenance columns do not all carry the required release (must be empty)."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.col(c).eqNullSafe(F.lit(release))
    return df.where(bad)
