"""Writing prepared tables, exports and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.operators.quality import content_hash


ROW_GROUP_BYTES = 16 << 20  # of a matrix: a lookup reads a row group or two
FEATURES = 100_000  # that a Bloom filter of a row group is made for at most


def write_prepared(df: DataFrame, path: str, codec: str = "zstd", **options: object) -> DataFrame:
    """New Parquet table; an existing one is never overwritten."""
    df.write.mode("errorifexists").options(compression=codec, **options).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_matrix(matrix: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Long matrix sorted by feature, so that Parquet statistics find one feature.

    The range key includes the entity: a feature holding a large part of all cells is
    spread over several files instead of one. Row groups are small and carry a Bloom filter of their
    features, so that a name inside a group's range that it does not have is not read either.
    """
    keys = ["feature", "entity"]
    ranged = matrix.repartitionByRange(partitions, *keys) if partitions else matrix.repartitionByRange(*keys)
    bloom = {"parquet.bloom.filter.enabled#feature": "true", "parquet.bloom.filter.expected.ndv#feature": FEATURES, "parquet.bloom.filter.adaptive.enabled": "true"}
    return write_prepared(ranged.sortWithinPartitions(*keys), path, **{"parquet.block.size": ROW_GROUP_BYTES, **bloom})


def write_export(df: DataFrame, path: str) -> None:
    """CSV with header; doubles keep full precision, so a tiny P never becomes zero."""
    df.write.mode("errorifexists").option("header", "true").option("nullValue", "").csv(path)


def append_ledger(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def manifest_row(df: DataFrame, name: str, key: Sequence[str], method: str, codec: str = "zstd") -> DataFrame:
    """Rows, columns, distinct keys and content hash of a table, as one manifest row."""
    keys = df.agg(F.count_distinct(*key).alias("n_keys"))
    return content_hash(df).select(
        F.lit(name).alias("dataset"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        keys.scalar().alias("n_keys"),
        F.lit(codec).alias("codec"),
        F.lit(method).alias("method"),
        "row_hash",
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
