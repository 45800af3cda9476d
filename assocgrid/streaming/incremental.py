"""Incremental ingest: only files not seen before are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new_files(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, separator: str = ",") -> DataFrame:
    """Append the rows of new delimited files to ``target`` and return the whole target.

    The file source remembers finished files in ``checkpoint``; a restart after a lost
    executor or driver neither skips nor repeats one.
    """
    stream = (
        spark.readStream.schema(schema)
        .options(sep=separator, header="true", nullValue="")
        .csv(folder)
        .withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    )
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)


def stale_inputs(inputs: DataFrame, manifest: DataFrame, version: str) -> DataFrame:
    """Inputs to process: not in the manifest with the same size, time and processor version."""
    done = manifest.where(F.col("version") == version).select("path", "size", "modified")
    return inputs.join(done, ["path", "size", "modified"], "left_anti")


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files below a folder, without reading their content."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return listing.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
