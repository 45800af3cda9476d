"""Many delimited files with differing headers as one typed table.

Files are grouped by their header line; each group is one scan with a schema of its own, so the plan
grows with the number of distinct headers and not with that of files. What the manifest says of a
file (its constants) is joined by the file's name. Finding the headers reads the lines once, and
keeps one per file; the driver then holds one path per file, as Spark's own file listing does.

A gap is any of the missing texts. A column that a group lacks is NULL there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assocgrid.functions.finite import MISSING_TEXTS
from assocgrid.operators.quality import QualityError, duplicate_keys, require_none
from assocgrid.sources.ingest import union_tables

FILE = "source_file"
MOST_HEADERS = 500


def last_part(path: Column, back: int = 1) -> Column:
    """The last element of a path, or the one so many steps before."""
    return F.element_at(F.split(path, "/"), -back)


def file_headers(spark: SparkSession, folder: str, comment: str = "#") -> DataFrame:
    """(path, header): the first line of every file that is neither empty nor a comment."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    # a file's first split is read from its start by one task, whose row numbers rise
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    told = lines.select(F.col("_metadata.file_path").alias("path"), place.alias("place"), "value").where((F.trim("value") != "") & ~F.startswith("value", F.lit(comment)))
    # min_by alone keeps texts, for which Spark sorts all lines of a task; beside a collected set it keeps one entry per file
    header = told.groupBy("path").agg(F.min_by("value", "place").alias("header"), F.collect_set("place.block").alias("blocks"))
    return header.where(F.size("blocks") > 0).select("path", F.regexp_replace("header", "^﻿|\r$", "").alias("header"))


def read_group(spark: SparkSession, paths: Sequence[str], names: Sequence[str], separator: str, comment: str) -> DataFrame:
    """The rows of files with one header, all columns texts, and the path they come from."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.options(header="true", sep=separator, comment=comment, enforceSchema="true", nullValue="").schema(schema).csv(list(paths))
    known = [F.when(~F.trim(F.col(f"`{n}`")).isin(*MISSING_TEXTS), F.col(f"`{n}`")).alias(n) for n in names]
    return rows.select(*known, F.col("_metadata.file_path").alias("path"))


def read_file_tables(spark: SparkSession, folder: str, separator: str = "\t", comment: str = "#", name_part: int = 1) -> DataFrame:
    """All files below ``folder``: the union of their columns as texts, and ``source_file``."""
    groups: dict[str, list[str]] = defaultdict(list)
    for row in file_headers(spark, folder, comment).collect():
        groups[row["header"]].append(row["path"])
    if not groups:
        raise QualityError(f"no file with a header below {folder}")
    if len(groups) > MOST_HEADERS:
        raise QualityError(f"{len(groups)} different headers below {folder}")
    frames = []
    for header, paths in sorted(groups.items()):
        names = header.split(separator)
        if len(set(names)) != len(names):
            raise QualityError(f"repeated column labels: {header}")
        frames.append(read_group(spark, sorted(paths), names, separator, comment))
    return union_tables(frames).withColumn(FILE, last_part(F.col("path"), name_part)).drop("path")


def with_constants(rows: DataFrame, manifest: DataFrame, file: str = "file_name") -> DataFrame:
    """Each row with its file's manifest columns. The manifest must name every file once."""
    require_none(duplicate_keys(manifest, [file]), "files listed twice")
    stated = manifest.withColumnRenamed(file, "_file")
    joined = rows.join(stated.withColumn("_listed", F.lit(True)), F.col(FILE) == F.col("_file"), "left")
    # no second pass over the rows: an unlisted file ends the job that reads it
    listed = F.when(F.col("_listed"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("file is not in the manifest: "), F.col(FILE))))
    return joined.where(listed).drop("_file", "_listed")


def unlisted_files(rows: DataFrame, manifest: DataFrame, file: str = "file_name") -> DataFrame:
    """Files on one side only, with the side."""
    read, stated = rows.select(F.col(FILE).alias("file")).distinct(), manifest.select(F.col(file).alias("file")).distinct()
    left = read.join(stated, "file", "left_anti").withColumn("side", F.lit("not in the manifest"))
    return left.union(stated.join(read, "file", "left_anti").withColumn("side", F.lit("without rows")))


def typed_strictly(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Listed text columns in their types; a known text that is none of its type ends the job."""
    out = {}
    for name, kind in types.items():
        if name in rows.columns:
            value = F.trim(F.col(name)).try_cast(kind)
            message = F.concat(F.lit(f"{name} is no {kind}: "), F.col(name))
            out[name] = F.when(F.col(name).isNotNull() & value.isNull(), F.raise_error(message).cast(kind)).otherwise(value)
    return rows.withColumns(out)


def unreadable_cells(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """source_file, column, text and n of the known texts that do not fit their column's type."""
    cells = [
        F.when(F.col(c).isNotNull() & F.trim(F.col(c)).try_cast(kind).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("text")))
        for c, kind in types.items()
        if c in rows.columns
    ]
    found = rows.select(FILE, F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return found.groupBy(FILE, "c.column", "c.text").agg(F.count(F.lit(1)).alias("n"))
