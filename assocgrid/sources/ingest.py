"""Text, wide and per-entity files to long tables.

Lines and files stay distributed; only a header line is looked at on the driver, as Spark's
own CSV reader does.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assocgrid.functions.finite import MISSING_TEXTS, parse_number, safe_ratio
from assocgrid.functions.labels import SAMPLE_PATTERN, before_bar
from assocgrid.operators.quality import QualityError, bad_ids, require_none

MELT_CHUNK = 500


# ---- metadata -----------------------------------------------------------------------


def read_text_table(spark: SparkSession, path: str, separator: str = ",", comment: str | None = None) -> DataFrame:
    """A delimited table with every column as text; empty cells are NULL."""
    # the parser reserves room for so many columns: those of the header, and as many again
    width = len(header_fields(spark, path, separator, comment))
    options = {"header": "true", "sep": separator, "nullValue": "", "inferSchema": "false", "maxColumns": str(max(20_480, 2 * width))}
    if comment:
        options["comment"] = comment
    return spark.read.options(**options).csv(path)


# ---- wide matrices ------------------------------------------------------------------


def header_fields(spark: SparkSession, path: str, separator: str, comment: str | None = None) -> list[str]:
    return next(csv.reader([_first_line(spark, path, comment).lstrip("\ufeff")], delimiter=separator))


def _first_line(spark: SparkSession, path: str, comment: str | None = None) -> str:
    lines = spark.read.text(path)
    first = (lines.where(~F.col("value").startswith(comment)) if comment else lines).first()
    if first is None:
        raise QualityError(f"empty file: {path}")
    return first["value"]


def split_fields(text: str, separator: str) -> Column:
    """Fields of a delimited line; separators inside quotes do not count, doubled quotes are one.

    Between two quotes in a row every second piece of the line is quoted, so one pass is enough.
    """
    pieces = F.split(text, '"', -1)
    held = F.transform(
        pieces,
        lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(separator), F.lit("\x01"))).when((x == "") & (i > 0) & (i < F.size(pieces) - 1), F.lit('"')).otherwise(x),
    )
    quoted = F.transform(F.split(F.array_join(held, ""), _pattern(separator), -1), lambda x: F.replace(x, F.lit("\x01"), F.lit(separator)))
    return F.when(F.contains(F.col(text), F.lit('"')), quoted).otherwise(F.split(text, _pattern(separator), -1))


def read_wide_text(spark: SparkSession, path: str, separator: str = ",", skip: Sequence[str] = (), check: bool = True) -> DataFrame:
    """(entity, feature, value) from a delimited file with one row per entity.

    The first column is the entity id whatever its name.  Each line becomes an array and
    is exploded by position, so no stage ever holds a column per feature.  Works for any
    number of columns.  A line of another width is an error.
    """
    cells, features, lines = _exploded_lines(spark, path, separator)
    if check:
        names = header_fields(spark, path, separator)
        if len(set(names)) != len(names):
            raise QualityError("repeated column labels are ambiguous")
        require_none(_of_other_width(lines, separator, len(names)), f"lines of another width in {path}")
    features = features.where(~F.col("feature").isin(*skip)) if skip else features
    out = cells.join(features, "position")
    return out.select(F.col("id").alias("entity"), "feature", parse_number("cell").alias("value"))


def read_feature_vectors(spark: SparkSession, path: str, separator: str = "\t", pattern: str | None = SAMPLE_PATTERN) -> tuple[DataFrame, DataFrame]:
    """(vectors, samples) from a (gzipped) matrix with one row per feature and one column per sample.

    ``vectors(feature, symbol, n_known, values)`` keeps each line as one array;
    ``samples(sample_index, sample_id)`` is the header in order.
    """
    names = header_fields(spark, path, separator)
    if len(set(names)) != len(names):
        raise QualityError("repeated sample ids")
    samples = _header_table(spark, names, "sample_id").select((F.col("position") - 1).alias("sample_index"), "sample_id")
    if pattern:
        require_none(bad_ids(samples, "sample_id", pattern), "invalid sample ids")
    lines = _data_lines(spark, path)
    require_none(_of_other_width(lines, separator, len(names)), f"lines of another width in {path}")
    parts = split_fields("value", separator)
    values = F.transform(F.slice(parts, 2, max(len(names) - 1, 1)), parse_number)
    vectors = lines.select(parts[0].alias("feature"), before_bar(parts[0]).alias("symbol"), values.alias("values"))
    known = F.size(F.filter("values", lambda v: v.isNotNull()))
    return vectors.withColumn("n_known", known), samples


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines other than empty ones and the header, which every file of a folder repeats."""
    header = _first_line(spark, path)
    return spark.read.text(path).where(~F.col("value").isin("", header, header.lstrip("\ufeff")))


def _of_other_width(lines: DataFrame, separator: str, width: int) -> DataFrame:
    return lines.withColumn("n_fields", F.size(split_fields("value", separator))).where(F.col("n_fields") != width)


def _pattern(separator: str) -> str:
    """Separator as a regular expression for ``split``."""
    return {"\t": "\t", ",": ",", ";": ";", "|": r"\|"}[separator]


def _header_table(spark: SparkSession, names: Sequence[str], name: str) -> DataFrame:
    """(position, name) of every column after the first."""
    return spark.createDataFrame(list(enumerate(names))[1:], f"position int, {name} string")


def _exploded_lines(spark: SparkSession, path: str, separator: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = _data_lines(spark, path)
    fields = lines.select(split_fields("value", separator).alias("parts"))
    cells = fields.select(F.col("parts")[0].alias("id"), F.posexplode("parts").alias("position", "cell"))
    return cells.where("position > 0"), _header_table(spark, header_fields(spark, path, separator), "feature"), lines


def melt_wide(spark: SparkSession, path: str, id_column: str, features: Sequence[str] | None = None, chunk: int = MELT_CHUNK) -> DataFrame:
    """(entity, feature, value) from a wide Parquet table of any width; without a list, its numeric columns.

    The columns are read in chunks, each a scan of its own columns only: memory per task
    is bounded by the chunk, not by the width of the table.
    """
    wide = spark.read.parquet(path)
    columns = list(features) if features is not None else [f.name for f in wide.schema if f.name != id_column and isinstance(f.dataType, T.NumericType)]
    parts = []
    for start in range(0, len(columns), chunk):
        block = columns[start : start + chunk]
        schema = T.StructType([wide.schema[id_column], *[wide.schema[c] for c in block]])
        frame = spark.read.schema(schema).parquet(path)
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in block])
        parts.append(frame.select(F.col(f"`{id_column}`").alias("entity"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def pivot_features(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """Wide table of a few listed features, for export; large sets stay long."""
    kept = matrix.where(F.col("feature").isin(*features))
    return kept.groupBy("entity").pivot("feature", list(features)).agg(F.first("value", ignorenulls=True))


# ---- one file per entity ------------------------------------------------------------


def read_entity_files(spark: SparkSession, folder: str, schema: str, separator: str = "\t", header: bool = True) -> DataFrame:
    """All delimited files below a folder with their file name; comment lines start with #.

    Cells are read as texts, so that every missing text is NULL, then cast; other texts that do not
    fit their column's type are NULL too.
    """
    wanted = T._parse_datatype_string(schema)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    df = spark.read.option("recursiveFileLookup", "true").options(sep=separator, header=str(header).lower(), comment="#", nullValue="").schema(texts).csv(folder)
    df = df.withColumn("file_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return typed(df, {f.name: f.dataType.simpleString() for f in wanted.fields})


def split_summary_rows(df: DataFrame, feature: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(feature rows, summary rows) by the feature id's prefix."""
    real = F.col(feature).startswith(prefix)
    return df.where(real), df.where(~real)


def library_summary(summary: DataFrame, file: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per file with a column per summary line."""
    return summary.groupBy(file).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns absent from one table are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Listed text columns cast to their type; unreadable or missing texts become NULL."""
    out = {}
    for name, kind in types.items():
        if name in df.columns:
            text = F.trim(F.col(name).cast("string"))
            out[name] = F.when(text.isin(*MISSING_TEXTS), None).otherwise(text.try_cast(kind))
    return df.withColumns(out)


def renamed_or_null(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Adds each target column from its source column, NULL when the source is absent."""
    lookup = {target: F.col(source) if source in df.columns else F.lit(None).cast("string") for target, source in mapping.items()}
    return df.withColumns(lookup)


def allele_fraction(df: DataFrame, alt: str, depth: str, out: str = "allele_fraction") -> DataFrame:
    if alt in df.columns and depth in df.columns:
        return df.withColumn(out, safe_ratio(F.col(alt).cast("double"), F.col(depth).cast("double")))
    return df.withColumn(out, F.lit(None).cast("double"))


def variant_report(variants: DataFrame, sample: str, feature: str, pattern: str = SAMPLE_PATTERN) -> DataFrame:
    """Rows, distinct samples and features, and rows with an invalid sample id."""
    return variants.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(sample).alias("n_samples"),
        F.count_distinct(feature).alias("n_features"),
        F.count_if(F.col(sample).isNull() | ~F.col(sample).rlike(pattern)).alias("n_bad_ids"),
    )


def identity_checked(variants: DataFrame, identities: DataFrame, uuid: str, barcode: str, case: str) -> tuple[DataFrame, DataFrame]:
    """(rows with resolved identity, mismatches): the source id must exist and agree.

    ``identities(uuid, known_barcode, known_case, ...)`` has one row per id.
    """
    joined = variants.join(identities, uuid, "left")
    agree = F.coalesce((F.col("known_barcode") == F.col(barcode)) & (F.col("known_case") == F.col(case)), F.lit(False))
    problem = F.when(F.col("known_barcode").isNull(), "unknown id").when(~agree, "barcode or case differs")
    marked = joined.withColumn("problem", problem)
    bad = marked.where("problem is not null").groupBy(uuid, "problem").agg(F.count(F.lit(1)).alias("n_rows"))
    return marked.where("problem is null").drop("problem", "known_barcode", "known_case"), bad
