"""Nested case and file records to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import col
from assocgrid.functions.labels import type_code_part
from assocgrid.functions.states import TUMOUR_CODES

TUMOUR_ONLY_DATA = ("Gene Level Copy Number", "Allele-specific Copy Number Segment", "Masked Somatic Mutation")


# ---- values of child arrays (all row-local) -----------------------------------------


def combine_distinct(children: Column | str, field: str) -> Column:
    """Distinct known texts of a child array joined by ; in order of first appearance."""
    texts = F.filter(F.transform(col(children), lambda c: c[field].cast("string")), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(F.array_distinct(texts), ";"))


def numeric_values(children: Column | str, field: str) -> Column:
    """Readable numbers of a child array, in order."""
    numbers = F.transform(col(children), lambda c: c[field].cast("string").try_cast("double"))
    return F.filter(numbers, lambda v: v.isNotNull())


def only_number(children: Column | str, field: str) -> Column:
    """The number all children agree on, otherwise NULL."""
    distinct = F.array_distinct(numeric_values(children, field))
    return F.when(F.size(distinct) == 1, F.try_element_at(distinct, F.lit(1)))


def largest_number(children: Column | str, field: str) -> Column:
    return F.array_max(numeric_values(children, field))


def compact_json(value: Column | str) -> Column:
    return F.to_json(col(value))


# ---- tables -------------------------------------------------------------------------


def leaf_rows(parents: DataFrame, keep: Sequence[str], levels: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Rows of the deepest level of nested arrays; a parent without any leaf gives one row of NULLs.

    ``levels`` are (array field inside the previous level, fields to keep from it), such as
    [("portions", ["portion_id"]), ("analytes", ["analyte_id"]), ("aliquots", ["aliquot_id"])].
    The leaves of one parent are gathered inside its own nested value, without a shuffle.
    """

    def leaves(array: Column, depth: int, carried: list[Column]) -> Column:
        fields = levels[depth][1]

        def step(item: Column) -> Column:
            own = [*carried, *[item[f].alias(f) for f in fields]]
            if depth + 1 == len(levels):
                return F.struct(*own)
            return leaves(item[levels[depth + 1][0]], depth + 1, own)

        mapped = F.transform(array, step)
        if depth + 1 == len(levels):
            return mapped
        return F.flatten(F.filter(mapped, lambda inner: inner.isNotNull()))

    names = [f for _, fields in levels for f in fields]
    rows = parents.select(*keep, F.explode_outer(leaves(F.col(levels[0][0]), 0, [])).alias("_leaf"))
    return rows.select(*keep, *[F.col("_leaf")[f].alias(f) for f in names])


ENTITY_FIELDS = ("project_id", "case_id", "case", "sample_id", "sample", "sample_type", "aliquot_id", "aliquot")


def with_entities(files: DataFrame) -> DataFrame:
    """(file_id, file_name, data_type, entities): what each file is associated with, in one array of its row.

    ``files(file_id, file_name, data_type, associated array<string>, cases array<...>)``; entities are aliquots,
    or samples where no aliquot is associated; an empty association list accepts all of the file's own cases.
    """
    free = F.coalesce(F.size("associated"), F.lit(0)) <= 0

    def linked(item: Column, own_id: str) -> Column:
        named = F.array_contains("associated", item[own_id]) | F.array_contains("associated", item["submitter_id"])
        return F.coalesce(free | named, F.lit(False))

    def entity(case: Column, sample: Column, aliquot_id: Column, aliquot: Column) -> Column:
        values = [case["project_id"], case["case_id"], case["submitter_id"], sample["sample_id"], sample["submitter_id"], sample["sample_type"], aliquot_id, aliquot]
        return F.struct(*[v.alias(name) for v, name in zip(values, ENTITY_FIELDS, strict=True)])

    def inner(item: Column, field: str, step) -> Column:
        """What ``step`` gives for each child, in one array; an absent list of children gives none."""
        return F.flatten(F.filter(F.transform(item[field], step), lambda found: found.isNotNull()))

    def aliquots(case: Column, sample: Column) -> Column:
        def of_analyte(analyte: Column) -> Column:
            near = F.filter(analyte["aliquots"], lambda a: linked(a, "aliquot_id"))
            return F.transform(near, lambda a: entity(case, sample, a["aliquot_id"], a["submitter_id"]))

        return inner(sample, "portions", lambda portion: inner(portion, "analytes", of_analyte))

    whole = F.struct(F.filter("cases", lambda c: c.isNotNull()).alias("cases"))
    deep = inner(whole, "cases", lambda c: inner(c, "samples", lambda s: aliquots(c, s)))
    shallow = inner(whole, "cases", lambda c: F.transform(F.filter(c["samples"], lambda s: linked(s, "sample_id")), lambda s: entity(c, s, F.lit(""), F.lit(""))))
    return files.select("file_id", "file_name", "data_type", F.when(F.size(deep) > 0, deep).otherwise(shallow).alias("entities"))


def _entity_rows(files: DataFrame, entities: Column, *more: str) -> DataFrame:
    return files.select("file_id", "file_name", "data_type", *more, F.explode(entities).alias("_e")).select("file_id", "file_name", "data_type", *[F.col(f"_e.{f}").alias(f) for f in ENTITY_FIELDS], *more)


def file_entities(files: DataFrame) -> DataFrame:
    """One row per entity of ``with_entities``."""
    return _entity_rows(with_entities(files), F.col("entities"))


def _targets(files: DataFrame) -> DataFrame:
    """``with_entities`` with the entities a file is about and how they were found; a file's row decides alone."""

    def named(e: Column) -> Column:
        return F.coalesce(((e["aliquot_id"] != "") & F.contains("file_name", e["aliquot_id"])) | ((e["aliquot"] != "") & F.contains("file_name", e["aliquot"])), F.lit(False))

    def tumour(e: Column) -> Column:
        return F.coalesce(type_code_part(e["sample"]).isin(*TUMOUR_CODES), F.lit(False))

    rows = with_entities(files).withColumns({"_named": F.filter("entities", named), "_tumours": F.filter("entities", tumour)})
    somatic = F.col("data_type").isin(*TUMOUR_ONLY_DATA)
    method = (
        F.when(F.size("entities") == 1, "only entity")
        .when(F.size("_named") == 1, "named in file name")
        .when(somatic & (F.size("_tumours") == 1), "only tumour of a tumour-normal pair")
        .otherwise("")
    )
    rows = rows.withColumn("mapping_method", method)
    chosen = F.when(F.col("mapping_method") == "named in file name", F.col("_named")).when(F.startswith("mapping_method", F.lit("only tumour")), F.col("_tumours"))
    return rows.withColumn("targets", chosen.otherwise(F.col("entities")))


def target_entities(files: DataFrame) -> DataFrame:
    """The entity a file is about: the only one, the one named in the file name, or the only tumour.

    Files for which none of these decides keep all their entities with an empty method.
    """
    return _entity_rows(_targets(files), F.col("targets"), "mapping_method")


def matched_normals(files: DataFrame) -> DataFrame:
    """The other entities of files resolved to their only tumour, one row each."""
    paired = _targets(files).where(F.startswith("mapping_method", F.lit("only tumour")))
    others = F.filter("entities", lambda e: e["aliquot_id"] != F.element_at("targets", 1)["aliquot_id"])
    return _entity_rows(paired, others).select("file_id", "aliquot_id")


def summary_table(df: DataFrame, module: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., module, statistic, value): every other column as one text row."""
    names = [c for c in df.columns if c not in keep]
    entries = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("string").alias("value")) for c in names])
    return df.select(*keep, F.lit(module).alias("module"), F.inline(entries))
