"""Nested case JSON to clinical and biospecimen rows.

One scan gives a row per case. The schema of ``CASE`` names the fields that the tables need and takes
the nested records (``demographic``, each diagnosis, each sample) as their JSON text: Spark's reader
hands such a record over unparsed, so fields that no schema names are kept too. It cuts the records
out of a line that it holds; of a file under ``multiLine`` it would open the file again for each
record. So a file of several lines is read as one line, up to a separator that no JSON text holds.
Both tables are projections of those rows; nothing is exploded but samples and their aliquots, and
nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assocgrid.functions.labels import years_from_days
from assocgrid.storage import materialize

CASE = (
    "project struct<project_id: string>, case_id string, submitter_id string, disease_type string, primary_site string, "
    "demographic string, diagnoses array<string>, samples array<string>, unreadable string"
)
DEMOGRAPHIC = ("gender", "race", "vital_status", "age_at_index", "days_to_death")
DIAGNOSIS = ("primary_diagnosis", "age_at_diagnosis", "ajcc_pathologic_stage", "tumor_stage", "figo_stage", "tumor_grade", "days_to_death", "days_to_last_follow_up")
DIAGNOSIS_LISTS = ("treatments", "follow_ups")
SAMPLE_KIND = ("sample_type", "tissue_type", "tumor_descriptor", "specimen_type", "preservation_method")
SAMPLE = ("sample_id", "submitter_id", *SAMPLE_KIND)
PORTIONS = "array<struct<portion_id: string, analytes: array<struct<analyte_id: string, analyte_type: string, aliquots: array<string>>>>>"

# control characters, which JSON allows neither in texts nor between its parts
END_OF_FILE = "\x1e\x1d\x1e"

# fixed values: where an age comes from
AGE_FROM_INDEX = "demographic.age_at_index (years)"
AGE_FROM_DAYS = "diagnosis.age_at_diagnosis / 365.25"
AGE_UNKNOWN = "unavailable or multiple diagnoses"


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per case of the files below ``path``: arrays of cases, or with ``multi_line`` off one case a line.

    A record that is no JSON has its text in ``unreadable`` and NULLs elsewhere.
    """
    options = {"recursiveFileLookup": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"}
    if multi_line:
        options["lineSep"] = END_OF_FILE
    rows = spark.read.options(**options).schema(CASE).json(path)
    nested = {"demographic": compacted(F.col("demographic")), "diagnoses": F.transform("diagnoses", compacted), "samples": F.transform("samples", compacted)}
    return rows.withColumns(nested).select(F.col("project.project_id").alias("project_id"), *[c for c in rows.columns if c != "project"])


def compacted(text: Column) -> Column:
    """A JSON text without the white space between its parts; its texts, numbers and order stay as they are.

    White space between parts touches a bracket, a colon or a comma: a text where none does is compact.
    """
    loose = F.rlike(text, F.lit(r"[\[\]{}:,]\s|\s[\[\]{}:,]"))
    return F.when(loose, F.regexp_replace(text, r'("(?:[^"\\]++|\\.)*+")|\s++', "$1")).otherwise(text)


def case_problems(cases: DataFrame, project_prefix: str = "") -> DataFrame:
    """project_id, case_id and problem of cases that must not be used: unreadable, unnamed or of a foreign project."""
    problem = (
        F.when(F.col("unreadable").isNotNull(), "unreadable record")
        .when(F.col("case_id").isNull(), "no case id")
        .when(F.col("project_id").isNull(), "no project")
        .when(~F.startswith("project_id", F.lit(project_prefix)), "foreign project")
    )
    return _whole(cases).select("project_id", "case_id", problem.alias("problem")).where("problem IS NOT NULL")


def usable_cases(cases: DataFrame, project_prefix: str = "") -> DataFrame:
    """The cases without such a problem."""
    named = F.col("case_id").isNotNull() & F.col("project_id").isNotNull()
    return _whole(cases).where(F.col("unreadable").isNull() & named & F.startswith("project_id", F.lit(project_prefix)))


def _whole(cases: DataFrame) -> DataFrame:
    """The same rows, all of whose columns are asked for.

    A reader that leaves columns out does not find a record unreadable that is so for their sake. The
    condition holds for every row.
    """
    sizes = [F.size(c) if isinstance(cases.schema[c].dataType, T.ArrayType) else F.length(c) for c in cases.columns]
    return cases.where(F.coalesce(*sizes, F.lit(0)) >= -1)


# ---- values of a record's children, all inside the row ------------------------------------


def _texts(children: Column, field: str) -> Column:
    return F.filter(F.transform(children, lambda c: c[field]), lambda t: t.isNotNull())


def _joined(children: Column, field: str) -> Column:
    """Distinct known values in order of first appearance, joined by ;"""
    texts = F.array_distinct(_texts(children, field))
    return F.when(F.size(texts) > 0, F.array_join(texts, ";"))


def _numbers(children: Column, field: str) -> Column:
    return F.filter(F.transform(children, lambda c: F.trim(c[field]).try_cast("double")), lambda v: v.isNotNull())


def _agreed(numbers: Column) -> Column:
    """The number that all children with one state."""
    distinct = F.array_distinct(numbers)
    return F.when(F.size(distinct) == 1, F.try_element_at(distinct, F.lit(1)))


def _texts_of(fields: Sequence[str], *more: str) -> str:
    """Schema of an object whose listed fields are read as texts."""
    return ", ".join([*(f"{f} string" for f in fields), *more])


def _parsed(texts: Column, schema: str) -> Column:
    return F.transform(texts, lambda t: F.from_json(t, schema))


def _list_json(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _grandchildren(children: Column, field: str) -> Column:
    return F.flatten(F.filter(F.transform(children, lambda c: c[field]), lambda a: a.isNotNull()))


def _none() -> Column:
    return F.array().cast("array<string>")


def clinical_rows(cases: DataFrame) -> DataFrame:
    """One row per case of ``read_cases``.

    Age is the demographic record's, else that of the diagnoses in days if they agree; of the three
    stages the first that any diagnosis states counts; numbers on which the children disagree are
    NULL. The four ``_json`` columns and ``treatments`` hold the source's records whole.
    """
    records = F.coalesce("diagnoses", _none())
    known = cases.withColumn("_records", records).withColumn("_d", _parsed(F.col("_records"), _texts_of(DIAGNOSIS, *(f"{f} array<string>" for f in DIAGNOSIS_LISTS)))).withColumn("_p", F.from_json("demographic", _texts_of(DEMOGRAPHIC)))
    known = known.withColumn("_f", _grandchildren(F.col("_d"), "follow_ups")).withColumn("_days", _agreed(_numbers(F.col("_d"), "age_at_diagnosis")))
    d, index_age = F.col("_d"), F.col("_p.age_at_index").try_cast("double")
    last = F.array_max(F.concat(_numbers(d, "days_to_last_follow_up"), _numbers(_parsed(F.col("_f"), _texts_of(["days_to_last_follow_up"])), "days_to_last_follow_up")))
    stages = [F.nullif(_joined(d, c), F.lit("")) for c in ("ajcc_pathologic_stage", "tumor_stage", "figo_stage")]
    return known.select(
        "project_id", "case_id", "submitter_id",
        _joined(d, "primary_diagnosis").alias("primary_diagnosis"),
        "disease_type", "primary_site",
        F.coalesce(index_age, years_from_days("_days")).alias("age"),
        F.when(index_age.isNotNull(), AGE_FROM_INDEX).when(F.col("_days").isNotNull(), AGE_FROM_DAYS).otherwise(AGE_UNKNOWN).alias("age_source"),
        F.col("_days").alias("age_at_diagnosis_days"),
        F.col("_p.gender").alias("sex"), F.col("_p.race").alias("race"),
        F.coalesce(*stages).alias("stage"),
        _joined(d, "tumor_grade").alias("grade"),
        F.col("_p.vital_status").alias("vital_status"),
        F.coalesce(F.col("_p.days_to_death").try_cast("double"), _agreed(_numbers(d, "days_to_death"))).alias("days_to_death"),
        last.alias("days_to_last_follow_up"),
        _list_json(_grandchildren(d, "treatments")).alias("treatments"),
        _list_json(F.col("_records")).alias("diagnoses_json"),
        _list_json(F.col("_f")).alias("follow_ups_json"),
        F.coalesce("demographic", F.lit("{}")).alias("demographic_json"),
    )


def biospecimen_rows(cases: DataFrame) -> DataFrame:
    """One row per aliquot of every sample; a sample without aliquots gives one row of NULLs.

    ``sample_json`` is the sample without its portions, ``aliquot_json`` the aliquot, both whole.
    """
    samples = cases.select("project_id", "case_id", F.col("submitter_id").alias("case_submitter_id"), F.explode("samples").alias("_text"))
    samples = samples.withColumn("_s", F.from_json("_text", _texts_of(SAMPLE, f"portions {PORTIONS}"))).withColumn("sample_json", without_field("_text", "portions")).drop("_text")
    portions = F.coalesce("_s.portions", F.array().cast(PORTIONS))

    def aliquots(portion: Column) -> Column:
        return F.flatten(_known(F.transform(portion["analytes"], lambda analyte: F.transform(analyte["aliquots"], lambda aliquot: F.struct(
            portion["portion_id"].alias("portion_id"), analyte["analyte_id"].alias("analyte_id"), analyte["analyte_type"].alias("analyte_type"), aliquot.alias("aliquot_json"))))))

    leaves = F.flatten(_known(F.transform(portions, aliquots)))
    rows = samples.withColumn("_a", F.explode_outer(leaves)).withColumn("_named", F.from_json("_a.aliquot_json", _texts_of(["aliquot_id", "submitter_id"])))
    own = [F.col(f"_s.{c}").alias(c) for c in SAMPLE_KIND]
    return rows.select(
        "project_id", "case_id", "case_submitter_id", F.col("_s.sample_id").alias("sample_id"), F.col("_s.submitter_id").alias("sample_submitter_id"), *own,
        "sample_json",
        "_a.portion_id", "_a.analyte_id", "_a.analyte_type", F.col("_named.aliquot_id").alias("aliquot_id"), F.col("_named.submitter_id").alias("aliquot_submitter_id"), "_a.aliquot_json",
    )


def _known(arrays: Column) -> Column:
    return F.filter(arrays, lambda a: a.isNotNull())


def without_field(text: str, field: str) -> Column:
    """A compacted JSON object's text without one of its fields; the others stay as they are written."""
    value = F.coalesce(F.from_json(text, f"{field} string")[field], F.lit("null"))
    entry = F.concat(F.lit(f'"{field}":'), value)
    rest = F.replace(F.col(text), F.concat(F.lit(","), entry), F.lit(""))
    rest = F.when(rest == F.col(text), F.replace(F.replace(F.col(text), F.concat(entry, F.lit(",")), F.lit("")), entry, F.lit(""))).otherwise(rest)
    return rest


def case_tables(spark: SparkSession, path: str, project_prefix: str = "", multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clinical, biospecimen, problems) of the files, which are read once and kept as columns.

    For one of the three alone, its own function on ``read_cases`` writes nothing.
    """
    cases = materialize(read_cases(spark, path, multi_line), "cases")
    problems = case_problems(cases, project_prefix)
    good = usable_cases(cases, project_prefix)
    return clinical_rows(good), biospecimen_rows(good), problems


def unknown_fields(cases: DataFrame) -> DataFrame:
    """record, field and n: how many records hold a field that no schema here names."""
    records = [
        ("demographic", F.array_compact(F.array("demographic")), DEMOGRAPHIC),
        ("diagnosis", F.col("diagnoses"), (*DIAGNOSIS, *DIAGNOSIS_LISTS)),
        ("sample", F.col("samples"), (*SAMPLE, "portions")),
    ]
    found = F.concat(*[_odd_fields(record, texts, known) for record, texts, known in records])
    return cases.select(F.explode(found).alias("o")).groupBy("o.record", "o.field").agg(F.count(F.lit(1)).alias("n"))


def _odd_fields(record: str, texts: Column, known: Sequence[str]) -> Column:
    """One (record, field) for each field of each of the objects that is not among the known ones."""
    names = F.flatten(_known(F.transform(F.coalesce(texts, _none()), lambda t: F.json_object_keys(t))))
    return F.transform(F.filter(names, lambda f: ~f.isin(*known)), lambda f: F.struct(F.lit(record).alias("record"), f.alias("field")))
