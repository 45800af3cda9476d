"""Feature labels, identifiers and text codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import col

# fixed values: identifier patterns, id-column candidates, sample-type codes, star cutoffs
ENTITY_PATTERN = r"^ACH-\d{6}$"
SAMPLE_PATTERN = r"^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-\d{2}"
ID_COLUMNS = ("ModelID", "DepMap_ID", "DepMapID", "Unnamed: 0", "V1", "X", "")
OTHER_ID_COLUMNS = ("ModelID", "ModelConditionID", "ProfileID", "OmicsProfileID", "SequencingID")
SAMPLE_TYPE_BY_CODE = {
    "01": "Primary Solid Tumor",
    "02": "Recurrent Solid Tumor",
    "03": "Primary Blood Derived Cancer - Peripheral Blood",
    "04": "Recurrent Blood Derived Cancer - Bone Marrow",
    "05": "Additional - New Primary",
    "06": "Metastatic",
    "07": "Additional Metastatic",
    "08": "Human Tumor Original Cells",
    "09": "Primary Blood Derived Cancer - Bone Marrow",
    "10": "Blood Derived Normal",
    "11": "Solid Tissue Normal",
    "12": "Buccal Cell Normal",
    "13": "EBV Immortalized Normal",
    "14": "Bone Marrow Normal",
    "20": "Control Analyte",
    "40": "Recurrent Blood Derived Cancer - Peripheral Blood",
}
STARS = ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*"))


def clean_label(label: Column | str) -> Column:
    """Label without a trailing parenthesised part and without anything after a bar."""
    return F.regexp_replace(F.regexp_replace(col(label), r"\s*\([^)]*\)\s*$", ""), r"\|.*$", "")


def label_number(label: Column | str) -> Column:
    """The number in trailing parentheses, as text; NULL without one."""
    number = F.regexp_extract(col(label), r"\((\d+)\)$", 1)
    return F.when(number != "", number)


def feature_dim(labels: DataFrame, label: str) -> DataFrame:
    """feature_dim(label, symbol, number) of distinct labels."""
    return labels.select(F.col(label).alias("label")).distinct().select(
        "label", clean_label("label").alias("symbol"), label_number("label").alias("number")
    )


def map_code(code: Column | str, mapping: Mapping[str, str]) -> Column:
    """Lookup in a small literal map; NULL when absent."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), col(code))


def unmapped_labels(df: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    """Known labels that a mapping(label, ...) table does not cover; they must be none."""
    return df.where(F.col(label).isNotNull()).select(label).distinct().join(mapping.select(label), label, "left_anti")


def iso_now() -> Column:
    """Current time as ISO text with its zone offset."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def sample_type(code: Column | str) -> Column:
    return map_code(code, SAMPLE_TYPE_BY_CODE)


def patient_part(barcode: Column | str) -> Column:
    return F.substring(col(barcode), 1, 12)


def type_code_part(barcode: Column | str) -> Column:
    return F.substring(col(barcode), 14, 2)


def strip_prefix(text: Column | str, prefix: str) -> Column:
    t = col(text)
    return F.when(t.startswith(prefix), F.substring(t, F.lit(len(prefix) + 1), F.length(t))).otherwise(t)


def before_bar(text: Column | str) -> Column:
    return F.split(col(text), r"\|")[0]


def star_code(p: Column | str) -> Column:
    out = F.when(col(p).isNull() | F.isnan(col(p)), "NA")
    for limit, stars in STARS:
        out = out.when(col(p) < limit, stars)
    return out.otherwise("ns")


def p_text(p: Column | str) -> Column:
    """P as text with three significant digits; very small values share one floor text."""
    v = col(p)
    small = F.format_string("%.2e", v)
    places = F.greatest(F.lit(0), 2 - F.floor(F.log10(v)).cast("int"))
    plain = F.regexp_replace(F.format_string("%.10f", F.round(v * F.pow(10.0, places)) / F.pow(10.0, places)), r"\.?0+$", "")
    return F.when(v.isNull() | F.isnan(v), "NA").when(v < 2e-16, "<2e-16").when(v < 1e-4, small).otherwise(plain)


def years_from_days(days: Column | str) -> Column:
    return col(days) / 365.25


def pick_id_column(names: Sequence[str]) -> str:
    """The id column of a wide table: the first known candidate, otherwise the first column."""
    return next((c for c in ID_COLUMNS if c in names), names[0])


def feature_columns(names: Sequence[str], id_column: str) -> list[str]:
    other = {*OTHER_ID_COLUMNS, id_column}
    return [c for c in names if c not in other]


def first_present(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate column a table has; source columns are chosen at plan time."""
    return next((c for c in candidates if c in names), None)


def dataset_name(file_name: Column | str, prefixes: Mapping[str, str]) -> Column:
    """Canonical dataset of a file by the first matching prefix, NULL when none matches."""
    name = col(file_name)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    out = None
    for prefix, target in prefixes.items():
        hit = (stem == prefix) | name.startswith(f"{prefix}_") | name.startswith(f"{prefix}(")
        out = (F if out is None else out).when(hit, target)
    return out


class ResolutionError(KeyError):
    """A feature name matches nothing, or more than one label."""


def resolve_feature(dim: DataFrame, name: str, on_ambiguous: str = "error", required: bool = True) -> str | None:
    """The label of a feature given as exact label, symbol or number.

    ``first`` ignores case, matches symbols only and takes the first label; ``error``
    rejects several matches.  An absent name is an error unless ``required`` is false.
    """
    if on_ambiguous == "first":
        hits = dim.where(F.upper("symbol") == name.upper()).orderBy("label").limit(1)
    else:
        hits = dim.where((F.col("label") == name) | (F.col("symbol") == name) | (F.col("number") == name))
        hits = hits.orderBy((F.col("label") == name).desc(), "label").limit(2)
    found = [row["label"] for row in hits.collect()]  # at most two rows
    if not found:
        if required:
            raise ResolutionError(f"feature {name!r} is absent")
        return None
    if found[0] == name or len(found) == 1:
        return found[0]
    raise ResolutionError(f"feature {name!r} is ambiguous: {found}")


def resolve_versioned(dim: DataFrame, name: str) -> str:
    """Feature id given as id, name, or id without version; only a unique match counts.

    ``dim(feature_id, feature_name)``; an exact id wins over names.
    """
    exact, named = F.col("feature_id") == name, F.col("feature_name") == name
    bare = F.substring_index("feature_id", ".", 1) == name
    tier = F.when(exact, 0).when(named, 1).when(bare, 2)
    per_tier = dim.select("feature_id", tier.alias("tier")).where("tier is not null")
    per_tier = per_tier.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("feature_id").alias("feature_id"))
    best = per_tier.orderBy("tier").limit(1).collect()  # at most one row
    if not best or best[0]["n"] != 1:
        raise ResolutionError(f"feature {name!r} is absent or ambiguous")
    return best[0]["feature_id"]
