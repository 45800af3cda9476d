"""Data-quality checks; each returns a DataFrame of violations, empty when the check passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assocgrid.functions.finite import col, is_finite


class QualityError(ValueError):
    """A check that must hold found violations."""


def require_none(violations: DataFrame, message: str, shown: int = 5) -> None:
    rows = violations.limit(shown).collect()
    if rows:
        raise QualityError(f"{message}: {[r.asDict() for r in rows]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_to_one_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a key may appear once on either side; a repeated key is an error."""
    require_none(duplicate_keys(a, keys), "repeated keys on the first side")
    require_none(duplicate_keys(b, keys), "repeated keys on the second side")
    return a.join(b, list(keys), how)


def enforced(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """``df``; a row that is not ``ok`` ends the job that meets it, so the check needs no pass of its own."""
    told = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(told)))


def unique_rows(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` with one row per key; a repeated key ends the job.

    The rows are gathered by their keys, so that a join on them that follows needs no other shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    gathered = df.groupBy(*keys).agg(F.any_value(F.struct(*others)).alias("_row"), F.count(F.lit(1)).alias("_times"))
    message = F.concat(F.lit(f"{what}: "), F.to_json(F.struct(*keys)))
    return enforced(gathered, F.col("_times") == 1, message).select(*keys, "_row.*")


def bad_ids(df: DataFrame, column: str, pattern: str) -> DataFrame:
    text = F.col(column).cast("string")
    return df.where(text.isNull() | ~text.rlike(pattern)).select(column).distinct()


def ambiguous_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more or fewer than one distinct value."""
    facts = df.groupBy(key).agg(F.count_distinct(value).alias("n_values"))
    return facts.where("n_values <> 1")


def mapping_report(df: DataFrame, entity: str, default: Column) -> DataFrame:
    """Per entity: default rows (must be one, never averaged) and skipped non-default rows."""
    facts = df.groupBy(entity).agg(F.count_if(default).alias("n_default"), F.count_if(~default).alias("n_skipped"))
    return facts.withColumn("ambiguous", F.col("n_default") > 1)


def coverage_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    only_a = left.join(right, key, "left_anti").withColumn("side", F.lit("first only"))
    return only_a.unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("second only")))


def field_changes(now: DataFrame, saved: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field) of every field whose value differs between two tables, NULL equal to NULL."""
    b = saved.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = now.select(key, *fields).join(b, key)
    changed = F.filter(
        F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]), lambda name: name.isNotNull()
    )
    return joined.select(key, F.explode(changed).alias("field"))


def inconsistent_rows(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows in which two columns that must agree differ; NULL agrees with NULL only."""
    bad = F.lit(False)
    for a, b in pairs:
        bad = bad | ~F.col(a).eqNullSafe(F.col(b))
    return df.where(bad)


def domain_violations(
    df: DataFrame, value: str, minimum: float | None = None, maximum: float | None = None, integer: bool = False, allowed: Sequence[float] | None = None
) -> DataFrame:
    """One row per broken rule with the number of offending values; NULL cells are not tested."""
    v = F.col(value)
    rules: dict[str, Column] = {"not finite": v.isNotNull() & ~is_finite(value)}
    if minimum is not None:
        rules[f"below {minimum}"] = is_finite(value) & (v < minimum)
    if maximum is not None:
        rules[f"above {maximum}"] = is_finite(value) & (v > maximum)
    if integer:
        rules["not an integer"] = is_finite(value) & (v != F.rint(v))
    if allowed is not None:
        rules["not allowed"] = is_finite(value) & ~v.isin(*allowed)
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    entries = [F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in rules]
    return counts.select(F.inline(F.array(*entries))).where("n > 0")


def feature_list_differences(cells: DataFrame, file: str, feature: str, position: str) -> DataFrame:
    """Files whose ordered feature list differs from the most common one.

    The list is fingerprinted by an order-sensitive sum over (position, feature), so no
    file's list is ever collected.
    """
    mark = F.xxhash64(position, feature).cast("decimal(38,0)")
    prints = cells.groupBy(file).agg(F.sum(mark).alias("fingerprint"), F.count(F.lit(1)).alias("n_features"))
    common = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    usual = common.agg(F.max_by("fingerprint", F.struct("n", "fingerprint"))).scalar()
    return prints.where(F.col("fingerprint") != usual).select(file, "n_features")


def ragged_lines(lines: DataFrame, text: str, separator: str, width: int) -> DataFrame:
    fields = F.size(F.split(F.col(text), separator, -1))
    return lines.withColumn("n_fields", fields).where((F.col("n_fields") != width) & (F.col(text) != ""))


def empty_table(df: DataFrame, name: str) -> DataFrame:
    """One row when the table is empty."""
    return df.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(name).alias("empty_table"))


def metadata_overlap(matrix: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Distinct matrix entities with and without metadata."""
    ids = matrix.select(key).distinct().join(meta.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    return ids.agg(F.count_if(F.col("_known")).alias("matched"), F.count_if(F.col("_known").isNull()).alias("unmatched"))


def close(a: Column | str, b: Column | str, rtol: float) -> Column:
    """Equal (NULLs and infinities included), or both finite and within a relative tolerance; a tiny P never equals zero."""
    x, y = col(a), col(b)
    size = F.greatest(F.abs(x), F.abs(y))
    within = (size < float("inf")) & (F.abs(x - y) <= rtol * size)
    return x.eqNullSafe(y) | F.coalesce(within, F.lit(False))


def recomputation_differences(stored: DataFrame, again: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-9) -> DataFrame:
    """Keys and columns whose stored value is not reproduced."""
    b = again.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stored.select(*keys, *columns).join(b, list(keys), "left")
    off = F.filter(F.array(*[F.when(~close(c, f"_{c}", rtol), F.lit(c)) for c in columns]), lambda name: name.isNotNull())
    return joined.select(*keys, F.explode(off).alias("column"))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], rtol: float = 5e-13) -> DataFrame:
    """One row per column: mismatches, NULL-mask differences, rows on one side, largest error.

    Numbers are compared with a relative tolerance and no absolute one, all else exactly.
    """
    columns = [c for c in a.columns if c not in keys]
    left = a.select(*keys, *columns, F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_b"))
    joined = left.join(right, list(keys), "full_outer")
    paired = F.col("_a") & F.col("_b")
    numeric = {f.name for f in a.schema.fields if isinstance(f.dataType, T.NumericType)}
    aggregates, entries = [], []
    for i, c in enumerate(columns):
        x, y = F.col(c), F.col(f"_{c}")
        same = close(c, f"_{c}", rtol) if c in numeric else x.eqNullSafe(y)
        error = F.max(F.when(paired, F.abs(x.cast("double") - y.cast("double")))) if c in numeric else F.lit(None).cast("double")
        aggregates += [
            F.count_if(paired & ~same).alias(f"m{i}"),
            F.count_if(paired & (x.isNull() != y.isNull())).alias(f"k{i}"),
            error.alias(f"e{i}"),
        ]
        entries.append(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_different"), F.col(f"k{i}").alias("n_null_mask"), F.col(f"e{i}").alias("max_error"), "n_one_side"))
    one_side = F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_one_side")
    return joined.agg(*aggregates, one_side).select(F.inline(F.array(*entries)))


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    """Column names or types that differ, in order; decided from the schemas alone."""
    left, right = [f.simpleString() for f in a.schema.fields], [f.simpleString() for f in b.schema.fields]
    return [f"{x} / {y}" for x, y in zip(left, right) if x != y] + left[len(right) :] + right[len(left) :]


def percentage_problems(shares: DataFrame, stratum: str, tolerance: float = 1e-9) -> DataFrame:
    """Strata whose percentages do not sum to 100."""
    total = shares.groupBy(stratum).agg(F.sum("percentage").alias("total"))
    return total.where(F.abs(F.col("total") - 100) > tolerance)


def uncovered_entities(matrix: DataFrame, meta: DataFrame, key: str, exempt: Column, group: str) -> DataFrame:
    """Matrix entities without metadata per group; only those known to be exempt (controls) are left out."""
    missing = matrix.where(~F.coalesce(exempt, F.lit(False))).select(key, group).distinct().join(meta.select(key).distinct(), key, "left_anti")
    return missing.groupBy(group).agg(F.count(F.lit(1)).alias("n_missing"))


def sampled_cell_differences(source: DataFrame, derived: DataFrame, keys: Sequence[str], value: str, features: Sequence[str], feature: str) -> DataFrame:
    """Cells of chosen features that differ between the source and the derived matrix."""
    a = source.where(F.col(feature).isin(*features)).select(*keys, F.col(value).alias("in_source"))
    b = derived.where(F.col(feature).isin(*features)).select(*keys, F.col(value).alias("in_derived"))
    return a.join(b, list(keys), "full_outer").where(~F.col("in_source").eqNullSafe(F.col("in_derived")))


def range_report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Count of rows failing each named predicate (the predicate states the failure)."""
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in checks.items()])
    entries = [F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("n_failed")) for name in checks]
    return counts.select(F.inline(F.array(*entries)))


def rank_problems(df: DataFrame, rank: str) -> DataFrame:
    """One row unless the ranks are exactly 1..n."""
    facts = df.agg(F.count(rank).alias("n"), F.count_distinct(rank).alias("n_distinct"), F.max(rank).alias("highest"), F.min(rank).alias("lowest"))
    fine = (F.col("n") == F.col("n_distinct")) & (F.col("highest") == F.col("n")) & (F.col("lowest") == 1)
    return facts.where((F.col("n") > 0) & ~fine)


def file_mapping_issues(files: DataFrame, file: str, entity: str, access: str, state: str) -> DataFrame:
    """Files that map to no or several entities, or are not known to be open and released."""
    released = F.coalesce((F.col(access) == "open") & (F.col(state) == "released"), F.lit(False))
    facts = files.groupBy(file).agg(F.count_distinct(entity).alias("n_entities"), F.min(released).alias("usable"))
    return facts.where((F.col("n_entities") != 1) | ~F.col("usable"))


def matrix_profile(cells: DataFrame, feature: str, value: str) -> DataFrame:
    """Missing and finite cells, range and distinct features of a long matrix, in one pass."""
    return cells.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.min(F.when(is_finite(value), F.col(value))).alias("minimum"),
        F.max(F.when(is_finite(value), F.col(value))).alias("maximum"),
        F.count_distinct(feature).alias("n_features"),
    )


HASH_DIGITS = 15  # hexadecimal digits of a row's checksum that count


def row_text(df: DataFrame) -> Column:
    """A row as text that no other row of the schema shares: each value with its length, NULL as a minus."""
    texts = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and order-insensitive hash of all rows: the first 60 bits of the rows' MD5 sums, added modulo 2^64.

    It depends on the values' texts alone and can be computed by any engine that writes them alike.
    """
    mark = F.conv(F.substring(F.md5(row_text(df).cast("binary")), 1, HASH_DIGITS), 16, 10).cast("decimal(38,0)")
    total = F.sum(mark) % F.lit(str(2**64)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(total, F.lit(0)).cast("decimal(20,0)").cast("string").alias("row_hash"))
