"""Deterministic choices among several candidate rows per key.

Each choice is a minimum or maximum of an ordering struct, a partial aggregate, so a key
with very many candidates is reduced on the map side and never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.labels import map_code
from assocgrid.operators.quality import require_none


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the largest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def pick_representatives(candidates: DataFrame, preferred: DataFrame, entity: str, aliquot: str, file: str) -> DataFrame:
    """All candidates with ``matches`` and ``selected``: one selected per entity.

    A candidate whose aliquot is the entity's preferred one wins, then the smallest file id.
    ``preferred(entity, aliquot)`` has one row per entity.
    """
    wish = preferred.select(entity, F.col(aliquot).alias("_wish"))
    rows = candidates.join(wish, entity, "left").withColumn("matches", F.coalesce(F.col(aliquot) == F.col("_wish"), F.lit(False)))
    best = rows.groupBy(entity).agg(F.min(F.struct(~F.col("matches"), F.col(file).alias("f")))["f"].alias("_file"))
    return rows.join(best, entity).withColumn("selected", F.col(file) == F.col("_file")).drop("_wish", "_file")


def apply_selection(candidates: DataFrame, saved: DataFrame, file: str, fields: Sequence[str]) -> DataFrame:
    """Candidates chosen by a saved selection; a changed coverage or identity is an error."""
    require_none(selection_problems(candidates, saved, file, fields), "the saved selection does not fit the candidates")
    return candidates.join(saved.where("selected").select(file, "matches", "selected"), file)


def selection_problems(candidates: DataFrame, saved: DataFrame, file: str, fields: Sequence[str]) -> DataFrame:
    """Files missing on either side, or whose identity fields changed since the selection."""
    a = candidates.select(file, *[F.col(f).alias(f"{f}_now") for f in fields]).withColumn("_now", F.lit(True))
    b = saved.select(file, *[F.col(f).alias(f"{f}_saved") for f in fields]).withColumn("_saved", F.lit(True))
    both = a.join(b, file, "full_outer")
    problem = F.when(F.col("_saved").isNull(), "not in selection").when(F.col("_now").isNull(), "file gone")
    for f in fields:
        problem = problem.when(~F.col(f"{f}_now").eqNullSafe(F.col(f"{f}_saved")), f"{f} changed")
    return both.select(file, problem.alias("problem")).where("problem is not null")


def pick_by_priority(
    rows: DataFrame, entity: str, method: str, priority: Mapping[str, int], order: Sequence[str], name: str | None = None
) -> DataFrame:
    """One row per entity by method priority and ``order``, with what else was available.

    Adds ``available_methods`` (in priority order) and ``same_method_candidates``; with a ``name``
    column also ``candidate_ids``, the names of all the entity's rows in the order of choice, joined by ; Rows with an
    unknown method must be rejected first (see ``unknown_methods``).
    """
    ranked = rows.withColumn("_priority", map_code(method, {k: str(v) for k, v in priority.items()}).cast("int"))
    rest = [c for c in rows.columns if c not in (entity, method)]
    in_order = F.sort_array(F.collect_list(F.struct(*order, F.col(name).cast("string").alias("_name")))) if name else None
    names = [F.array_join(F.transform(in_order, lambda c: c["_name"]), ";").alias("_names")] if name else []
    by_method = ranked.groupBy(entity, method, "_priority").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("_n"), *names
    )
    # one row per entity and method: bounded by the number of methods
    methods = F.sort_array(F.collect_list(F.struct("_priority", method, *(["_names"] if name else []))))
    best = by_method.groupBy(entity).agg(
        F.min_by(F.struct(method, "_row", "_n"), "_priority").alias("_best"),
        F.array_join(F.transform(methods, lambda m: m[method]), ";").alias("available_methods"),
        *([F.array_join(F.transform(methods, lambda m: m["_names"]), ";").alias("candidate_ids")] if name else []),
    )
    return best.select(
        entity,
        F.col("_best")[method].alias(method),
        *[F.col("_best")["_row"][c].alias(c) for c in rest],
        "available_methods",
        F.col("_best")["_n"].alias("same_method_candidates"),
        *(["candidate_ids"] if name else []),
    )


def unknown_methods(rows: DataFrame, method: str, priority: Mapping[str, int]) -> DataFrame:
    return rows.where(F.col(method).isNull() | ~F.col(method).isin(*priority)).select(method).distinct()


def preferred_methods(rows: DataFrame, method: str, words: Sequence[str]) -> DataFrame:
    """Rows whose method contains every word; all rows if there are none and only one method exists."""
    hit = F.lit(True)
    for word in words:
        hit = hit & F.col(method).contains(word)
    facts = rows.agg(F.count_if(hit).alias("hits"), F.count_distinct(method).alias("methods")).first()
    if facts["hits"]:
        return rows.where(hit)
    if facts["methods"] > 1:
        raise ValueError("several methods and none preferred: an explicit choice is needed")
    return rows


TIER_REASONS = ("same method and aliquot", "same method", "fallback to another supported method")
NO_CANDIDATE = "no candidate for this entity"


def tiered_fallback(
    wanted: DataFrame, candidates: DataFrame, entity: str, method: str, aliquot: str, file: str, priority: Mapping[str, int] | None = None
) -> DataFrame:
    """For each wanted row the best candidate of its entity, or none, with the reason.

    Tiers: same method and aliquot, else same method, else any (supported) method; then
    priority, aliquot and file.  ``wanted`` has one row per entity.
    """
    c = candidates.select(entity, F.col(method).alias("_m"), F.col(aliquot).alias("_a"), F.col(file).alias("_f"))
    if priority is None:
        place = F.lit(0)
    else:
        c = c.where(F.col("_m").isin(*priority))
        place = map_code("_m", {k: str(v) for k, v in priority.items()}).cast("int")
    pairs = wanted.join(c, entity, "left")
    tier = F.when(F.col("_f").isNull(), None).when((F.col("_m") == F.col(method)) & (F.col("_a") == F.col(aliquot)), 0)
    tier = tier.when(F.col("_m") == F.col(method), 1).otherwise(2)
    ordering = F.struct(tier.alias("tier"), place.alias("place"), F.col("_a").alias("a"), F.col("_f").alias("f"), F.col("_m").alias("m"))
    best = pairs.groupBy(*wanted.columns).agg(F.min(F.when(F.col("_f").isNotNull(), ordering)).alias("_best"))
    reason = F.when(F.col("_best").isNull(), NO_CANDIDATE)
    for number, text in enumerate(TIER_REASONS):
        reason = reason.when(F.col("_best")["tier"] == number, text)
    return best.select(
        *wanted.columns,
        F.col("_best")["f"].alias("chosen_file"),
        F.col("_best")["m"].alias("chosen_method"),
        F.coalesce(F.col("_best")["m"] == F.col(method), F.lit(False)).alias("method_match"),
        reason.alias("reason"),
    )


def best_by_coverage(files: DataFrame, name: str, coverage: Sequence[Column | str]) -> DataFrame:
    """All files with ``active``: the one of largest coverage per name (ties by file name)."""
    best = files.groupBy(name).agg(F.max_by("file_name", F.struct(*coverage, "file_name")).alias("_best"))
    return files.join(best, name).withColumn("active", F.col("file_name") == F.col("_best")).drop("_best")


def latest_release(df: DataFrame, release: str, pattern: str = r"^Public (\d{2})Q([1-4])(?: v(\d+))?$") -> DataFrame:
    """One row: the newest release by (year, quarter, revision); names off the pattern are ignored."""
    parts = [F.regexp_extract(release, pattern, i) for i in (1, 2, 3)]
    number = F.struct(parts[0].cast("int"), parts[1].cast("int"), F.when(parts[2] == "", 1).otherwise(parts[2].try_cast("int")))
    return df.where(F.col(release).rlike(pattern)).agg(F.max_by(release, F.struct(number, F.col(release))).alias("latest"))


def with_fallback(primary: DataFrame, fallback: DataFrame, entity: str, names: tuple[str, str] = ("primary", "fallback")) -> DataFrame:
    """Primary rows plus fallback rows of entities absent from primary (a NULL value is not absence)."""
    extra = fallback.join(primary.select(entity).distinct(), entity, "left_anti").withColumn("source", F.lit(names[1]))
    return primary.withColumn("source", F.lit(names[0])).unionByName(extra, allowMissingColumns=True)


def resolve_ids(
    rows: DataFrame, raw: str, profiles: DataFrame, conditions: DataFrame, pattern: str
) -> DataFrame:
    """Adds ``entity`` and ``via``: the id itself, else through the profile map, else the condition map.

    ``profiles(key, entity, is_default)`` and ``conditions(key, entity)`` have one row per
    key; a non-default profile is marked ``skipped``, an unknown id ``unresolved``.
    """
    p = profiles.select(F.col("key").alias(raw), F.col("entity").alias("_p"), F.col("is_default").alias("_default"))
    c = conditions.select(F.col("key").alias(raw), F.col("entity").alias("_c"))
    direct = F.col(raw).rlike(pattern)
    via = (
        F.when(direct, "direct")
        .when(F.col("_p").isNotNull() & F.col("_default"), "profile")
        .when(F.col("_p").isNotNull(), "skipped")
        .when(F.col("_c").isNotNull(), "condition")
        .otherwise("unresolved")
    )
    entity = F.when(F.col("via") == "direct", F.col(raw)).when(F.col("via") == "profile", F.col("_p")).when(F.col("via") == "condition", F.col("_c"))
    joined = rows.join(p, raw, "left").join(c, raw, "left").withColumn("via", via)
    return joined.withColumn("entity", entity).drop("_p", "_c", "_default")


def corrected_rows(rows: DataFrame, corrections: DataFrame, file: str, fields: Sequence[str]) -> DataFrame:
    """Rows of corrected files replaced by one row per correction; the former ids are kept.

    ``corrections(file, fields...)`` may hold several rows per file.
    """
    fix = corrections.select(file, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("corrected"))
    joined = rows.join(fix, file, "left").withColumn("corrected", F.coalesce("corrected", F.lit(False)))
    former = {f"original_{f}": F.when(F.col("corrected"), F.col(f)) for f in fields}
    joined = joined.withColumns(former)
    return joined.withColumns({f: F.when(F.col("corrected"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def catalog_status(wanted: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """Status of each wanted file: available, missing but optional, or missing and required."""
    known = catalog.select(name).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known"), "available").when(F.col("optional"), "unavailable_optional").otherwise("missing_required")
    return wanted.join(known, name, "left").withColumn("status", status).drop("_known")


def pairwise_overlap(members: DataFrame, entity: str, dataset: str, names: Sequence[str]) -> DataFrame:
    """Shared entities of every pair of datasets: one flag per dataset and entity, then counts.

    The pairs are columns of one aggregate, so no pair of rows is ever formed.
    """
    flags = members.groupBy(entity).agg(*[F.max(F.col(dataset) == n).alias(f"_d{i}") for i, n in enumerate(names)])
    pairs = [(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if a < b]
    counts = flags.agg(*[F.count_if(F.col(f"_d{i}") & F.col(f"_d{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    entries = [F.struct(F.lit(names[i]).alias("dataset_a"), F.lit(names[j]).alias("dataset_b"), F.col(f"p{i}_{j}").alias("overlap")) for i, j in pairs]
    return counts.select(F.inline(F.array(*entries)))


def impute_from_group(df: DataFrame, group: str, value: str, source: str) -> DataFrame:
    """Missing values filled from the group's only known value; ``source`` tells where it came from."""
    known = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    only = known.where(F.col("_lo") == F.col("_hi")).select(group, F.col("_lo").alias("_only"))
    joined = df.join(only, group, "left")
    origin = F.when(F.col(value).isNotNull(), "observed").when(F.col("_only").isNotNull(), "same_group_unambiguous").otherwise("unmapped")
    return joined.withColumn(source, origin).withColumn(value, F.coalesce(value, "_only")).drop("_only")


def reindex_to_all(dim: DataFrame, key: str, others: Sequence[DataFrame]) -> DataFrame:
    """``dim`` extended to every key seen in any of the other tables."""
    keys = dim.select(key)
    for other in others:
        keys = keys.unionByName(other.select(key))
    return keys.distinct().join(dim, key, "left")


def single_value(value: Column | str) -> Column:
    """Aggregate: the value if all known values of the group agree, otherwise NULL."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.min(v) == F.max(v), F.min(v))
