"""Ranks, medians and quantiles of groups of any size.

Keys are divided by their number of rows, counted in one cheap pass:

* keys of up to ``SLICE_ROWS`` rows are sorted and windowed as a whole, one shuffle;
* larger keys first collapse equal values to one counted row, a cell (so a value shared by a
  third of all rows costs one row per map task). Their cells are cut into ``SLICES`` slices at
  approximate quantiles of the key's own values, windowed inside a slice, and shifted by the
  running totals of the slices before. Values close together are cut like any others.

Both give the same exact result. The larger keys and their cut points are written first: the
planner knows their size and decides how to join them. NULL keys are keys like any others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import is_finite
from assocgrid.storage import materialize

# rows that one task orders as a whole
SLICE_ROWS = 1_000_000
SLICES = 256
ACCURACY = 4096


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the key columns are those of ``left``."""
    there = right.withColumnsRenamed({k: f"_there_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_there_{k}`")) for k in keys]
    joined = left.join(there, reduce(Column.__and__, same), how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_there_{k}" for k in keys])


def sliced(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``_code``, the slice of its key's values that a row falls into.

    Equal values share a slice, larger values never have a lower one.
    """
    at = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, at, ACCURACY)).alias("_cuts"))
    placed = null_safe_join(rows, materialize(cuts, "cuts"), keys)
    return placed.withColumn("_code", F.expr(f"coalesce(size(filter(_cuts, c -> c < {value})), 0)")).drop("_cuts")


def split_by_size(rows: DataFrame, keys: Sequence[str], sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small keys, rows of large keys, None without such a key).

    ``sized`` is a frame with the keys of at least all rows to count instead, such as the
    matrix before a join; counting it reads only the key columns.
    """
    sizes = (rows if sized is None else sized).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = materialize(sizes.where(f"_rows > {SLICE_ROWS}").select(*keys), "large-keys")
    if large.isEmpty():
        return rows, None
    return null_safe_join(rows, large, keys, "left_anti"), null_safe_join(rows, large, keys, "left_semi")


def ordered_rows(rows: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, str]) -> DataFrame:
    """Rows of small keys with, for each counted condition, their place in the sorted key.

    ``counts`` name -> SQL condition; gives ``name`` (0 or 1), ``name_cell`` (rows of equal
    value), ``name_before`` (rows of smaller value) and ``name_total``.
    """
    group = ", ".join(f"`{k}`" for k in keys)
    flagged = rows.selectExpr("*", *[f"CASE WHEN {condition} THEN 1L ELSE 0L END AS {n}" for n, condition in counts.items()])
    upto = f"(PARTITION BY {group} ORDER BY {value} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    placed = flagged.selectExpr(
        "*",
        *[f"sum({n}) OVER {upto} AS {n}_upto" for n in counts],
        *[f"sum({n}) OVER (PARTITION BY {group}) AS {n}_total" for n in counts],
    ).selectExpr("*", *[f"sum({n}) OVER (PARTITION BY {group}, {value}) AS {n}_cell" for n in counts])
    return placed.withColumns({f"{n}_before": F.expr(f"{n}_upto - {n}_cell") for n in counts}).drop(*[f"{n}_upto" for n in counts])


def ordered_cells(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: Mapping[str, str],
    payload: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per (keys, value) with counts, the counts before it and the group's totals.

    ``counts``  name -> SQL condition; gives ``name``, ``name_cell``, ``name_before``, ``name_total``.
    ``payload`` name -> SQL aggregate (double) over the rows of one value.
    ``totals``  name -> SQL aggregate over the cells of one group, payload in braces;
                names starting with ``min_`` or ``max_`` merge that way, others by sum.

    The cells feed two branches (places inside a slice, totals per slice).  Column pruning
    would leave them with different columns, and the cells would be scanned and shuffled
    twice; so the payload travels as one array and both branches read every column, which
    lets them share one exchange.
    """
    keys, payload, totals = list(keys), dict(payload or {}), dict(totals or {})
    aggregates = [F.expr(f"count_if({condition}) AS {name}") for name, condition in counts.items()]
    if payload:
        packed = ", ".join(f"double({aggregate})" for aggregate in payload.values())
        aggregates.append(F.expr(f"array({packed}) AS _pack"))
    cells = sliced(rows, keys, value).groupBy(*keys, value, "_code").agg(*aggregates)
    columns = ", ".join([value, *counts, *(["_pack"] if payload else [])])
    place = {name: f"_pack[{i}]" for i, name in enumerate(payload)}
    group = ", ".join(f"`{k}`" for k in keys)
    names = [f"`{k}`" for k in keys]
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    placed = cells.selectExpr(
        "*", *[f"coalesce(sum({n}) OVER (PARTITION BY {group}, _code ORDER BY {value} {before}), 0L) AS {n}_in" for n in counts]
    )
    if payload:
        placed = placed.where("size(_pack) > 0")
    sums = cells.groupBy(*keys, "_code").agg(
        *[F.expr(f"sum({n}) AS {n}") for n in counts],
        *[F.expr(f"{aggregate.format(**place)} AS {name}") for name, aggregate in totals.items()],
        F.expr(f"bit_xor(xxhash64({columns})) AS _read"),
    )
    offsets = sums.where("_read IS NOT NULL").selectExpr(
        *names,
        "_code",
        *[f"coalesce(sum({n}) OVER (PARTITION BY {group} ORDER BY _code {before}), 0L) AS {n}_off" for n in counts],
        *[f"sum({n}) OVER (PARTITION BY {group}) AS {n}_total" for n in counts],
        *[f"{_merge(name)}({name}) OVER (PARTITION BY {group}) AS {name}" for name in totals],
    )
    return null_safe_join(placed, offsets, [*keys, "_code"]).selectExpr(
        *names,
        value,
        *counts,
        *[f"{n} AS {n}_cell" for n in counts],
        *[f"{n}_in + {n}_off AS {n}_before" for n in counts],
        *[f"{n}_total" for n in counts],
        *[f"{column} AS {name}" for name, column in place.items()],
        *totals,
    )


def _merge(name: str) -> str:
    return name[:3] if name.startswith(("min_", "max_")) else "sum"


def quantile_sql(value: str, name: str, q: float) -> str:
    """SQL aggregate over ordered rows or cells: quantile with linear interpolation (type 7).

    The two neighbouring positions are looked up by the value that covers them.
    """
    at = f"(({name}_total - 1) * {q!r}D)"

    def value_at(position: str) -> str:
        return f"max({value}) FILTER (WHERE {name}_before < {position} AND {position} <= {name}_before + {name}_cell)"

    low, high, weight = value_at(f"(floor({at}) + 1)"), value_at(f"(ceil({at}) + 1)"), f"max({at} - floor({at}))"
    return f"CASE WHEN {weight} = 0 THEN {low} ELSE {low} + ({high} - {low}) * {weight} END"


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles of the finite values per group; groups may be of any size."""
    rows, group = _grouped(df.where(is_finite(value)), keys)
    rows = rows.selectExpr(*[f"`{k}`" for k in group], f"double(`{value}`) + 0.0D AS _v")
    small, large = split_by_size(rows, group)
    sums = [F.max("_n_total").alias("n"), *[F.expr(f"{quantile_sql('_v', '_n', q)} AS {name}") for name, q in quantiles.items()]]
    out = ordered_rows(small, group, "_v", {"_n": "true"}).groupBy(*group).agg(*sums)
    if large is not None:
        out = out.unionByName(ordered_cells(large, group, "_v", {"_n": "true"}).groupBy(*group).agg(*sums))
    return out if keys else out.drop("_all")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(keys, value, rank): the mean rank of each distinct value, ties sharing it."""
    cells = ordered_cells(df, keys, value, {"_n": "true"})
    return cells.selectExpr(*[f"`{k}`" for k in keys], value, f"_n_before + (_n + 1) / 2 AS {out}")


def _grouped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Ungrouped input gets one constant key, so both cases share one plan."""
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(1)), ["_all"]
