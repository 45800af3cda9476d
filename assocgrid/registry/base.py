"""Input frames of the registered queries and the SQL text that mirrors them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assocgrid.functions.finite import log2_plus_one
from assocgrid.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL, filled by the modules of this package."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


REGISTRY = Registry()


class Tables:
    """The given tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # a second use finds the attribute, schema and all
        return table


def long_matrix(t: Tables, feature: Column | None = None) -> DataFrame:
    """matrix(entity, feature, value): quantity bought per customer and brand."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"))
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), (feature if feature is not None else F.col("p_brand")).alias("feature"))
    joined = lines.join(orders, "l_orderkey").join(parts, "l_partkey")
    return joined.groupBy("entity", "feature").agg(F.sum("l_quantity").alias("value"))


def prepared_matrix(t: Tables) -> DataFrame:
    """The same matrix written once, for plans that read it more than once."""
    return materialize(long_matrix(t), "matrix")


def driver(t: Tables) -> DataFrame:
    """driver(entity, level, level_log, stratum): one row per customer."""
    level = F.col("c_acctbal") / 5000
    return t.customer.select(
        F.col("c_custkey").alias("entity"), level.alias("level"), log2_plus_one(level).alias("level_log"), F.col("c_mktsegment").alias("stratum")
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; integers widened to long."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---- SQL text -----------------------------------------------------------------------

M = """m AS (SELECT o_custkey AS entity, p_brand AS feature, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
DRV = """drv AS (SELECT c_custkey AS entity, c_acctbal / 5000.0 AS level,
  CASE WHEN c_acctbal / 5000.0 + 1 > 0 THEN log2(c_acctbal / 5000.0 + 1) END AS level_log, c_mktsegment AS stratum FROM customer)"""


def final(sql: str, keep: Sequence[str] = (), ints: Sequence[str] = (), floats: Sequence[str] = (), where: str = "") -> str:
    """Outermost SELECT: keeps, casts and rounds the listed columns of ``sql``."""
    columns = [*keep, *[f"CAST({c} AS BIGINT) AS {c}" for c in ints]]
    columns += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in floats]
    return f"SELECT {', '.join(columns)} FROM ({sql}) {'WHERE ' + where if where else ''}"


def normal_p(z: str) -> str:
    """Two-sided normal P by Simpson's rule over the density (4000 steps)."""
    a = f"least(abs({z}), 12.0)"
    weight = "(CASE WHEN i = 0 OR i = 4000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    total = f"list_sum(list_transform(range(0, 4001), lambda i: {weight} * exp(-0.5 * pow({a} * i / 4000.0, 2))))"
    return f"CASE WHEN {z} IS NOT NULL THEN greatest(0.0, 1 - 2 * 0.3989422804014327 * ({a} / 12000.0) * {total}) END"


def t_p(t: str, df: str) -> str:
    """Two-sided t P by Simpson's rule in the angle atan(t / sqrt(df))."""
    a = f"atan(abs({t}) / sqrt({df}))"
    weight = "(CASE WHEN i = 0 OR i = 4000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    total = f"list_sum(list_transform(range(0, 4001), lambda i: {weight} * pow(cos({a} * i / 4000.0), {df} - 1)))"
    factor = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())"
    return f"CASE WHEN {t} IS NOT NULL THEN greatest(0.0, 1 - 2 * {factor} * ({a} / 12000.0) * {total}) END"


def effects_sql(rows: str, key: str, gate: int | None = None, extra: str = "") -> str:
    """Two-group effect of ``rows(key..., y, low)`` per key; ``extra`` adds aggregates."""
    shown = f"CASE WHEN count(*) FILTER (WHERE low) >= {gate} AND count(*) FILTER (WHERE NOT low) >= {gate} THEN" if gate else "CASE WHEN true THEN"
    return f"""SELECT *, mean_low - mean_other AS delta_mean, median_low - median_other AS delta_median,
      CASE WHEN n_low >= 3 AND n_other >= 3 THEN w END AS rank_sum_w, n_low >= 3 AND n_other >= 3 AS eligible,
      CASE WHEN n_low >= 3 AND n_other >= 3 AND variance > 0 THEN
        (w - n_low * n_other / 2.0 - 0.5 * sign(w - n_low * n_other / 2.0)) / sqrt(variance) END AS rank_sum_z
    FROM (SELECT *, ranks - n_low * (n_low + 1) / 2.0 AS w,
        n_low * n_other / 12.0 * ((n_low + n_other + 1) - ties / ((n_low + n_other) * (n_low + n_other - 1.0))) AS variance
      FROM (SELECT {key}, count(*) FILTER (WHERE low) AS n_low, count(*) FILTER (WHERE NOT low) AS n_other,
        {shown} avg(y) FILTER (WHERE low) END AS mean_low, {shown} avg(y) FILTER (WHERE NOT low) END AS mean_other,
        {shown} median(y) FILTER (WHERE low) END AS median_low, {shown} median(y) FILTER (WHERE NOT low) END AS median_other,
        sum(rk) FILTER (WHERE low) AS ranks, sum(tn * tn - 1.0) AS ties {extra}
      FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY y) + (count(*) OVER (PARTITION BY {key}, y) - 1) / 2.0 AS rk,
          count(*) OVER (PARTITION BY {key}, y) AS tn FROM {rows})
      GROUP BY {key}))"""


def correlation_sql(rows: str, key: str, min_n: int, prefix: str = "", perfect: str = "0.0") -> str:
    """Pearson and Spearman of ``rows(key..., x, y)`` with P per key."""

    def p(r: str) -> str:
        t = f"({r} * sqrt((n - 2) / (1 - {r} * {r})))"
        return f"CASE WHEN abs({r}) >= 1 THEN {perfect} ELSE {t_p(t, '(n - 2)')} END"

    ok = f"count(*) >= {min_n} AND min(x) < max(x) AND min(y) < max(y)"
    return f"""SELECT {key}, n, r AS {prefix}pearson_r, {p('r')} AS {prefix}pearson_p, rho AS {prefix}spearman_rho, {p('rho')} AS {prefix}spearman_p
      FROM (SELECT {key}, count(*) AS n, CASE WHEN {ok} THEN corr(x, y) END AS r, CASE WHEN {ok} THEN corr(rx, ry) END AS rho
        FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY x) + (count(*) OVER (PARTITION BY {key}, x) - 1) / 2.0 AS rx,
            rank() OVER (PARTITION BY {key} ORDER BY y) + (count(*) OVER (PARTITION BY {key}, y) - 1) / 2.0 AS ry FROM {rows})
        GROUP BY {key})"""


def bh_sql(rows: str, p: str, out: str, family: str = "") -> str:
    """``rows`` plus the Benjamini-Hochberg adjustment of column ``p``."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""SELECT * EXCLUDE (_k, _m, _raw), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(_raw) OVER ({part} ORDER BY _k DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {out}
      FROM (SELECT *, {p} * _m / _k AS _raw FROM (SELECT *, count({p}) OVER ({part}) AS _m,
        row_number() OVER ({part} ORDER BY {p} NULLS LAST) AS _k FROM {rows}))"""
