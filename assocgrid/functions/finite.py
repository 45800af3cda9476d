"""Null, NaN and infinity rules shared by every statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: texts that stand for a missing cell
MISSING_TEXTS = ("", "NA", "NaN", "nan", "null", "N/A")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_sql(name: str) -> str:
    return f"(`{name}` IS NOT NULL AND NOT isnan(`{name}`) AND abs(`{name}`) < double('Infinity'))"


def is_finite(c: Column | str) -> Column:
    """Neither NULL, NaN nor infinite; never NULL itself."""
    if isinstance(c, str):
        return F.expr(finite_sql(c))
    v = col(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def finite_or_null(c: Column | str) -> Column:
    return F.when(is_finite(c), col(c))


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(is_finite(x) & is_finite(y))


def log2_plus_one(c: Column | str) -> Column:
    """log2(x + 1); values below -1 have no logarithm and become NULL."""
    v = col(c)
    return F.when(v + 1 > 0, F.log2(v + 1))


def parse_number(c: Column | str) -> Column:
    """Text cell to double; the missing texts become NULL, anything else unreadable too."""
    v = F.trim(col(c))
    return F.when(v.isin(*MISSING_TEXTS), None).otherwise(v.try_cast("double"))


def parse_flag(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def safe_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole where whole is positive, otherwise NULL."""
    return F.when(col(whole) > 0, col(part) / col(whole))
