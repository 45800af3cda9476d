"""Tail probabilities against published values, compared on the log scale."""

import math
from decimal import Decimal, getcontext

import pytest

from assocgrid.functions.tails import normal_two_sided, t_two_sided


def t_tails(spark, pairs):
    rows = spark.createDataFrame([(k, float(t), float(v)) for k, (t, v) in enumerate(pairs)], "k int, t double, v double")
    return [r.p for r in rows.select("k", t_two_sided("t", "v").alias("p")).orderBy("k").collect()]


def plain_t_tail(t, v):
    """Even or odd whole degrees of freedom by the finite trigonometric sums, in 60 digits."""
    getcontext().prec = 60
    t = Decimal(t)
    cos2 = Decimal(v) / (Decimal(v) + t * t)
    sin = (1 - cos2).sqrt()
    if v % 2 == 0:
        term, total = Decimal(1), Decimal(1)
        for k in range(1, v // 2):
            term *= cos2 * (2 * k - 1) / (2 * k)
            total += term
        return float(1 - sin * total)
    # odd: the angle by its series, pi by Machin
    def arctan(x):
        n, power, out = 1, x, x
        while abs(power) > Decimal(10) ** -58:
            power *= -x * x
            n += 2
            out += power / n
        return out
    pi = 4 * (4 * arctan(Decimal(1) / 5) - arctan(Decimal(1) / 239))
    ratio = t / Decimal(v).sqrt()
    halvings = 0
    while abs(ratio) > Decimal("0.1"):
        ratio = ratio / (1 + (1 + ratio * ratio).sqrt())
        halvings += 1
    angle = arctan(ratio) * 2**halvings
    total = Decimal(0)
    if v > 1:
        term = cos2.sqrt()
        total = term
        for k in range(1, (v - 1) // 2):
            term *= cos2 * (2 * k) / (2 * k + 1)
            total += term
    return float(1 - 2 / pi * (angle + sin * total))


def test_t_tail_keeps_twelve_digits(spark):
    pairs = [(t, v) for v in (1, 2, 3, 4, 9, 10, 57, 200, 1001) for t in (0.01, 0.5, 1.4999, 1.5, 2.0, 3.7, 8.0, 15.0)]
    for (t, v), got in zip(pairs, t_tails(spark, pairs)):
        want = plain_t_tail(t, v)
        if want > 1e-40:  # what 60 digits resolve
            assert abs(got / want - 1) < 1e-12, (t, v, got, want)


def test_normal_tail_keeps_twelve_digits(spark):
    zs = [0.0, 1e-9, 0.3, 0.66, 0.67, 1.0, 1.959963984540054, 3.0, 5.65, 5.66, 8.0, 12.0, 20.0, 30.0, 37.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided("z").alias("p")).collect()
    for r in rows:
        assert abs(r.p / math.erfc(r.z / math.sqrt(2)) - 1) < 1e-12, r


def t_of(r, n):
    return r * math.sqrt((n - 2) / (1 - r * r))


@pytest.mark.parametrize(
    ("t", "df", "p", "tolerance"),
    [
        (t_of(0.483064938982221, 858), 856, 2.27550945778848e-51, 1e-10),
        (t_of(0.39679918583409, 858), 856, 9.75842434049797e-34, 1e-10),
        (t_of(0.22324630047598, 10542), 10540, 3.40726023771065e-119, 1e-9),
        (t_of(0.236553254404411, 10542), 10540, 5.26595970893279e-134, 1e-9),
        (15.3623803168994, 828, 4.76709824593027e-47, 1e-10),
        (1.0, 1, 0.5, 1e-13),
        (0.0, 5, 1.0, 1e-13),
    ],
)
def test_t_tail(spark, t, df, p, tolerance):
    got = t_tails(spark, [(t, df)])[0]
    assert abs(math.log(got) - math.log(p)) < tolerance


def test_undefined_and_extreme_arguments(spark):
    got = t_tails(spark, [(math.nan, 3), (math.inf, 3), (1.0, 0), (1e-9, 3)])
    assert got[0] is None and got[1] == 0 and got[2] is None and abs(got[3] - 1) < 1e-8


def test_columns_keep_null(spark):
    df = spark.createDataFrame([(1.959963984540054, 10), (None, 10), (37.0, None)], "z double, df int")
    rows = df.select(normal_two_sided("z").alias("p"), t_two_sided("z", "df").alias("q")).collect()
    assert abs(rows[0]["p"] - 0.05) < 1e-14 and rows[0]["q"] is not None
    assert rows[1]["p"] is None and rows[1]["q"] is None
    assert 0 < rows[2]["p"] < 1e-290 and rows[2]["q"] is None


def test_rank_sum_published(spark):
    """z from (n1, n2, W) without ties reproduces the published P values."""
    for n1, n2, w, p in [(76, 782, 9507, 1.15337648533155e-22), (3, 855, 25, 0.00335166997952249)]:
        d = w - n1 * n2 / 2
        z = (d - math.copysign(0.5, d)) / math.sqrt(n1 * n2 / 12 * (n1 + n2 + 1))
        got = spark.range(1).selectExpr(f"double({z!r}) AS z").select(normal_two_sided("z").alias("p")).first()["p"]
        assert abs(math.log(got) - math.log(p)) < 1e-8
