"""Two-sided tail probabilities of the normal and t distributions, as Column expressions.

Spark SQL has neither distribution. The normal tail is a rational approximation of erfc (W. J. Cody,
1969). The t tail is its density's front factor times an integral that does not underflow: beyond
``CENTRE`` the integral runs over the fall of the log density and is summed at fixed double-exponential
nodes; below it one minus the central part is summed at Gauss-Legendre nodes. Both keep a relative
precision of about 1e-13 down to 1e-300, for one degree of freedom or more, and need no Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from assocgrid.functions.finite import col

# fixed values: coefficients of the rational approximations of erfc, highest power first
MIDDLE_TOP = (2.15311535474403846e-8, 0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131,
              881.95222124176909, 1712.04761263407058, 2051.07837782607147, 1230.33935479799725)
MIDDLE_BOTTOM = (1.0, 15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019,
                 3290.79923573345963, 4362.61909014324716, 3439.36767414372164, 1230.33935480374942)
FAR_TOP = (0.0163153871373020978, 0.305326634961232344, 0.360344899949804439, 0.125781726111229246, 0.0160837851487422766, 6.58749161529837803e-4)
FAR_BOTTOM = (1.0, 2.56852019228982242, 1.87295284992346725, 0.527905102951428412, 0.0605183413124413191, 0.00233520497626869185)
NEAR_TOP = (0.185777706184603153, 3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947)
NEAR_BOTTOM = (1.0, 23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062)
NEAR, MIDDLE = 0.46875, 4.0

CENTRE = 1.5
SHIFT = 16  # steps by which the gamma ratio is moved to where its series holds
HALF_STEP = ((-1, 8), (1, 192), (-1, 640), (17, 14336), (-31, 18432), (691, 180224))  # by odd powers of 1 / a


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _exp_minus_square(x: Column) -> Column:
    """exp(-x * x) with the square's rounding error taken out."""
    coarse = F.floor(x * 16) / 16
    return F.exp(-coarse * coarse) * F.exp(-(x - coarse) * (x + coarse))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    square = x * x
    near = 1 - x * _polynomial(square, NEAR_TOP) / _polynomial(square, NEAR_BOTTOM)
    middle = _exp_minus_square(x) * _polynomial(x, MIDDLE_TOP) / _polynomial(x, MIDDLE_BOTTOM)
    inverse = 1 / square
    rest = F.lit(1 / math.sqrt(math.pi)) - inverse * _polynomial(inverse, FAR_TOP) / _polynomial(inverse, FAR_BOTTOM)
    far = _exp_minus_square(x) * rest / x
    return F.when(x <= NEAR, near).when(x <= MIDDLE, middle).when(x < 27, far).otherwise(0.0)


def normal_two_sided(z: Column | str) -> Column:
    z = col(z).cast("double")
    return F.when(z.isNotNull() & ~F.isnan(z), erfc(F.abs(z) / math.sqrt(2.0)))


def _nodes() -> tuple[Column, Column]:
    """(y, w) with the sum of w * g(y) near the integral of exp(-y) g(y) over y >= 0; (u, w) for that of g over 0 to 1."""
    step = 0.1
    x = np.arange(-3.6, 4.9, step)
    y = np.exp(x - np.exp(-x))
    w = step * (1 + np.exp(-x)) * y * np.exp(-y)
    u, v = np.polynomial.legendre.leggauss(40)
    return _pairs(y, w), _pairs((u + 1) / 2, v / 2)


def _pairs(places: np.ndarray, weights: np.ndarray) -> Column:
    return F.array(*[F.struct(F.lit(float(p)).alias("at"), F.lit(float(w)).alias("w")) for p, w in zip(places, weights)])


def _log_gamma_half_step(a: Column) -> Column:
    """ln Gamma(a + 1/2) - ln Gamma(a)."""
    far = a + SHIFT
    out = 0.5 * F.log(far)
    for k, (top, bottom) in enumerate(HALF_STEP):
        out = out + F.lit(top / bottom) / F.pow(far, F.lit(2.0 * k + 1))
    ratio = F.lit(1.0)
    for k in range(SHIFT):
        ratio = ratio * ((a + k) / (a + (k + 0.5)))
    return out + F.log(ratio)


def t_two_sided(t: Column | str, df: Column | str) -> Column:
    """2 * P(T > |t|) with df degrees of freedom; NULL where undefined."""
    t, df = F.abs(col(t).cast("double")), col(df).cast("double")
    falling, central = _nodes()
    front = 2 * F.exp(_log_gamma_half_step(df / 2) - 0.5 * F.log(df * math.pi))
    # one row's facts are bound once and used at every node
    facts = F.struct(t.alias("t"), df.alias("v"), front.alias("front"), (1 + t * t / df).alias("q"), F.log1p(t * t / df).alias("log_q"))

    def tail(f: Column) -> Column:
        def part(total: Column, node: Column) -> Column:
            square = f["t"] * f["t"] + f["v"] * f["q"] * F.expm1(2 * node["at"] / (f["v"] + 1))
            return total + node["w"] * (f["v"] + square) / ((f["v"] + 1) * F.sqrt(square))

        return f["front"] * F.exp(-(f["v"] + 1) / 2 * f["log_q"]) * F.aggregate(falling, F.lit(0.0), part)

    def middle(f: Column) -> Column:
        def part(total: Column, node: Column) -> Column:
            u = node["at"] * f["t"]
            return total + node["w"] * F.exp(-(f["v"] + 1) / 2 * F.log1p(u * u / f["v"]))

        return 1 - f["front"] * f["t"] * F.aggregate(central, F.lit(0.0), part)

    value = F.transform(F.array(facts), lambda f: F.when(f["t"] == float("inf"), F.lit(0.0)).when(f["t"] < CENTRE, middle(f)).otherwise(tail(f)))
    return F.when(t.isNotNull() & ~F.isnan(t) & (df > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_element_at(value, F.lit(1)))))
