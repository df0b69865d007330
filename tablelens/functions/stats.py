"""Statistics that Spark's built-in functions lack: corrected moments, and tails of distributions for single findings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(c).cast("double")
    g1 = F.when(F.var_pop(c) > 0, F.skewness(c))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    n = F.count(c).cast("double")
    g2 = F.when(F.var_pop(c) > 0, F.kurtosis(c))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both are known; null where either doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


RANGES = 64


def range_part(frame: DataFrame, column: str) -> Column:
    """The number of the range, of RANGES at most, in which a row's double lies; bounds are approximate quantiles.

    Equal values lie in the same range, and greater ones in no lower range.
    """
    bounds = frame.approxQuantile(column, [k / RANGES for k in range(1, RANGES)], 0.005)
    return reduce(lambda part, bound: part + (F.col(column) > F.lit(bound)).cast("int"), sorted(set(bounds)), F.lit(0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    if dof <= 0 or math.isnan(t):
        return math.nan
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)) if math.isfinite(t) else 0.0


def correlation_p(r: float, n: int) -> float:
    dof = n - 2
    return t_tail(abs(r) * math.sqrt(dof / max(1e-300, 1 - r * r)), dof) if dof > 0 else math.nan
