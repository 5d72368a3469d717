"""Tail probabilities of the Kolmogorov-Smirnov and chi-square statistics."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

SERIES_TERMS = 100


def ks_asymptotic(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """Kolmogorov series with the finite-sample shift of Vrbik (2018).

    x = sqrt(n) * (d + 1/(6n) + (d - 1)/(4n)) with n the rounded effective size.
    """
    n = F.rint(n_ref * n_cur / (n_ref + n_cur).cast("double"))
    x = F.sqrt(n) * (statistic + F.lit(1.0) / (n * 6.0) + (statistic - 1.0) / (n * 4.0))
    # The value rides in the array, because a column named inside a lambda would resolve to
    # an alias of the same name next to it.
    sign = lambda i: F.when(i % 2 == 0, 1.0).otherwise(-1.0)
    terms = F.transform(F.array_repeat(x, SERIES_TERMS), lambda v, i: sign(i) * F.exp(F.lit(-2.0) * (i + 1) * (i + 1) * v * v))
    # Below 0.2 the series needs more terms than it has, and the tail is 1 to 12 places.
    series = F.lit(2.0) * F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_exact_tail(d: float, m: int, n: int) -> float:
    """P(D >= d) for samples of sizes m and n, by counting lattice paths.

    A path that stays strictly inside |i/m - j/n| < d keeps the statistic below d. The
    counts of one row are running sums of the row before, kept in scaled form.
    """
    if n > m:
        m, n = n, m
    limit = int(round(d * m * n))
    if limit <= 0:
        return 1.0
    j = np.arange(n + 1, dtype=np.int64)
    row = np.where(j * m < limit, 1.0, 0.0)
    log_scale = 0.0
    for i in range(1, m + 1):
        low = max(0, (i * n - limit) // m + 1)
        high = min(n, -((-(i * n + limit)) // m) - 1)
        inside = np.zeros(n + 1)
        if low > high:
            return 1.0
        inside[low:high + 1] = np.cumsum(row[low:high + 1])
        top = inside[high]
        if top <= 0.0:
            return 1.0
        inside /= top
        log_scale += math.log(top)
        row = inside
    if row[n] <= 0.0:
        return 1.0
    log_inside = math.log(row[n]) + log_scale
    log_paths = math.lgamma(m + n + 1) - math.lgamma(m + 1) - math.lgamma(n + 1)
    return min(1.0, max(0.0, -math.expm1(log_inside - log_paths)))


def gamma_tail(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    # Continued fraction, evaluated from the front (modified Lentz).
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 100000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def chi_square_tail(x: float, dof: int) -> float:
    if dof <= 0:
        return 1.0
    return math.erfc(math.sqrt(x / 2.0)) if dof == 1 else gamma_tail(dof / 2.0, x / 2.0)


def _ship_by_value() -> None:
    """Send this module along with its functions; executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chi_square_p(x: Column | str, dof: Column | str) -> Column:
    """P-value of a handful of statistics (one per feature)."""
    _ship_by_value()

    @F.pandas_udf("double")
    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(a, int(b)) for a, b in zip(x, dof)], dtype="float64")

    return tail(x, dof)


def ks_p(statistic: Column, n_ref: Column, n_cur: Column, method: str = "asymptotic") -> Column:
    """Two-sample p-value by the method asked for, whatever the number of rows.

    ``exact`` counts paths on one row per feature, in time that grows with the product of the sizes.
    """
    if method == "asymptotic":
        return ks_asymptotic(statistic, n_ref, n_cur)
    if method != "exact":
        raise ValueError(f"unknown method {method}")
    _ship_by_value()

    @F.pandas_udf("double")
    def exact(d: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([ks_exact_tail(a, int(b), int(c)) for a, b, c in zip(d, m, n)], dtype="float64")

    return exact(statistic, n_ref, n_cur)
