"""Tail probabilities of test statistics.

The box has no statistics library; the incomplete gamma and beta functions are computed
from their series and continued fractions.  They are applied to tables of test results,
a row for each feature and pair, never to measurements.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _continued(terms, limit: int = 500) -> float:
    """Continued fraction by the modified Lentz method; ``terms`` yields (numerator, denominator)."""
    f, c, d = _TINY, _TINY, 0.0
    for k, (a, b) in enumerate(terms):
        d = 1.0 / (b + a * d or _TINY)
        c = b + a / c or _TINY
        f *= c * d
        if abs(c * d - 1) < 1e-16 or k > limit:
            break
    return f


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale

    def terms():
        yield 1.0, x + 1 - a
        k = 1
        while True:
            yield -k * (k - a), x + 2 * k + 1 - a
            k += 1

    return scale * _continued(terms())


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def terms():
        yield 1.0, 1.0
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return scale * _continued(terms())


def chi2_tail(x: float, df: float) -> float:
    return upper_gamma(df / 2, x / 2)


def f_tail(x: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact probability of a two by two table with the same margins."""
    row, column, n = a + b, a + c, a + b + c + d

    def log_p(k: int) -> float:
        def choose(m: int, j: int) -> float:
            return math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1)

        return choose(row, k) + choose(n - row, column - k) - choose(n, column)

    seen = log_p(a)
    every = [log_p(k) for k in range(max(0, row + column - n), min(row, column) + 1)]
    return min(1.0, sum(math.exp(p) for p in every if p <= seen + 1e-7))


def normal_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def studentised_range_tail(q: float, k: int, df: float) -> float:
    """Tail of the range of ``k`` normal values over an independent deviation of ``df`` degrees."""
    if q <= 0:
        return 1.0

    def range_cdf(w: float, steps: int = 200) -> float:
        total, width = 0.0, 16.0 / steps
        for i in range(steps):
            z = -8 + (i + 0.5) * width
            total += math.exp(-z * z / 2) * (normal_cdf(z) - normal_cdf(z - w)) ** (k - 1)
        return min(1.0, k * total * width / math.sqrt(2 * math.pi))

    # the deviation's distribution, about one, in its logarithm
    spread, total, weight, steps = 8 / math.sqrt(2 * df), 0.0, 0.0, 64
    for i in range(steps):
        s = math.exp(-spread + (i + 0.5) * 2 * spread / steps)
        density = math.exp(df * math.log(s) - df * s * s / 2 + df / 2)
        total += density * range_cdf(q * s)
        weight += density
    return max(0.0, 1 - total / weight)


def _elementwise(function):
    """A pandas function over result rows; null where an argument is."""

    def over(*columns: pd.Series) -> pd.Series:
        frame = pd.concat(columns, axis=1)
        return frame.apply(lambda r: None if r.isna().any() else function(*r), axis=1).astype("float64")

    return over


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _elementwise(chi2_tail)(x, df)


@F.pandas_udf(DoubleType())
def f_p(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _elementwise(f_tail)(x, df1, df2)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _elementwise(t_two_sided)(t, df)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _elementwise(normal_two_sided)(z)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _elementwise(lambda *t: fisher_two_sided(*map(int, t)))(a, b, c, d)


@F.pandas_udf(DoubleType())
def range_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _elementwise(lambda q, k, df: studentised_range_tail(q, int(k), df))(q, k, df)
