"""Tail probabilities for report rows, as plain math and as Arrow functions over small results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _lower_gamma_series(a: float, x: float) -> float:
    term = total = 1.0 / a
    k = a
    while abs(term) > abs(total) * 1e-16:
        k += 1.0
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _upper_gamma_fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_upper(x: float, dof: float) -> float:
    if dof <= 0 or x <= 0:
        return 1.0
    a, half = dof / 2.0, x / 2.0
    if half < a + 1.0:
        return max(0.0, 1.0 - _lower_gamma_series(a, half))
    return _upper_gamma_fraction(a, half)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (tiny if abs(d) < tiny else d)
    h = d
    for m in range(1, 2000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (tiny if abs(d) < tiny else d)
            c = 1.0 + num / c
            c = tiny if abs(c) < tiny else c
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return beta_regularized(dof / 2.0, 0.5, dof / (dof + t * t))


def ks_two_sample(d: float, n: float, m: float) -> float:
    """Asymptotic tail of the two-sample Kolmogorov-Smirnov statistic."""
    lam = math.sqrt(n * m / (n + m)) * d
    if lam < 0.2:
        return 1.0
    p = 2.0 * sum((-1.0) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, p))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _over(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*series)
    return pd.Series([None if any(pd.isna(v) for v in r) else fn(*map(float, r)) for r in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _over(chi2_upper, x, dof)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _over(t_two_sided, t, dof)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _over(normal_two_sided, z)


@F.pandas_udf(T.DoubleType())
def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return _over(ks_two_sample, d, n, m)


@F.pandas_udf(T.DoubleType())
def probit(p: pd.Series) -> pd.Series:
    return _over(normal_quantile, p)
