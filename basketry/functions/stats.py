"""Tail probabilities and quantiles for aggregated test results.

Spark has no normal or t distribution. These run on one row per test and
metric, never on raw interactions.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# executors get these functions with the job and need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NORMAL = NormalDist()


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t), by the incomplete beta function."""
    x = df / (df + t * t)
    half = 0.5 * _beta_share(df / 2, 0.5, x)
    return half if t >= 0 else 1 - half


def t_two_sided(t: float, df: float) -> float | None:
    if df <= 0:
        return None
    return _beta_share(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float | None:
    if df <= 0 or not 0 < p < 1:
        return None
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 2.0
    while t_upper_tail(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_upper_tail(middle, df) > 1 - p else (low, middle)
    return (low + high) / 2


def t_test_power(effect: float, n: float, alpha: float) -> float | None:
    """Power of the two-sided two-sample t test with ``n`` rows per group."""
    df = 2 * n - 2
    if df <= 0:
        return None
    critical = t_quantile(1 - alpha / 2, df)
    shift = effect * math.sqrt(n / 2)
    return 1 - _shifted_t_cdf(critical, df, shift) + _shifted_t_cdf(-critical, df, shift)


def t_test_sample_size(effect: float, alpha: float, power: float) -> float | None:
    """Rows per group at which the t test reaches the power; none does without effect."""
    effect = abs(effect)
    if effect < 1e-6:
        return None
    low, high = 1.5, 4.0
    while t_test_power(effect, high, alpha) < power:
        low, high = high, high * 2
    while high - low > 1e-7 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if t_test_power(effect, middle, alpha) < power else (low, middle)
    return (low + high) / 2


def _shifted_t_cdf(t: float, df: float, shift: float) -> float:
    """Noncentral t: the normal probability averaged over the chi density."""
    spread = 12 / math.sqrt(2 * df)
    ratio = np.linspace(max(1e-9, 1 - spread), 1 + spread, 801)  # chi / sqrt(df)
    log_density = (df - 1) * np.log(ratio) - df * ratio ** 2 / 2
    weight = np.exp(log_density - log_density.max())
    below = np.array([_NORMAL.cdf(t * r - shift) for r in ratio])
    return float((weight * below).sum() / weight.sum())


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    # continued fraction, evaluated forward by Lentz's method
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def _apply(function, *columns: pd.Series) -> pd.Series:
    def one(values) -> float | None:
        return None if any(pd.isna(v) for v in values) else function(*values)
    return pd.Series([one(v) for v in zip(*columns)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_quantile_of(p: pd.Series) -> pd.Series:
    return _apply(normal_quantile, p)


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return _apply(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_quantile_of(p: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_quantile, p, df)


@F.pandas_udf(DoubleType())
def t_sample_size_of(effect: pd.Series, alpha: pd.Series, power: pd.Series) -> pd.Series:
    return _apply(t_test_sample_size, effect, alpha, power)


@F.pandas_udf(DoubleType())
def t_power_of(effect: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return _apply(t_test_power, effect, n, alpha)
