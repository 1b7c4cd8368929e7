"""Student's t without tables: tail probabilities and quantiles, as Arrow functions over columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the continued fraction, and halvings of the quantile's bracket: more than doubles need.
TERMS, HALVINGS = 300, 1100

_log_gamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The incomplete beta integral's continued fraction, from the front (Lentz)."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, TERMS):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + top * d), away(1 + top / c)
            value = value * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    return value


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b). `y` is 1 - x where that is known more exactly."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    y = 1 - x if y is None else np.broadcast_to(np.asarray(y, float), x.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log(y))
        # The fraction converges fast below the mean; above it the mirrored one does.
        low = x < (a + 1) / (a + b + 2)
        part = front * _fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, x, y))
        out = np.where(low, part / a, 1 - part / b)
    return np.where(x <= 0, 0.0, np.where(y <= 0, 1.0, out))


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The probability of |T| >= |t| with `df` degrees of freedom; infinite ones mean the normal distribution."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    finite, there = np.where(np.isfinite(df) & (df > 0), df, 1.0), np.where(np.isfinite(t), t, 1.0)
    scale = finite + there * there
    p = incomplete_beta(finite / 2, 0.5, finite / scale, there * there / scale)
    return np.where(np.isnan(t) | ~(df > 0), np.nan, np.where(np.isposinf(df), _erfc(t / math.sqrt(2)), np.where(np.isinf(t), 0.0, p)))


def two_sided_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The t whose two-sided probability is p, by halving a bracket until doubles have nothing between its ends."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(1024):
        short = two_sided(high, df) > p
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(HALVINGS):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = two_sided(middle, df) > p
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.where((p > 0) & (p < 1) & (df > 0), high, np.where((p == 1) & (df > 0), 0.0, np.nan))


def t_probability(t: Column, df: Column) -> Column:
    """Two-sided p-value of each row's statistic."""

    @F.pandas_udf("double")
    def probability(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(two_sided(t.to_numpy(float), df.to_numpy(float)))

    return probability(t.cast("double"), df.cast("double"))


def t_quantile(p: Column, df: Column) -> Column:
    """The statistic whose two-sided p-value is p."""

    @F.pandas_udf("double")
    def quantile(p: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(two_sided_quantile(p.to_numpy(float), df.to_numpy(float)))

    return quantile(p.cast("double"), df.cast("double"))
