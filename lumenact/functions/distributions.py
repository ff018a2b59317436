"""Distribution functions as NumPy code and Pandas UDFs; Spark has none of them built in."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in np.asarray(z, float).ravel()]).reshape(np.shape(z))


def normal_p(z: np.ndarray, alternative: str = "two-sided") -> np.ndarray:
    if alternative == "two-sided":
        return 2 * normal_cdf(-np.abs(z))
    if alternative == "less":
        return normal_cdf(z)
    if alternative == "greater":
        return normal_cdf(-np.asarray(z))
    raise ValueError("alternative is two-sided, less or greater")


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function by Lentz's method, for all values at once."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / safe(1.0 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + top * d)
            c = safe(1 + top / c)
            out *= d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function; its arguments are numbers or arrays."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    unique, at = np.unique(np.stack([a.ravel(), b.ravel()]), axis=1, return_inverse=True)
    scale = (log_gamma(unique[0] + unique[1]) - log_gamma(unique[0]) - log_gamma(unique[1]))[at.ravel()].reshape(x.shape) if x.size else np.zeros(x.shape)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(scale + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    part = _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, inside, 1 - inside)) / np.where(low, a, b)
    out = np.where(low, front * part, 1 - front * part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, df) -> np.ndarray:
    """P(|T| >= |t|) of Student's distribution; NaN for NaN and for less than one degree of freedom."""
    t, df = (np.array(v, float) for v in np.broadcast_arrays(t, df))
    ok = ~np.isnan(t) & (df > 0)
    f, square = np.where(ok, df, 1.0), np.minimum(np.where(ok, np.abs(t), 0.0), 1e150) ** 2
    return np.where(ok, np.clip(incomplete_beta(f / 2, 0.5, f / (f + square)), 0, 1), np.nan)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series(normal_p(z.to_numpy(float)))
