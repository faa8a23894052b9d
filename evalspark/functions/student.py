"""Tail and quantile of Student's t for small result tables (one row per test)."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return float(front * (f - 1.0))


def two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if not (np.isfinite(t) and df > 0):
        return 0.0 if np.isinf(t) and df > 0 else float("nan")
    return _beta_tail(df / 2.0, 0.5, df / (df + t * t))


def quantile975(df: float) -> float:
    if not df > 0:
        return float("nan")
    lo, hi = 0.0, 2.0
    while two_sided(hi, df) > 0.05:
        hi *= 2.0
    for _ in range(100):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if two_sided(mid, df) > 0.05 else (lo, mid)
    return (lo + hi) / 2.0


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float))])


@F.pandas_udf(DoubleType())
def t_quantile975(df: pd.Series) -> pd.Series:
    known = {d: quantile975(d) for d in df.astype(float).dropna().unique()}
    return df.astype(float).map(known)
