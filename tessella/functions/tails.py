"""Tails of distributions that SQL lacks, in numpy, for tables of results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(x / math.sqrt(2)) / 2 for x in np.asarray(z, float)])


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, steps):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
    log = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log(p + q) - log(p) - log(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, front * f)
    return np.clip(np.where(flip, 1 - out, out), 0, 1)


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Chance of a t at least as far from 0; not a number where t is none or there are no degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = (df > 0) & ~np.isnan(t)
    out[ok & np.isinf(t)] = 0.0
    ok &= np.isfinite(t)
    out[ok] = beta_share(df[ok] / 2, np.full(ok.sum(), 0.5), df[ok] / (df[ok] + t[ok] ** 2))
    return out


def student_p(t: Column, df: Column) -> Column:
    """``student_two_sided`` of two columns, for tables of results."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(student_two_sided(a.to_numpy(float), b.to_numpy(float)))

    return p(t.cast("double"), df.cast("double"))
