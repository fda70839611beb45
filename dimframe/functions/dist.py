"""Tails of the t and F distributions, by the incomplete beta function, for arrays and for columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    a, b, x0 = np.where(ok, a, 1.0), np.where(ok, b, 1.0), np.where(ok, x, 0.0)
    swap = x0 > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x0, x0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(y == 0, 0.0, front * h)
    return np.where(ok, np.where(swap, 1 - out, out), np.nan)


def t_p(t, df) -> np.ndarray:
    """Two-sided p of a t value."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isinf(t), 0.0, betainc(df / 2, 0.5, df / (df + np.where(np.isinf(t), 0, t) ** 2)))


def f_p(f, df1, df2) -> np.ndarray:
    """Upper tail of an F value."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    return np.where(np.isposinf(f), 0.0, betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * np.where(np.isposinf(f), 0, f))))


def _nulls(out: np.ndarray) -> pd.Series:
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def t_p_col(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return _nulls(t_p(t.to_numpy(float), df.to_numpy(float)))

    return run(t.cast("double"), df.cast("double"))


def f_p_col(f: Column, df1: Column, df2: Column) -> Column:
    @F.pandas_udf("double")
    def run(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return _nulls(f_p(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))

    return run(f.cast("double"), df1.cast("double"), df2.cast("double"))
