"""Tail probabilities as vectorised kernels and as Arrow-batched column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def upper_gamma(a, x):
    """Regularised upper incomplete gamma Q(a, x): a series below a + 1, a continued fraction above it."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    for low in (True, False):
        at = ok & (x > 0) & ((x < a + 1) == low)
        p, q = a[at], x[at]
        if not p.size:
            continue
        front = np.exp(-q + p * np.log(q) - _lgamma(p))
        if low:
            term = total = 1.0 / p
            n = p.copy()
            for _ in range(1000):
                n = n + 1
                term = term * q / n
                total = total + term
                if (np.abs(term) < np.abs(total) * 1e-15).all():
                    break
            out[at] = 1 - total * front
        else:
            b = q + 1 - p
            c, d = np.full(p.shape, 1e300), 1 / b
            h = d.copy()
            for i in range(1, 1000):
                an = -i * (i - p)
                b = b + 2
                d = an * d + b
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = b + an / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
                if (np.abs(d * c - 1) < 1e-15).all():
                    break
            out[at] = front * h
    return np.clip(out, 0, 1)


def incomplete_beta(a, b, x):
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inner = (z > 0) & (z < 1)
    zz = np.where(inner, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(zz) + q * np.log(1 - zz)) / p
    c, d = np.ones_like(zz), 1 - (p + q) * zz / (p + 1)
    d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
    h = d.copy()
    for m in range(1, 1000):
        for num in (m * (q - m) * zz / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * zz / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    value = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(turn, 1 - value, value)


def chi2_tail(chi2, df):
    return upper_gamma(np.asarray(df, float) / 2, np.asarray(chi2, float) / 2)


def z_below(z):
    """Probability of a standard normal value below z."""
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def f_tail(f, df1, df2):
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def ks_tail(lam):
    """Probability of a larger Kolmogorov-Smirnov statistic."""
    lam = np.asarray(lam, float)
    k = np.arange(1, 101)[:, None]
    total = 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k**2 * np.atleast_1d(lam)[None, :] ** 2)).sum(0)
    return np.where(np.atleast_1d(lam) < 0.2, 1.0, np.clip(total, 0, 1))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided probability of a 2 x 2 table."""
    n, r, k = a + b + c + d, a + b, a + c
    logs = {x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(n - r + 1) - math.lgamma(k - x + 1) - math.lgamma(n - r - k + x + 1) for x in range(max(0, k - n + r), min(r, k) + 1)}
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return min(1.0, sum(math.exp(v - top) for v in logs.values() if v <= logs[a] + 1e-9))


def _kept(*values: pd.Series) -> np.ndarray:
    return np.logical_and.reduce([v.notna().to_numpy() for v in values])


def _column(f):
    def apply(*values: pd.Series) -> pd.Series:
        out = np.full(len(values[0]), np.nan)
        ok = _kept(*values)
        if ok.any():
            out[ok] = f(*[v.to_numpy(dtype=float)[ok] for v in values])
        return pd.Series(out).where(pd.Series(ok), None)

    return apply


@pandas_udf(DoubleType())
def chi2_p(chi2: pd.Series, df: pd.Series) -> pd.Series:
    return _column(chi2_tail)(chi2, df)


@pandas_udf(DoubleType())
def z_p(z: pd.Series) -> pd.Series:
    return _column(z_below)(z)


@pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _column(t_two_sided)(t, df)


@pandas_udf(DoubleType())
def f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _column(f_tail)(f, df1, df2)


@pandas_udf(DoubleType())
def ks_p(lam: pd.Series) -> pd.Series:
    return _column(ks_tail)(lam)


@pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _column(lambda *v: [fisher_exact(*map(int, r)) for r in zip(*v)])(a, b, c, d)
