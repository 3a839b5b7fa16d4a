"""Two-sided tail probability of Student's t, vectorised over aggregated rows."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated by the modified Lentz method.

    A row stops when it has converged, so that its value does not depend on the other rows.
    """
    def safe(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < _TINY, _TINY, v)

    c = np.ones_like(x)
    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    value = d.copy()
    open_rows = np.ones(x.shape, bool)
    for m in range(1, steps + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for term in (even, odd):
            d = 1.0 / safe(1.0 + term * d)
            c = safe(1.0 + term / c)
            change = c * d
            value = np.where(open_rows, value * change, value)
        open_rows &= np.abs(change - 1.0) >= 1e-15
        if not open_rows.any():
            break
    return value


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    log_beta = np.array([lgamma(u) + lgamma(v) - lgamma(u + v) for u, v in zip(p, q)])
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta) / p
    out = np.where(z > 0, front * _continued_fraction(p, q, z), 0.0)
    return np.where(flip, 1.0 - out, out)


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); NaN where either argument is missing or df < 1."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(df) & (df >= 1) & ~np.isnan(t)
    finite = ok & np.isfinite(t)
    out[ok & ~finite] = 0.0
    if finite.any():
        d, s = df[finite], t[finite] ** 2
        out[finite] = incomplete_beta(d / 2.0, np.full(d.shape, 0.5), d / (d + s))
    return out


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    p = pd.Series(two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)), dtype="float64")
    return p.where(p.notna(), None)
