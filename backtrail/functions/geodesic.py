"""Geodesics on the ellipsoid, vectorised over Arrow batches.

Both problems need a fixed-point iteration. Written as columns, each step would
refer several times to the one before, and a filter pushed below them would
unfold into an expression of exponential size; one vectorised function per batch
is small and keeps the iteration out of the plan. The functions are marked
non-deterministic only so that the optimizer evaluates them once per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.functions.geo import EARTH_RADIUS, FLATTENING, POLAR_RADIUS

_STEPS = 60
_CLOSE = 1e-13


def _reduced(lat: np.ndarray) -> np.ndarray:
    return np.arctan((1 - FLATTENING) * np.tan(np.radians(lat)))


def _correction(ca2: np.ndarray) -> np.ndarray:
    return FLATTENING / 16 * ca2 * (4 + FLATTENING * (4 - 3 * ca2))


def initial_bearing(lat0: np.ndarray, lon0: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Bearing in [0, 360) at (lat0, lon0) of the geodesic to (lat, lon)."""
    u1, u2, gap = _reduced(lat0), _reduced(lat), np.radians(lon - lon0)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, going = gap, np.ones(np.shape(gap), dtype=bool)  # a row stops by itself, whatever its batch does
    for _ in range(_STEPS):
        sl, cl = np.sin(lam), np.cos(lam)
        y, x = c2 * sl, c1 * s2 - s1 * c2 * cl
        ss, cs = np.hypot(x, y), s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(ss, cs)
        with np.errstate(invalid="ignore", divide="ignore"):
            sa = np.where(ss > 0, c1 * y / ss, 0.0)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 > 0, cs - 2 * s1 * s2 / ca2, 0.0)
        c = _correction(ca2)
        bent = sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))
        new = gap + (1 - c) * FLATTENING * sa * bent
        lam, going = np.where(going, new, lam), going & (np.abs(new - lam) >= _CLOSE)
        if not going.any():
            break
    y, x = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
    return np.mod(np.degrees(np.arctan2(y, x)) + 360, 360)


def destination(
    lat0: np.ndarray, lon0: np.ndarray, bearing: np.ndarray, metres: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude reached from (lat0, lon0) along a bearing."""
    alpha, u1 = np.radians(bearing), _reduced(lat0)
    s1, c1, sa1, ca1 = np.sin(u1), np.cos(u1), np.sin(alpha), np.cos(alpha)
    sigma1, sa = np.arctan2(np.tan(u1), ca1), c1 * sa1
    ca2 = 1 - sa * sa
    second = ca2 * (EARTH_RADIUS**2 - POLAR_RADIUS**2) / POLAR_RADIUS**2
    a = 1 + second / 16384 * (4096 + second * (-768 + second * (320 - 175 * second)))
    b = second / 1024 * (256 + second * (-128 + second * (74 - 47 * second)))
    base = metres / (POLAR_RADIUS * a)
    sigma, going = base, np.ones(np.shape(base), dtype=bool)
    for _ in range(_STEPS):
        cm, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
        inner = cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)
        new = base + b * ss * (cm + b / 4 * inner)
        sigma, going = np.where(going, new, sigma), going & (np.abs(new - sigma) >= _CLOSE)
        if not going.any():
            break
    cm, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
    side = s1 * ss - c1 * cs * ca1
    lat = np.arctan2(s1 * cs + c1 * ss * ca1, (1 - FLATTENING) * np.hypot(sa, side))
    lam = np.arctan2(ss * sa1, c1 * cs - s1 * ss * ca1)
    c = _correction(ca2)
    bent = sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))
    gap = lam - (1 - c) * FLATTENING * sa * bent
    return np.degrees(lat), np.mod(lon0 + np.degrees(gap) + 540, 360) - 180


def _floats(*columns: pd.Series) -> list[np.ndarray]:
    return [c.to_numpy(dtype=float) for c in columns]


def _nullable(values: np.ndarray) -> pd.Series:
    out = pd.Series(values, dtype="float64")
    return out.where(out.notna(), None)


@F.pandas_udf(T.DoubleType())
def ellipsoid_bearing(lat0: pd.Series, lon0: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
    return _nullable(initial_bearing(*_floats(lat0, lon0, lat, lon)))


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def ellipsoid_destination(
    lat0: pd.Series, lon0: pd.Series, bearing: pd.Series, metres: pd.Series
) -> pd.DataFrame:
    lat, lon = destination(*_floats(lat0, lon0, bearing, metres))
    return pd.DataFrame({"lat": _nullable(lat), "lon": _nullable(lon)})


ellipsoid_bearing = ellipsoid_bearing.asNondeterministic()
ellipsoid_destination = ellipsoid_destination.asNondeterministic()
