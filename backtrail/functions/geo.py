"""Distance, bearing, grid and region expressions on the sphere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere and ellipsoid of the geodesic formulas (metres).
EARTH_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
POLAR_RADIUS = EARTH_RADIUS * (1 - FLATTENING)


@dataclass(frozen=True)
class Place:
    lon: float
    lat: float


# The sampling site used for distances, and the map origin.
RECEPTOR = Place(lon=6.22, lat=49.62)
MAP_ORIGIN = Place(lon=5.94, lat=49.51)


def as_column(x: float | str | Column) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def grid_floor(x: Column, size: float = 1) -> Column:
    """Lower edge of the grid cell that holds ``x``."""
    return F.floor(x).cast("double") if size == 1 else F.floor(x / F.lit(float(size))) * F.lit(float(size))


def haversine_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    dlat, dlon = F.radians(lat - lat0), F.radians(lon - lon0)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * F.pow(F.sin(dlon / 2), 2)
    # rounding may push the half chord of antipodes above 1
    half = F.when(h > 1, 1.0).otherwise(F.sqrt(h))
    return F.asin(half) * F.lit(2 * EARTH_RADIUS / 1000)


def wrap_degrees(angle: Column) -> Column:
    """Angle in [0, 360)."""
    return F.pmod(angle + F.lit(360.0), F.lit(360.0))


def bearing_sphere(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    """Initial bearing from (lat0, lon0) to (lat, lon), degrees in [0, 360)."""
    a, b, d = F.radians(lat0), F.radians(lat), F.radians(lon - lon0)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return wrap_degrees(F.degrees(F.atan2(y, x)))


def in_view(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


@dataclass(frozen=True)
class Sector:
    """A label for a distance range (from, to] in km and a bearing range [from, to) in degrees."""

    label: str
    near: float | None = None
    far: float | None = None
    left: float | None = None
    right: float | None = None

    def holds(self, distance: Column, bearing: Column) -> Column:
        tests = []
        if self.near is not None:
            tests.append(distance > self.near)
        if self.far is not None:
            tests.append(distance <= self.far)
        if self.left is not None and self.right is not None:
            above, below = bearing >= self.left, bearing < self.right
            tests.append(above & below if self.left < self.right else above | below)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def first_match(rules: Sequence[tuple[Column, str]]) -> Column:
    """Label of the first rule that holds; NULL when none does."""
    out = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def classify(sectors: Sequence[Sector], distance: Column, bearing: Column) -> Column:
    return first_match([(s.holds(distance, bearing), s.label) for s in sectors])


# Region sectors in the order in which they are tested (current version).
SECTORS_CURRENT = (
    Sector("Local (<= 500 km)", far=500),
    Sector("West", 500, 1500, 225, 315),
    Sector("Southwest", 500, 1500, 200, 240),
    Sector("Southeast", 500, 1500, 120, 200),
    Sector("North", 500, 1500, 315, 45),
    Sector("East", 500, 1500, 45, 120),
    Sector("Atlantic (> 1500 km)", near=1500, left=240, right=315),
    Sector("Other (> 1500 km)", near=1500, left=315, right=240),
)
# Report order of the regions (current version).
REGIONS_CURRENT = (
    "Other (> 1500 km)", "Atlantic (> 1500 km)", "West", "Southwest", "North", "East",
    "Southeast", "Local (<= 500 km)",
)
# Region sectors of the earlier version.
SECTORS_EARLIER = (
    Sector("Local (<= 500 km)", far=500),
    Sector("West", 500, 1500, 225, 315),
    Sector("Southwest", 500, 1500, 200, 225),
    Sector("South", 500, 1500, 135, 200),
    Sector("North", 500, 1500, 315, 45),
    Sector("East", 500, 1500, 45, 135),
    Sector("West (> 1500 km)", near=1500, left=225, right=315),
    Sector("Other (> 1500 km)", near=1500, left=315, right=225),
)
# Report order of the regions (earlier version).
REGIONS_EARLIER = (
    "Other (> 1500 km)", "West (> 1500 km)", "West", "Southwest", "North", "East",
    "South", "Local (<= 500 km)",
)
# Direction sectors and distance bands of the two-axis version, in report order.
DIRECTION_SECTORS = (
    Sector("West", left=225, right=315),
    Sector("Southwest", left=200, right=225),
    Sector("North", left=315, right=45),
    Sector("East", left=45, right=135),
    Sector("South", left=135, right=200),
)
DIRECTIONS = tuple(s.label for s in DIRECTION_SECTORS)
DISTANCE_SECTORS = (Sector("Local", far=500), Sector("Near", near=500, far=1500), Sector("Far", near=1500))
DISTANCE_BANDS = tuple(s.label for s in DISTANCE_SECTORS)
# Radii of the range rings (km); bearings, reach and step of the sector lines (km).
RING_RADII_KM = (500, 1500)
LINE_BEARINGS = (45, 120, 240, 315, 200)
LINE_REACH_KM, LINE_STEP_KM = 7000, 100


def anomaly_band(x: Column, low: float, high: float) -> Column:
    """moderate: low <= |x| <= high; high: x > high; low: x < -high; otherwise none."""
    return (
        F.when(F.abs(x).between(low, high), "moderate")
        .when(x > high, "high")
        .when(x < -high, "low")
        .when(x.isNotNull(), "none")
    )


# Anomaly limits of the isotope ratio and of the excess.
BAND_LIMITS_DO = (0.5, 3.0)
BAND_LIMITS_EXCESS = (1.0, 5.0)


def land_class(lat: Column, lon: Column) -> Column:
    """Land class of a polygon from its centroid."""
    # Class labels and limits
    return first_match([
        (lat < 45, "SE-EA"),
        ((lat >= 45) & (lon <= 15), "WE"),
        ((lat >= 45) & (lon > 15), "EE"),
    ])


def ocean_class(lat: Column, lon: Column) -> Column:
    """Ocean class of a polygon from its centroid; NULL where no rule covers it."""
    # Class labels and limits
    return first_match([
        ((lat < 40) & (lon <= 5), "SA"),
        ((lat < 45) & (lon > 5), "ME"),
        ((lat >= 40) & (lat < 55) & (lon < 0), "AT"),
        (lat >= 55, "NA-NS"),
    ])
