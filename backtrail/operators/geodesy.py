"""Bearings, rings, sector lines and polygon centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.functions.geo import (
    LINE_BEARINGS,
    LINE_REACH_KM,
    LINE_STEP_KM,
    RING_RADII_KM,
    as_column,
    land_class,
    ocean_class,
)
from backtrail.functions.geodesic import ellipsoid_bearing, ellipsoid_destination
from backtrail.operators.skew import over_ordered


def with_ellipsoid_bearing(
    df: DataFrame,
    lat0: float | str | Column,
    lon0: float | str | Column,
    lat: str = "lat",
    lon: str = "lon",
    out: str = "bearing_deg",
) -> DataFrame:
    """Initial bearing on the ellipsoid from (lat0, lon0) to each point, degrees in [0, 360)."""
    return df.withColumn(
        out, ellipsoid_bearing(as_column(lat0), as_column(lon0), F.col(lat), F.col(lon))
    )


def with_destination(
    df: DataFrame,
    lat0: float | str | Column,
    lon0: float | str | Column,
    bearing: Column,
    metres: Column,
    out_lat: str = "lat",
    out_lon: str = "lon",
) -> DataFrame:
    """Point reached on the ellipsoid from (lat0, lon0) along a bearing for a distance."""
    reached = ellipsoid_destination(
        as_column(lat0), as_column(lon0), bearing.cast("double"), metres.cast("double")
    )
    return (
        df.withColumn("__p", reached)
        .withColumns({out_lat: F.col("__p.lat"), out_lon: F.col("__p.lon")})
        .drop("__p")
    )


def _dealt(origins: DataFrame) -> DataFrame:
    """Origins in as many parts as a shuffle has: a small file is one task otherwise, with all the points drawn from it."""
    return origins.repartition(int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_rings(
    origins: DataFrame, lat: str, lon: str, radii_km: Sequence[int] = RING_RADII_KM
) -> DataFrame:
    """Circles around each origin: a point per whole degree of bearing, 0 to 360, and radius."""
    spokes = _dealt(origins).withColumn(
        "radius_km", F.explode(F.array(*[F.lit(int(r)) for r in radii_km]))
    ).withColumn("bearing", F.explode(F.sequence(F.lit(0), F.lit(360))))
    return with_destination(
        spokes, lat, lon, F.col("bearing"), F.col("radius_km") * 1000, "ring_lat", "ring_lon"
    )


def sector_lines(
    origins: DataFrame,
    lat: str,
    lon: str,
    bearings: Sequence[int] = LINE_BEARINGS,
    reach_km: int = LINE_REACH_KM,
    step_km: int = LINE_STEP_KM,
) -> DataFrame:
    """Lines from each origin along the given bearings, a point every ``step_km``."""
    spokes = _dealt(origins).withColumn(
        "bearing", F.explode(F.array(*[F.lit(int(b)) for b in bearings]))
    ).withColumn("distance_km", F.explode(F.sequence(F.lit(0), F.lit(reach_km), F.lit(step_km))))
    return with_destination(
        spokes, lat, lon, F.col("bearing"), F.col("distance_km") * 1000, "line_lat", "line_lon"
    )


def polygon_centroids(
    vertices: DataFrame,
    keys: Sequence[str] = ("poly_id", "kind"),
    ring: str = "ring",
    order: Sequence[str] = ("seq",),
    slice_by: Column | None = None,
) -> DataFrame:
    """Area centroid of each polygon from its vertices; ring 0 is the outline, others are holes.

    A ring may be closed or not: the segment from its last to its first vertex
    is always added, and has no weight when both are the same point. ``slice_by`` as
    in ``over_ordered``, for rings of unbounded length.
    """
    groups = [*keys, ring]
    at = F.struct(*order)

    def segments(frame: DataFrame, window) -> DataFrame:
        return frame.withColumns({
            "__lon2": F.lead("lon").over(window), "__lat2": F.lead("lat").over(window),
        })

    def cross(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return x1 * y2 - x2 * y1

    inner = over_ordered(
        vertices.select(*groups, *order, "lon", "lat"), groups, list(order), segments,
        after=1, slice_by=slice_by,
    ).where(F.col("__lon2").isNotNull())
    closing = vertices.groupBy(*groups).agg(
        F.max_by("lon", at).alias("lon"), F.max_by("lat", at).alias("lat"),
        F.min_by("lon", at).alias("__lon2"), F.min_by("lat", at).alias("__lat2"),
    )
    columns = [*groups, "lon", "lat", "__lon2", "__lat2"]
    pieces = inner.select(*columns).unionByName(closing.select(*columns)).withColumn(
        "__w", cross(F.col("lon"), F.col("lat"), F.col("__lon2"), F.col("__lat2"))
    )
    rings = pieces.groupBy(*groups).agg(
        F.sum("__w").alias("w"),
        F.sum((F.col("lon") + F.col("__lon2")) * F.col("__w")).alias("wx"),
        F.sum((F.col("lat") + F.col("__lat2")) * F.col("__w")).alias("wy"),
    )
    # orientation must not matter: the outline counts positive, holes negative
    sign = F.signum("w") * F.when(F.col(ring) == 0, 1).otherwise(-1)
    return (
        rings.groupBy(*keys)
        .agg(*[F.sum(F.col(c) * sign).alias(c) for c in ("w", "wx", "wy")])
        .select(
            *keys,
            (F.col("w") / 2).alias("area"),
            F.try_divide(F.col("wx"), F.col("w") * 3).alias("lon"),
            F.try_divide(F.col("wy"), F.col("w") * 3).alias("lat"),
        )
    )


def polygon_classes(centroids: DataFrame, kind: str = "kind") -> DataFrame:
    """Land or ocean class of each polygon centroid."""
    return centroids.withColumn(
        "class",
        F.when(F.col(kind) == "land", land_class(F.col("lat"), F.col("lon"))).when(
            F.col(kind) == "ocean", ocean_class(F.col("lat"), F.col("lon"))
        ),
    )
