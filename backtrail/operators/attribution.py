"""Uptake grids, moisture centroids, origin regions and share tables.

Grids are aggregated before anything is joined or totalled: the number of cells
is bounded by the globe, so season totals and shares are taken over cells and
no window ever runs over points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backtrail.functions.geo import (
    DIRECTION_SECTORS,
    DISTANCE_SECTORS,
    RECEPTOR,
    SECTORS_CURRENT,
    Place,
    Sector,
    anomaly_band,
    as_column,
    bearing_sphere,
    classify,
    grid_floor,
    haversine_km,
    in_view,
)
from backtrail.functions.scalars import ordinal, rounded
from backtrail.functions.semantics import positive_sum, rows, safe_div, strict_sum, total, wmean
from backtrail.operators.geodesy import with_ellipsoid_bearing
from backtrail.operators.joins import complete_grid
from backtrail.operators.skew import null_safe_join

CELL = ("lat", "lon", "season")


def season_uptake(tracks: DataFrame) -> DataFrame:
    """Total positive gain per season."""
    return tracks.groupBy("season").agg(positive_sum(F.col("delta_q")).alias("seas_uptake"))


def _on_grid(tracks: DataFrame, cell: float) -> DataFrame:
    return tracks.withColumns({
        "lat": grid_floor(F.col("lat"), cell), "lon": grid_floor(F.col("lon"), cell),
    })


def _season_share(cells: DataFrame) -> DataFrame:
    """Share of a cell's uptake in its season; a row per season is joined back."""
    of_season = cells.groupBy("season").agg(F.sum("uptake").alias("__season"))
    return null_safe_join(cells, of_season, ["season"]).withColumn(
        "prop_uptake", safe_div(F.col("uptake"), F.col("__season"))).drop("__season")


def uptake_grid(tracks: DataFrame, cell: float = 1) -> DataFrame:
    """Uptake, share of the season total and point count per grid cell and season."""
    cells = _on_grid(tracks, cell).groupBy(*CELL).agg(
        positive_sum(F.col("delta_q")).alias("uptake"), rows().alias("count")
    )
    return _season_share(cells)


def source_grid(
    events: DataFrame,
    tracks: DataFrame,
    values: Sequence[str],
    amount: str = "P",
    cell: float = 1,
    key: str = "index",
) -> DataFrame:
    """Event values spread over the cells where their moisture was taken up.

    Points are first reduced to one row per event, cell and season, so the join
    with the events never meets an event's whole track, however long it is.
    ``P_point_sum`` adds the event amount once per point.
    """
    gains = (
        _on_grid(tracks.where(F.col("delta_q") > 0), cell)
        .groupBy(key, *CELL)
        .agg(F.sum("delta_q").alias("gain"), rows().alias("points"))
    )
    joined = gains.join(events.select(key, amount, *values), on=key, how="inner")
    cells = joined.groupBy(*CELL).agg(
        F.sum("gain").alias("uptake"),
        *[wmean(F.col(v), F.col("gain")).alias(v) for v in values],
        total(F.col(amount) * F.col("points")).alias("P_point_sum"),
        F.sum("points").alias("count"),
    )
    return _season_share(cells)


def map_layer(
    cells: DataFrame,
    least_percent: float,
    view: tuple[float, float, float, float] | None = None,
    bands: dict[str, tuple[str, float, float]] | None = None,
    seasons: Sequence[str] | None = None,
) -> DataFrame:
    """Cells above a share of the season total, inside a view (south, north, west, east).

    ``bands`` adds an anomaly band column per entry: name -> (column, low, high).
    """
    out = cells.where(F.col("prop_uptake") * 100 > least_percent)
    if view is not None:
        out = out.where(in_view(F.col("lat"), F.col("lon"), *view))
    if seasons is not None:
        out = out.where(F.col("season").isin(*seasons))
    for name, (column, low, high) in (bands or {}).items():
        out = out.withColumn(name, anomaly_band(F.col(column), low, high))
    return out


def uptake_points(
    tracks: DataFrame, view: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Points with a positive gain, inside a view (south, north, west, east)."""
    out = tracks.where(F.col("delta_q") > 0)
    return out if view is None else out.where(in_view(F.col("lat"), F.col("lon"), *view))


def centroids(
    tracks: DataFrame,
    keys: Sequence[str] = ("index", "date", "year", "month", "season", "height_i"),
) -> DataFrame:
    """Gain-weighted mean position, uptake and number of gaining points of each track."""
    return (
        tracks.where(F.col("delta_q") > 0)
        .groupBy(*keys)
        .agg(
            wmean(F.col("lat"), F.col("delta_q")).alias("lat"),
            wmean(F.col("lon"), F.col("delta_q")).alias("lon"),
            F.sum("delta_q").alias("uptake"),
            rows().alias("count"),
        )
    )


def locate(
    points: DataFrame,
    receptor: Place = RECEPTOR,
    lat: str = "lat",
    lon: str = "lon",
    method: str = "ellipsoid",
) -> DataFrame:
    """Distance to the receptor (sphere) and bearing from it (ellipsoid or sphere)."""
    lat0, lon0 = as_column(receptor.lat), as_column(receptor.lon)
    out = points.withColumn("distance_km", haversine_km(F.col(lat), F.col(lon), lat0, lon0))
    if method == "ellipsoid":
        return with_ellipsoid_bearing(out, receptor.lat, receptor.lon, lat, lon)
    if method == "sphere":
        return out.withColumn("bearing_deg", bearing_sphere(lat0, lon0, F.col(lat), F.col(lon)))
    raise ValueError(f"unknown method {method!r}")


def with_region(points: DataFrame, sectors: Sequence[Sector] = SECTORS_CURRENT) -> DataFrame:
    """Origin region from distance and bearing; the first sector that holds wins."""
    return points.withColumn("region", classify(sectors, F.col("distance_km"), F.col("bearing_deg")))


def with_direction(points: DataFrame) -> DataFrame:
    """Direction and distance band as two separate labels."""
    distance, bearing = F.col("distance_km"), F.col("bearing_deg")
    return points.withColumns({
        "region": classify(DIRECTION_SECTORS, distance, bearing),
        "distance": classify(DISTANCE_SECTORS, distance, bearing),
    })


def near_sector_edge(
    points: DataFrame, sectors: Sequence[Sector] = SECTORS_CURRENT, tolerance: float = 0.13
) -> DataFrame:
    """Mark points whose bearing is so close to an edge that the earth model decides the region."""
    edges = sorted({e for s in sectors for e in (s.left, s.right) if e is not None})
    gaps = [F.abs(F.col("bearing_deg") - F.lit(float(e))) for e in edges]
    return points.withColumn("near_edge", F.least(*gaps) <= tolerance)


def attribute(events: DataFrame, located: DataFrame, keep: Sequence[str], key: str = "index") -> DataFrame:
    """Event columns beside the track columns; an event with tied heights occurs once per height."""
    return events.join(located.select(key, *keep), on=key, how="inner")


def share_table(
    attributed: DataFrame,
    group: str,
    label: str,
    levels: Sequence | None = None,
    amount: str = "P",
) -> DataFrame:
    """Amount per group and label with its share in the group; missing combinations count 0."""
    sums = attributed.groupBy(group, label).agg(strict_sum(F.col(amount)).alias(amount))
    filled = complete_grid(sums, [group], label, {amount: 0.0}, levels)
    of_group = F.sum(amount).over(Window.partitionBy(group))
    return filled.withColumn("P_tot", of_group).withColumn(
        "contr", safe_div(F.col(amount), F.col("P_tot"))
    )


def percent_shares(shares: DataFrame, digits: int = 3) -> DataFrame:
    """Shares rounded for a table (half to even), and the rounded share as a percentage."""
    return shares.withColumn("contr", rounded(F.col("contr"), digits)).withColumn("contr_100", F.col("contr") * 100)


def stacked_shares(shares: DataFrame, group: str, label: str, levels: Sequence | None = None) -> DataFrame:
    """Running share within the group, in label order, and the middle of each band."""
    by = ordinal(F.col(label), tuple(levels)) if levels is not None else F.col(label)
    upto = Window.partitionBy(group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        shares.withColumn("__at", by)
        .withColumn("contr_upto", F.sum("contr").over(upto))
        .withColumn("contr_mid", F.col("contr_upto") - F.col("contr") / 2)
        .drop("__at")
    )


def region_means(attributed: DataFrame, values: dict[str, str], amount: str = "P") -> DataFrame:
    """Weighted mean and deviation of each value and the amount, per region and season.

    ``values`` maps a value column to the name of its deviation.
    """
    return attributed.groupBy("region", "season").agg(
        *[F.stddev_samp(v).alias(sd) for v, sd in values.items()],
        *[wmean(F.col(v), F.col(amount)).alias(v) for v in values],
        total(F.col(amount)).alias(amount),
    )


def season_deviations(attributed: DataFrame, values: dict[str, str]) -> DataFrame:
    return attributed.groupBy("season").agg(*[F.stddev_samp(v).alias(sd) for v, sd in values.items()])


def region_ranges(means: DataFrame, values: Sequence[str]) -> DataFrame:
    """Least and largest seasonal mean per region, and their distance."""
    out = means.groupBy("region").agg(
        *[f(v).alias(f"{v}_{s}") for v in values for s, f in (("min", F.min), ("max", F.max))]
    )
    return out.withColumns({f"{v}_range": F.col(f"{v}_max") - F.col(f"{v}_min") for v in values})


def ordered_means(means: DataFrame, seasons: Sequence[str], amount: str = "P") -> DataFrame:
    """Rows by season, the largest amount first."""
    at: Column = ordinal(F.col("season"), tuple(seasons))
    return means.orderBy(at, F.desc(amount))
