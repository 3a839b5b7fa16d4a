"""Tracks: preparation, length, moisture uptake, dominant height, counts.

A track is the ordered set of points of one (event, height): a few hundred hours at
most, which bounds every window here. The points of one event are brought together
once, and all windows use that exchange and one sort. Totals are added up as
decimals, so that equal gains have equal totals in whatever order they come; a gain
counts to 12 digits behind the point, one under 5e-13 as nothing, and is finite. On
request they are added up as doubles, point after point, as SQL does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from backtrail.functions.geo import MAP_ORIGIN
from backtrail.functions.scalars import count_label, season
from backtrail.functions.semantics import (
    flag,
    positive_part,
    safe_div,
    share_percent,
)
from backtrail.operators.series import roll_sum
from backtrail.operators.skew import null_safe_join

# Least reach of a kept track (hours), width of the trailing sum (rows),
# gain that marks an uptake, and the points of a complete track.
LEAST_REACH = -24
TRAILING_ROWS = 6
UPTAKE_GAIN = 0.5
POINTS_PER_TRACK = 121

_EXACT = "decimal(38,12)"


def prepare_tracks(points: DataFrame, arrival: str = "traj_dt_i") -> DataFrame:
    """Calendar columns of the arrival time."""
    return points.withColumn("date", F.to_date(arrival)).withColumns({
        "year": F.year("date"), "month": F.month("date"), "season": season(F.col("date")),
    })


def track_length(points: DataFrame, keys: Sequence[str], hour: str = "hour_along") -> DataFrame:
    """Oldest hour per key."""
    return points.groupBy(*keys).agg(F.min(hour).alias("traj_end"))


def with_track_length(
    points: DataFrame, keys: Sequence[str] = ("index", "height_i"), hour: str = "hour_along"
) -> DataFrame:
    """Oldest hour of the track on each of its points."""
    return null_safe_join(points, track_length(points, keys, hour), keys)


def _gain(value: str, trailing: int):
    def add(frame: DataFrame, window: WindowSpec) -> DataFrame:
        step = F.col(value) - F.lag(value).over(window)
        return frame.withColumn("delta_q", step).withColumn(
            "delta_q6d", roll_sum(F.col("delta_q"), window, trailing, "right")
        )

    return add


def _finish(df: DataFrame) -> DataFrame:
    gain = F.col("delta_q")
    prop = F.when(gain > 0, safe_div(gain, F.col("tot_uptake"))).when(gain <= 0, 0.0)
    return df.withColumns({"uptake": flag(F.col("delta_q6d") >= UPTAKE_GAIN), "prop_uptake": prop})


def uptake(
    points: DataFrame,
    key: str = "index",
    height: str = "height_i",
    order: Sequence[str] = ("hour_along",),
    value: str = "sp_humidity",
    least_reach: int | None = LEAST_REACH,
    least_points: int | None = None,
    trailing: int = TRAILING_ROWS,
    dominant_only: bool = False,
    exact: bool = True,
) -> DataFrame:
    """Moisture gain along each track.

    Adds the step from the next older point (``delta_q``), its trailing sum
    (``delta_q6d``), the uptake mark, the track total of positive steps and the
    share of each positive step in it. ``order`` starts with the hour (oldest
    first) and must be unique within a track. Tracks that do not reach
    ``least_reach`` hours back, or have fewer than ``least_points`` points, are
    left out. With ``dominant_only``, only the height with the largest total is
    kept per event; equal totals are all kept. Totals are decimal sums; without
    ``exact``, sums of doubles in the order of the track.
    """
    tests = []
    if least_reach is not None:
        tests.append(F.col("traj_end") <= least_reach)
    if least_points is not None:
        tests.append(F.col("__points") >= least_points)
    long_enough = F.lit(True)
    for test in tests:
        long_enough = long_enough & test
    # every window below asks for the same order, so one sort serves them all
    along = Window.partitionBy(key, height).orderBy(*order)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = points.repartition(key).withColumns({
        "traj_end": F.min(order[0]).over(whole), "__points": F.count(F.lit(1)).over(whole),
    }).where(long_enough).drop("__points")
    frame = _gain(value, trailing)(frame, along)
    gain = positive_part(F.col("delta_q"))
    gained = F.sum(gain.cast(_EXACT) if exact else gain).over(whole).cast("double")
    frame = frame.withColumn("tot_uptake", F.coalesce(gained, F.lit(0.0)))
    if dominant_only:
        frame = _largest(frame, key, "tot_uptake")
    added = ["traj_end", "delta_q", "delta_q6d", "uptake", "tot_uptake", "prop_uptake"]
    return _finish(frame).select(*[c for c in points.columns if c not in added], *added)


def _largest(tracks: DataFrame, key: str, total: str) -> DataFrame:
    """Rows whose total equals the largest of their event."""
    most = F.max(total).over(Window.partitionBy(key))
    return tracks.withColumn("__most", most).where(F.col(total) == F.col("__most")).drop("__most")


def dominant(
    tracks: DataFrame,
    key: str = "index",
    height: str = "height_i",
    total: str = "tot_uptake",
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Points of the height with the largest total of each event; equal totals are all kept.

    With ``tie_break`` one height is kept, the first in the order of those columns.
    """
    if not tie_break:
        return _largest(tracks, key, total)
    names = list(dict.fromkeys([key, height, total, *tie_break]))
    per_track = tracks.select(*names).groupBy(key, height).agg(
        F.max(total).alias(total),
        *[F.min(c).alias(c) for c in names if c not in (key, height, total)],
    )
    first = F.struct((-F.col(total)).alias("t"), *[F.col(c).alias(f"b{i}") for i, c in enumerate(tie_break)])
    best = per_track.groupBy(key).agg(F.min_by(height, first).alias(height))
    return null_safe_join(tracks, best, [key, height], "left_semi")


def track_counts(tracks: DataFrame, west_of: float = MAP_ORIGIN.lon) -> DataFrame:
    """Share of points west of a longitude and number of tracks, per month and season."""
    points = F.count(F.lit(1)).cast("double")
    return (
        tracks.groupBy("month", "season")
        .agg(
            share_percent(F.col("lon") < west_of).alias("amount_western"),
            (points / F.lit(float(POINTS_PER_TRACK))).alias("N"),
        )
        .withColumn("label", count_label(F.col("N")))
    )


def distinct_track_counts(tracks: DataFrame, key: str = "index", height: str = "height_i") -> DataFrame:
    """Number of tracks per month and season, counted rather than derived from points."""
    return (
        tracks.groupBy("month", "season", key, height).agg(F.count(F.lit(1)).alias("points"))
        .groupBy("month", "season")
        .agg(F.count(F.lit(1)).alias("N"), F.sum("points").alias("points"))
    )


def season_counts(counts: DataFrame) -> DataFrame:
    """Track number and mean western share per season, from the monthly table."""
    return counts.groupBy("season").agg(
        F.sum("N").alias("N"), F.avg("amount_western").alias("amount_western")
    )
