"""Run requests and audits of what was delivered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.functions.geo import RECEPTOR, Place
from backtrail.operators.joins import explode_grid, unmatched
from backtrail.operators.order import numbered

# Arrival heights (m) and length (h) of the tracks to run.
HEIGHTS = (500, 1000, 1500, 2000)
TRACK_HOURS = 120


def run_requests(
    events: DataFrame, heights: Sequence[int] = HEIGHTS, receptor: Place = RECEPTOR
) -> DataFrame:
    """One backward run per event and arrival height."""
    base = events.select("index", F.col("date").alias("run_date"), F.col("time").alias("run_hour"))
    return explode_grid(base, {"height_i": [float(h) for h in heights]}).withColumns({
        "lat_i": F.lit(receptor.lat), "lon_i": F.lit(receptor.lon),
        "run_hours": F.lit(TRACK_HOURS), "direction": F.lit("backward"),
    })


def request_progress(requests: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number of each request in the given order, of how many, and the percentage reached."""
    counted = numbered(requests, order, "number", total="requests")
    percent = F.try_divide(F.col("number").cast("double"), F.col("requests").cast("double")) * 100
    return counted.withColumn("percent", percent)


def coverage_audit(requests: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests that delivered no row."""
    return unmatched(requests, results.select(*keys).distinct(), list(keys))
