"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from backtrail.plans.catalog import all_queries  # noqa: E402
from backtrail.session import local_session  # noqa: E402

HEADLINE = (
    "moisture_uptake", "moisture_uptake_dominant", "uptake_grid", "source_grid_residuals",
    "event_attribution", "origin_share_monthly", "event_threshold_summary", "event_monthly_summary",
    "rolling_composite", "rolling_composite_scattered", "event_anomalies", "weather_smoothing",
    "weather_event_join", "weather_regression", "window_sweep_regression", "water_line_methods_season",
    "region_offsets", "pearson_by_type", "revised_events_missing", "range_rings", "polygon_centroids",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    catalog = all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet")).count()  # start the workers
    seconds = {}
    for name in names:
        started = time.perf_counter()
        # every column is produced, nothing is fetched
        catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
