"""Domain tables derived from the given tables.

Every table is a projection of one given table (weather: an aggregation), over
all of its rows. The expressions are plain SQL that both engines evaluate
alike; ``sql_tables`` hands the same text to the checking queries.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ORDER_TIME = "o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24)"
_ORDER_DO = "-((o_orderkey * 31 + o_custkey * 17) % 2200) / 1e2"
# the years of the other events, so that weather and composite meet them by date
_SITE_TIME = "CAST(DATE '1995-02-01' AS {ts}) + INTERVAL '1' HOUR * ({key} * 607 % 55000)"

# Precipitation events: one per order. Some starts, ends, amounts and ratios are missing.
EVENTS = ("orders", {
    "index": "o_orderkey",
    "start": f"CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE {_ORDER_TIME} END",
    "end": f"CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_ORDER_TIME}"
           " + INTERVAL '1' MINUTE * (30 + o_orderkey * 13 % 1800) END",
    "type": "o_orderstatus",
    "P": "CASE WHEN month(o_orderdate) = 2 AND o_orderkey % 53 = 0 THEN NULL"
         " ELSE (CAST(round(o_totalprice * 100) AS BIGINT) % 2400) / 1e2 END",
    "dD": f"CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE {_ORDER_DO} * 75e-1 + (o_custkey % 41) * 3e-1 - 2e0 END",
    "dD_dev": "(o_orderkey % 10) / 1e1",
    "dO": f"CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE {_ORDER_DO} END",
    "dO_dev": "(o_orderkey % 7) / 1e1",
})

# The same table after a correction: some starts moved by a day, some amounts raised.
REVISED = ("orders", EVENTS[1] | {
    "start": f"CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN {_ORDER_TIME}"
             f" + INTERVAL '1' DAY ELSE {_ORDER_TIME} END",
    "end": f"CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN {_ORDER_TIME}"
           f" + INTERVAL '1' DAY + INTERVAL '1' MINUTE * (30 + o_orderkey * 13 % 1800) ELSE {_ORDER_TIME}"
           " + INTERVAL '1' MINUTE * (30 + o_orderkey * 13 % 1800) END",
    "P": "((CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey % 40) % 2400) / 1e2",
})

# Events that have tracks: one per supplier.
SITES = ("supplier", {
    "index": "s_suppkey",
    "start": _SITE_TIME.replace("{key}", "s_suppkey"),
    "end": _SITE_TIME.replace("{key}", "s_suppkey") + " + INTERVAL '1' MINUTE * (60 + s_suppkey * 29 % 1300)",
    "type": "'rain'",
    "P": "(101 + s_suppkey * 173 % 2400) / 1e2",
    "dD": "-(s_suppkey * 311 % 2200) / 1e2 * 79e-1 + s_suppkey % 29",
    "dD_dev": "(s_suppkey % 10) / 1e1",
    "dO": "CASE WHEN s_suppkey % 31 = 0 THEN NULL ELSE -(s_suppkey * 311 % 2200) / 1e2 END",
    "dO_dev": "(s_suppkey % 7) / 1e1",
})

_HOUR = ("-CAST((l_orderkey * 7 + l_linenumber * 29) %"
         " (CASE WHEN (l_suppkey + l_linenumber % 4) % 9 = 0 THEN 20 ELSE 121 END) AS INT)")

# Track points: one per order line. The event is the supplier, the height follows the line
# number; some tracks are short, some humidities missing, some heights tied. The last four make the order unique.
TRACKS = ("lineitem", {
    "index": "l_suppkey",
    "height_i": "500e0 * (1 + l_linenumber % 4)",
    "hour_along": _HOUR,
    "traj_dt_i": _SITE_TIME.replace("{key}", "l_suppkey"),
    "lat": "30e0 + (l_suppkey * 17 % 40) + (l_partkey % 500) / 1e2",
    "lon": "(l_suppkey * 37 % 100) - 60e0 + (l_orderkey % 500) / 1e2",
    "air_temp": "250e0 + l_discount * 400e0",
    "rh": "30e0 + l_tax * 800e0",
    "rainfall": "CASE WHEN l_returnflag = 'R' THEN l_quantity / 1e2 ELSE 0e0 END",
    # events far in the west gain the same in steps at all their heights
    "sp_humidity": f"CASE WHEN l_suppkey * 37 % 100 < 10 THEN floor(({_HOUR} + 121) / 41e0) * 1e0"
                   " WHEN l_orderkey % 211 = 0 THEN NULL ELSE l_extendedprice / 7e3 END",
    "run": "l_orderkey",
    "receptor": "l_linenumber",
    "part": "l_partkey",
    "price": "l_extendedprice",
})
TRACK_ORDER = ("hour_along", "run", "receptor", "part", "price")

# Plain tracks: one per user and event type of the event log.
LOG_TRACKS = ("events", {
    "index": "user_id", "height_i": "event_type", "moment": "ts", "event_id": "event_id",
    "sp_humidity": "value / 2e1",
})
LOG_ORDER = ("moment", "event_id")

# Hourly weather from order lines; the last query step of `weather` averages per station and hour.
WEATHER_LINES = ("lineitem", {
    "station": "l_linestatus",
    "date": "CAST(l_shipdate AS DATE)",
    "time": "CAST(l_orderkey % 24 AS INT)",
    "temp": "l_discount * 100e0",
    "rh": "30e0 + l_tax * 800e0",
    "gph": "l_quantity",
})

# Polygons: one per nation, with a vertex per customer on a star around the nation's centre.
# Ring 1 of every fifth nation is a hole made of the customers of one market segment.
_ANGLE = "radians((c_custkey * 7919 % 36000) / 1e2)"
_RADIUS = "(CASE WHEN c_nationkey % 5 = 0 AND c_mktsegment = 'BUILDING' THEN 1e-1 ELSE 1e0 END) * (3e0 + (c_acctbal + 1000) / 4e3)"
VERTICES = ("customer", {
    "poly_id": "CAST(c_nationkey AS BIGINT)",
    "kind": "CASE WHEN c_nationkey % 2 = 0 THEN 'land' ELSE 'ocean' END",
    "ring": "CASE WHEN c_nationkey % 5 = 0 AND c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END",
    "seq": "c_custkey * 7919 % 36000",
    "vertex": "c_custkey",
    "lon": f"-30e0 + c_nationkey * 2 + {_RADIUS} * cos({_ANGLE})",
    "lat": f"25e0 + (c_nationkey * 7 % 25) * 2 + {_RADIUS} * sin({_ANGLE})",
})

# Places around which rings and lines are drawn: one per supplier.
PLACES = ("supplier", {
    "place": "s_suppkey",
    "lat0": "-60e0 + (s_suppkey * 17 % 120)",
    "lon0": "-170e0 + (s_suppkey * 37 % 340)",
})


def _bound(spark: SparkSession, sf_dir: str, binding: tuple[str, dict[str, str]]) -> DataFrame:
    table, columns = binding
    source = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
    return source.select(
        *[F.expr(e.replace("{ts}", "TIMESTAMP_NTZ")).alias(name) for name, e in columns.items()]
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, EVENTS)


def revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, REVISED)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, SITES)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, TRACKS)


def log_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, LOG_TRACKS)


def weather(spark: SparkSession, sf_dir: str, by_station: bool = False) -> DataFrame:
    keys = ["station", "date", "time"] if by_station else ["date", "time"]
    lines = _bound(spark, sf_dir, WEATHER_LINES)
    return lines.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("temp", "rh", "gph")])


def weather_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, WEATHER_LINES)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, VERTICES)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, PLACES)


def _sql(binding: tuple[str, dict[str, str]]) -> str:
    source, columns = binding
    listed = ", ".join(f'{e.replace("{ts}", "TIMESTAMP")} AS "{n}"' for n, e in columns.items())
    return f"SELECT {listed} FROM {source}"


def sql_tables() -> dict[str, str]:
    """The derived tables as SELECT statements for the checking queries."""
    lines = _sql(WEATHER_LINES)
    averages = "avg(temp) AS temp, avg(rh) AS rh, avg(gph) AS gph"
    return {
        "raw_events": _sql(EVENTS),
        "raw_revised": _sql(REVISED),
        "raw_sites": _sql(SITES),
        "track_points": _sql(TRACKS),
        "log_points": _sql(LOG_TRACKS),
        "weather_lines": lines,
        "weather": f'SELECT "date", "time", {averages} FROM ({lines}) GROUP BY ALL',
        "weather_station": f'SELECT station, "date", "time", {averages} FROM ({lines}) GROUP BY ALL',
        "vertices": _sql(VERTICES),
        "places": _sql(PLACES),
    }
