"""Requests, audits, differences, geometry and written tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.operators import attribution, geodesy, joins, models, quality, summaries, tracks
from backtrail.plans import attribution_queries as aq
from backtrail.plans import bindings as b
from backtrail.plans import event_queries as ev
from backtrail.plans import track_queries as tq
from backtrail.plans.registry import Query
from backtrail.plans.sqlparts import using
from backtrail.session import scratch_path
from backtrail.sources import delivery, store, tables
from backtrail.sources.schemas import EVENTS, TRACKS, WEATHER

KEYS = ("index", "date", "time")
LINE_HEIGHTS = tuple(500.0 * n for n in range(1, 8))


def _part_requests(spark: SparkSession, d: str) -> DataFrame:
    parts = b.table(spark, d, "part").select(F.col("p_partkey").alias("index"))
    return joins.explode_grid(parts, {"height_i": LINE_HEIGHTS})


def _part_results(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("index"), (F.col("l_linenumber") * 500.0).alias("height_i")
    )


def _revised(spark: SparkSession, d: str) -> DataFrame:
    prepared = summaries.prepare_events(b.revised(spark, d), excess="global")
    return summaries.select_events(prepared)


def _missing_events(spark: SparkSession, d: str) -> DataFrame:
    out = joins.unmatched(_revised(spark, d), ev.selected(spark, d), KEYS)
    return out.select(*KEYS, "P", "d_excess")


def _replaced_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of the events that are still listed, and a second set of corrected tracks."""
    columns = ("index", "height_i", "event_id", "sp_humidity")
    log = b.log_tracks(spark, d).select(*columns)
    keep = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("index"))
    corrected = log.where(F.col("height_i") == "error").withColumn("sp_humidity", F.col("sp_humidity") * 2)
    return joins.replace_tracks(log, keep, corrected, ["index"])


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    points = b.tracks(spark, d)
    columns = ("index", "hour_along", "run", "receptor", "part", "price")
    return tables.ensemble({
        float(h): points.where(F.col("height_i") == h).select(*columns) for h in quality.HEIGHTS
    })


def _as_track_file(points: DataFrame) -> DataFrame:
    """All columns of the track files, those without a source as NULL."""
    have = set(points.columns)
    return points.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRACKS
    ])


_FILE_COLUMNS = ("index", "height_i", "hour_along", "traj_dt_i", "lat", "lon", "air_temp", "rainfall", "rh", "sp_humidity")


def _csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "track-csv")
    tables.write_csv(_as_track_file(b.tracks(spark, d)), path)
    return tables.read_tracks(spark, path, row_names=False).select(*_FILE_COLUMNS)


def _ensemble_files(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "ensemble")
    points = _as_track_file(b.tracks(spark, d))
    paths = {}
    for height in quality.HEIGHTS:
        paths[float(height)] = os.path.join(root, str(height))
        tables.write_csv(points.where(F.col("height_i") == height), paths[float(height)])
    return tables.load_ensemble(spark, paths, row_names=False).select(*_FILE_COLUMNS)


def _track_store(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "track-store")
    tables.write_tracks(tq.prepared_tracks(spark, d), path)
    stored = spark.read.parquet(path).withColumn("height_i", F.col("height_i").cast("double"))
    return stored.groupBy("index", "height_i").agg(
        F.count(F.lit(1)).alias("points"), F.min("hour_along").alias("traj_end"))


# Deliveries of tracks, one folder per height; the last one never comes.
_DELIVERIES = ("500", "1000", "1500", "2000", "2500")
# What is wrong with which rows: a word for a number, half a row, no day, the folder of another height.
_PLANTED = {"word": "run % 29 = 0", "half": "run % 31 = 0", "day": "run % 37 = 0", "astray": "run % 41 = 0"}
_PLANT = "CASE " + " ".join(f"WHEN {test} THEN '{kind}'" for kind, test in _PLANTED.items()) + " END"


def _delivered(spark: SparkSession, d: str) -> delivery.Delivery:
    """Track files of which some rows are broken, read and routed."""
    root = scratch_path(spark, "delivery")
    points = _as_track_file(b.tracks(spark, d)).withColumn("planted", F.expr(_PLANT))
    fields = {f.name: F.coalesce(F.col(f.name).cast("string"), F.lit(tables.MISSING)) for f in TRACKS}
    fields["hour_along"] = F.when(F.col("planted") == "word", F.lit("noon")).otherwise(fields["hour_along"])
    fields["traj_dt_i"] = F.when(F.col("planted") == "day", F.lit("2020-02-31")).otherwise(fields["traj_dt_i"])
    listed = list(fields.values())
    line = F.when(F.col("planted") == "half", F.concat_ws(",", *listed[:9])).otherwise(F.concat_ws(",", *listed))
    height = F.when(F.col("planted") == "astray", F.col("height_i") % 2000 + 500).otherwise(F.col("height_i"))
    for name in _DELIVERIES[:-1]:
        points.where(height == float(name)).select(line.alias("line")).write.text(os.path.join(root, name))
    return delivery.accept(
        spark, {n: os.path.join(root, n) for n in _DELIVERIES}, TRACKS, scratch_path(spark, "accepted"), header=False,
        misplaced=F.col("height_i") != delivery.folder_of().cast("double"))


def _faults(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each delivery were left out, why, and the sum of their lengths."""
    bad = _delivered(spark, d).bad
    return bad.groupBy("delivery", "fault").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("file").cast("boolean").alias("from_files"),
        F.count_if(F.length("line") > 0).alias("lines"))


_REVISED_BLOCKS = ("height_i", "block")
_REVISED_COLUMNS = ("index", "height_i", "hour_along", "run", "sp_humidity")


def _revised_store(spark: SparkSession, d: str) -> DataFrame:
    """A store of tracks after some events were run again and some were struck out."""
    path = scratch_path(spark, "revised-store")
    points = b.tracks(spark, d).select(*_REVISED_COLUMNS, F.pmod("index", F.lit(16)).cast("int").alias("block"))
    points.repartition("block").write.partitionBy(*_REVISED_BLOCKS).parquet(path)
    struck = points.where("index % 16 IN (3, 5) AND index % 3 <> 0").select("index").distinct()
    again = points.where("index % 16 = 3 AND index % 3 = 1").withColumn("sp_humidity", F.col("sp_humidity") * 2)
    store.revise_store(spark, path, points.schema, _REVISED_BLOCKS, struck, again, ["index"])
    return spark.read.schema(points.schema).parquet(path)


def bucketed_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Prepared track points in buckets of their event."""
    return store.bucketed(tq.prepared_tracks(spark, d), "index", _buckets(spark), ["index", "height_i", *b.TRACK_ORDER], "tracks")


def bucketed_sites(spark: SparkSession, d: str) -> DataFrame:
    sites = tq.sites(spark, d).select("index", "P", "dO", "d_excess")
    return store.bucketed(sites, "index", _buckets(spark), label="sites")


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_origins(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Events with their origin region, from tables in buckets of the event."""
    centres = attribution.centroids(tracks.uptake(points, order=b.TRACK_ORDER, dominant_only=True, exact=False))
    # joined before they are located: rows that went through Python have no buckets any more
    beside = attribution.attribute(sites, centres, ("date", "year", "month", "season", "height_i", "lat", "lon"))
    return attribution.with_region(attribution.locate(beside))


def stored_sweep(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Means along the track for each window beside the event, from tables in buckets of the event."""
    return sites.select("index", "dO").join(models.remote_sweep(points, keys=["index"]), "index")


def _event_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "event-csv")
    tables.write_csv(b.events(spark, d).select(*EVENTS.names), path)
    return tables.read_events(spark, path)


def _weather_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "weather-csv")
    tables.write_csv(b.weather(spark, d).select(F.col("time").alias("rownum"), *WEATHER.names[1:]), path)
    return tables.read_weather(spark, path).drop("rownum")


def _named_rows(spark: SparkSession, d: str) -> DataFrame:
    """A file whose rows begin with a number that the header does not name."""
    path = scratch_path(spark, "named-csv")
    points = _as_track_file(b.tracks(spark, d))
    first, *rest = points.columns
    number = F.concat_ws(",", F.monotonically_increasing_id().cast("string"), F.coalesce(F.col(first).cast("string"), F.lit(tables.MISSING)))
    points.select(number.alias(first), *rest).write.csv(path, header=True, nullValue=tables.MISSING, quote="\u0000")
    return tables.read_tracks(spark, path, row_names=True).select(*_FILE_COLUMNS)


def _direct_sql(source: str, bearing: str, metres: str, lat: str, lon: str, steps: int = 12) -> list[tuple[str, str]]:
    """Direct geodesic by repeated sub-queries; the result table is ``reached``."""
    f, polar = "(1 / 298.257223563e0)", "(6378137e0 * (1 - 1 / 298.257223563e0))"
    ratio = f"((6378137e0 * 6378137e0 - {polar} * {polar}) / ({polar} * {polar}))"
    out = [("gd0", f"""SELECT *, sigma0 AS sigma FROM (SELECT *, {metres} / ({polar} * ka) AS sigma0
  FROM (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ka,
      uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS kb
    FROM (SELECT *, (1 - sa * sa) * {ratio} AS uu, atan2(tan(u1), cos(az)) AS sigma1
      FROM (SELECT *, cos(u1) * sin(az) AS sa
        FROM (SELECT *, radians({bearing}) AS az, atan((1 - {f}) * tan(radians(lat0))) AS u1 FROM {source})))))""")]
    for i in range(steps):
        out.append((f"gd{i + 1}", f"""SELECT * EXCLUDE (sigma, cm), sigma0 + kb * sin(sigma) * (cm + kb / 4 * (
  cos(sigma) * (2 * cm * cm - 1) - kb / 6 * cm * (4 * sin(sigma) * sin(sigma) - 3) * (4 * cm * cm - 3))) AS sigma
FROM (SELECT *, cos(2 * sigma1 + sigma) AS cm FROM gd{i})"""))
    out.append(("reached", f"""SELECT *, degrees(atan2(sin(u1) * cos(sigma) + cos(u1) * sin(sigma) * cos(az),
    (1 - {f}) * sqrt(sa * sa + pow(sin(u1) * sin(sigma) - cos(u1) * cos(sigma) * cos(az), 2)))) AS {lat},
  (lon0 + degrees(lam - (1 - cc) * {f} * sa * (sigma + cc * sin(sigma) * (cm + cc * cos(sigma) * (2 * cm * cm - 1))))
    + 540) % 360 - 180 AS {lon}
FROM (SELECT *, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS cc, cos(2 * sigma1 + sigma) AS cm,
    atan2(sin(sigma) * sin(az), cos(u1) * cos(sigma) - sin(u1) * sin(sigma) * cos(az)) AS lam FROM gd{steps})"""))
    return out


_POLYGON_SQL = [
    ("closed", """SELECT poly_id, kind, ring, lon, lat,
  coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2
FROM vertices WINDOW w AS (PARTITION BY poly_id, kind, ring ORDER BY seq, vertex)"""),
    ("ring_sums", """SELECT poly_id, kind, ring, sum(lon * lat2 - lon2 * lat) AS w,
  sum((lon + lon2) * (lon * lat2 - lon2 * lat)) AS wx, sum((lat + lat2) * (lon * lat2 - lon2 * lat)) AS wy
FROM closed GROUP BY ALL"""),
    ("centroids_of", """SELECT poly_id, kind, w / 2 AS area, wx / (3 * w) AS lon, wy / (3 * w) AS lat
FROM (SELECT poly_id, kind, sum(w * s) AS w, sum(wx * s) AS wx, sum(wy * s) AS wy
  FROM (SELECT *, sign(w) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS s FROM ring_sums) GROUP BY ALL)"""),
]


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    # a ring has a vertex per customer, so it is walked in slices of its angle
    return geodesy.polygon_centroids(b.vertices(spark, d), order=["seq", "vertex"], slice_by=F.floor(F.col("seq") / 100))


_FILE_SQL = f"SELECT {', '.join(_FILE_COLUMNS)} FROM track_points"
_FILE_ROUNDS = ("height_i", "lat", "lon", "air_temp", "rainfall", "rh", "sp_humidity")

QUERIES: dict[str, Query] = {
    "run_requests": Query(
        lambda s, d: quality.run_requests(ev.selected(s, d)),
        using("selected", """SELECT index, date AS run_date, time AS run_hour, height_i, 49.62e0 AS lat_i, 6.22e0 AS lon_i,
  CAST(120 AS INT) AS run_hours, 'backward' AS direction
FROM selected CROSS JOIN (VALUES (500e0), (1000e0), (1500e0), (2000e0)) AS h(height_i)"""),
        ("height_i", "lat_i", "lon_i"),
    ),
    "run_request_progress": Query(
        lambda s, d: quality.request_progress(
            quality.run_requests(ev.selected(s, d)), ["index", "height_i"]
        ).select("index", "height_i", "number", "requests", "percent"),
        using("selected", """SELECT index, height_i, row_number() OVER (ORDER BY index, height_i) AS number,
  count(*) OVER () AS requests, 100e0 * row_number() OVER (ORDER BY index, height_i) / count(*) OVER () AS percent
FROM selected CROSS JOIN (VALUES (500e0), (1000e0), (1500e0), (2000e0)) AS h(height_i)"""),
        ("height_i", "percent"),
    ),
    "event_file": Query(
        _event_file, f"""SELECT {', '.join(f'"{c}"' for c in EVENTS.names)} FROM ({b.sql_tables()['raw_events']}) WHERE start IS NOT NULL""",
        ("P", "dD", "dD_dev", "dO", "dO_dev"),
    ),
    "weather_file": Query(
        _weather_file, f"""SELECT "date", "time", temp, rh, gph FROM ({b.sql_tables()['weather']})""", ("temp", "rh", "gph"),
    ),
    "track_csv_row_names": Query(
        _named_rows, f"""SELECT {', '.join(_FILE_COLUMNS)} FROM ({b.sql_tables()['track_points']})""", _FILE_ROUNDS,
    ),
    "coverage_audit": Query(
        lambda s, d: quality.coverage_audit(_part_requests(s, d), _part_results(s, d), ["index", "height_i"]),
        """SELECT p_partkey AS index, height_i FROM part CROSS JOIN (SELECT unnest(range(1, 8)) * 500e0 AS height_i)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber * 500e0 = height_i)""",
        ("height_i",),
    ),
    "ensemble_union": Query(
        _ensemble,
        using("track_points", "SELECT index, hour_along, run, receptor, part, price, height_i FROM track_points"),
        ("price", "height_i"),
    ),
    "revised_events_missing": Query(
        _missing_events,
        using("selected revised_global", """SELECT index, date, time, "P", d_excess FROM revised_global r
WHERE "P" > 1 AND duration <= 24 AND NOT EXISTS (
  SELECT 1 FROM selected s WHERE s.index = r.index AND s.date = r.date AND s.time = r.time)"""),
        ("P", "d_excess"),
    ),
    "revised_events_audit": Query(
        lambda s, d: joins.match_audit(ev.selected(s, d), _revised(s, d), KEYS),
        using("selected revised_global", """SELECT index, date, time, CAST(a.l IS NOT NULL AS INT) AS in_left,
  CAST(c.r IS NOT NULL AS INT) AS in_right, CASE WHEN a.l IS NOT NULL AND c.r IS NOT NULL THEN 0 ELSE 1 END AS flag
FROM (SELECT index, date, time, 1 AS l FROM selected) a
FULL JOIN (SELECT index, date, time, 1 AS r FROM revised_global WHERE "P" > 1 AND duration <= 24) c
  USING (index, date, time)"""),
    ),
    "replaced_tracks": Query(
        _replaced_tracks,
        using("log_points", """SELECT index, height_i, event_id, sp_humidity FROM log_points
WHERE index IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT index, height_i, event_id, sp_humidity * 2 FROM log_points WHERE height_i = 'error'"""),
        ("sp_humidity",),
    ),
    "range_rings": Query(
        lambda s, d: geodesy.range_rings(b.places(s, d), "lat0", "lon0"),
        using("places", "SELECT place, lat0, lon0, radius_km, bearing, ring_lat, ring_lon FROM reached", [
            ("spokes", """SELECT *, radius_km * 1000e0 AS metres FROM places
CROSS JOIN (VALUES (500), (1500)) AS r(radius_km) CROSS JOIN (SELECT CAST(unnest(range(0, 361)) AS INT) AS bearing)"""),
            *_direct_sql("spokes", "bearing", "metres", "ring_lat", "ring_lon"),
        ]),
        ("lat0", "lon0", "ring_lat", "ring_lon"),
    ),
    "sector_lines": Query(
        lambda s, d: geodesy.sector_lines(b.places(s, d), "lat0", "lon0"),
        using("places", "SELECT place, lat0, lon0, bearing, distance_km, line_lat, line_lon FROM reached", [
            ("spokes", """SELECT *, distance_km * 1000e0 AS metres FROM places
CROSS JOIN (VALUES (45), (120), (240), (315), (200)) AS r(bearing)
CROSS JOIN (SELECT CAST(unnest(range(0, 7001, 100)) AS INT) AS distance_km)"""),
            *_direct_sql("spokes", "bearing", "metres", "line_lat", "line_lon"),
        ]),
        ("lat0", "lon0", "line_lat", "line_lon"),
    ),
    "polygon_centroids": Query(
        _polygons,
        using("vertices", "SELECT * FROM centroids_of", _POLYGON_SQL),
        ("area", "lon", "lat"),
    ),
    "polygon_classes": Query(
        lambda s, d: geodesy.polygon_classes(_polygons(s, d)),
        using("vertices", """SELECT *, CASE WHEN kind = 'land' THEN CASE WHEN lat < 45 THEN 'SE-EA'
      WHEN lon <= 15 THEN 'WE' ELSE 'EE' END
    ELSE CASE WHEN lat < 40 AND lon <= 5 THEN 'SA' WHEN lat < 45 AND lon > 5 THEN 'ME'
      WHEN lat >= 40 AND lat < 55 AND lon < 0 THEN 'AT' WHEN lat >= 55 THEN 'NA-NS' END END AS class
FROM centroids_of""", _POLYGON_SQL),
        ("area", "lon", "lat"),
    ),
    "delivered_rows": Query(
        lambda s, d: _delivered(s, d).good.select(*_FILE_COLUMNS),
        using("track_points", f"{_FILE_SQL} WHERE ({_PLANT}) IS NULL"), _FILE_ROUNDS,
    ),
    "delivery_audit": Query(
        lambda s, d: _delivered(s, d).audit,
        using("track_points", f"""SELECT delivery, coalesce("rows", 0) AS "rows", coalesce(good, 0) AS good,
  coalesce(record, 0) AS record, coalesce(moment, 0) AS moment, coalesce(place, 0) AS place
FROM (VALUES ('500'), ('1000'), ('1500'), ('2000'), ('2500')) AS e(delivery)
LEFT JOIN (SELECT delivery, count(*) AS "rows", count(*) FILTER (planted IS NULL) AS good,
    count(*) FILTER (planted IN ('word', 'half')) AS record, count(*) FILTER (planted = 'day') AS moment,
    count(*) FILTER (planted = 'astray') AS place
  FROM sent GROUP BY delivery) USING (delivery)""", [("sent", f"""SELECT *, CAST(CAST(
    CASE WHEN planted = 'astray' THEN height_i % 2000 + 500 ELSE height_i END AS INT) AS VARCHAR) AS delivery
FROM (SELECT *, {_PLANT} AS planted FROM track_points)""")]),
    ),
    "delivery_faults": Query(
        _faults,
        using("track_points", f"""SELECT delivery, fault, count(*) AS "rows", true AS from_files, count(*) AS lines
FROM (SELECT CAST(CAST(CASE WHEN planted = 'astray' THEN height_i % 2000 + 500 ELSE height_i END AS INT) AS VARCHAR) AS delivery,
    CASE planted WHEN 'day' THEN 'moment' WHEN 'astray' THEN 'place' ELSE 'record' END AS fault
  FROM (SELECT *, {_PLANT} AS planted FROM track_points) WHERE planted IS NOT NULL) GROUP BY ALL"""),
    ),
    "track_store_revised": Query(
        _revised_store,
        using("track_points", f"""SELECT {', '.join(_REVISED_COLUMNS)}, CAST(index % 16 AS INT) AS block FROM track_points
WHERE NOT (index % 16 IN (3, 5) AND index % 3 <> 0)
UNION ALL SELECT index, height_i, hour_along, run, sp_humidity * 2, CAST(index % 16 AS INT) FROM track_points
WHERE index % 16 = 3 AND index % 3 = 1"""), ("height_i", "sp_humidity"),
    ),
    "stored_origins": Query(
        lambda s, d: stored_origins(bucketed_tracks(s, d), bucketed_sites(s, d)).select(
            "index", "P", "dO", "region", "height_i", "season", "distance_km"),
        using(aq.ORIGIN_PARTS, 'SELECT index, "P", "dO", region, height_i, season, distance_km FROM origins', aq.ORIGINS_SQL),
        ("P", "dO", "height_i", "distance_km"),
    ),
    "stored_sweep": Query(
        lambda s, d: stored_sweep(bucketed_tracks(s, d), bucketed_sites(s, d)),
        using("track_points selected_sites", """SELECT s.index, s."dO", w AS "window",
  CASE WHEN count(air_temp) = count(*) THEN avg(air_temp) END AS temp_rm,
  CASE WHEN count(rh) = count(*) THEN avg(rh) END AS rh_rm,
  CASE WHEN count(rainfall) = count(*) THEN sum(rainfall) END AS rainout, count(*) AS "count"
FROM track_points t JOIN (VALUES (-3), (-6), (-12), (-18), (-24), (-36), (-48), (-72), (-96)) AS v(w) ON hour_along >= w
JOIN selected_sites s ON s.index = t.index GROUP BY s.index, s."dO", w"""), ("dO", "temp_rm", "rh_rm", "rainout"),
    ),
    "track_csv_round_trip": Query(_csv_round_trip, using("track_points", _FILE_SQL), _FILE_ROUNDS),
    "track_ensemble_files": Query(_ensemble_files, using("track_points", _FILE_SQL), _FILE_ROUNDS),
    "track_store": Query(
        _track_store,
        using("track_points", """SELECT index, height_i, count(*) AS points, min(hour_along) AS traj_end FROM track_points
GROUP BY index, height_i"""), ("height_i",),
    ),
    "track_stage_written": Query(
        lambda s, d: tq.settled_tracks(s, d).groupBy("season").agg(
            F.sum("prop_uptake").alias("shares"), F.count(F.lit(1)).alias("points")
        ),
        using("dominant", "SELECT season, sum(prop_uptake) AS shares, count(*) AS points FROM dominant GROUP BY season"),
        ("shares",),
    ),
}
