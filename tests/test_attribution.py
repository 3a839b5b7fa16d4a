from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.functions import geo
from backtrail.functions.geodesic import destination, initial_bearing
from backtrail.operators import attribution, geodesy, joins


def regions(spark, pairs, sectors=geo.SECTORS_CURRENT):
    df = spark.createDataFrame(pairs, "distance_km double, bearing_deg double")
    return [r.region for r in attribution.with_region(df, sectors).collect()]


def test_regions_at_their_limits(spark):
    pairs = [(500.0, 10.0), (500.001, 10.0), (1500.0, 270.0), (1500.001, 270.0), (1000.0, 230.0), (1000.0, 210.0),
             (1000.0, 120.0), (1000.0, 119.9), (1000.0, 315.0), (2000.0, 239.9), (2000.0, 315.0)]
    assert regions(spark, pairs) == [
        "Local (<= 500 km)", "North", "West", "Atlantic (> 1500 km)", "West", "Southwest",
        "Southeast", "East", "North", "Other (> 1500 km)", "Other (> 1500 km)",
    ]
    assert regions(spark, [(1000.0, 140.0), (2000.0, 230.0)], geo.SECTORS_EARLIER) == ["South", "West (> 1500 km)"]


@pytest.mark.parametrize("sectors", [geo.SECTORS_CURRENT, geo.SECTORS_EARLIER])
def test_every_distance_and_bearing_has_a_region(spark, sectors):
    pairs = [(float(d), float(b)) for d in (0, 500, 501, 1500, 1501, 9000) for b in range(0, 360, 5)]
    assert None not in regions(spark, pairs, sectors)


def test_directions(spark):
    df = spark.createDataFrame([(400.0, 0.0), (1000.0, 210.0), (1501.0, 140.0)], "distance_km double, bearing_deg double")
    got = [(r.region, r.distance) for r in attribution.with_direction(df).collect()]
    assert got == [("North", "Local"), ("Southwest", "Near"), ("South", "Far")]


def test_grid_floor(spark):
    r = spark.range(1).select(
        geo.grid_floor(F.lit(-0.5)), geo.grid_floor(F.lit(3.9), 2), geo.grid_floor(F.lit(-0.5), 2)
    ).first()
    assert tuple(r) == (-1.0, 2.0, -2.0)


def test_distance_of_one_degree_of_latitude(spark):
    lat, lon = F.lit(50.0), F.lit(6.0)
    km = spark.range(1).select(geo.haversine_km(lat + 1, lon, lat, lon)).first()[0]
    assert km == pytest.approx(6378.137 * np.pi / 180)


def test_destination_and_bearing_are_inverse():
    bearings = np.arange(0.0, 360.0, 7.5)
    lat0, lon0 = np.full(bearings.shape, 49.62), np.full(bearings.shape, 6.22)
    lat, lon = destination(lat0, lon0, bearings, np.full(bearings.shape, 1.5e6))
    assert initial_bearing(lat0, lon0, lat, lon) == pytest.approx(bearings, abs=1e-8)


def test_published_geodesic():
    """Flinders Peak to Buninyong, rounded to the arc second digits of the published example."""
    def degrees(d, m, s):
        return d + m / 60 + s / 3600

    lat0, lon0 = np.array([-degrees(37, 57, 3.72030)]), np.array([degrees(144, 25, 29.52440)])
    lat, lon = np.array([-degrees(37, 39, 10.15610)]), np.array([degrees(143, 55, 35.38390)])
    assert initial_bearing(lat0, lon0, lat, lon)[0] == pytest.approx(degrees(306, 52, 5.37), abs=2e-5)
    reached = destination(lat0, lon0, np.array([degrees(306, 52, 5.37)]), np.array([54972.271]))
    assert (reached[0][0], reached[1][0]) == pytest.approx((lat[0], lon[0]), abs=2e-7)


def test_sphere_and_ellipsoid_differ_little_and_unknown_stays_unknown(spark):
    rows = [(float(a), float(o)) for a in range(20, 81, 10) for o in range(-100, 51, 10)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    a = attribution.locate(df).withColumnRenamed("bearing_deg", "e").drop("distance_km")
    both = a.withColumn("s", geo.bearing_sphere(F.lit(49.62), F.lit(6.22), F.col("lat"), F.col("lon"))).collect()
    gaps = [abs((r.e - r.s + 180) % 360 - 180) for r in both if r.lat is not None]
    assert max(gaps) < 0.13 and [r.e for r in both if r.lat is None] == [None]
    assert attribution.locate(df).where("lat is null").first().distance_km is None
    with pytest.raises(ValueError):
        attribution.locate(df, method="flat")


def test_lines_and_rings_of_a_small_file_are_drawn_in_many_tasks(spark):
    origins = spark.range(40).selectExpr("id", "id - 20e0 AS lat0", "id * 3e0 AS lon0").coalesce(1)
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for drawn, each in ((geodesy.sector_lines(origins, "lat0", "lon0"), 355), (geodesy.range_rings(origins, "lat0", "lon0"), 722)):
        per_task = drawn.groupBy(F.spark_partition_id()).count().collect()
        assert many > 1 and len(per_task) == many
        assert sum(r["count"] for r in per_task) == 40 * each


def test_rings_and_lines(spark):
    origin = spark.createDataFrame([(49.51, 5.94)], "lat0 double, lon0 double")
    rings = geodesy.range_rings(origin, "lat0", "lon0")
    assert rings.count() == 361 * 2
    north = rings.where("bearing = 0 and radius_km = 500").first()
    assert north.ring_lon == pytest.approx(5.94) and north.ring_lat > 53.9
    lines = geodesy.sector_lines(origin, "lat0", "lon0")
    assert lines.count() == 5 * 71
    start = lines.where("distance_km = 0").first()
    assert (start.line_lat, start.line_lon) == pytest.approx((49.51, 5.94))


def test_polygon_centroid_with_hole_open_or_closed(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (1, 3), (2, 3), (2, 1)]
    rows = [(1, "land", 0, i, float(x), float(y)) for i, (x, y) in enumerate(square + square[:1])]
    rows += [(1, "land", 1, i, float(x), float(y)) for i, (x, y) in enumerate(hole)]
    rows += [(2, "ocean", 0, i, float(x) - 20, float(y) + 45) for i, (x, y) in enumerate(reversed(square))]
    df = spark.createDataFrame(rows, "poly_id long, kind string, ring int, seq int, lon double, lat double")
    for slice_by in (None, F.floor(F.col("seq") / 2)):
        got = {r.poly_id: r for r in geodesy.polygon_classes(geodesy.polygon_centroids(df, slice_by=slice_by)).collect()}
        assert (got[1].area, got[1].lon, got[1].lat) == pytest.approx((14.0, (16 * 2 - 2 * 1.5) / 14, 2.0))
        assert (got[2].area, got[2].lon, got[2].lat) == pytest.approx((16.0, -18.0, 47.0))
        assert got[1]["class"] == "SE-EA" and got[2]["class"] == "AT"


TRACKS = "index long, height_i double, date date, year int, month int, season string, lat double, lon double, delta_q double"


@pytest.fixture(scope="module")
def points(spark):
    rows = []
    for i in range(6):
        for h in range(8):
            rows.append((i, 500.0, date(2020, 1 + i, 1), 2020, 1 + i, "Winter" if i < 2 else "Spring",
                         50.0 + (h % 3) * 0.6, -1.0 + (h % 4) * 0.7, float(h - 2) if h != 5 else None))
    return spark.createDataFrame(rows, TRACKS)


def test_source_grid_equals_point_by_point_sums(spark, points):
    events = spark.createDataFrame(
        [(0, 2.0, -5.0), (1, 3.0, None), (2, None, -7.0), (9, 1.0, -1.0)], "index long, P double, dO double"
    )
    got = {(r.lat, r.lon, r.season): r for r in attribution.source_grid(events, points, ["dO"]).collect()}
    value = {r["index"]: r for r in events.collect()}
    cells, season = {}, {}
    for p in points.collect():
        if p["index"] in value and p.delta_q is not None and p.delta_q > 0:
            cells.setdefault((np.floor(p.lat), np.floor(p.lon), p.season), []).append(p)
            season[p.season] = season.get(p.season, 0) + p.delta_q
    assert got.keys() == cells.keys()
    for cell, members in cells.items():
        r = got[cell]
        known = [(value[p["index"]].dO, p.delta_q) for p in members if value[p["index"]].dO is not None]
        weight = sum(w for _, w in known)
        assert r.uptake == pytest.approx(sum(p.delta_q for p in members))
        assert r.dO == (pytest.approx(sum(v * w for v, w in known) / weight) if known else None)
        assert r.P_point_sum == pytest.approx(sum(value[p["index"]].P or 0 for p in members))
        assert r["count"] == len(members) and r.prop_uptake == pytest.approx(r.uptake / season[cell[2]])


def test_uptake_grid_shares_sum_to_one_per_season(points):
    sums = attribution.uptake_grid(points).groupBy("season").agg(F.sum("prop_uptake").alias("s")).collect()
    assert [r.s for r in sums] == pytest.approx([1.0, 1.0])


def test_centroids_use_gains_only(points):
    r = attribution.centroids(points).where("index = 0").first()
    gains = [(p.lat, p.delta_q) for p in points.where("index = 0 and delta_q > 0").collect()]
    assert r.lat == pytest.approx(sum(a * w for a, w in gains) / sum(w for _, w in gains))
    assert r["count"] == len(gains)


def test_shares_are_complete_and_sum_to_one(spark):
    df = spark.createDataFrame(
        [(1, "West", 2.0), (1, "North", 6.0), (2, "West", 5.0), (3, "West", None)], "month int, region string, P double"
    )
    got = {(r.month, r.region): r for r in attribution.share_table(df, "month", "region", geo.REGIONS_CURRENT).collect()}
    assert len(got) == 3 * len(geo.REGIONS_CURRENT)
    assert got[1, "West"].contr == 0.25 and got[2, "East"].P == 0.0 and got[2, "East"].contr == 0.0
    assert got[3, "West"].P == 0.0 and got[3, "West"].contr is None
    assert sum(r.contr for k, r in got.items() if k[0] == 1) == 1.0
    stacked = attribution.stacked_shares(
        attribution.share_table(df, "month", "region"), "month", "region"
    ).where("month = 1").orderBy("region").collect()
    assert [(r.region, r.contr_upto, r.contr_mid) for r in stacked] == [("North", 0.75, 0.375), ("West", 1.0, 0.875)]


def test_unlabelled_rows_stay_in_the_share_table(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, "Near", 2.0)], "month int, distance string, P double")
    got = {r.distance: r.contr for r in attribution.share_table(df, "month", "distance", geo.DISTANCE_BANDS).collect()}
    assert got == {None: 0.5, "Near": 0.5, "Local": 0.0, "Far": 0.0}


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.4, 0.5, -3.0, 3.1, -3.1, None)], "x double")
    assert [r[0] for r in df.select(geo.anomaly_band(F.col("x"), 0.5, 3.0)).collect()] == [
        "none", "moderate", "moderate", "high", "low", None,
    ]


def test_attribution_repeats_events_with_tied_heights(spark):
    events = spark.createDataFrame([(1, 2.0)], "index long, P double")
    placed = spark.createDataFrame([(1, 500.0, "West"), (1, 1000.0, "East")], "index long, height_i double, region string")
    assert attribution.attribute(events, placed, ["height_i", "region"]).count() == 2


def test_differences_and_audits(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    c = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert [r.k for r in joins.unmatched(a, c, ["k"]).collect()] == [1]
    assert [r.k for r in joins.listed(a, c, ["k"]).collect()] == [2]
    assert sorted((r.k, r.flag) for r in joins.match_audit(a, c, ["k"]).collect()) == [(1, 1), (2, 0), (3, 1)]
    with pytest.raises(ValueError):
        joins.natural_join(a, c, ["k"])
    assert joins.replace_tracks(a, c, c, ["k"]).count() == 3
