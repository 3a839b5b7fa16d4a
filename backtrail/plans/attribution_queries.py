"""Moisture centroids, origin regions and the tables by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.functions.geo import DISTANCE_BANDS, REGIONS_CURRENT, SECTORS_EARLIER
from backtrail.functions.scalars import SEASONS
from backtrail.operators import attribution, models, summaries
from backtrail.plans import event_queries as ev
from backtrail.plans import track_queries as tq
from backtrail.plans.registry import Query
from backtrail.plans.sqlparts import (
    REGION_CURRENT,
    REGION_EARLIER,
    ellipsoid_bearing,
    haversine,
    iqr,
    sphere_bearing,
    strict_sum,
    using,
    wmean,
)

VALUES = {"dO_nm": "dO_sd", "d_excess_nm": "de_sd"}
TRACK_COLUMNS = ("date", "year", "month", "season", "height_i", "region", "distance_km", "bearing_deg")


def located(spark: SparkSession, d: str, points: DataFrame | None = None) -> DataFrame:
    points = points if points is not None else tq.dominant_uptake(spark, d)
    return attribution.with_region(attribution.locate(attribution.centroids(points)))


def attributed(spark: SparkSession, d: str) -> DataFrame:
    """Events with fit, anomaly and origin region."""
    fitted = tq.events_with_fit(spark, d).select(
        "index", "P", "dO", "d_excess", "temp", "rh", "gph", "fits", "residuals"
    )
    unusual = tq.site_anomalies(spark, d).select("index", "dO_nm", "d_excess_nm")
    return attribution.attribute(fitted.join(unusual, on="index"), located(spark, d), TRACK_COLUMNS)


def origins(spark: SparkSession, d: str) -> DataFrame:
    """Events with origin region only."""
    sites = tq.sites(spark, d).select("index", "P", "dO", "d_excess")
    return attribution.attribute(sites, located(spark, d), TRACK_COLUMNS)


def settled_origins(spark: SparkSession, d: str) -> DataFrame:
    """``origins``, written once for summaries that read it several times."""
    return ev.settled(spark, origins(spark, d), "origins")


def settled_attributed(spark: SparkSession, d: str) -> DataFrame:
    """``attributed``, written once for summaries that read it several times."""
    return ev.settled(spark, attributed(spark, d), "attributed")


LOCATED_SQL = [*ellipsoid_bearing("centroids", 49.62, 6.22),
               ("regions", f"SELECT *, {REGION_CURRENT} AS region FROM located")]
ORIGINS_SQL = [*LOCATED_SQL, ("origins", """SELECT s.index, s."P", s."dO", s.d_excess, r.date, r.year, r.month,
  r.season, r.height_i, r.region, r.distance_km, r.bearing_deg
FROM selected_sites s JOIN regions r ON r.index = s.index""")]
ATTRIBUTED_SQL = [*LOCATED_SQL, *tq.site_fit_sql(), *tq.SITE_ANOMALY_SQL, ("attributed", """SELECT f.index, f."P", f."dO",
  f.d_excess, f.temp, f.rh, f.gph, f.fits, f.residuals, a."dO_nm", a.d_excess_nm, r.date, r.year, r.month, r.season,
  r.height_i, r.region, r.distance_km, r.bearing_deg
FROM fitted_sites f JOIN site_anomaly a ON a.index = f.index JOIN regions r ON r.index = f.index""")]
ORIGIN_PARTS = "centroids selected_sites"
ATTRIBUTED_PARTS = "centroids selected_sites composite smooth"


def _sphere(spark: SparkSession, d: str) -> DataFrame:
    return attribution.locate(attribution.centroids(tq.dominant_uptake(spark, d)), method="sphere")


_SPHERE_SQL = f"""SELECT *, {haversine('lat', 'lon', '49.62e0', '6.22e0')} AS distance_km,
  {sphere_bearing('lat', 'lon', '49.62e0', '6.22e0')} AS bearing_deg FROM centroids"""
_PLACE_ROUNDS = ("height_i", "lat", "lon", "uptake", "distance_km", "bearing_deg")


def _means(spark: SparkSession, d: str) -> DataFrame:
    return attribution.region_means(attributed(spark, d), VALUES)


_MEANS_SQL = f"""SELECT region, season, stddev_samp("dO_nm") AS "dO_sd", stddev_samp(d_excess_nm) AS de_sd,
  {wmean('"dO_nm"', '"P"')} AS "dO_nm", {wmean('d_excess_nm', '"P"')} AS d_excess_nm, coalesce(sum("P"), 0) AS "P"
FROM attributed GROUP BY region, season"""
_MEANS_ROUNDS = ("dO_sd", "de_sd", "dO_nm", "d_excess_nm", "P")


def _directions(spark: SparkSession, d: str) -> DataFrame:
    return attribution.with_direction(_sphere(spark, d))


def _distance_share(spark: SparkSession, d: str) -> DataFrame:
    where = _directions(spark, d).select("index", "month", "distance")
    joined = tq.sites(spark, d).select("index", "P").join(where, on="index")
    return attribution.share_table(joined, "month", "distance", DISTANCE_BANDS)


# Sectors and distance bands of the two-axis classifier.
_DIRECTION = """CASE WHEN bearing_deg >= 225 AND bearing_deg < 315 THEN 'West'
  WHEN bearing_deg >= 200 AND bearing_deg < 225 THEN 'Southwest'
  WHEN bearing_deg >= 135 AND bearing_deg < 200 THEN 'South'
  WHEN bearing_deg >= 315 OR bearing_deg < 45 THEN 'North'
  WHEN bearing_deg >= 45 AND bearing_deg < 135 THEN 'East' END"""
_DISTANCE = "CASE WHEN distance_km <= 500 THEN 'Local' WHEN distance_km <= 1500 THEN 'Near' ELSE 'Far' END"


def _share_sql(source: str, group: str, label: str, levels: str) -> str:
    """Shares with all levels of the label; ``levels`` is a table expression with column ``label``."""
    return f"""SELECT {group}, {label}, "P", sum("P") OVER (PARTITION BY {group}) AS "P_tot",
  "P" / nullif(sum("P") OVER (PARTITION BY {group}), 0) AS contr
FROM (SELECT g.{group}, l.label AS {label}, coalesce(s."P", 0) AS "P"
  FROM (SELECT DISTINCT {group} FROM {source}) g CROSS JOIN ({levels}) l
  LEFT JOIN (SELECT {group}, {label}, {strict_sum('"P"')} AS "P" FROM {source} GROUP BY {group}, {label}) s
    ON s.{group} = g.{group} AND s.{label} = l.label)"""


def _values(labels: tuple[str, ...]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in labels) + ") AS v(label)"


_MONTHLY_SQL = _share_sql("origins", "month", "region", _values(REGIONS_CURRENT))
_HEIGHT_SQL = _share_sql("origins", "season", "height_i", "SELECT DISTINCT height_i AS label FROM origins")
_SHARE_ROUNDS = ("P", "P_tot", "contr")


def _stack_sql(shares: str, group: str, label: str, at: str) -> str:
    run = f"sum(contr) OVER (PARTITION BY {group} ORDER BY {at} ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {group}, {label}, "P", "P_tot", contr, {run} AS contr_upto, {run} - contr / 2 AS contr_mid
FROM ({shares})"""


def _monthly_shares(spark: SparkSession, d: str) -> DataFrame:
    return attribution.share_table(settled_origins(spark, d), "month", "region", REGIONS_CURRENT)


def _height_shares(spark: SparkSession, d: str) -> DataFrame:
    return attribution.share_table(settled_origins(spark, d), "season", "height_i")


REMOTE = ("temp_rm", "rh_rm", "rainout")


def _monthly_composite(spark: SparkSession, d: str) -> DataFrame:
    points = tq.settled_tracks(spark, d)
    remote = models.remote_means(points, -12, ["index"]).select("index", *REMOTE)
    where = located(spark, d, points).select("index", "year", "month", "season")
    joined = tq.sites(spark, d).select("index", "P", "dO", "d_excess").join(where, on="index").join(remote, on="index")
    return summaries.monthly_composite(joined, ["dO", "d_excess", *REMOTE])


_REMOTE_SQL = [("remote12", """SELECT index, CASE WHEN count(air_temp) = count(*) THEN avg(air_temp) END AS temp_rm,
  CASE WHEN count(rh) = count(*) THEN avg(rh) END AS rh_rm,
  CASE WHEN count(rainfall) = count(*) THEN sum(rainfall) END AS rainout
FROM dominant WHERE hour_along >= -12 GROUP BY index""")]
_FENCES_SQL = [("fences", f"""SELECT region, q1, med, q3, q1 - 1.5e0 * (q3 - q1) AS low, q3 + 1.5e0 * (q3 - q1) AS high
FROM (SELECT region, quantile_cont("dO", 0.25) AS q1, median("dO") AS med, quantile_cont("dO", 0.75) AS q3
  FROM origins WHERE "dO" IS NOT NULL GROUP BY region)""")]

QUERIES: dict[str, Query] = {
    "moisture_centroids": Query(
        lambda s, d: attribution.centroids(tq.dominant_uptake(s, d)),
        using("centroids", "SELECT * FROM centroids"),
        ("height_i", "lat", "lon", "uptake"),
    ),
    "centroid_place_sphere": Query(_sphere, using("centroids", _SPHERE_SQL), _PLACE_ROUNDS),
    "centroid_place_ellipsoid": Query(
        lambda s, d: attribution.locate(attribution.centroids(tq.dominant_uptake(s, d))),
        using("centroids", "SELECT * FROM located", LOCATED_SQL[:-1]),
        _PLACE_ROUNDS,
    ),
    "origin_regions": Query(
        lambda s, d: located(s, d),
        using("centroids", "SELECT * FROM regions", LOCATED_SQL),
        _PLACE_ROUNDS,
    ),
    "origin_regions_earlier": Query(
        lambda s, d: attribution.with_region(_sphere(s, d), SECTORS_EARLIER),
        using("centroids", f"SELECT *, {REGION_EARLIER} AS region FROM ({_SPHERE_SQL})"),
        _PLACE_ROUNDS,
    ),
    "origin_directions": Query(
        _directions,
        using("centroids", f"SELECT *, {_DIRECTION} AS region, {_DISTANCE} AS distance FROM ({_SPHERE_SQL})"),
        _PLACE_ROUNDS,
    ),
    "origin_near_edge": Query(
        lambda s, d: attribution.near_sector_edge(_sphere(s, d)).select("index", "height_i", "near_edge"),
        using("centroids", f"""SELECT index, height_i, least(abs(bearing_deg - 45), abs(bearing_deg - 120),
  abs(bearing_deg - 200), abs(bearing_deg - 225), abs(bearing_deg - 240), abs(bearing_deg - 315)) <= 0.13e0 AS near_edge
FROM ({_SPHERE_SQL})"""),
        ("height_i",),
    ),
    "event_attribution": Query(
        attributed,
        using(ATTRIBUTED_PARTS, "SELECT * FROM attributed", ATTRIBUTED_SQL),
        ("P", "dO", "d_excess", "temp", "rh", "gph", "fits", "residuals", "dO_nm", "d_excess_nm", "height_i",
         "distance_km", "bearing_deg"),
    ),
    "origin_share_monthly": Query(
        _monthly_shares, using(ORIGIN_PARTS, _MONTHLY_SQL, ORIGINS_SQL), _SHARE_ROUNDS
    ),
    "origin_share_percent": Query(
        lambda s, d: attribution.percent_shares(_monthly_shares(s, d)),
        using(ORIGIN_PARTS, f"SELECT *, contr * 100 AS contr_100 FROM (SELECT * REPLACE (round_even(contr, 3) AS contr) FROM ({_MONTHLY_SQL}))", ORIGINS_SQL),
        (*_SHARE_ROUNDS, "contr_100"),
    ),
    "origin_share_height": Query(
        _height_shares, using(ORIGIN_PARTS, _HEIGHT_SQL, ORIGINS_SQL), ("height_i", *_SHARE_ROUNDS)
    ),
    "origin_share_distance": Query(
        _distance_share,
        using(ORIGIN_PARTS, _share_sql("banded", "month", "distance", _values(DISTANCE_BANDS)),
              [("banded", f"""SELECT s."P", c.month, c.distance FROM selected_sites s
JOIN (SELECT *, {_DISTANCE} AS distance FROM ({_SPHERE_SQL})) c ON c.index = s.index""")]),
        _SHARE_ROUNDS,
    ),
    "origin_share_stacked": Query(
        lambda s, d: attribution.stacked_shares(_monthly_shares(s, d), "month", "region", REGIONS_CURRENT),
        using(ORIGIN_PARTS, _stack_sql(_MONTHLY_SQL, "month", "region",
              "list_position([" + ", ".join(f"'{r}'" for r in REGIONS_CURRENT) + "], region)"), ORIGINS_SQL),
        (*_SHARE_ROUNDS, "contr_upto", "contr_mid"),
    ),
    "origin_share_height_stacked": Query(
        lambda s, d: attribution.stacked_shares(_height_shares(s, d), "season", "height_i"),
        using(ORIGIN_PARTS, _stack_sql(_HEIGHT_SQL, "season", "height_i", "height_i"), ORIGINS_SQL),
        ("height_i", *_SHARE_ROUNDS, "contr_upto", "contr_mid"),
    ),
    "region_season_means": Query(
        _means, using(ATTRIBUTED_PARTS, _MEANS_SQL, ATTRIBUTED_SQL), _MEANS_ROUNDS
    ),
    "region_season_means_ordered": Query(
        lambda s, d: attribution.ordered_means(_means(s, d), SEASONS),
        using(ATTRIBUTED_PARTS, _MEANS_SQL, ATTRIBUTED_SQL), _MEANS_ROUNDS,
    ),
    "season_deviations": Query(
        lambda s, d: attribution.season_deviations(tq.site_anomalies(s, d).transform(summaries.with_season), VALUES),
        using("selected_sites composite", """SELECT season, stddev_samp("dO_nm") AS "dO_sd", stddev_samp(d_excess_nm) AS de_sd
FROM (SELECT *, CASE WHEN month IN (3, 4, 5) THEN 'Spring' WHEN month IN (6, 7, 8) THEN 'Summer'
    WHEN month IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END AS season FROM site_anomaly) GROUP BY season""",
              tq.SITE_ANOMALY_SQL),
        ("dO_sd", "de_sd"),
    ),
    "region_ranges": Query(
        lambda s, d: attribution.region_ranges(_means(s, d), list(VALUES)),
        using(ATTRIBUTED_PARTS, f"""SELECT region, min("dO_nm") AS "dO_nm_min", max("dO_nm") AS "dO_nm_max",
  min(d_excess_nm) AS d_excess_nm_min, max(d_excess_nm) AS d_excess_nm_max,
  max("dO_nm") - min("dO_nm") AS "dO_nm_range", max(d_excess_nm) - min(d_excess_nm) AS d_excess_nm_range
FROM ({_MEANS_SQL}) GROUP BY region""", ATTRIBUTED_SQL),
        ("dO_nm_min", "dO_nm_max", "d_excess_nm_min", "d_excess_nm_max", "dO_nm_range", "d_excess_nm_range"),
    ),
    "region_median_summary": Query(
        lambda s, d: summaries.median_summary(settled_origins(s, d), ["region"]),
        using(ORIGIN_PARTS, f"""SELECT region, {strict_sum('"P"')} AS precip, count(*) AS "N", median("dO") AS "dO",
  median(d_excess) AS d_excess, {iqr('"dO"')} AS "dO_iqr", {iqr('d_excess')} AS d_excess_iqr
FROM origins GROUP BY region""", ORIGINS_SQL),
        ("precip", "dO", "d_excess", "dO_iqr", "d_excess_iqr"),
    ),
    "monthly_composite": Query(
        _monthly_composite,
        using(ORIGIN_PARTS, f"""SELECT o.year, o.month, o.season, {wmean('o."dO"', 'o."P"')} AS "dO",
  {wmean('o.d_excess', 'o."P"')} AS d_excess, {wmean('r.temp_rm', 'o."P"')} AS temp_rm,
  {wmean('r.rh_rm', 'o."P"')} AS rh_rm, {wmean('r.rainout', 'o."P"')} AS rainout, coalesce(sum(o."P"), 0) AS "P"
FROM origins o JOIN remote12 r ON r.index = o.index GROUP BY ALL""", [*ORIGINS_SQL, *_REMOTE_SQL]),
        ("dO", "d_excess", "temp_rm", "rh_rm", "rainout", "P"),
    ),
    "region_box_statistics": Query(
        lambda s, d: summaries.box_statistics(settled_origins(s, d), ["region"], "dO"),
        using(ORIGIN_PARTS, """SELECT o.region, q1, med, q3, min("dO") FILTER ("dO" BETWEEN low AND high) AS whisker_low,
  max("dO") FILTER ("dO" BETWEEN low AND high) AS whisker_high,
  count(*) FILTER (NOT "dO" BETWEEN low AND high) AS outliers, count(*) AS n
FROM origins o JOIN fences f ON f.region = o.region WHERE "dO" IS NOT NULL GROUP BY ALL""", [*ORIGINS_SQL, *_FENCES_SQL]),
        ("q1", "med", "q3", "whisker_low", "whisker_high"),
    ),
    "region_box_outliers": Query(
        # the fourth power has a long tail, so that some values lie outside
        lambda s, d: summaries.box_outliers(settled_origins(s, d).select(
            "index", "height_i", "region", F.pow(F.col("dO") / 10, F.lit(4)).alias("tail")), ["region"], "tail"),
        using(ORIGIN_PARTS, """SELECT o.index, o.height_i, o.region, tail
FROM (SELECT *, pow("dO" / 10, 4) AS tail FROM origins) o JOIN (
  SELECT region, quantile_cont(pow("dO" / 10, 4), 0.25) AS q1, quantile_cont(pow("dO" / 10, 4), 0.75) AS q3
  FROM origins WHERE "dO" IS NOT NULL GROUP BY region) f ON f.region = o.region
WHERE tail < q1 - 1.5e0 * (q3 - q1) OR tail > q3 + 1.5e0 * (q3 - q1)""", ORIGINS_SQL),
        ("height_i", "tail"),
    ),
    "amount_box_outliers": Query(
        lambda s, d: summaries.box_outliers(
            tq.b.table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"),
            ["o_orderpriority"], "o_totalprice", reach=0.5,
        ),
        """SELECT o_orderkey, o.o_orderpriority, o_totalprice FROM orders o JOIN (
  SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3
  FROM orders GROUP BY o_orderpriority) f ON f.o_orderpriority = o.o_orderpriority
WHERE o_totalprice < q1 - 0.5e0 * (q3 - q1) OR o_totalprice > q3 + 0.5e0 * (q3 - q1)""",
        ("o_totalprice",),
    ),
}
