"""Event preparation, summaries and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.functions.scalars import MONTH_NAMES, SEASONS, month_name, ordinal, season
from backtrail.functions.semantics import flag
from backtrail.operators import joins, series, summaries
from backtrail.operators.order import numbered
from backtrail.plans import bindings as b
from backtrail.plans.registry import Query
from backtrail.plans.sqlparts import iqr, strict_sum, using, wmean
from backtrail.plans.sqlparts import season as sql_season
from backtrail.sources import stages


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return summaries.prepare_events(b.events(spark, d))


def selected(spark: SparkSession, d: str) -> DataFrame:
    return summaries.select_events(prepared(spark, d))


def composite_days(spark: SparkSession, d: str) -> DataFrame:
    return series.daily_composite(selected(spark, d))


def settled(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """A stage that several steps and queries read, written once in a session."""
    return stages.settled(df, label)


def composite(spark: SparkSession, d: str) -> DataFrame:
    """Every day with its composite; the days are read for their span, for the calendar and for the sums."""
    return series.rolling_composite(every_day(spark, d))


def every_day(spark: SparkSession, d: str) -> DataFrame:
    days = settled(spark, composite_days(spark, d), "days")
    return settled(spark, series.complete_days(days), "every-day")


def _four_weeks() -> Column:
    """Slices of at most 672 hours of one series."""
    return F.floor(F.unix_date("date") / 28)


def smooth_weather(spark: SparkSession, d: str) -> DataFrame:
    hours = settled(spark, b.weather(spark, d), "hours")  # read by the slices and by their edges
    return series.rolling_means(
        hours, [], ["date", "time"], ["temp", "rh", "gph"], slice_by=_four_weeks())


WEATHER_COLUMNS = (
    "index", "type", "P", "dD", "dO", "d_excess", "date", "time", "year", "month", "temp", "rh", "gph",
)


def events_with_weather(spark: SparkSession, d: str) -> DataFrame:
    joined = series.with_weather(selected(spark, d), smooth_weather(spark, d))
    return summaries.complete_events(joined, ["temp", "rh", "gph"]).select(*WEATHER_COLUMNS)


def seasonal_events(spark: SparkSession, d: str) -> DataFrame:
    return summaries.with_season(prepared(spark, d))


def _prepared_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "index", "type", "P", "dD", "dO", "d_excess", "date", "time", "year", "month", "duration"
    )


_PREPARED = 'index, type, "P", "dD", "dO", d_excess, date, time, year, month, duration'
_WEIGHTED = f"""stddev_samp("dO") AS "dO_sd", stddev_samp(d_excess) AS d_excess_sd,
  {wmean('"dO"', '"P"')} AS "dO", {wmean('d_excess', '"P"')} AS d_excess,
  {strict_sum('"P"')} AS precip, count(*) AS "N", {iqr('"dO"')} AS "dO_iqr", {iqr('d_excess')} AS d_excess_iqr"""
_MEDIAN = f"""{strict_sum('"P"')} AS precip, count(*) AS "N",
  median("dO") AS "dO", median(d_excess) AS d_excess, {iqr('"dO"')} AS "dO_iqr", {iqr('d_excess')} AS d_excess_iqr"""
_WEIGHTED_ROUNDS = ("dO_sd", "d_excess_sd", "dO", "d_excess", "precip", "dO_iqr", "d_excess_iqr")
_MEDIAN_ROUNDS = ("precip", "dO", "d_excess", "dO_iqr", "d_excess_iqr")
_COMPOSITE_ROUNDS = ("dO", "d_excess", "P", "P_rm", "dO_rm", "d_excess_rm")


def _point_classes(spark: SparkSession, d: str) -> DataFrame:
    classed = prepared(spark, d).withColumn("heavy", flag(F.col("P") >= 1.0))
    return classed.where(F.col("P") > 0).select("index", "dO", "dD", "heavy")


def _calendar_labels(spark: SparkSession, d: str) -> DataFrame:
    df = prepared(spark, d).select("index", "date", season(F.col("date")).alias("season"))
    df = df.withColumn("month_name", month_name(F.col("date")))
    for column, levels, out in (("season", SEASONS, "season_at"), ("month_name", MONTH_NAMES, "month_at")):
        df = joins.with_ordinal(df, column, joins.label_table(df, column, levels), out)
    return df.select("index", "date", "season", "month_name", "season_at", "month_at")


def _season_totals(spark: SparkSession, d: str) -> DataFrame:
    sums = seasonal_events(spark, d).groupBy("season", "type").agg(F.sum("P").alias("P"))
    at = ordinal(F.col("season"), SEASONS)
    return numbered(sums, [at.asc_nulls_first(), F.desc_nulls_last("P")], "position").withColumn(
        "position", F.col("position").cast("int"))


def _all_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its place by season and, within it, falling amount."""
    events = seasonal_events(spark, d).select("index", "season", "P")
    order = [ordinal(F.col("season"), SEASONS).asc_nulls_first(), F.desc_nulls_last("P"), "index"]
    return numbered(events, order, "place", total="events")


def _event_anomalies(spark: SparkSession, d: str) -> DataFrame:
    out = series.anomalies(selected(spark, d), composite(spark, d))
    return out.select("index", "date", "P", "dO", "d_excess", "dO_rm", "d_excess_rm", "dO_nm", "d_excess_nm")


def _unsmoothed(spark: SparkSession, d: str) -> DataFrame:
    moments = selected(spark, d).select("index", "date", "time")
    joined = series.with_weather(moments, b.weather(spark, d))
    return joined.select("index", "temp", "rh", "gph")


def _series_composite(spark: SparkSession, d: str) -> DataFrame:
    return series.daily_composite(selected(spark, d), series=["type"])


def _weather_by_station(spark: SparkSession, d: str) -> DataFrame:
    return series.rolling_means(
        b.weather(spark, d, by_station=True), ["station"], ["date", "time"], ["temp", "rh", "gph"], slice_by=_four_weeks()
    )


_ROLL = "ROWS BETWEEN 14 PRECEDING AND 15 FOLLOWING"

QUERIES: dict[str, Query] = {
    "event_preparation": Query(
        lambda s, d: _prepared_columns(prepared(s, d)),
        using("prepared", f"SELECT {_PREPARED} FROM prepared"),
        ("P", "dD", "dO", "d_excess"),
    ),
    "event_preparation_global_line": Query(
        lambda s, d: _prepared_columns(
            summaries.prepare_events(b.events(s, d), excess="global", moment="start")
        ),
        using("prepared_global", f"SELECT {_PREPARED} FROM prepared_global"),
        ("P", "dD", "dO", "d_excess"),
    ),
    "event_selection": Query(
        lambda s, d: _prepared_columns(selected(s, d)),
        using("selected", f"SELECT {_PREPARED} FROM selected"),
        ("P", "dD", "dO", "d_excess"),
    ),
    "event_complete_rows": Query(
        lambda s, d: _prepared_columns(summaries.complete_events(prepared(s, d))),
        using("prepared", f"""SELECT {_PREPARED} FROM prepared WHERE "end" IS NOT NULL AND "P" IS NOT NULL
  AND "dD" IS NOT NULL AND "dO" IS NOT NULL"""),
        ("P", "dD", "dO", "d_excess"),
    ),
    "event_point_classes": Query(
        _point_classes,
        using("prepared", """SELECT index, "dO", "dD", CASE WHEN "P" >= 1 THEN 1 ELSE 0 END AS heavy
FROM prepared WHERE "P" > 0"""),
        ("dO", "dD"),
    ),
    "event_calendar_labels": Query(
        _calendar_labels,
        using("prepared", f"""SELECT index, date, season, month_name,
  CAST(nullif(list_position(['Winter', 'Spring', 'Summer', 'Autumn'], season), 0) AS INT) AS season_at,
  CAST(nullif(list_position(['Dec', 'Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov'],
    month_name), 0) AS INT) AS month_at
FROM (SELECT index, date, {sql_season('date')} AS season, strftime(date, '%b') AS month_name FROM prepared)"""),
    ),
    "event_threshold_summary": Query(
        lambda s, d: summaries.threshold_summary(prepared(s, d)),
        using("prepared", f"""SELECT threshold, stddev_samp("dO") AS "dO_sd", stddev_samp(d_excess) AS d_excess_sd,
  {_MEDIAN} FROM prepared JOIN (VALUES (0e0), (1e0), (2.5e0), (10e0)) AS t(threshold) ON "P" > threshold
WHERE duration <= 24 GROUP BY threshold"""),
        ("threshold", *_WEIGHTED_ROUNDS),
    ),
    "event_weighted_summary": Query(
        lambda s, d: summaries.weighted_summary(prepared(s, d).where(F.col("P") > 0)),
        using("prepared", f'SELECT {_WEIGHTED} FROM prepared WHERE "P" > 0'),
        _WEIGHTED_ROUNDS,
    ),
    "event_weighted_summary_season": Query(
        lambda s, d: summaries.weighted_summary(seasonal_events(s, d), ["season"]),
        using("prepared", f"""SELECT season, {_WEIGHTED}
FROM (SELECT *, {sql_season('date')} AS season FROM prepared) GROUP BY season"""),
        _WEIGHTED_ROUNDS,
    ),
    "event_median_summary": Query(
        lambda s, d: summaries.median_summary(selected(s, d)),
        using("selected", f"SELECT {_MEDIAN} FROM selected"),
        _MEDIAN_ROUNDS,
    ),
    "event_median_summary_group": Query(
        lambda s, d: summaries.median_summary(prepared(s, d), ["type"]),
        using("prepared", f"SELECT type, {_MEDIAN} FROM prepared GROUP BY type"),
        _MEDIAN_ROUNDS,
    ),
    "event_monthly_summary": Query(
        lambda s, d: summaries.monthly_summary(prepared(s, d)),
        using("prepared", f"SELECT year, month, {_WEIGHTED} FROM prepared GROUP BY year, month"),
        _WEIGHTED_ROUNDS,
    ),
    "event_mean_monthly_deviation": Query(
        lambda s, d: summaries.mean_monthly_deviation(summaries.monthly_summary(prepared(s, d))),
        using("prepared", """SELECT avg(a) AS "dO_sd", avg(b) AS d_excess_sd, count(*) AS "N"
FROM (SELECT stddev_samp("dO") AS a, stddev_samp(d_excess) AS b FROM prepared GROUP BY year, month)"""),
        ("dO_sd", "d_excess_sd"),
    ),
    "event_first_rows": Query(
        lambda s, d: _prepared_columns(selected(s, d)).orderBy("index").limit(5),
        using("selected", f"SELECT {_PREPARED} FROM selected ORDER BY index LIMIT 5"),
        ("P", "dD", "dO", "d_excess"),
    ),
    "event_season_order": Query(
        _season_totals,
        using("prepared", f"""SELECT season, type, "P", CAST(row_number() OVER (ORDER BY
  CASE season WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 2 WHEN 'Summer' THEN 3 WHEN 'Autumn' THEN 4 END NULLS FIRST, "P" DESC NULLS LAST) AS INT) AS position
FROM (SELECT season, type, sum("P") AS "P"
  FROM (SELECT *, {sql_season('date')} AS season FROM prepared) GROUP BY season, type)"""),
        ("P",),
    ),
    "daily_composite": Query(
        composite_days,
        using("composite_day", "SELECT * FROM composite_day"),
        ("dO", "d_excess", "P"), digits=8,
    ),
    "daily_composite_by_series": Query(
        lambda s, d: series.complete_days(_series_composite(s, d), ["type"]),
        using("selected", """SELECT g.type, g.day AS date, c.month, c.year, c."dO", c.d_excess, c."P"
FROM (SELECT type, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP),
    INTERVAL '1' DAY)) AS DATE) AS day FROM per_day GROUP BY type) g
LEFT JOIN per_day c ON c.date = g.day AND c.type = g.type""",
              [("per_day", f"""SELECT type, date, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year,
  {wmean('"dO"', '"P"')} AS "dO", {wmean('d_excess', '"P"')} AS d_excess, coalesce(sum("P"), 0) AS "P"
FROM selected GROUP BY type, date""")]),
        ("dO", "d_excess", "P"), digits=8,
    ),
    "calendar_completion": Query(
        lambda s, d: series.complete_days(composite_days(s, d)),
        using("all_days", "SELECT * FROM all_days"),
        ("dO", "d_excess", "P"), digits=8,
    ),
    "rolling_composite": Query(
        composite,
        using("composite", "SELECT * FROM composite"),
        _COMPOSITE_ROUNDS, digits=8,
    ),
    "rolling_composite_year": Query(
        lambda s, d: series.rolling_composite(every_day(s, d), width=365),
        using("all_days", """SELECT date, month, year, "dO", d_excess, "P", "P_rm",
  s_do / nullif("P_rm", 0) AS "dO_rm", s_de / nullif("P_rm", 0) AS d_excess_rm
FROM (SELECT *, CASE WHEN count(*) OVER w = 365 THEN coalesce(sum("P") OVER w, 0) END AS "P_rm",
    CASE WHEN count(*) OVER w = 365 THEN coalesce(sum("dO" * "P") OVER w, 0) END AS s_do,
    CASE WHEN count(*) OVER w = 365 THEN coalesce(sum(d_excess * "P") OVER w, 0) END AS s_de
  FROM all_days WINDOW w AS (ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING))"""),
        _COMPOSITE_ROUNDS, digits=8,
    ),
    "composite_anomalies": Query(
        lambda s, d: series.own_anomalies(composite(s, d)),
        using("composite", """SELECT *, "dO" - "dO_rm" AS "dO_nm", d_excess - d_excess_rm AS d_excess_nm FROM composite"""),
        (*_COMPOSITE_ROUNDS, "dO_nm", "d_excess_nm"), digits=8,
    ),
    "event_global_order": Query(
        _all_in_order,
        using("prepared", f"""SELECT index, season, "P", row_number() OVER (ORDER BY
  CASE season WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 2 WHEN 'Summer' THEN 3 WHEN 'Autumn' THEN 4 END NULLS FIRST,
  "P" DESC NULLS LAST, index) AS place, count(*) OVER () AS events
FROM (SELECT *, {sql_season('date')} AS season FROM prepared)"""),
        ("P",),
    ),
    "rolling_composite_scattered": Query(
        lambda s, d: series.scatter_composite(composite_days(s, d)),
        using("composite", "SELECT * FROM composite"),
        _COMPOSITE_ROUNDS, digits=8,
    ),
    "rolling_composite_by_series": Query(
        lambda s, d: series.scatter_composite(_series_composite(s, d), ["type"]),
        using("selected", f"""SELECT type, date, month, year, "dO", d_excess, "P", "P_rm",
  s_do / nullif("P_rm", 0) AS "dO_rm", s_de / nullif("P_rm", 0) AS d_excess_rm
FROM (SELECT *, CASE WHEN count(*) OVER w = 30 THEN coalesce(sum("P") OVER w, 0) END AS "P_rm",
    CASE WHEN count(*) OVER w = 30 THEN coalesce(sum("dO" * "P") OVER w, 0) END AS s_do,
    CASE WHEN count(*) OVER w = 30 THEN coalesce(sum(d_excess * "P") OVER w, 0) END AS s_de
  FROM every WINDOW w AS (PARTITION BY type ORDER BY date {_ROLL}))""",
              [("per_day", f"""SELECT type, date, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year,
  {wmean('"dO"', '"P"')} AS "dO", {wmean('d_excess', '"P"')} AS d_excess, coalesce(sum("P"), 0) AS "P"
FROM selected GROUP BY type, date"""),
               ("every", """SELECT g.type, g.day AS date, c.month, c.year, c."dO", c.d_excess, c."P"
FROM (SELECT type, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP),
    INTERVAL '1' DAY)) AS DATE) AS day FROM per_day GROUP BY type) g
LEFT JOIN per_day c ON c.date = g.day AND c.type = g.type""")]),
        _COMPOSITE_ROUNDS, digits=8,
    ),
    "event_anomalies": Query(
        _event_anomalies,
        using("composite", """SELECT e.index, e.date, e."P", e."dO", e.d_excess, c."dO_rm", c.d_excess_rm,
  e."dO" - c."dO_rm" AS "dO_nm", e.d_excess - c.d_excess_rm AS d_excess_nm
FROM selected e JOIN composite c ON c.date = e.date
WHERE c."dO" IS NOT NULL AND c.d_excess IS NOT NULL AND c."dO_rm" IS NOT NULL AND c.d_excess_rm IS NOT NULL"""),
        ("P", "dO", "d_excess", "dO_rm", "d_excess_rm", "dO_nm", "d_excess_nm"), digits=8,
    ),
    "daily_weather_statistics": Query(
        lambda s, d: summaries.daily_statistics(b.weather_lines(s, d), "1998-12-31"),
        using("weather_lines", """SELECT date, stddev_samp(temp) AS temp_sd, stddev_samp(rh) AS rh_sd,
  stddev_samp(gph) AS gph_sd, median(temp) AS temp, median(rh) AS rh, median(gph) AS gph
FROM weather_lines WHERE date > DATE '1998-12-31' GROUP BY date"""),
        ("temp_sd", "rh_sd", "gph_sd", "temp", "rh", "gph"),
    ),
    "weather_smoothing": Query(
        smooth_weather,
        using("smooth", "SELECT * FROM smooth"),
        ("temp", "rh", "gph"),
    ),
    "weather_smoothing_by_station": Query(
        _weather_by_station,
        using("weather_station", """SELECT station, date, time,
  CASE WHEN count(*) OVER w = 5 THEN avg(temp) OVER w END AS temp,
  CASE WHEN count(*) OVER w = 5 THEN avg(rh) OVER w END AS rh,
  CASE WHEN count(*) OVER w = 5 THEN avg(gph) OVER w END AS gph
FROM weather_station WINDOW w AS (PARTITION BY station ORDER BY date, time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""),
        ("temp", "rh", "gph"),
    ),
    "weather_event_join": Query(
        events_with_weather,
        using("with_weather", "SELECT * FROM with_weather"),
        ("P", "dD", "dO", "d_excess", "temp", "rh", "gph"),
    ),
    "weather_event_join_unsmoothed": Query(
        _unsmoothed,
        using("selected weather", """SELECT e.index, w.temp, w.rh, w.gph
FROM selected e JOIN weather w ON w.date = e.date AND w.time = e.time"""),
        ("temp", "rh", "gph"),
    ),
}
