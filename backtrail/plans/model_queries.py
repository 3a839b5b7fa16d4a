"""Regressions, line fits and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.functions.scalars import count_label, fit_label, offset_label
from backtrail.operators import joins, models, moments, summaries, tracks
from backtrail.plans import attribution_queries as aq
from backtrail.plans import event_queries as ev
from backtrail.plans import track_queries as tq
from backtrail.plans.registry import Query
from backtrail.plans.sqlparts import glance as sql_glance
from backtrail.plans.sqlparts import season as sql_season
from backtrail.plans.sqlparts import sweep_operator, using

FULL = ("temp", "rh", "gph", "P")
SHORT = ("temp", "gph", "P")
_FULL_SQL = ["temp", "rh", "gph", '"P"']
_SHORT_SQL = ["temp", "gph", '"P"']
_GLANCE_ROUNDS = ("r_squared", "sigma", "AIC")


def complete_events(spark: SparkSession, d: str) -> DataFrame:
    return summaries.complete_events(ev.seasonal_events(spark, d))


_COMPLETE = [("complete", f"""SELECT *, {sql_season('date')} AS season FROM prepared
WHERE "end" IS NOT NULL AND "P" IS NOT NULL AND "dD" IS NOT NULL AND "dO" IS NOT NULL""")]


def _line_sql(by: str, methods: list[str]) -> str:
    """Line fits from sums; the ranged form uses the angle of the major axis."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    slope = {
        "OLS": "sxy / sxx",
        "MA": "tan(0.5e0 * atan2(2 * sxy, sxx - syy))",
        "SMA": "sign(sxy) * sqrt(syy / sxx)",
        "RMA": "tan(0.5e0 * atan2(2 * sxy / (rx * ry), sxx / (rx * rx) - syy / (ry * ry))) * ry / rx",
    }
    parts = " UNION ALL ".join(
        f"SELECT {key}'{m}' AS method, n, {slope[m]} AS slope, mx, my, r2 FROM m" for m in methods
    )
    return f"""SELECT {key}method, CAST(n AS BIGINT) AS n, my - slope * mx AS intercept, slope, r2 AS r_squared
FROM (WITH m AS (SELECT {key}count(*) AS n, avg("dO") AS mx, avg("dD") AS my, var_samp("dO") AS sxx,
    var_samp("dD") AS syy, covar_samp("dD", "dO") AS sxy, max("dO") - min("dO") AS rx, max("dD") - min("dD") AS ry,
    pow(corr("dD", "dO"), 2) AS r2 FROM complete {group}) {parts})"""


_LABEL = """'d²H = ' || CAST(round_even(intercept, 2) AS VARCHAR) || ' + ' || CAST(round_even(slope, 2) AS VARCHAR)
  || ' * d¹⁸O' || chr(10) || 'R² = ' || CAST(round_even(r_squared, 2) AS VARCHAR)"""


def _season_labels(spark: SparkSession, d: str) -> DataFrame:
    complete = complete_events(spark, d)
    lines = models.line_labels(models.line_fits(complete, "dD", "dO", ["season"], method="RMA"))
    places = models.label_positions(complete, ["season"], "dO", "dD")
    return joins.natural_join(places, lines.drop("n", "method"), ["season"])


def _full_fit(spark: SparkSession, d: str) -> DataFrame:
    return models.ols(ev.events_with_weather(spark, d), "dO", FULL)


def _short_fit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = ev.events_with_weather(spark, d)
    return rows, models.ols(rows, "dO", SHORT)


def _coefficients(spark: SparkSession, d: str) -> DataFrame:
    return models.tidy(_short_fit(spark, d)[1], SHORT)


def _short_fits(spark: SparkSession, d: str) -> DataFrame:
    rows, fit = _short_fit(spark, d)
    return models.augment(rows, fit, "dO", SHORT).select("index", "date", "dO", "fits", "residuals")


def _fit_text(spark: SparkSession, d: str) -> DataFrame:
    stats = models.glance(_short_fit(spark, d)[1], len(SHORT))
    return stats.select("n", fit_label(F.col("r_squared"), F.col("sigma")).alias("label"))


def _residual_sum(spark: SparkSession, d: str) -> DataFrame:
    rows, fit = _short_fit(spark, d)
    beside = models.augment(rows, fit, "dO", SHORT)
    return beside.agg(F.sum("residuals").alias("residual_sum"), F.count(F.lit(1)).alias("n"))


def _t_tail(t: str, dof: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over the angle atan(t / sqrt(dof))."""
    steps = 4000
    low = f"atan(abs({t}) / sqrt({dof}))"
    width = f"((pi() / 2 - {low}) / {steps})"
    area = f"""(SELECT sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * pow(greatest(cos({low} + i * {width}), 0), {dof} - 1)) * {width} / 3 FROM range(0, {steps + 1}) AS g(i))"""
    return f"2 * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi()) * {area}"


def _tidy_sql(terms: list[str]) -> str:
    k = len(terms)
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS term, b_{i} AS estimate, sqrt(rss / (n - {k}) * v_{i}) AS std_error, n - {k}e0 AS dof FROM fit"
        for i, t in enumerate(terms)
    )
    return f"""SELECT term, estimate, std_error, estimate / std_error AS statistic,
  {_t_tail('(estimate / std_error)', 'dof')} AS p_value FROM ({rows}) AS terms"""


def _regional(spark: SparkSession, d: str) -> DataFrame:
    fit = models.ols(aq.attributed(spark, d), "dO", tq.SITE_FIT, ["region"])
    return models.glance(fit, len(tq.SITE_FIT), ["region"])


def _by_type(spark: SparkSession, d: str) -> DataFrame:
    fit = models.ols(ev.events_with_weather(spark, d), "dO", FULL, ["type"])
    return models.glance(fit, len(FULL), ["type"])


STATE_VARIABLES = (*FULL, "dO")
FORMULAS = {"full": FULL, "reduced": SHORT, "weather": ("temp", "rh", "gph")}


def weather_states(spark: SparkSession, d: str) -> DataFrame:
    """Moments of events and weather, one state per type and day, written once in a session."""
    return ev.settled(spark, moments.moment_states(ev.events_with_weather(spark, d), STATE_VARIABLES, ["type", "date"]), "states")


def _formulas(spark: SparkSession, d: str) -> DataFrame:
    whole = moments.merged_states(weather_states(spark, d), STATE_VARIABLES)
    return moments.compare_formulas(whole, STATE_VARIABLES, "dO", FORMULAS)


def _formulas_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The full and the reduced model of each type, from the days of its states."""
    types = moments.merged_states(weather_states(spark, d), STATE_VARIABLES, ["type"])
    return moments.compare_formulas(types, STATE_VARIABLES, "dO", {"full": FULL, "reduced": SHORT}, ["type"])


def _formulas_sql(formulas: dict[str, list[str]], by: list[str]) -> str:
    parts = [part for name, xs in formulas.items() for part in sweep_operator(xs, '"dO"', by, "with_weather", f"{name}_")]
    rows = [f"SELECT *, '{name}' AS formula FROM ({sql_glance(len(xs), by).replace('FROM fit', f'FROM {name}_fit')})"
            for name, xs in formulas.items()]
    return using("with_weather", " UNION ALL ".join(rows), parts)


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    points = tq.settled_tracks(spark, d)
    where = aq.located(spark, d, points).select("index", "region")
    joined = tq.sites(spark, d).select("index", "dO").join(where, on="index")
    return models.sweep_fits(joined, points)


def _remote_regression(spark: SparkSession, d: str) -> DataFrame:
    points = tq.settled_tracks(spark, d)
    where = aq.located(spark, d, points).select("index", "region")
    remote = models.remote_means(points, -12, ["index"]).select("index", "temp_rm", "rh_rm")
    rain = models.rainout(points).select("index", "rainout")
    joined = tq.sites(spark, d).select("index", "dO").join(where, on="index").join(remote, on="index").join(rain, on="index")
    xs = ("temp_rm", "rh_rm", "rainout")
    return models.glance(models.ols(joined, "dO", xs, ["region"]), len(xs), ["region"])


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    out = models.offsets(joins.known(aq.settled_attributed(spark, d), ["dO"]), ["region"])
    return out.withColumn("label", offset_label(F.col("sigma"), F.col("median_res")))


def _track_labels(spark: SparkSession, d: str) -> DataFrame:
    counted = tracks.distinct_track_counts(tq.dominant_uptake(spark, d))
    return counted.select("month", "season", "N", count_label(F.col("N").cast("double")).alias("label"))


_REMOTE_COLUMNS = ("index", "date", "year", "month", "season")
_REMOTE_BY_WINDOW = """SELECT w AS "window", {keys},
  CASE WHEN count(air_temp) = count(*) THEN avg(air_temp) END AS temp_rm,
  CASE WHEN count(rh) = count(*) THEN avg(rh) END AS rh_rm,
  CASE WHEN count(rainfall) = count(*) THEN sum(rainfall) END AS rainout, count(*) AS "count"
FROM dominant JOIN (VALUES (-3), (-6), (-12), (-18), (-24), (-36), (-48), (-72), (-96)) AS t(w) ON hour_along >= w
GROUP BY ALL"""

QUERIES: dict[str, Query] = {
    "water_line_methods": Query(
        lambda s, d: models.line_fits(complete_events(s, d), "dD", "dO"),
        using("prepared", _line_sql("", ["OLS", "MA", "SMA", "RMA"]), _COMPLETE),
        ("intercept", "slope", "r_squared"),
    ),
    "water_line_methods_season": Query(
        lambda s, d: models.line_fits(complete_events(s, d), "dD", "dO", ["season"]),
        using("prepared", _line_sql("season", ["OLS", "MA", "SMA", "RMA"]), _COMPLETE),
        ("intercept", "slope", "r_squared"),
    ),
    "water_line_label": Query(
        lambda s, d: models.line_labels(models.line_fits(complete_events(s, d), "dD", "dO", method="RMA")),
        using("prepared", f"SELECT *, {_LABEL} AS label FROM ({_line_sql('', ['RMA'])})", _COMPLETE),
        ("intercept", "slope", "r_squared"),
    ),
    "water_line_labels_season": Query(
        _season_labels,
        using("prepared", f"""SELECT l.season, p."dO", p."dD", l.intercept, l.slope, l.r_squared, {_LABEL} AS label
FROM ({_line_sql('season', ['RMA'])}) l
JOIN (SELECT season, min("dO") * 0.6e0 AS "dO", max("dD") * 0.4e0 AS "dD" FROM complete GROUP BY season) p
  ON p.season = l.season""", _COMPLETE),
        ("dO", "dD", "intercept", "slope", "r_squared"),
    ),
    "weather_regression": Query(
        lambda s, d: models.glance(_full_fit(s, d), len(FULL)),
        using("with_weather", sql_glance(4, []), sweep_operator(_FULL_SQL, '"dO"', [], "with_weather")),
        _GLANCE_ROUNDS,
    ),
    "weather_formulas": Query(
        _formulas, _formulas_sql({"full": _FULL_SQL, "reduced": _SHORT_SQL, "weather": ["temp", "rh", "gph"]}, []), _GLANCE_ROUNDS,
    ),
    "weather_formulas_by_type": Query(
        _formulas_by_type, _formulas_sql({"full": _FULL_SQL, "reduced": _SHORT_SQL}, ["type"]), _GLANCE_ROUNDS,
    ),
    "weather_regression_reduced": Query(
        lambda s, d: models.glance(_short_fit(s, d)[1], len(SHORT)),
        using("with_weather", sql_glance(3, []), sweep_operator(_SHORT_SQL, '"dO"', [], "with_weather")),
        _GLANCE_ROUNDS,
    ),
    "weather_regression_coefficients": Query(
        _coefficients,
        using("with_weather", _tidy_sql(["(Intercept)", "temp", "gph", "P"]),
              sweep_operator(_SHORT_SQL, '"dO"', [], "with_weather")),
        ("estimate", "std_error", "statistic", "p_value"),
    ),
    "weather_regression_fits": Query(
        _short_fits,
        using("with_weather", """SELECT index, date, "dO", b_0 + b_1 * temp + b_2 * gph + b_3 * "P" AS fits,
  "dO" - (b_0 + b_1 * temp + b_2 * gph + b_3 * "P") AS residuals FROM with_weather CROSS JOIN fit""",
              sweep_operator(_SHORT_SQL, '"dO"', [], "with_weather")),
        ("dO", "fits", "residuals"),
    ),
    "weather_regression_residual_sum": Query(
        _residual_sum,
        using("with_weather", "SELECT 0e0 AS residual_sum, count(*) AS n FROM with_weather"),
        ("residual_sum",),
    ),
    "weather_regression_label": Query(
        _fit_text,
        using("with_weather", f"""SELECT n, 'R² = ' || CAST(round_even(r_squared, 2) AS VARCHAR) || chr(10) || 'RMSE = '
  || CAST(round_even(sigma, 1) AS VARCHAR) || ' ‰' AS label FROM ({sql_glance(3, [])})""",
              sweep_operator(_SHORT_SQL, '"dO"', [], "with_weather")),
    ),
    "regional_regression": Query(
        _regional,
        using(aq.ATTRIBUTED_PARTS, sql_glance(3, ["region"]), [
            *aq.ATTRIBUTED_SQL, *sweep_operator(["temp", "gph", '"P"'], '"dO"', ["region"], "attributed")]),
        _GLANCE_ROUNDS, digits=5,
    ),
    "weather_regression_by_type": Query(
        _by_type,
        using("with_weather", sql_glance(4, ["type"]), sweep_operator(_FULL_SQL, '"dO"', ["type"], "with_weather")),
        _GLANCE_ROUNDS,
    ),
    "window_sweep_means": Query(
        lambda s, d: models.remote_sweep(tq.dominant_uptake(s, d)),
        using("dominant", _REMOTE_BY_WINDOW.format(keys=", ".join(_REMOTE_COLUMNS))),
        ("temp_rm", "rh_rm", "rainout"),
    ),
    "window_sweep_regression": Query(
        _sweep,
        using(aq.ORIGIN_PARTS, sql_glance(3, ['"window"', "region"]), [
            *aq.ORIGINS_SQL, ("remote", _REMOTE_BY_WINDOW.format(keys="index")),
            ("swept", """SELECT r."window", o.region, o."dO", r.temp_rm, r.rh_rm, r.rainout
FROM origins o JOIN remote r ON r.index = o.index"""),
            *sweep_operator(["temp_rm", "rh_rm", "rainout"], '"dO"', ['"window"', "region"], "swept"),
        ]),
        _GLANCE_ROUNDS, digits=5,
    ),
    "rainout": Query(
        lambda s, d: models.rainout(tq.dominant_uptake(s, d)),
        using("dominant", """SELECT index, CASE WHEN count(rainfall) = count(*) THEN sum(rainfall) END AS rainout,
  count(*) AS "count" FROM dominant WHERE hour_along < -5 GROUP BY index"""),
        ("rainout",),
    ),
    "remote_means": Query(
        lambda s, d: models.remote_means(tq.dominant_uptake(s, d), -12).drop("rainout"),
        using("dominant", """SELECT index, date, year, month, season,
  CASE WHEN count(air_temp) = count(*) THEN avg(air_temp) END AS temp_rm,
  CASE WHEN count(rh) = count(*) THEN avg(rh) END AS rh_rm, count(*) AS "count"
FROM dominant WHERE hour_along >= -12 GROUP BY ALL"""),
        ("temp_rm", "rh_rm"),
    ),
    "remote_regression": Query(
        _remote_regression,
        using(aq.ORIGIN_PARTS, sql_glance(3, ["region"]), [
            *aq.ORIGINS_SQL,
            ("remote", """SELECT index, avg(air_temp) AS temp_rm, avg(rh) AS rh_rm
FROM dominant WHERE hour_along >= -12 GROUP BY index"""),
            ("rain", "SELECT index, sum(rainfall) AS rainout FROM dominant WHERE hour_along < -5 GROUP BY index"),
            ("remote_joined", """SELECT o.region, o."dO", r.temp_rm, r.rh_rm, n.rainout
FROM origins o JOIN remote r ON r.index = o.index JOIN rain n ON n.index = o.index"""),
            *sweep_operator(["temp_rm", "rh_rm", "rainout"], '"dO"', ["region"], "remote_joined"),
        ]),
        _GLANCE_ROUNDS, digits=5,
    ),
    "region_offsets": Query(
        _offsets,
        using(aq.ATTRIBUTED_PARTS, """SELECT region, x0, y0, median_res, sigma,
  'RMSE = ' || CAST(round_even(sigma, 2) AS VARCHAR) || ' ‰' || chr(10) || 'Offset = '
    || CAST(round_even(median_res, 2) AS VARCHAR) || ' ‰' AS label
FROM (SELECT region, median("dO") AS x0, median(fits) AS y0, (median("dO") - median(fits)) / sqrt(2) AS median_res,
    sqrt(sum(residuals * residuals) / count(*)) AS sigma FROM attributed WHERE "dO" IS NOT NULL GROUP BY region)""",
              aq.ATTRIBUTED_SQL),
        ("x0", "y0", "median_res", "sigma"),
    ),
    "region_residual_statistics": Query(
        lambda s, d: models.residual_statistics(aq.settled_attributed(s, d), ["region"]),
        using(aq.ATTRIBUTED_PARTS, """SELECT region, stddev_samp(residuals) AS residual_sd, median(residuals) AS residual_median
FROM attributed GROUP BY region""", aq.ATTRIBUTED_SQL),
        ("residual_sd", "residual_median"),
    ),
    "pearson_by_region": Query(
        lambda s, d: models.pearson(aq.attributed(s, d), "temp", "dO", ["region"]),
        using(aq.ATTRIBUTED_PARTS, f"""SELECT region, pearson_rho, pairs, "N", statistic,
  {_t_tail('statistic', '(pairs - 2e0)')} AS p_value
FROM (SELECT *, CASE WHEN pairs > 2 THEN pearson_rho * sqrt((pairs - 2) / (1 - pearson_rho * pearson_rho)) END AS statistic
  FROM (SELECT region, CASE WHEN NOT isnan(corr(temp, "dO")) THEN corr(temp, "dO") END AS pearson_rho, count(*) FILTER (temp IS NOT NULL AND "dO" IS NOT NULL) AS pairs,
      count(*) AS "N" FROM attributed GROUP BY region)) AS tested""", aq.ATTRIBUTED_SQL),
        ("pearson_rho", "statistic", "p_value"),
    ),
    "pearson_by_type": Query(
        lambda s, d: models.pearson(ev.prepared(s, d), "dD", "dO", ["type"]),
        using("prepared", f"""SELECT type, pearson_rho, pairs, "N", statistic, {_t_tail('statistic', '(pairs - 2e0)')} AS p_value
FROM (SELECT *, pearson_rho * sqrt((pairs - 2) / (1 - pearson_rho * pearson_rho)) AS statistic
  FROM (SELECT type, corr("dD", "dO") AS pearson_rho, count(*) FILTER ("dD" IS NOT NULL AND "dO" IS NOT NULL) AS pairs,
  count(*) AS "N" FROM prepared GROUP BY type)) AS tested"""),
        ("pearson_rho", "statistic", "p_value"),
    ),
    "track_count_labels": Query(
        _track_labels,
        using("dominant", """SELECT month, season, "N", 'N = ' || CAST("N" AS VARCHAR) AS label
FROM (SELECT month, season, count(DISTINCT (index, height_i)) AS "N" FROM dominant GROUP BY month, season)"""),
    ),
}
