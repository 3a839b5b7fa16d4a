"""Named sub-queries shared by the checking SQL."""

from __future__ import annotations

from backtrail.plans.bindings import TRACK_ORDER, sql_tables
from backtrail.plans.registry import with_tables

ORDER = ", ".join(TRACK_ORDER)


def prepared(source: str, excess: str = 'dD - 746e-2 * "dO" - 599e-2', at: str | None = None) -> str:
    at = at or (
        "start + INTERVAL '1' SECOND * CAST(ceil(date_diff('second', start, \"end\") / 2e0) AS BIGINT)"
    )
    return f"""SELECT *, CAST(mid AS DATE) AS date, CAST(hour(mid) AS INT) AS time,
  CAST(year(mid) AS INT) AS year, CAST(month(mid) AS INT) AS month,
  CAST(ceil(date_diff('second', start, "end") / 36e2) AS BIGINT) AS duration
FROM (SELECT *, {excess} AS d_excess, {at} AS mid FROM {source} WHERE start IS NOT NULL)"""


def season(date: str) -> str:
    return (
        f"CASE WHEN month({date}) IN (3, 4, 5) THEN 'Spring' WHEN month({date}) IN (6, 7, 8) THEN 'Summer'"
        f" WHEN month({date}) IN (9, 10, 11) THEN 'Autumn' ELSE 'Winter' END"
    )


def wmean(x: str, w: str) -> str:
    return (
        f"CASE WHEN count(*) FILTER ({x} IS NOT NULL AND {w} IS NULL) = 0"
        f" THEN sum({x} * {w}) / nullif(sum({w}) FILTER ({x} IS NOT NULL), 0) END"
    )


def strict_sum(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN sum({x}) END"


def iqr(x: str) -> str:
    return f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"


def uptake(source: str, key: str, height: str, order: str, keep: str) -> dict[str, str]:
    """Stages of the uptake calculation; ``keep`` is the test on whole tracks."""
    track = f"PARTITION BY {key}, {height}"
    return {
        "up_len": f"SELECT *, min({order.split(',')[0]}) OVER ({track}) AS traj_end,"
                  f" count(*) OVER ({track}) AS n_points FROM {source}",
        "up_step": f"SELECT *, sp_humidity - lag(sp_humidity) OVER ({track} ORDER BY {order}) AS delta_q"
                   f" FROM up_len WHERE {keep}",
        "up_roll": f"""SELECT *,
  CASE WHEN count(*) OVER six = 6 THEN coalesce(sum(delta_q) OVER six, 0) END AS delta_q6d,
  coalesce(sum(CASE WHEN delta_q > 0 THEN delta_q END) OVER ({track} ORDER BY {order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS tot_uptake
FROM up_step WINDOW six AS ({track} ORDER BY {order} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
        "tracks_up": """SELECT *, CASE WHEN delta_q6d >= 0.5 THEN 1 WHEN delta_q6d < 0.5 THEN 0 END AS uptake,
  CASE WHEN delta_q > 0 THEN delta_q / tot_uptake WHEN delta_q <= 0 THEN 0e0 END AS prop_uptake
FROM up_roll""",
        "dominant": f"""SELECT * EXCLUDE (most) FROM (
  SELECT *, max(tot_uptake) OVER (PARTITION BY {key}) AS most FROM tracks_up) WHERE tot_uptake = most""",
    }


def haversine(lat: str, lon: str, lat0: str, lon0: str) -> str:
    return (
        f"2 * 6378.137 * asin(least(1, sqrt(pow(sin(radians({lat} - {lat0}) / 2), 2)"
        f" + cos(radians({lat})) * cos(radians({lat0})) * pow(sin(radians({lon} - {lon0}) / 2), 2))))"
    )


def sphere_bearing(lat: str, lon: str, lat0: str, lon0: str) -> str:
    y = f"sin(radians({lon} - {lon0})) * cos(radians({lat}))"
    x = (
        f"cos(radians({lat0})) * sin(radians({lat}))"
        f" - sin(radians({lat0})) * cos(radians({lat})) * cos(radians({lon} - {lon0}))"
    )
    return f"(degrees(atan2({y}, {x})) + 360) % 360"


def ellipsoid_bearing(source: str, lat0: float, lon0: float, steps: int = 20) -> list[tuple[str, str]]:
    """Inverse geodesic by repeated sub-queries, one per step; the result table is ``located``."""
    f = "(1 / 298.257223563e0)"
    out = [("eb0", f"""SELECT *, atan((1 - {f}) * tan(radians({lat0}e0))) AS u1,
  atan((1 - {f}) * tan(radians(lat))) AS u2, radians(lon - {lon0}e0) AS lam0,
  radians(lon - {lon0}e0) AS lam FROM {source}""")]
    for i in range(steps):
        out.append((f"eb{i + 1}", f"""SELECT * EXCLUDE (lam, y, x, cs, sa, ca2, cm, cc, sg),
  lam0 + (1 - cc) * {f} * sa * (sg + cc * sin(sg) * (cm + cc * cs * (2 * cm * cm - 1))) AS lam
FROM (SELECT *, {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS cc,
    coalesce(cs - 2 * sin(u1) * sin(u2) / nullif(ca2, 0), 0) AS cm
  FROM (SELECT *, 1 - sa * sa AS ca2
    FROM (SELECT *, atan2(sqrt(y * y + x * x), cs) AS sg,
        coalesce(cos(u1) * y / nullif(sqrt(y * y + x * x), 0), 0) AS sa
      FROM (SELECT *, cos(u2) * sin(lam) AS y,
          cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam) AS x,
          sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM eb{i}))))"""))
    out.append(("located", f"""SELECT * EXCLUDE (u1, u2, lam0, lam),
  {haversine('lat', 'lon', f'{lat0}e0', f'{lon0}e0')} AS distance_km,
  (degrees(atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))) + 360) % 360
    AS bearing_deg FROM eb{steps}"""))
    return out


# Sector limits and labels of the two region classifiers, as the checking SQL states them.
REGION_CURRENT = """CASE WHEN distance_km <= 500 THEN 'Local (<= 500 km)'
  WHEN distance_km <= 1500 AND bearing_deg >= 225 AND bearing_deg < 315 THEN 'West'
  WHEN distance_km <= 1500 AND bearing_deg >= 200 AND bearing_deg < 240 THEN 'Southwest'
  WHEN distance_km <= 1500 AND bearing_deg >= 120 AND bearing_deg < 200 THEN 'Southeast'
  WHEN distance_km <= 1500 AND (bearing_deg >= 315 OR bearing_deg < 45) THEN 'North'
  WHEN distance_km <= 1500 AND bearing_deg >= 45 AND bearing_deg < 120 THEN 'East'
  WHEN distance_km > 1500 AND bearing_deg >= 240 AND bearing_deg < 315 THEN 'Atlantic (> 1500 km)'
  WHEN distance_km > 1500 THEN 'Other (> 1500 km)' END"""

REGION_EARLIER = """CASE WHEN distance_km <= 500 THEN 'Local (<= 500 km)'
  WHEN distance_km <= 1500 AND bearing_deg >= 225 AND bearing_deg < 315 THEN 'West'
  WHEN distance_km <= 1500 AND bearing_deg >= 200 AND bearing_deg < 225 THEN 'Southwest'
  WHEN distance_km <= 1500 AND bearing_deg >= 135 AND bearing_deg < 200 THEN 'South'
  WHEN distance_km <= 1500 AND (bearing_deg >= 315 OR bearing_deg < 45) THEN 'North'
  WHEN distance_km <= 1500 AND bearing_deg >= 45 AND bearing_deg < 135 THEN 'East'
  WHEN distance_km > 1500 AND bearing_deg >= 225 AND bearing_deg < 315 THEN 'West (> 1500 km)'
  WHEN distance_km > 1500 THEN 'Other (> 1500 km)' END"""


def sweep_operator(xs: list[str], y: str, by: list[str], source: str, prefix: str = "") -> list[tuple[str, str]]:
    """Normal equations solved by sweeping the moment matrix, one sub-query per predictor.

    The result table ``fit`` (after ``prefix``) has one row per group with n, the means, the swept
    matrix ``c_i_j`` and its residual corner; groups with too few rows are NULL.
    """
    names = [*xs, y]
    k = len(xs)
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in names)
    moments = ", ".join(
        f"covar_pop({names[i]}, {names[j]}) AS c_{i}_{j}" for i, j in pairs
    ) + ", " + ", ".join(f"avg({c}) AS m_{i}" for i, c in enumerate(names))
    means = ", ".join(f"m_{i}" for i in range(k + 1))
    out = [(f"{prefix}sw0", f"SELECT {keys}count(*) AS n, {moments}, var_pop({y}) AS vy FROM {source} WHERE {complete}{group}")]

    def at(i: int, j: int) -> str:
        return f"c_{min(i, j)}_{max(i, j)}"

    for p in range(k):
        pivot = f"nullif(c_{p}_{p}, 0)"
        cells = []
        for i, j in pairs:
            if i == p and j == p:
                value = f"-1 / {pivot}"
            elif p in (i, j):
                value = f"{at(i, j)} / {pivot}"
            else:
                value = f"{at(i, j)} - {at(i, p)} * {at(p, j)} / {pivot}"
            cells.append(f"{value} AS c_{i}_{j}")
        out.append((f"{prefix}sw{p + 1}", f"SELECT {keys}n, {means}, vy, {', '.join(cells)} FROM {prefix}sw{p}"))
    slopes = [f"CASE WHEN n > {k + 1} THEN c_{i}_{k} END AS b_{i + 1}" for i in range(k)]
    intercept = f"CASE WHEN n > {k + 1} THEN m_{k} - " + " - ".join(f"c_{i}_{k} * m_{i}" for i in range(k)) + " END AS b_0"
    inverse = ", ".join(f"-c_{i}_{i} / n AS v_{i + 1}" for i in range(k))
    at_zero = " + ".join(f"m_{i} * m_{j} * -{at(i, j)}" for i in range(k) for j in range(k))
    out.append((f"{prefix}fit", f"""SELECT {keys}CAST(n AS BIGINT) AS n, {intercept}, {', '.join(slopes)}, {inverse},
  (1 + {at_zero}) / n AS v_0, CASE WHEN n > {k + 1} THEN n * c_{k}_{k} END AS rss, n * vy AS tss FROM {prefix}sw{k}"""))
    return out


def glance(k: int, by: list[str]) -> str:
    keys = "".join(f'{b}, ' for b in by)
    return f"""SELECT {keys}n, 1 - rss / nullif(tss, 0) AS r_squared, sqrt(rss / (n - {k + 1})) AS sigma,
  n * (ln(2 * pi()) + 1) + n * ln(CASE WHEN rss > 0 THEN rss END / n) + 2e0 * {k + 2} AS "AIC" FROM fit"""


_SITE_EVENTS = prepared("raw_sites")

PARTS: dict[str, str] = sql_tables() | {
    "prepared": prepared("raw_events"),
    "prepared_global": prepared("raw_events", 'dD - 8 * "dO"', "start"),
    "revised_global": prepared("raw_revised", 'dD - 8 * "dO"'),
    "selected": "SELECT * FROM prepared WHERE P > 1 AND duration <= 24",
    "sites": _SITE_EVENTS,
    "selected_sites": "SELECT * FROM sites WHERE P > 1 AND duration <= 24",
    "tracks": f"""SELECT *, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  {season('date')} AS season FROM (SELECT *, CAST(traj_dt_i AS DATE) AS date FROM track_points)""",
    **uptake("tracks", "index", "height_i", ORDER, "traj_end <= -24"),
    "composite_day": f"""SELECT date, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year,
  {wmean('"dO"', '"P"')} AS "dO", {wmean('d_excess', '"P"')} AS d_excess, coalesce(sum(P), 0) AS "P"
FROM selected GROUP BY date""",
    "all_days": """SELECT g.day AS date, c.month, c.year, c."dO", c.d_excess, c."P"
FROM (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL '1' DAY)) AS DATE) AS day
  FROM composite_day) g LEFT JOIN composite_day c ON c.date = g.day""",
    "composite": """SELECT date, month, year, "dO", d_excess, "P", "P_rm",
  s_do / nullif("P_rm", 0) AS "dO_rm", s_de / nullif("P_rm", 0) AS d_excess_rm
FROM (SELECT *, CASE WHEN count(*) OVER w = 30 THEN coalesce(sum("P") OVER w, 0) END AS "P_rm",
    CASE WHEN count(*) OVER w = 30 THEN coalesce(sum("dO" * "P") OVER w, 0) END AS s_do,
    CASE WHEN count(*) OVER w = 30 THEN coalesce(sum(d_excess * "P") OVER w, 0) END AS s_de
  FROM all_days WINDOW w AS (ORDER BY date ROWS BETWEEN 14 PRECEDING AND 15 FOLLOWING))""",
    "smooth": """SELECT date, time,
  CASE WHEN count(*) OVER w = 5 THEN avg(temp) OVER w END AS temp,
  CASE WHEN count(*) OVER w = 5 THEN avg(rh) OVER w END AS rh,
  CASE WHEN count(*) OVER w = 5 THEN avg(gph) OVER w END AS gph
FROM weather WINDOW w AS (ORDER BY date, time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "with_weather": """SELECT e.index, e.type, e."P", e."dD", e."dO", e.d_excess, e.date, e.time, e.year, e.month,
  s.temp, s.rh, s.gph FROM selected e JOIN smooth s ON s.date = e.date AND s.time = e.time
WHERE e."end" IS NOT NULL AND e."P" IS NOT NULL AND e."dD" IS NOT NULL AND e."dO" IS NOT NULL
  AND s.temp IS NOT NULL AND s.rh IS NOT NULL AND s.gph IS NOT NULL""",
    "centroids": """SELECT index, date, year, month, season, height_i,
  sum(lat * delta_q) / sum(delta_q) AS lat, sum(lon * delta_q) / sum(delta_q) AS lon,
  sum(delta_q) AS uptake, count(*) AS "count"
FROM dominant WHERE delta_q > 0 GROUP BY ALL""",
}

DEPENDS: dict[str, tuple[str, ...]] = {
    "weather": (), "weather_station": (),
    "prepared": ("raw_events",), "prepared_global": ("raw_events",), "revised_global": ("raw_revised",),
    "selected": ("prepared",), "sites": ("raw_sites",), "selected_sites": ("sites",),
    "tracks": ("track_points",), "up_len": ("tracks",), "up_step": ("up_len",), "up_roll": ("up_step",),
    "tracks_up": ("up_roll",), "dominant": ("tracks_up",),
    "composite_day": ("selected",), "all_days": ("composite_day",), "composite": ("all_days",),
    "smooth": ("weather",), "with_weather": ("selected", "smooth"), "centroids": ("dominant",),
}


def using(names: str, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``body`` preceded by the named tables, what they depend on, and extra tables."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for other in DEPENDS.get(name, ()):
            visit(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        visit(name)
    return with_tables([(n, PARTS[n]) for n in wanted] + list(extra or []), body)
