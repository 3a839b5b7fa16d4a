"""Regression, line fits and correlation from grouped moments.

Each group is reduced to counts, means and centred products by one ordinary
aggregation; partial results merge, so the size of a group does not matter.
Only the reduced rows (one per group) are solved, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.functions.scalars import line_label
from backtrail.functions.semantics import rms, rows, safe_div, strict_sum
from backtrail.functions.student import t_p_value
from backtrail.operators.joins import explode_windows
from backtrail.operators.quantiles import summarise
from backtrail.operators.skew import null_safe_join

# Windows of the sweep (hours along the track) and the hour before which rain counts
# as rained out.
SWEEP_WINDOWS = (-3, -6, -12, -18, -24, -36, -48, -72, -96)
RAINOUT_BEFORE = -5

_SINGULAR = 1e-11


def _moments(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    names = [*xs, y]
    complete = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).na.drop(subset=names)
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    products = [
        F.var_pop(names[i]) if i == j else F.covar_pop(names[i], names[j]) for i, j in pairs
    ]
    return complete.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("__mean"),
        F.array(*products).alias("__cov"),
    ).where(F.col("n") > 0)


def _solver(k: int):
    """Solve all groups of a batch at once; groups without a unique fit get NULL."""
    pairs = list(combinations_with_replacement(range(k + 1), 2))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            mean = np.array(batch.column("__mean").to_pylist(), dtype=float)
            flat = np.array(batch.column("__cov").to_pylist(), dtype=float)
            cov = np.zeros((len(n), k + 1, k + 1))
            for at, (i, j) in enumerate(pairs):
                cov[:, i, j] = cov[:, j, i] = flat[:, at]
            sxx, sxy, syy = cov[:, :k, :k], cov[:, :k, k], cov[:, k, k]
            scale = np.sqrt(np.einsum("gii->gi", sxx))
            ok = (n > k + 1) & (scale > 0).all(axis=1)
            unit = np.where(scale > 0, scale, 1.0)
            corr = sxx / (unit[:, :, None] * unit[:, None, :])
            corr[~ok] = np.eye(k)
            ok &= np.linalg.eigvalsh(corr)[:, 0] > _SINGULAR
            corr[~ok] = np.eye(k)
            inverse = np.linalg.inv(corr) / (unit[:, :, None] * unit[:, None, :])
            slopes = np.einsum("gij,gj->gi", inverse, sxy)
            intercept = mean[:, k] - np.einsum("gi,gi->g", slopes, mean[:, :k])
            left = sxx @ slopes[:, :, None]
            explained = 2 * np.einsum("gi,gi->g", slopes, sxy) - np.einsum("gi,gi->g", slopes, left[:, :, 0])
            rss = n * np.maximum(syy - explained, 0.0)
            centre = mean[:, :k]
            at_zero = 1.0 + np.einsum("gi,gij,gj->g", centre, inverse, centre)
            spread = np.concatenate([at_zero[:, None], np.einsum("gii->gi", inverse)], axis=1)
            spread = spread / np.maximum(n, 1.0)[:, None]
            coef = np.concatenate([intercept[:, None], slopes], axis=1)

            def listed(values: np.ndarray) -> pa.Array:
                return pa.array([list(v) if good else None for v, good in zip(values, ok)], pa.list_(pa.float64()))

            kept = [c for c in batch.schema.names if not c.startswith("__")]
            arrays = [batch.column(c) for c in kept]
            arrays += [
                listed(coef), listed(spread),
                pa.array(rss, pa.float64(), mask=~ok),
                pa.array(n * syy, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "coef", "unit_var", "rss", "tss"])

    return solve


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Least squares with intercept, one row per group.

    Rows with a missing value in any used column are left out. ``coef`` holds
    the intercept and then one slope per predictor; it is NULL for a group with
    too few rows or dependent predictors.
    """
    return solved(_moments(df, y, xs, by), len(xs))


def solved(grouped: DataFrame, k: int) -> DataFrame:
    """Fits from ``n``, means and centred products (``__mean``, ``__cov``: predictors, then the response)."""
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [f for f in grouped.schema.fields if not f.name.startswith("__")]
        + [
            T.StructField("coef", doubles), T.StructField("unit_var", doubles),
            T.StructField("rss", T.DoubleType()), T.StructField("tss", T.DoubleType()),
        ]
    )
    return grouped.mapInArrow(_solver(k), schema)


def _dof(k: int) -> Column:
    return F.col("n") - F.lit(k + 1)


def glance(fit: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Share of variance explained, residual deviation and information criterion per fit."""
    n = F.col("n").cast("double")
    fitted = F.col("coef").isNotNull()
    positive = F.when(F.col("rss") > 0, F.col("rss"))
    aic = n * F.lit(log(2 * pi) + 1) + n * F.ln(safe_div(positive, n)) + F.lit(2.0 * (k + 2))
    return fit.select(
        *by, "n",
        F.when(fitted, F.lit(1.0) - safe_div(F.col("rss"), F.col("tss"))).alias("r_squared"),
        F.when(fitted, F.sqrt(safe_div(F.col("rss"), _dof(k).cast("double")))).alias("sigma"),
        F.when(fitted, aic).alias("AIC"),
    )


def tidy(fit: DataFrame, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per fit and term: estimate, standard error, t and two-sided p."""
    k = len(xs)
    terms = F.array(*[F.lit(t) for t in ("(Intercept)", *xs)])
    variance = safe_div(F.col("rss"), _dof(k).cast("double"))
    return (
        fit.where(F.col("coef").isNotNull())
        .withColumns({"__v": variance, "__dof": _dof(k).cast("double")})
        .select(
            *by, "__v", "__dof",
            F.inline(F.arrays_zip(terms.alias("term"), F.col("coef").alias("estimate"), F.col("unit_var").alias("u"))),
        )
        .withColumn("std_error", F.sqrt(F.col("__v") * F.col("u")))
        .withColumn("statistic", safe_div(F.col("estimate"), F.col("std_error")))
        .withColumn("p_value", t_p_value("statistic", "__dof"))
        .select(*by, "term", "estimate", "std_error", "statistic", "p_value")
    )


def augment(
    df: DataFrame,
    fit: DataFrame,
    y: str,
    xs: Sequence[str],
    by: Sequence[str] = (),
    fits: str = "fits",
    residuals: str = "residuals",
) -> DataFrame:
    """Fitted value and residual on each row."""
    beside = null_safe_join(df, fit.select(*by, "coef"), by, "left")
    fitted = F.col("coef")[0]
    for i, x in enumerate(xs, start=1):
        fitted = fitted + F.col("coef")[i] * F.col(x)
    out = beside.withColumn(fits, fitted)
    return out.withColumn(residuals, F.col(y) - F.col(fits)).drop("coef")


LINE_METHODS = ("OLS", "MA", "SMA", "RMA")


def line_fits(df: DataFrame, y: str, x: str, by: Sequence[str] = (), method: str | None = None) -> DataFrame:
    """Line fits with errors in both variables, one row per group and method.

    OLS: least squares; MA: major axis; SMA: standard major axis; RMA: major
    axis of the variables scaled to their range, scaled back.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = df.select(*by, a.alias("__x"), b.alias("__y")).na.drop("any", subset=["__x", "__y"])
    m = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__x").alias("mx"), F.avg("__y").alias("my"),
        F.var_samp("__x").alias("sxx"), F.var_samp("__y").alias("syy"),
        F.covar_samp("__x", "__y").alias("sxy"),
        (F.max("__x") - F.min("__x")).alias("rx"), (F.max("__y") - F.min("__y")).alias("ry"),
    )
    sxx, syy, sxy, rx, ry = (F.col(c) for c in ("sxx", "syy", "sxy", "rx", "ry"))

    def major_axis(vx: Column, vy: Column, cxy: Column) -> Column:
        gap = vy - vx
        return safe_div(gap + F.sqrt(gap * gap + cxy * cxy * 4), cxy * 2)

    ranged = major_axis(
        safe_div(sxx, rx * rx), safe_div(syy, ry * ry), safe_div(sxy, rx * ry)
    ) * safe_div(ry, rx)
    slopes = {
        "OLS": safe_div(sxy, sxx),
        "MA": major_axis(sxx, syy, sxy),
        "SMA": F.signum(sxy) * F.sqrt(safe_div(syy, sxx)),
        "RMA": ranged,
    }
    chosen = [method] if method else list(LINE_METHODS)
    lines = F.array(*[F.struct(F.lit(c).alias("method"), slopes[c].alias("slope")) for c in chosen])
    return (
        m.select(*by, "n", "mx", "my", safe_div(sxy * sxy, sxx * syy).alias("r_squared"), F.inline(lines))
        .withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
        .select(*by, "method", "n", "intercept", "slope", "r_squared")
    )


def line_labels(lines: DataFrame) -> DataFrame:
    return lines.withColumn(
        "label", line_label(F.col("intercept"), F.col("slope"), F.col("r_squared"))
    )


def label_positions(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Place of a label per group: 0.6 of the least x and 0.4 of the largest y."""
    return df.groupBy(*by).agg((F.min(x) * 0.6).alias(x), (F.max(y) * 0.4).alias(y))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, its t statistic and two-sided p over complete pairs; N counts all rows."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    u, v = F.when(both, a), F.when(both, b)
    # a constant variable has no correlation
    rho = safe_div(F.covar_pop(u, v), F.sqrt(F.var_pop(u) * F.var_pop(v)))
    grouped = df.groupBy(*by).agg(
        rho.alias("pearson_rho"), F.count_if(both).alias("pairs"), rows().alias("N")
    )
    dof = (F.col("pairs") - 2).cast("double")
    rho = F.col("pearson_rho")
    r = F.when(F.abs(rho) > 1, F.signum(rho)).otherwise(rho)
    spread = F.sqrt(safe_div(F.abs(dof), F.lit(1.0) - r * r))
    t = F.when(dof > 0, F.when(F.abs(r) >= 1, F.signum(r) * float("inf")).otherwise(r * spread))
    return (
        grouped.withColumns({"pearson_rho": r, "__dof": dof})
        .withColumn("statistic", t)
        .withColumn("p_value", t_p_value("statistic", "__dof"))
        .drop("__dof")
    )


def remote_means(tracks: DataFrame, least_hour: int, keys: Sequence[str] = ("index", "date", "year", "month", "season")) -> DataFrame:
    """Mean temperature and humidity and rain total of the points within a window of hours."""
    return remote_sweep(tracks, [least_hour], keys).drop("window")


def remote_sweep(
    tracks: DataFrame,
    windows: Sequence[int] = SWEEP_WINDOWS,
    keys: Sequence[str] = ("index", "date", "year", "month", "season"),
    hour: str = "hour_along",
) -> DataFrame:
    """``remote_means`` for several windows at once.

    Points are first added up per event and hour band between two windows; only
    these few rows are repeated for the windows that contain them.
    """
    edges = F.array(*[F.lit(int(w)) for w in windows])
    band = F.array_max(F.filter(edges, lambda w: w <= F.col(hour)))
    sums = [
        f.alias(name)
        for c in ("air_temp", "rh", "rainfall")
        for name, f in ((f"{c}_sum", F.sum(c)), (f"{c}_n", F.count(c)))
    ]
    bands = (
        tracks.withColumn("__band", band)
        .where(F.col("__band").isNotNull())
        .groupBy(*keys, "__band")
        .agg(*sums, rows().alias("points"))
    )
    spread = explode_windows(bands, "__band", windows)
    points = F.sum("points")

    def whole(c: str, value: Column) -> Column:
        return F.when(F.sum(f"{c}_n") == points, value)

    def mean(c: str) -> Column:
        return whole(c, safe_div(F.sum(f"{c}_sum"), points.cast("double")))

    return spread.groupBy(*keys, "window").agg(
        mean("air_temp").alias("temp_rm"), mean("rh").alias("rh_rm"),
        whole("rainfall", F.sum("rainfall_sum")).alias("rainout"),
        points.alias("count"),
    )


def rainout(tracks: DataFrame, key: str = "index", before: int = RAINOUT_BEFORE) -> DataFrame:
    """Rain along the track before the last hours, per event."""
    return tracks.where(F.col("hour_along") < before).groupBy(key).agg(
        strict_sum(F.col("rainfall")).alias("rainout"), rows().alias("count")
    )


def sweep_fits(
    attributed: DataFrame,
    tracks: DataFrame,
    y: str = "dO",
    windows: Sequence[int] = SWEEP_WINDOWS,
    by: str = "region",
    key: str = "index",
) -> DataFrame:
    """Fit of ``y`` on the remote means per window and region, in one job."""
    xs = ("temp_rm", "rh_rm", "rainout")
    remote = remote_sweep(tracks, windows, [key])
    joined = attributed.select(key, by, y).join(remote, on=key, how="inner")
    return glance(ols(joined, y, xs, ["window", by]), len(xs), ["window", by])


def offsets(
    df: DataFrame, by: Sequence[str], observed: str = "dO", fitted: str = "fits",
    residual: str = "residuals",
) -> DataFrame:
    """Median observed and fitted value, their offset from the 1:1 line and the residual size."""
    grouped = summarise(
        df, by, {"sigma": rms(F.col(residual))}, medians={"x0": observed, "y0": fitted},
    )
    return grouped.withColumn("median_res", (F.col("x0") - F.col("y0")) / F.sqrt(F.lit(2.0)))


def residual_statistics(
    df: DataFrame, by: Sequence[str], residual: str = "residuals"
) -> DataFrame:
    return summarise(
        df, by, {"residual_sd": F.stddev_samp(residual)}, medians={"residual_median": residual},
    )
