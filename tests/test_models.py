import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.functions.student import two_sided
from backtrail.operators import models

XS = ("a", "b", "c")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in ("u", "v", "w"):
        n = {"u": 200, "v": 40, "w": 7}[g]
        x = rng.normal([1000, 0.01, 5], [30, 0.002, 2], (n, 3))
        y = 3 + x @ [0.2, -150.0, 1.5] + rng.normal(0, 2, n)
        rows += [(g, *map(float, r), float(t)) for r, t in zip(x, y)]
    rows += [("u", None, 1.0, 1.0, 1.0), ("one", 1.0, 2.0, 3.0, 4.0)]
    rows += [("flat", 1.0, float(i), float(i * i), float(i)) for i in range(9)]
    rows += [("dependent", float(i), 2.0 * i, float(i * i), float(i % 4)) for i in range(9)]
    return spark.createDataFrame(rows, "g string, a double, b double, c double, y double").repartition(6).cache()


def fit_of(data, g):
    rows = data.where(F.col("g") == g).na.drop().collect()
    x = np.array([[1, r.a, r.b, r.c] for r in rows])
    return x, np.array([r.y for r in rows])


def test_grouped_fit_equals_least_squares(data):
    fit = models.ols(data, "y", XS, ["g"])
    got = {r.g: r for r in fit.collect()}
    stats = {r.g: r for r in models.glance(fit, 3, ["g"]).collect()}
    for g in ("u", "v", "w"):
        x, y = fit_of(data, g)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        rss = float(((y - x @ beta) ** 2).sum())
        n = len(y)
        assert got[g].coef == pytest.approx(list(beta), rel=1e-7)
        assert stats[g].sigma == pytest.approx(np.sqrt(rss / (n - 4)))
        assert stats[g].r_squared == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
        likelihood = -n / 2 * (np.log(2 * np.pi) + np.log(rss / n) + 1)
        assert stats[g].AIC == pytest.approx(-2 * likelihood + 2 * 5)


def test_groups_without_a_unique_fit_are_null(data):
    got = {r.g: r.coef for r in models.ols(data, "y", XS, ["g"]).collect()}
    assert got["one"] is None and got["flat"] is None and got["dependent"] is None


def test_coefficient_table(data):
    got = {
        (r.g, r.term): r for r in models.tidy(models.ols(data, "y", XS, ["g"]), XS, ["g"]).collect()
    }
    x, y = fit_of(data, "v")
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    s2 = ((y - x @ beta) ** 2).sum() / (len(y) - 4)
    for i, term in enumerate(("(Intercept)", *XS)):
        r = got["v", term]
        assert r.std_error == pytest.approx(np.sqrt(s2 * inverse[i, i]), rel=1e-6)
        assert r.statistic == pytest.approx(beta[i] / r.std_error, rel=1e-6)
        assert 0 <= r.p_value <= 1


def test_residuals_sum_to_zero_and_missing_predictors_give_none(data):
    fit = models.ols(data, "y", XS, ["g"])
    rows = models.augment(data, fit, "y", XS, ["g"])
    assert rows.count() == data.count()
    sums = {r.g: r.s for r in rows.groupBy("g").agg(F.sum("residuals").alias("s")).collect()}
    assert sums["u"] == pytest.approx(0, abs=1e-7) and sums["v"] == pytest.approx(0, abs=1e-7)
    assert rows.where("g = 'u' and a is null").first().fits is None


def test_fit_without_groups(data):
    x, y = fit_of(data, "u")
    row = models.ols(data.where("g = 'u'"), "y", XS).first()
    assert row.coef == pytest.approx(list(np.linalg.lstsq(x, y, rcond=None)[0]), rel=1e-7)


@pytest.mark.parametrize(
    ("t", "df", "p"),
    [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.960, 10**7, 0.05), (0.0, 4, 1.0)],
)
def test_published_quantiles(t, df, p):
    assert two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(p, abs=6e-5)


def test_tail_of_unknown_and_infinite():
    got = two_sided(np.array([np.nan, np.inf, 1.0]), np.array([3, 3, 0]))
    assert np.isnan(got[0]) and got[1] == 0 and np.isnan(got[2])


def test_perfect_line_has_slope_two_in_every_method(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0)], "x double, y double")
    for r in models.line_fits(df, "y", "x").collect():
        assert (r.slope, r.intercept, r.r_squared, r.n) == pytest.approx((2.0, 0.0, 1.0, 3))


def test_ranged_major_axis_is_the_eigenvector_of_ranged_data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(-8, 3, 300)
    y = 7.5 * x + 6 + rng.normal(0, 6, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r.method: r for r in models.line_fits(df, "y", "x").collect()}
    rx, ry = np.ptp(x), np.ptp(y)
    vector = np.linalg.eigh(np.cov(x / rx, y / ry))[1][:, 1]
    slope = vector[1] / vector[0] * ry / rx
    assert got["RMA"].slope == pytest.approx(slope)
    assert got["RMA"].intercept == pytest.approx(y.mean() - slope * x.mean())
    assert got["SMA"].slope == pytest.approx(y.std() / x.std())
    assert got["RMA"].r_squared == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)


def test_pearson_counts_all_rows_but_uses_complete_pairs(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("a", 4.0, 4.0), ("a", None, 9.0), ("b", 1.0, 1.0),
            ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("c", 1.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in models.pearson(df, "x", "y", ["g"]).collect()}
    rho = np.corrcoef([1, 2, 3, 4], [2, 1, 5, 4])[0, 1]
    assert got["a"].pearson_rho == pytest.approx(rho) and got["a"].N == 5 and got["a"].pairs == 4
    assert got["a"].p_value == pytest.approx(1 - rho, abs=1e-9)  # two degrees of freedom: p = 1 - |r|
    assert got["b"].pearson_rho is None and got["c"].pearson_rho is None and got["c"].p_value is None


SWEEP = "index long, hour_along int, air_temp double, rh double, rainfall double"


def test_sweep_equals_one_window_at_a_time(spark):
    rows = [(i, -h, 280.0 + i + h, 50.0 + h % 7, 0.1 * (h % 3)) for i in range(5) for h in range(100)]
    rows.append((4, -50, None, 60.0, 0.0))
    df = spark.createDataFrame(rows, SWEEP)
    got = {(r["index"], r.window): r for r in models.remote_sweep(df, keys=["index"]).collect()}
    assert len(got) == 5 * 9
    for (i, w), r in got.items():
        inside = [x for x in rows if x[0] == i and x[1] >= w]
        assert r["count"] == len(inside)
        if any(x[2] is None for x in inside):
            assert r.temp_rm is None
        else:
            assert r.temp_rm == pytest.approx(np.mean([x[2] for x in inside]))
        assert r.rainout == pytest.approx(sum(x[4] for x in inside))


def test_sweep_has_no_cartesian_product(spark):
    points = spark.createDataFrame([(1, -5, 1.0, 1.0, 1.0)], SWEEP)
    events = spark.createDataFrame([(1, "West", 1.0)], "index long, region string, dO double")
    plan = models.sweep_fits(events, points)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
