from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from backtrail.operators import series, summaries

DAILY = "date date, month int, year int, dO double, d_excess double, P double"


def days(spark, values):
    start = date(2020, 1, 1)
    rows = [
        (start + timedelta(d), 1, 2020, v, None if v is None else v * 2, p) for d, (v, p) in values.items()
    ]
    return spark.createDataFrame(rows, DAILY)


def test_even_window_has_one_more_row_after():
    assert series.frame_offsets(30, "center") == (-14, 15)
    assert series.frame_offsets(5, "center") == (-2, 2)
    assert series.frame_offsets(6, "right") == (-5, 0)


@pytest.fixture(scope="module")
def gappy(spark):
    return days(spark, {d: (float(d % 7), float(1 + d % 3)) for d in range(40) if d % 5 or d in (0, 39)} | {39: (1.0, 2.0)})


def test_calendar_has_every_day(gappy):
    out = series.complete_days(gappy)
    assert out.count() == 40 and out.where("P is null").count() == 40 - gappy.count()


def test_centred_composite_has_29_empty_edge_rows_and_matches_a_loop(gappy):
    completed = series.complete_days(gappy)
    got = series.rolling_composite(completed).orderBy("date").collect()
    assert sum(r.P_rm is None for r in got) == 29
    plain = completed.orderBy("date").collect()
    for i, r in enumerate(got):
        if i < 14 or i + 15 >= 40:
            assert r.P_rm is None and r.dO_rm is None
            continue
        inside = [p for p in plain[i - 14:i + 16] if p.P is not None]
        weight = sum(p.P for p in inside)
        assert r.P_rm == pytest.approx(weight)
        assert r.dO_rm == pytest.approx(sum(p.dO * p.P for p in inside) / weight)


def test_scattered_composite_equals_the_window_form(gappy):
    columns = ["date", "dO", *[F.round(c, 9).alias(c) for c in ("P_rm", "dO_rm", "d_excess_rm")]]
    a = series.rolling_composite(series.complete_days(gappy)).select(*columns)
    b = series.scatter_composite(gappy).select(*columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_window_without_values_sums_to_zero_and_has_no_ratio(spark):
    rows = [(date(2020, 1, 1) + timedelta(d), None, None, None, None, None) for d in range(30)]
    got = series.rolling_composite(spark.createDataFrame(rows, DAILY)).where("P_rm is not null").collect()
    assert [(r.P_rm, r.dO_rm) for r in got] == [(0.0, None)]


def test_rolling_mean_skips_missing_values_and_needs_full_windows(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, None, 3.0, 5.0, 7.0, 9.0])] + [("b", 0, 1.0)]
    df = spark.createDataFrame(rows, "s string, t int, v double")
    for slice_by in (None, F.floor(F.col("t") / 2)):
        got = series.rolling_means(df, ["s"], ["t"], ["v"], 5, slice_by=slice_by)
        assert [r.v for r in got.orderBy("s", "t").collect()] == [None, None, 4.0, 6.0, None, None, None]


def test_composite_per_series_has_its_own_calendar(spark):
    rows = [("a", date(2020, 1, d), 1.0, 1.0, 1.0) for d in (1, 3)] + [("b", date(2020, 2, 1), 1.0, 1.0, 1.0)]
    events = spark.createDataFrame(rows, "s string, date date, dO double, d_excess double, P double")
    out = series.complete_days(series.daily_composite(events, ["s"]), ["s"])
    assert sorted((r.s, str(r.date)) for r in out.collect()) == [
        ("a", "2020-01-01"), ("a", "2020-01-02"), ("a", "2020-01-03"), ("b", "2020-02-01"),
    ]


def test_anomaly_is_value_minus_composite(spark, gappy):
    composite = series.rolling_composite(series.complete_days(gappy))
    events = gappy.select("date", "dO", "d_excess", F.monotonically_increasing_id().alias("index"))
    out = series.anomalies(events, composite).collect()
    assert len(out) == composite.na.drop().count() > 0
    for r in out:
        assert r.dO_nm == pytest.approx(r.dO - r.dO_rm)


def test_threshold_summary_uses_strict_limits(spark):
    rows = [(1.0, -1.0, 2.0, 1), (2.5, -2.0, 4.0, 1), (11.0, -4.0, 8.0, 1), (50.0, 0.0, 0.0, 30)]
    df = spark.createDataFrame(rows, "P double, dO double, d_excess double, duration long")
    got = {r.threshold: r for r in summaries.threshold_summary(df).collect()}
    assert {t: r.N for t, r in got.items()} == {0.0: 3, 1.0: 2, 2.5: 1, 10.0: 1}
    assert got[0.0].dO == -2.0 and got[10.0].dO_sd is None and got[1.0].precip == 13.5


def test_box_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", None)], "g string, v double")
    r = summaries.box_statistics(df, ["g"], "v").collect()
    assert [(x.g, x.q1, x.med, x.q3, x.whisker_low, x.whisker_high, x.outliers) for x in r] == [
        ("a", 2.0, 3.0, 4.0, 1.0, 4.0, 1)
    ]
    assert [x.v for x in summaries.box_outliers(df, ["g"], "v").collect()] == [100.0]
