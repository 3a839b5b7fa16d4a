from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from backtrail.functions import scalars
from backtrail.functions.semantics import (
    flag,
    iqr,
    nan_to_null,
    positive_sum,
    rms,
    safe_div,
    share_percent,
    strict_mean,
    strict_sum,
    total,
    wmean,
)


def one(df, column):
    return df.agg(column.alias("v")).first()["v"]


def test_nan_becomes_null_and_is_skipped(frame):
    df = frame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert one(nan_to_null(df), F.sum("x")) == 4.0


def test_strict_aggregates_are_poisoned_by_a_missing_value(frame):
    df = frame([(1.0, 1.0), (None, 2.0)], "x double, y double")
    assert one(df, strict_sum(F.col("x"))) is None
    assert one(df, strict_mean(F.col("x"))) is None
    assert one(df, strict_sum(F.col("y"))) == 3.0
    assert one(df, total(F.col("x"))) == 1.0


def test_total_of_nothing_is_zero(frame):
    df = frame([(None,)], "x double")
    assert one(df, total(F.col("x"))) == 0.0
    assert one(df, positive_sum(F.col("x"))) == 0.0


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(1.0, 1.0), (4.0, 3.0)], 3.25),
        ([(None, 5.0), (4.0, 3.0)], 4.0),  # value missing: row skipped
        ([(1.0, None), (4.0, 3.0)], None),  # weight missing beside a value
        ([(1.0, 0.0), (4.0, 0.0)], None),  # weight sum 0
        ([(None, 1.0)], None),
    ],
)
def test_weighted_mean(frame, rows, expected):
    assert one(frame(rows, "x double, w double"), wmean(F.col("x"), F.col("w"))) == expected


def test_flag_of_unknown_is_null(frame):
    df = frame([(0.4,), (0.5,), (None,)], "x double")
    assert [r[0] for r in df.select(flag(F.col("x") >= 0.5)).collect()] == [0, 1, None]


def test_safe_division(frame):
    assert frame([(0.0, 0.0)], "a double, b double").select(safe_div(F.col("a"), F.col("b"))).first()[0] is None


def test_share_and_rms(frame):
    df = frame([(1.0,), (-1.0,), (3.0,), (5.0,)], "x double")
    assert one(df, share_percent(F.col("x") < 0)) == 25.0
    assert one(df, rms(F.col("x"))) == 3.0


def test_interquartile_range_interpolates(frame):
    df = frame([(float(v),) for v in (1, 2, 3, 10)], "x double")
    assert one(df, iqr(F.col("x"))) == pytest.approx(4.75 - 1.75)


def test_deviation_of_one_value_is_null(frame):
    assert one(frame([(1.0,)], "x double"), F.stddev_samp("x")) is None


def test_midpoint_and_duration_round_up(frame):
    df = frame(
        [(datetime(2020, 1, 1, 23, 0), datetime(2020, 1, 2, 1, 0, 1)), (datetime(2020, 3, 29, 0, 0), None)],
        "a timestamp_ntz, b timestamp_ntz",
    )
    row, missing = df.select(
        scalars.midpoint(F.col("a"), F.col("b")), scalars.duration_hours(F.col("a"), F.col("b"))
    ).collect()
    assert row[0] == datetime(2020, 1, 2, 0, 0, 1) and row[1] == 3
    assert missing[0] is None and missing[1] is None


def test_duration_ignores_the_session_time_zone(spark, frame):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = frame([(datetime(2020, 3, 29, 0, 0), datetime(2020, 3, 29, 6, 0))], "a timestamp_ntz, b timestamp_ntz")
        assert df.select(scalars.duration_hours(F.col("a"), F.col("b"))).first()[0] == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_season_and_month_name(frame):
    df = frame([(date(2020, m, 1),) for m in (2, 3, 8, 9, 12)] + [(None,)], "d date")
    got = [tuple(r) for r in df.select(scalars.season(F.col("d")), scalars.month_name(F.col("d"))).collect()]
    assert got == [
        ("Winter", "Feb"), ("Spring", "Mar"), ("Summer", "Aug"), ("Autumn", "Sep"), ("Winter", "Dec"), ("Winter", None),
    ]


def test_ordinals(frame):
    df = frame([("Winter",), ("Autumn",), ("other",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.ordinal(F.col("s"), scalars.SEASONS)).collect()] == [1, 4, None, None]


def test_excess(frame):
    row = frame([(10.0, -1.0)], "d double, o double").select(
        scalars.excess_local(F.col("d"), F.col("o")), scalars.excess_global(F.col("d"), F.col("o"))
    ).first()
    assert row[0] == pytest.approx(10 + 7.46 - 5.99) and row[1] == 18.0


def test_labels(frame):
    row = frame([(9.994, 7.5, 0.987, 4.0, 2.125)], "a double, b double, r double, n double, s double").select(
        scalars.line_label(F.col("a"), F.col("b"), F.col("r")),
        scalars.count_label(F.col("n")),
        scalars.offset_label(F.col("s"), F.col("a")),
        scalars.fit_label(F.col("r"), F.col("s")),
    ).first()
    assert row[0] == "d²H = 9.99 + 7.5 * d¹⁸O\nR² = 0.99"
    assert row[1] == "N = 4"
    assert row[2] == "RMSE = 2.12 ‰\nOffset = 9.99 ‰"
    assert row[3] == "R² = 0.99\nRMSE = 2.1 ‰"
