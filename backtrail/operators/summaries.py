"""Event preparation and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.functions.scalars import (
    duration_hours,
    excess_global,
    excess_local,
    midpoint,
    season,
)
from backtrail.functions.semantics import rows, strict_sum, total, wmean
from backtrail.operators.quantiles import summarise
from backtrail.operators.skew import null_safe_join
from backtrail.sources.schemas import EVENTS

# Amount thresholds (mm), the event selection, and the longest event (hours).
THRESHOLDS = (0.0, 1.0, 2.5, 10.0)
LEAST_AMOUNT = 1.0
LONGEST_EVENT = 24

VALUES = ("dO", "d_excess")
SOURCE_COLUMNS = tuple(f.name for f in EVENTS)


def prepare_events(events: DataFrame, excess: str = "local", moment: str = "middle") -> DataFrame:
    """Clean events and derive excess, date, hour, year, month and length in hours.

    ``excess`` is "local" or "global"; ``moment`` says whether the middle or the
    start of an event gives its date and hour.
    """
    excess_of = {"local": excess_local, "global": excess_global}[excess]
    start, end = F.col("start"), F.col("end")
    at = {"middle": midpoint(start, end), "start": start}[moment]
    return (
        events.na.drop(subset=["start"])
        .withColumns({"d_excess": excess_of(F.col("dD"), F.col("dO")), "__at": at})
        .withColumns({"date": F.to_date("__at"), "time": F.hour("__at")})
        .withColumns({
            "year": F.year("date"), "month": F.month("date"),
            "duration": duration_hours(start, end),
        })
        .drop("__at")
    )


def complete_events(prepared: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Events without a missing value in any column.

    A derived column is missing exactly when one of its sources is, so only the
    sources are tested: tests on derived columns would be pushed below the
    derivation and evaluate it again, once per test.
    """
    return prepared.na.drop("any", subset=[*SOURCE_COLUMNS, *also])


def with_season(events: DataFrame) -> DataFrame:
    return events.withColumn("season", season(F.col("date")))


def select_events(
    prepared: DataFrame, least: float = LEAST_AMOUNT, longest: int = LONGEST_EVENT
) -> DataFrame:
    """Events above an amount and no longer than the given hours."""
    return prepared.where((F.col("P") > least) & (F.col("duration") <= longest))


def threshold_summary(
    prepared: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    longest: int = LONGEST_EVENT,
) -> DataFrame:
    """The same summary for several amount thresholds, in one pass."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    levels = prepared.where(F.col("duration") <= longest).select(
        "P", *VALUES, F.explode(F.filter(marks, lambda t: F.col("P") > t)).alias("threshold")
    )
    return summarise(
        levels, ["threshold"],
        {
            "dO_sd": F.stddev_samp("dO"), "d_excess_sd": F.stddev_samp("d_excess"),
            "precip": strict_sum(F.col("P")), "N": rows(),
        },
        medians={"dO": "dO", "d_excess": "d_excess"},
        iqrs={"dO_iqr": "dO", "d_excess_iqr": "d_excess"},
    )


def weighted_summary(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean, deviation and interquartile range of the values, amount and count."""
    return summarise(
        events, keys,
        {
            "dO_sd": F.stddev_samp("dO"), "d_excess_sd": F.stddev_samp("d_excess"),
            "dO": wmean(F.col("dO"), F.col("P")), "d_excess": wmean(F.col("d_excess"), F.col("P")),
            "precip": strict_sum(F.col("P")), "N": rows(),
        },
        iqrs={"dO_iqr": "dO", "d_excess_iqr": "d_excess"},
    )


def median_summary(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median and interquartile range of the values, amount and count."""
    return summarise(
        events, keys,
        {"precip": strict_sum(F.col("P")), "N": rows()},
        medians={"dO": "dO", "d_excess": "d_excess"},
        iqrs={"dO_iqr": "dO", "d_excess_iqr": "d_excess"},
    )


def monthly_summary(events: DataFrame) -> DataFrame:
    return weighted_summary(events, ["year", "month"])


def mean_monthly_deviation(monthly: DataFrame) -> DataFrame:
    """Mean of the monthly deviations over all months."""
    return monthly.agg(
        F.avg("dO_sd").alias("dO_sd"), F.avg("d_excess_sd").alias("d_excess_sd"), rows().alias("N")
    )


def daily_statistics(
    weather: DataFrame,
    after: str,
    values: Sequence[str] = ("temp", "rh", "gph"),
) -> DataFrame:
    """Median and deviation of each value per day, for days after a date."""
    recent = weather.where(F.col("date") > F.lit(after).cast("date"))
    return summarise(
        recent, ["date"],
        {f"{v}_sd": F.stddev_samp(v) for v in values},
        medians={v: v for v in values},
    )


def monthly_composite(attributed: DataFrame, values: Sequence[str], amount: str = "P") -> DataFrame:
    """Weighted means and amount per year, month and season."""
    return attributed.groupBy("year", "month", "season").agg(
        *[wmean(F.col(v), F.col(amount)).alias(v) for v in values],
        total(F.col(amount)).alias(amount),
    )


def _fences(df: DataFrame, keys: Sequence[str], value: str, reach: float) -> DataFrame:
    quartiles = summarise(
        df.where(F.col(value).isNotNull()), keys, {},
        quantiles={"q1": (value, 0.25), "med": (value, 0.5), "q3": (value, 0.75)},
    )
    span = (F.col("q3") - F.col("q1")) * reach
    return quartiles.withColumns({"low": F.col("q1") - span, "high": F.col("q3") + span})


def box_statistics(
    df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5
) -> DataFrame:
    """Quartiles, whiskers (last values within the fences) and number of outliers per group."""
    fences = _fences(df, keys, value, reach)
    x = F.col(value)
    beside = null_safe_join(df.where(x.isNotNull()), fences, keys)
    within = x.between(F.col("low"), F.col("high"))
    return beside.groupBy(*keys, "q1", "med", "q3").agg(
        F.min(F.when(within, x)).alias("whisker_low"),
        F.max(F.when(within, x)).alias("whisker_high"),
        F.count_if(~within).alias("outliers"),
        rows().alias("n"),
    )


def box_outliers(
    df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5
) -> DataFrame:
    """Rows whose value lies outside the fences of their group."""
    fences = _fences(df, keys, value, reach)
    x = F.col(value)
    beside = null_safe_join(df.where(x.isNotNull()), fences, keys)
    return beside.where(~x.between(F.col("low"), F.col("high"))).select(*df.columns)
