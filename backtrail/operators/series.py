"""Daily series: completion, centred and trailing rolling windows, composites, anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from backtrail.functions.semantics import safe_div, total, wmean
from backtrail.operators.joins import natural_join
from backtrail.operators.skew import null_safe_join, over_ordered


def frame_offsets(width: int, align: str) -> tuple[int, int]:
    """First and last row offset of a rolling window of the given width.

    A centred window of even width has one more row after than before.
    """
    if align == "right":
        return 1 - width, 0
    before = (width - 1) // 2
    return -before, width - 1 - before


def roll_sum(x: Column, window: WindowSpec, width: int, align: str = "center") -> Column:
    """Sum over a full window; missing values inside count as nothing, partial windows are NULL."""
    frame = window.rowsBetween(*frame_offsets(width, align))
    return F.when(F.count(F.lit(1)).over(frame) == width, F.coalesce(F.sum(x).over(frame), F.lit(0.0)))


def roll_mean(x: Column, window: WindowSpec, width: int, align: str = "center") -> Column:
    """Mean of the known values of a full window; partial windows are NULL."""
    frame = window.rowsBetween(*frame_offsets(width, align))
    return F.when(F.count(F.lit(1)).over(frame) == width, F.avg(x).over(frame))


def rolling_means(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    width: int = 5,
    slice_by: Column | None = None,
) -> DataFrame:
    """Replace columns by their centred rolling mean over rows; ``slice_by`` as in ``over_ordered``."""
    first, last = frame_offsets(width, "center")

    def smooth(frame: DataFrame, window: WindowSpec) -> DataFrame:
        kept = [c for c in frame.columns if c not in columns]
        return frame.select(*kept, *[roll_mean(F.col(c), window, width).alias(c) for c in columns])

    out = over_ordered(df, series, order, smooth, before=-first, after=last, slice_by=slice_by)
    return out.select(*df.columns)


def rolling_sums(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, Column],
    width: int,
    align: str = "center",
    slice_by: Column | None = None,
) -> DataFrame:
    """Add rolling sums over rows; ``slice_by`` as in ``over_ordered``."""
    first, last = frame_offsets(width, align)

    def add(frame: DataFrame, window: WindowSpec) -> DataFrame:
        return frame.withColumns({n: roll_sum(c, window, width, align) for n, c in columns.items()})

    return over_ordered(df, series, order, add, before=-first, after=last, slice_by=slice_by)


def daily_composite(
    events: DataFrame,
    series: Sequence[str] = (),
    values: Sequence[str] = ("dO", "d_excess"),
    weight: str = "P",
    date: str = "date",
) -> DataFrame:
    """Weighted mean of each value and the weight total, per series and day."""
    return events.groupBy(*series, date, F.month(date).alias("month"), F.year(date).alias("year")).agg(
        *[wmean(F.col(v), F.col(weight)).alias(v) for v in values],
        total(F.col(weight)).alias(weight),
    )


def complete_days(daily: DataFrame, series: Sequence[str] = (), date: str = "date") -> DataFrame:
    """One row per series and day from its first to its last day; new days hold NULL."""
    span = daily.groupBy(*series).agg(F.min(date).alias("__from"), F.max(date).alias("__to"))
    calendar = span.where(F.col("__from").isNotNull()).select(
        *series, F.explode(F.sequence("__from", "__to", F.expr("interval 1 day"))).alias(date)
    )
    return null_safe_join(calendar, daily, [*series, date], "left").select(*daily.columns)


def rolling_composite(
    completed: DataFrame,
    series: Sequence[str] = (),
    values: Sequence[str] = ("dO", "d_excess"),
    weight: str = "P",
    date: str = "date",
    width: int = 30,
    suffix: str = "_rm",
) -> DataFrame:
    """Weighted centred rolling mean: rolling sum of value x weight over rolling sum of weight.

    ``completed`` has every day of a series once. The weight sum also counts days on which
    the value itself is missing; days near the ends have no whole window and hold NULL.
    """
    sums = {f"__{v}": F.col(v) * F.col(weight) for v in values} | {f"{weight}{suffix}": F.col(weight)}
    rolled = rolling_totals(completed, series, sums, date, width)
    return rolled.select(
        *completed.columns, f"{weight}{suffix}",
        *[safe_div(F.col(f"__{v}"), F.col(f"{weight}{suffix}")).alias(f"{v}{suffix}") for v in values])


#: Days of a slice of a series, and digits behind the point of the running sums.
SLICE_DAYS, SUM_DIGITS = 1024, 15


def prefix_sums(completed: DataFrame, series: Sequence[str], columns: Mapping[str, Column], date: str = "date") -> DataFrame:
    """The days of each series with exact sums of the columns from its first day on; missing values count as nothing.

    Sums run within slices of ``SLICE_DAYS`` days, the totals of the slices before are added.
    They are decimals, so that a difference of two is the sum of the days between;
    an amount under half of 1e-15 counts as nothing, a sum reaches to 1e23.
    """
    exact = f"decimal(38,{SUM_DIGITS})"
    cut = completed.select(
        *series, date, F.floor(F.unix_date(date) / SLICE_DAYS).alias("__slice"),
        *[F.coalesce(c.cast(exact), F.lit(0).cast(exact)).alias(n) for n, c in columns.items()])
    sums = cut.groupBy(*series, "__slice").agg(*[F.sum(n).cast(exact).alias(n) for n in columns])
    earlier = Window.partitionBy(*series).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*series, "__slice", *[F.coalesce(F.sum(n).over(earlier).cast(exact), F.lit(0).cast(exact)).alias(f"__b_{n}")
                                               for n in columns])
    within = Window.partitionBy(*series, "__slice").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.select(*series, date, "__slice", *[F.sum(n).over(within).cast(exact).alias(n) for n in columns])
    return null_safe_join(run, before, [*series, "__slice"]).select(
        *series, date, *[(F.col(n) + F.col(f"__b_{n}")).cast(exact).alias(n) for n in columns])


def rolling_totals(
    completed: DataFrame,
    series: Sequence[str],
    columns: Mapping[str, Column],
    date: str = "date",
    width: int = 30,
    align: str = "center",
) -> DataFrame:
    """Add rolling sums over full windows of days, of which a series holds every one.

    Each day's running sum enters the window that ends on it and leaves the one that
    begins after it: two rows a day, whatever the width.
    """
    first, last = frame_offsets(width, align)
    span = completed.groupBy(*series).agg(F.min(date).alias("__from"), F.max(date).alias("__to"))
    runs = prefix_sums(completed, series, columns, date)
    ends = F.array(F.struct(F.date_add(date, -last).alias("__day"), F.lit(1).alias("__sign")),
                   F.struct(F.date_add(date, 1 - first).alias("__day"), F.lit(-1).alias("__sign")))
    moved = runs.select(*series, *columns, F.inline(ends)).groupBy(*series, F.col("__day").alias(date)).agg(
        *[F.sum(F.when(F.col("__sign") > 0, F.col(n)).otherwise(-F.col(n))).cast("double").alias(f"__w_{n}") for n in columns])
    whole = (F.date_add(date, first) >= F.col("__from")) & (F.date_add(date, last) <= F.col("__to"))
    joined = null_safe_join(null_safe_join(completed, moved, [*series, date], "left"), span, series)
    return joined.select(*completed.columns, *[F.when(whole, F.col(f"__w_{n}")).alias(n) for n in columns])


def scatter_composite(
    daily: DataFrame,
    series: Sequence[str] = (),
    values: Sequence[str] = ("dO", "d_excess"),
    weight: str = "P",
    date: str = "date",
    width: int = 30,
    suffix: str = "_rm",
) -> DataFrame:
    """``complete_days`` and ``rolling_composite`` without sorting a series.

    Each day is sent to the days whose window covers it and the contributions
    are added up with an ordinary aggregation, so one long series is spread
    over all tasks.
    """
    first, last = frame_offsets(width, "center")
    span = daily.groupBy(*series).agg(F.min(date).alias("__from"), F.max(date).alias("__to"))
    near = null_safe_join(daily, span, series)
    one_day = F.expr("interval 1 day")
    low = F.greatest(F.date_add(date, -last), F.col("__from"))
    high = F.least(F.date_add(date, -first), F.col("__to"))
    scattered = near.select(
        *series, F.explode(F.sequence(low, high, one_day)).alias("__day"),
        *[(F.col(v) * F.col(weight)).alias(f"__{v}") for v in values], F.col(weight).alias("__w"),
    ).groupBy(*series, F.col("__day").alias(date)).agg(
        *[total(F.col(f"__{v}")).alias(f"__{v}") for v in values], total(F.col("__w")).alias("__w")
    )
    days = null_safe_join(complete_days(daily, series, date), span, series)
    joined = null_safe_join(days, scattered, [*series, date], "left")
    full = (F.date_add(date, first) >= F.col("__from")) & (F.date_add(date, last) <= F.col("__to"))

    def covered(c: str) -> Column:
        return F.when(full, F.coalesce(F.col(c), F.lit(0.0)))

    weighted = covered("__w")
    return joined.select(
        *daily.columns,
        weighted.alias(f"{weight}{suffix}"),
        *[safe_div(covered(f"__{v}"), weighted).alias(f"{v}{suffix}") for v in values],
    )


def with_weather(
    events: DataFrame, weather: DataFrame, keys: Sequence[str] = ("date", "time")
) -> DataFrame:
    """Events beside the weather of their day and hour; weather holds one row per hour."""
    return natural_join(events, weather, keys)


def anomalies(
    events: DataFrame,
    composite: DataFrame,
    keys: Sequence[str] = ("date",),
    values: Sequence[str] = ("dO", "d_excess"),
    suffix: str = "_rm",
    out: str = "_nm",
) -> DataFrame:
    """Event value minus the composite of its day.

    Days on which any column of the composite is missing are left out.
    """
    reference = composite.na.drop("any").select(*keys, *[f"{v}{suffix}" for v in values])
    joined = events.join(reference, on=list(keys), how="inner")
    return joined.withColumns({f"{v}{out}": F.col(v) - F.col(f"{v}{suffix}") for v in values})


def own_anomalies(composite: DataFrame, values: Sequence[str] = ("dO", "d_excess"), suffix: str = "_rm", out: str = "_nm") -> DataFrame:
    """Value of each day minus the composite around it; NULL where either is missing."""
    return composite.withColumns({f"{v}{out}": F.col(v) - F.col(f"{v}{suffix}") for v in values})
