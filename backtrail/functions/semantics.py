"""Null, NaN and aggregate rules shared by all operators.

Missing values are NULL everywhere: NaN is turned into NULL at ingest, a ratio
with a zero denominator is NULL, and a comparison with NULL is NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the floating point columns (all of them by default)."""
    wanted = set(columns) if columns is not None else None
    floating = {
        f.name: F.nullif(F.col(f.name), F.lit(float("nan")).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (wanted is None or f.name in wanted)
    }
    return df.withColumns(floating) if floating else df


def safe_div(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def flag(condition: Column) -> Column:
    """1 / 0, and NULL where the condition is unknown."""
    return F.when(condition, 1).when(~condition, 0)


def total(x: Column) -> Column:
    """Sum over the known values; 0 when all of them are missing."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def _all_known(x: Column) -> Column:
    return F.count(x) == F.count(F.lit(1))


def strict_sum(x: Column) -> Column:
    """Sum that one missing value makes missing."""
    return F.when(_all_known(x), total(x))


def strict_mean(x: Column) -> Column:
    """Mean that one missing value makes missing."""
    return F.when(_all_known(x), F.avg(x))


def positive_part(x: Column) -> Column:
    return F.when(x > 0, x)


def positive_sum(x: Column) -> Column:
    """Sum over the positive values; 0 when there is none."""
    return total(positive_part(x))


def wmean(x: Column, weight: Column) -> Column:
    """Weighted mean over rows with a known ``x``.

    A missing weight beside a known value makes the mean missing, and so does a
    weight sum of zero.
    """
    known = x.isNotNull()
    ratio = safe_div(F.sum(F.when(known, x * weight)), F.sum(F.when(known, weight)))
    return F.when(F.count_if(known & weight.isNull()) == 0, ratio)


def share_percent(condition: Column) -> Column:
    """Percentage of rows that meet the condition; one unknown row makes it missing."""
    return strict_mean(F.when(condition, 1.0).when(~condition, 0.0)) * 100


def rms(x: Column) -> Column:
    """Root of the mean square over all rows of the group; a missing value makes it missing."""
    return F.when(_all_known(x), F.sqrt(safe_div(F.sum(x * x), F.count(F.lit(1)).cast("double"))))


def rows() -> Column:
    return F.count(F.lit(1))


def iqr(x: Column) -> Column:
    """Interquartile range with linear interpolation between order statistics.

    Uses one exact percentile buffer per group; ``operators.quantiles`` has the
    form that also holds for groups too large for one buffer.
    """
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    return q[1] - q[0]
