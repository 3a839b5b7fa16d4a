"""Joins, differences, completion and parameter grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.operators.skew import null_safe_join

#: Values that a label may have.
MOST_LABELS = 10_000


def natural_join(left: DataFrame, right: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Inner join on all shared column names, which must be exactly the expected ones."""
    shared = sorted(set(left.columns) & set(right.columns))
    if shared != sorted(expected):
        raise ValueError(f"shared columns are {shared}, expected {sorted(expected)}")
    return left.join(right, on=list(expected), how="inner")


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys do not occur in ``right``."""
    return left.join(right.select(*keys), on=list(keys), how="left_anti")


def listed(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys occur in ``right``."""
    return left.join(right.select(*keys), on=list(keys), how="left_semi")


def match_audit(left: DataFrame, right: DataFrame, keys: Sequence[str], out: str = "flag") -> DataFrame:
    """All key combinations of both sides: 0 where both have them, 1 where only one does."""
    seen = (
        left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(*keys)
        .agg(F.max("l").alias("in_left"), F.max("r").alias("in_right"))
    )
    return seen.withColumn(out, F.when((F.col("in_left") == 1) & (F.col("in_right") == 1), 0).otherwise(1))


def replace_tracks(current: DataFrame, keep: DataFrame, corrected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the listed keys, followed by the corrected rows."""
    return listed(current, keep, keys).unionByName(corrected)


def explode_grid(df: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """Every row once per combination of the given values; no join is involved."""
    for name, choices in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in choices])))
    return df


def explode_windows(df: DataFrame, hour: str, windows: Sequence[int], out: str = "window") -> DataFrame:
    """Every row once per window ``w`` with ``hour >= w``."""
    edges = F.array(*[F.lit(int(w)) for w in windows])
    return df.withColumn(out, F.explode(F.filter(edges, lambda w: w <= F.col(hour))))


def label_table(df: DataFrame, column: str, levels: Sequence | None = None) -> DataFrame:
    """``label`` and ``ordinal`` (from 1) of a label: the levels in their order, else the values that occur, NULL first.

    A label has ``MOST_LABELS`` values at most; a column with more is not one, and an error.
    """
    if levels is None:
        found = [r[0] for r in df.select(column).distinct().orderBy(F.col(column).asc_nulls_first()).limit(MOST_LABELS + 1).collect()]
    else:
        found = list(levels)
    if len(found) > MOST_LABELS:
        raise ValueError(f"{column} has more than {MOST_LABELS} values")
    kind = df.schema[column].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(found, 1)], f"label {kind}, ordinal int")


def with_ordinal(df: DataFrame, column: str, labels: DataFrame, out: str = "ordinal") -> DataFrame:
    """Add the place of a label in the order of its table; NULL for one that is not in it."""
    places = labels.select(F.col("label").alias(column), F.col("ordinal").alias(out))
    return null_safe_join(df, F.broadcast(places), [column], "left")


def complete_grid(
    df: DataFrame,
    left: Sequence[str],
    right: str,
    fill: Mapping[str, object],
    levels: Sequence | None = None,
) -> DataFrame:
    """All combinations of the observed ``left`` keys with the values of ``right``.

    ``levels`` lists the values of an ordered label, observed or not; rows without a label
    are then a group of their own. Without it the observed values are used, see
    ``label_table``. Missing measures get the ``fill`` values.
    """
    base = df.select(*left).distinct()
    labels = label_table(df, right, levels).select(F.col("label").alias(right))
    grid = base.crossJoin(F.broadcast(labels))  # a few labels, which are counted
    if levels is not None:
        grid = grid.unionByName(df.where(F.col(right).isNull()).select(*left, right).distinct())
    joined = null_safe_join(grid, df, [*left, right], "left")
    return joined.fillna(dict(fill)).select(*df.columns)


def known(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in the named columns (all by default)."""
    return df.na.drop(subset=list(columns)) if columns else df.na.drop("any")
