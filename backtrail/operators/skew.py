"""Ways to keep one large group from landing in one task.

``over_ordered`` evaluates ordered window expressions. Groups with a natural bound (a
track, a day) are ordinary windows; a group without one is cut into slices of
neighbouring rows by an expression of the row, and each slice carries a copy of the
few rows just outside it that its frames reach. Which form is taken depends on the
call, never on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_SLICE = "__slice"
_HALO = "__halo"
_EDGE = "__edge"


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join in which NULL keys meet each other; the right key columns are dropped.

    Without keys ``right`` must be one row, as an aggregate without groups is.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    if not keys:
        return left.crossJoin(F.broadcast(renamed))
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def _carried(
    cut: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int, backwards: bool
) -> DataFrame:
    """The ``reach`` rows next to each slice, labelled with that slice."""
    columns = [c for c in cut.columns if c != _SLICE]
    direction = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    nearest = Window.partitionBy(*keys, _SLICE).orderBy(*direction)
    entry = F.struct(
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        F.struct(*columns).alias("row"),
    )
    edges = (
        cut.withColumn("__rn", F.row_number().over(nearest))
        .where(F.col("__rn") <= reach)
        .groupBy(*keys, _SLICE)
        .agg(F.sort_array(F.collect_list(entry)).alias(_EDGE))
    )
    # every slice holds a row, so `reach` neighbouring slices hold enough of them
    span = Window.partitionBy(*keys).orderBy(_SLICE)
    span = span.rowsBetween(-reach, -1) if backwards else span.rowsBetween(1, reach)
    near = F.flatten(F.collect_list(_EDGE).over(span))
    first = F.greatest(F.size("__near") - reach + 1, F.lit(1)) if backwards else F.lit(1)
    return (
        edges.withColumn("__near", near)
        .select(_SLICE, F.explode(F.slice("__near", first, reach)).alias("__e"))
        .select(*[F.col(f"__e.row.{c}").alias(c) for c in columns], _SLICE)
    )


def _over_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int,
    after: int,
    slice_by: Column,
) -> DataFrame:
    cut = df.withColumn(_SLICE, slice_by)
    framed = cut.withColumn(_HALO, F.lit(False))
    for reach, backwards in ((before, True), (after, False)):
        if reach:
            extra = _carried(cut, keys, order, reach, backwards)
            framed = framed.unionByName(extra.withColumn(_HALO, F.lit(True)))
    window = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    return compute(framed, window).where(~F.col(_HALO)).drop(_HALO, _SLICE)


def over_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    slice_by: Column | None = None,
) -> DataFrame:
    """Add columns from row frames over ``keys`` ordered by ``order``.

    ``compute(frame, window)`` adds columns with ``lag``, ``lead`` or
    ``rowsBetween`` frames that reach at most ``before`` rows back and ``after``
    rows ahead, counting what nested expressions need. ``order`` must be unique
    within a group. Give ``slice_by`` where a group can grow without bound: a
    column that never falls along ``order`` and is equal for a bounded number of rows.
    """
    if slice_by is None:
        return compute(df, Window.partitionBy(*keys).orderBy(*order))
    return _over_slices(df, keys, order, compute, before, after, slice_by)


def gather_totals(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]
) -> DataFrame:
    """Attach group aggregates to the rows."""
    return null_safe_join(df, df.groupBy(*keys).agg(*aggregates), keys)
