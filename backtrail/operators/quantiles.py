"""Grouped summaries with exact quantiles, by one algorithm for groups of any size.

A wanted rank lies between two values that a mergeable sketch of the group names, a few
thousandths of the group apart. The values between them are counted by value, those
below by one number, and a running count over these few gives the value at the rank.
If a group is so large that still more values lie between than one task should sort,
the values between are cut again at splitters of equal depth, as often as it takes: how
often follows from the size of the largest group and the error of the sketch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backtrail.operators.skew import null_safe_join
from backtrail.session import cut_lineage

QUARTILES = (0.25, 0.5, 0.75)
#: The sketch is off by 1/ACCURACY of a group; a rank is looked for MARGIN times as far on either side.
ACCURACY, MARGIN = 10_000, 4
#: Splitters of equal depth of a further cut.
SPLITTERS = 256
#: Values of a group that one task sorts at most, ties as one.
MOST = 1 << 20
#: Groups that are sent to the rows to be tested there; more are met by a join.
FEW_GROUPS = 50_000

_MEASURE, _RANK, _VALUE = "__measure", "__rank", "__value"


def _beside(rows: DataFrame, bounds: DataFrame, groups: int, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(rows, F.broadcast(bounds) if groups <= FEW_GROUPS else bounds, keys)


def _bounds(x: Column, probs: Sequence[float], accuracy: int) -> tuple[list[Column], list[Column]]:
    """Values of a group on either side of each rank and the next: near ones in a large group, wider ones in a small."""
    steps = [MARGIN / accuracy * 10 ** k for k in range(4)]
    asked = [(p, side, step) for p in probs for side in (-1, 1) for step in steps if 0 < p + side * step < 1]
    near = F.percentile_approx(x, [p + side * step for p, side, step in asked] or [0.5], accuracy)
    ends = {-1: F.min(x), 1: F.max(x)}

    def bound(p: float, side: int) -> Column:
        out = ends[side]
        for step in reversed(steps):  # a step is taken if it spans three ranks beside the error of the sketch
            at = near[asked.index((p, side, step))] if (p, side, step) in asked else ends[side]
            out = F.when(F.count(x) * (step - 2 / accuracy) >= 3, at).otherwise(out)
        return out

    return [bound(p, -1) for p in probs], [bound(p, 1) for p in probs]


def _cells(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts by value of what lies between the bounds, and one (value NULL) of what lies below."""
    return rows.groupBy(*group, _VALUE).agg(F.count(F.lit(1)).alias("n"))


def _cut_again(rows: DataFrame, wanted: DataFrame, group: Sequence[str], groups: int, accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Rows between the splitters around a rank (value NULL: below them), and the rank among all that is left."""
    grid = [k / SPLITTERS for k in range(SPLITTERS + 1)]
    inside = rows.where(F.col(_VALUE).isNotNull())
    sketch = inside.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__size"), F.percentile_approx(_VALUE, grid, accuracy).alias("__s"))
    below = rows.where(F.col(_VALUE).isNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("__below"))
    at = null_safe_join(null_safe_join(wanted, sketch, group), below, group, "left").withColumn(
        "at", F.col("at") - F.coalesce("__below", F.lit(0))).drop("__below")
    depth = F.col("at") / F.col("__size") * SPLITTERS
    reach = MARGIN * SPLITTERS / accuracy
    first, last = F.floor(depth - reach) - 1, F.ceil(depth + reach + SPLITTERS / F.col("__size")) + 1
    bounds = at.select(
        *group, F.when(first >= 0, F.get("__s", first.cast("int"))).alias("__low"),
        F.when(last <= SPLITTERS, F.get("__s", last.cast("int"))).alias("__high"))
    near = _beside(inside, bounds, groups, group).where(F.col("__high").isNull() | (F.col(_VALUE) <= F.col("__high")))
    value = F.when(F.col("__low").isNull() | (F.col(_VALUE) >= F.col("__low")), F.col(_VALUE))
    return near.select(*group, value.alias(_VALUE)), at.drop("__size", "__s")


def _quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], base: DataFrame,
               accuracy: int, most: int) -> DataFrame:
    """One row per group with an array column ``__q_<column>`` per measure."""
    sizes = base.agg(F.count(F.lit(1)).alias("groups"), F.max(F.greatest(F.lit(0), *[f"__n_{c}" for c in columns])).alias("n")).first()
    groups, largest = sizes["groups"], sizes["n"] or 0
    bounds = base.select(*keys, *[f"__{x}_{c}" for c in columns for x in ("low", "high")])
    tests = F.array(*[
        F.struct(F.lit(m).alias(_MEASURE), F.lit(i).alias(_RANK), F.col(c).cast("double").alias(_VALUE),
                 F.col(f"__low_{c}")[i].alias("low"), F.col(f"__high_{c}")[i].alias("high"))
        for m, c in enumerate(columns) for i in range(len(probs))])
    value = F.when(F.col(_VALUE) >= F.col("low"), F.col(_VALUE))
    rows = _beside(df.select(*dict.fromkeys([*keys, *columns])), bounds, groups, keys).select(
        *keys, F.inline(tests)).where(F.col(_VALUE) <= F.col("high")).select(*keys, _MEASURE, _RANK, value.alias(_VALUE))
    group = [*keys, _MEASURE, _RANK]
    ranks = F.array(*[
        F.struct(F.lit(m).alias(_MEASURE), F.lit(i).alias(_RANK), F.col(f"__n_{c}").alias("size"),
                 ((F.col(f"__n_{c}") - 1) * F.lit(float(p))).alias("rank"))
        for m, c in enumerate(columns) for i, p in enumerate(probs)])
    asked = base.select(*keys, F.inline(ranks)).where("size > 0").withColumn("at", F.floor("rank"))
    left = largest * 2 * (MARGIN + 1) / accuracy
    shrink = (4 + 2 * MARGIN * SPLITTERS / accuracy) / SPLITTERS + 2 / accuracy
    for _ in range(ceil(log(left / most) / -log(shrink)) if left > most else 0):
        held = cut_lineage(rows)
        rows, asked = _cut_again(held, asked, group, groups * len(columns) * len(probs), accuracy)
    cells = _cells(rows, group)
    run = Window.partitionBy(*group).orderBy(F.col(_VALUE).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.withColumn("upto", F.sum("n").over(run)).withColumn("from", F.col("upto") - F.col("n"))
    met = _beside(counted, asked, groups * len(columns) * len(probs), group)

    def at(step: int) -> Column:
        place = F.least(F.col("at") + step, F.col("at") + F.ceil(F.col("rank")) - F.floor(F.col("rank")))
        return F.max(F.when(place.between(F.col("from"), F.col("upto") - 1), F.col(_VALUE)))

    part = F.first("rank") - F.floor(F.first("rank"))
    found = met.groupBy(*group).agg(at(0).alias("a"), at(1).alias("b"), part.alias("part"))
    checked = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a rank lies outside its bounds"))).otherwise(
        F.col("a") + F.col("part") * (F.col("b") - F.col("a")))
    return found.withColumn("value", checked).groupBy(*keys).agg(*[
        F.array(*[F.max(F.when((F.col(_MEASURE) == m) & (F.col(_RANK) == i), F.col("value"))) for i in range(len(probs))])
        .alias(f"__q_{c}") for m, c in enumerate(columns)
    ])


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, Column],
    medians: Mapping[str, str] | None = None,
    iqrs: Mapping[str, str] | None = None,
    quantiles: Mapping[str, tuple[str, float]] | None = None,
    accuracy: int = ACCURACY,
    most: int = MOST,
) -> DataFrame:
    """Plain aggregates and exact quantiles of each group, one row per group.

    ``medians`` and ``iqrs`` map an output name to a column, ``quantiles`` to a
    column and a probability. Quantiles interpolate between order statistics; values
    are finite. The rows are read twice: for the aggregates, counts and sketches of all
    groups, which are written, and for the values near the wanted ranks.
    """
    medians, iqrs, quantiles = medians or {}, iqrs or {}, quantiles or {}
    asked = {p for _, p in quantiles.values()} | ({0.5} if medians else set()) | ({0.25, 0.75} if iqrs else set())
    probs = tuple(sorted(asked))
    columns = sorted({*medians.values(), *iqrs.values(), *(c for c, _ in quantiles.values())})
    sketched = []
    for c in columns:
        low, high = _bounds(F.col(c).cast("double"), probs, accuracy)
        sketched += [F.count(c).alias(f"__n_{c}"), F.array(*low).alias(f"__low_{c}"), F.array(*high).alias(f"__high_{c}")]
    # the marker keeps the list non-empty when only quantiles are asked for
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *[c.alias(n) for n, c in aggregates.items()], *sketched)

    def picked(column: str, p: float) -> Column:
        return F.col(f"__q_{column}")[probs.index(p)]

    if columns:
        base = cut_lineage(base)
        base = null_safe_join(base, _quantiles(df, keys, columns, probs, base, accuracy, most), keys, "left")
    out = [F.col(k) for k in keys] + [F.col(name) for name in aggregates]
    out += [picked(c, 0.5).alias(name) for name, c in medians.items()]
    out += [(picked(c, 0.75) - picked(c, 0.25)).alias(name) for name, c in iqrs.items()]
    out += [picked(c, p).alias(name) for name, (c, p) in quantiles.items()]
    return base.select(*out)
