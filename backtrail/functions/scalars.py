"""Calendar, isotope and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season names in their order, and the months of each.
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Autumn": (9, 10, 11),
}
SEASONS = tuple(SEASON_MONTHS)
# Month names in the order used for reports.
MONTH_NAMES = ("Dec", "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov")
# Local water line (slope, intercept) and global water line slope.
LOCAL_LINE = (7.46, 5.99)
GLOBAL_SLOPE = 8


def excess_local(dd: Column, do: Column) -> Column:
    slope, intercept = LOCAL_LINE
    return dd - F.lit(slope) * do - F.lit(intercept)


def excess_global(dd: Column, do: Column) -> Column:
    return dd - F.lit(GLOBAL_SLOPE) * do


def _seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two zone-less timestamps, whatever the session time zone."""
    return (end - start).cast("interval second").cast("long")


def midpoint(start: Column, end: Column) -> Column:
    """Moment half way between two timestamps, rounded up to whole seconds."""
    return F.timestamp_add("SECOND", F.ceil(_seconds(start, end) / 2), start)


def duration_hours(start: Column, end: Column) -> Column:
    """Length in hours, a started hour counting in full."""
    return F.ceil(_seconds(start, end) / 3600)


def season(date: Column) -> Column:
    """Season of a date; a missing date counts as winter."""
    month = F.month(date)
    label = None
    for name in ("Spring", "Summer", "Autumn"):
        hit = month.isin(*SEASON_MONTHS[name])
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise("Winter")


def month_name(date: Column) -> Column:
    return F.date_format(date, "MMM")


def ordinal(label: Column, levels: tuple[str, ...]) -> Column:
    """Position of a label in an ordered list of levels, from 1; NULL when it is not in it."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), label), F.lit(0)).cast("int")


def rounded(x: Column, digits: int) -> Column:
    """Presentation rounding, half to even."""
    return F.bround(x, digits)


def _text(x: Column, digits: int) -> Column:
    return rounded(x, digits).cast("string")


# The texts of the figure labels below.
def line_label(intercept: Column, slope: Column, r_squared: Column) -> Column:
    return F.concat(
        F.lit("d²H = "), _text(intercept, 2), F.lit(" + "), _text(slope, 2), F.lit(" * d¹⁸O"),
        F.lit("\nR² = "), _text(r_squared, 2),
    )


def offset_label(sigma: Column, offset: Column) -> Column:
    return F.concat(
        F.lit("RMSE = "), _text(sigma, 2), F.lit(" ‰\nOffset = "), _text(offset, 2), F.lit(" ‰")
    )


def fit_label(r_squared: Column, sigma: Column) -> Column:
    return F.concat(F.lit("R² = "), _text(r_squared, 2), F.lit("\nRMSE = "), _text(sigma, 1), F.lit(" ‰"))


def count_label(n: Column) -> Column:
    """"N = 12"; whole numbers carry no decimals."""
    whole = n == F.floor(n)
    return F.concat(
        F.lit("N = "), F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string"))
    )
