"""Numbers along an order over a whole table, without bringing its rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.session import scratch_path


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number", total: str | None = None) -> DataFrame:
    """Add the place of each row, from 1, in the given order; ``total`` adds the number of rows.

    Rows go to ranges of the order, cut where a sample says, and are sorted within each;
    a place is the rows of the ranges before plus the place within. The sorted rows are
    written once, so that a task that runs again finds the same ones; only a count for
    each range comes to the driver. Rows that the order does not tell apart get
    neighbouring places, which one first is not defined.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(ranges, *columns).sortWithinPartitions(*columns).withColumn(
        "__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))
    sizes = sorted(rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).collect())
    offsets, before = [], 0
    for size in sizes:
        offsets.append((size["__range"], before + 1 - size["first"]))
        before += size["n"]
    starts = spark.createDataFrame(offsets, "__range long, __offset long")  # one row for each range
    placed = rows.join(F.broadcast(starts), "__range").withColumn(name, F.col("__at") + F.col("__offset"))
    out = placed.drop("__range", "__at", "__offset")
    return out.withColumn(total, F.lit(before).cast("long")) if total else out
