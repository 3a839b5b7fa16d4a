"""What several operators of this subpackage share: input, number of parts, places in an order."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from backtrail.session import cut_lineage

#: White space that separates words: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str = "doc_id") -> Column:
    """Unsigned crc32 of an id as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def hot_keys(rows: DataFrame, key: Sequence[str], share: int = 500) -> list[tuple]:
    """Keys that hold over 1/``share`` of all rows: fewer than ``share`` by arithmetic."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    found = counts.where(F.col("__n") * share > F.lit(total)).select(*key).collect()
    return [tuple(r) for r in found]


def with_place(rows: DataFrame, group: Sequence[str], order: Sequence[Column], spread: Column, buckets: int,
               name: str = "place") -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large a group is.

    Rows are first put into ``buckets`` by ``spread`` (a non-negative whole number);
    the place is the count of the buckets before, plus the place in the own bucket,
    where ``order`` decides. Only counts per bucket are ever sorted by group.
    """
    dealt = cut_lineage(rows.withColumn("__bucket", F.pmod(spread, F.lit(buckets)).cast("long")))
    sizes = dealt.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__in"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "__bucket", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*group, "__bucket").orderBy(*order)
    placed = dealt.withColumn("__row", F.row_number().over(within) - 1)
    return placed.join(starts, [*group, "__bucket"]).withColumn(
        name, (F.col("__start") + F.col("__row")).cast("long")).drop("__bucket", "__row", "__start")


def slot_bits(slots: DataFrame, size: int) -> np.ndarray:
    """Map of the whole numbers in the only column, 0 to ``size`` - 1 (a power of two): ``size`` / 8 bytes."""
    name = slots.columns[0]
    maps = slots.select((F.col(name) + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for bucket, part in maps.toLocalIterator():
        room = bits[(bucket - 1) * len(part):bucket * len(part)]
        room[:] = np.frombuffer(part, np.uint8)[:len(room)]
    return bits


def key_filter(keys: DataFrame, most_bits: int = 1 << 28) -> Callable[[Column], Column]:
    """A test that is true for all longs in the only column of ``keys`` and for few others.

    16 bits are kept for each key, ``most_bits`` (32 MB) at most; with more keys than
    those serve, the test lets more others pass and is never false for a key.
    """
    size = min(most_bits, 1 << (16 * keys.count() + (1 << 15)).bit_length())

    def slot(column: Column | str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(size))

    shared = keys.sparkSession.sparkContext.broadcast(slot_bits(keys.select(slot(keys.columns[0]).alias("slot")), size))

    @F.pandas_udf("boolean")
    def taken(slots: pd.Series) -> pd.Series:
        place = slots.to_numpy()
        return pd.Series((shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)

    return lambda column: taken(slot(column))
