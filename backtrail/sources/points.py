"""A store of points along a space-filling curve, so that a view reads only the folders it meets."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.functions.geo import in_view

#: Bits of a coordinate along the curve, and those that name a folder: 2 ** (2 * CELL_BITS) folders over the whole earth.
PLACE_BITS, CELL_BITS = 16, 5

# Steps that put a zero bit before each bit of a number of 16 bits: shift, mask.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(x: Column) -> Column:
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def curve_place(lat: Column, lon: Column) -> Column:
    """Place of a point on the curve that visits quarter after quarter: bits of latitude and longitude in turn."""
    steps = 1 << PLACE_BITS

    def step(share: Column) -> Column:
        return F.greatest(F.least(F.floor(share * steps), F.lit(steps - 1)), F.lit(0)).cast("long")

    code = _spread(step((lon + 180) / 360)).bitwiseOR(F.shiftleft(_spread(step((lat + 90) / 180)), 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), code)


def write_points(df: DataFrame, path: str, lat: str = "lat", lon: str = "lon", mode: str = "errorifexists") -> None:
    """Write points in folders by cell of the curve, in its order within each; points without a place in a folder of their own."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__place", curve_place(F.col(lat), F.col(lon)))
    placed = placed.withColumn("cell", F.shiftright("__place", 2 * (PLACE_BITS - CELL_BITS)).cast("int"))
    placed.repartitionByRange(ranges, "__place").sortWithinPartitions("cell", "__place").drop("__place").write.mode(mode).partitionBy(
        "cell").parquet(path)


def cells_of_view(south: float, north: float, west: float, east: float) -> list[int]:
    """Cells that a view meets."""
    steps = 1 << CELL_BITS

    def reach(low: float, high: float, width: float) -> range:
        ends = [min(max(floor((x + width / 2) / width * steps), 0), steps - 1) for x in (low, high)]
        return range(ends[0], ends[1] + 1)

    def code(x: int, y: int) -> int:
        return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(CELL_BITS))

    return sorted(code(x, y) for x in reach(west, east, 360) for y in reach(south, north, 180))


def read_view(spark: SparkSession, path: str, schema: T.StructType, view: tuple[float, float, float, float],
              lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points of a view (south, north, west, east) from a store; folders outside it are not opened.

    Within a folder the order of the curve keeps near points together, so that parts of
    a file whose coordinates lie outside are passed over as well.
    """
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())])).parquet(path)
    near = stored.where(F.col("cell").isin(cells_of_view(*view)))
    return near.where(in_view(F.col(lat), F.col(lon), *view)).select(*schema.names)
