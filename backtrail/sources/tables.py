"""Reading and writing the event, weather and track tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.functions.semantics import nan_to_null
from backtrail.sources.schemas import EVENTS, TRACKS, WEATHER

MISSING = "NA"


def _read(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, kind: str, **options
) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    if kind == "parquet":
        return nan_to_null(spark.read.schema(schema).parquet(*paths))
    if kind != "csv":
        raise ValueError(f"unknown kind {kind!r}")
    # Days and moments are read as text: files hold both "2020-01-31" and "2020-01-31 06:00:00".
    timed = {f.name: f.dataType for f in schema if isinstance(f.dataType, (T.TimestampNTZType, T.DateType))}
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name in timed else f.dataType) for f in schema])
    df = spark.read.schema(text).csv(
        paths, header=True, enforceSchema=True, nullValue=MISSING, nanValue="NaN", mode="FAILFAST", **options
    )
    return nan_to_null(df.withColumns({n: F.col(n).cast(t) for n, t in timed.items()}) if timed else df)


def read_events(spark: SparkSession, path: str | Sequence[str], kind: str = "csv") -> DataFrame:
    """Event table; rows without a start are left out. Columns are taken by position."""
    return _read(spark, path, EVENTS, kind).na.drop(subset=["start"])


def read_weather(spark: SparkSession, path: str | Sequence[str], kind: str = "csv") -> DataFrame:
    return _read(spark, path, WEATHER, kind)


def read_tracks(
    spark: SparkSession, path: str | Sequence[str], kind: str = "csv", row_names: bool = True
) -> DataFrame:
    """Track points.

    With ``row_names`` each CSV row starts with a row number that the header
    does not mention, so the header must not decide which column is which.
    """
    if kind == "csv" and row_names:
        named = T.StructType([T.StructField("rownum", T.StringType()), *TRACKS.fields])
        return _read(spark, path, named, kind).drop("rownum")
    return _read(spark, path, TRACKS, kind)


def load_ensemble(
    spark: SparkSession, paths: Mapping[float, str], kind: str = "csv", row_names: bool = True
) -> DataFrame:
    """All per-height track files as one table, with the height of each file."""
    parts = [
        read_tracks(spark, path, kind, row_names).withColumn("height_i", F.lit(float(height)))
        for height, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def ensemble(parts: Mapping[float, DataFrame]) -> DataFrame:
    """Union of per-height tables."""
    labelled = [df.withColumn("height_i", F.lit(float(h))) for h, df in parts.items()]
    return reduce(DataFrame.unionByName, labelled)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Comma separated, with a header, no row names; missing values as ``NA``."""
    df.write.mode(mode).csv(path, header=True, nullValue=MISSING, emptyValue="")


def write_tracks(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Track store: parquet with one folder per arrival height."""
    df.write.mode(mode).partitionBy("height_i").parquet(path)


def materialise(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a costly stage once and go on from the written table."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)
