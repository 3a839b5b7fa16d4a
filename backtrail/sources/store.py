"""The track store: revised in place by partition, or bucketed so that joins by event need no exchange."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.session import drop_scratch, scratch_path


def _in_folders(names: Sequence[str], folders: Sequence[tuple]) -> Column:
    """Rows of some partitions, as a test that prunes folders."""
    parts = [reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.lit(v)) for n, v in zip(names, f)]) for f in folders]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def revise_store(spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str], listed: DataFrame,
                 corrected: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """Take the rows of the listed keys out of a partitioned store and put the corrected rows in.

    Only the partitions that hold a listed key or receive a corrected row are written anew;
    the files of all others stay as they are. What the new partitions hold is written aside
    first, so that an attempt that breaks off can be made again; a partition that is left
    without rows is removed. Corrected rows of a key that is not listed are added. Returns
    the partitions that were touched (the driver lists the folders of a store in any case).
    """
    current = spark.read.schema(schema).parquet(path)
    out = listed.select(*keys).distinct()
    held = current.join(out, list(keys), "left_semi").select(*partition_by)
    touched = [tuple(r) for r in held.unionByName(corrected.select(*partition_by)).distinct().collect()]
    if not touched:
        return []
    kept = current.where(_in_folders(partition_by, touched)).join(out, list(keys), "left_anti")
    aside = scratch_path(spark, "revision")
    kept.select(*schema.names).unionByName(corrected.select(*schema.names)).write.parquet(aside)
    fresh = spark.read.schema(schema).parquet(aside)
    filled = {tuple(r) for r in fresh.select(*partition_by).distinct().collect()}
    fresh.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by).parquet(path)
    for folder in set(touched) - filled:
        names = [f"{n}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for n, v in zip(partition_by, folder)]
        drop_scratch(spark, os.path.join(path, *names))
    drop_scratch(spark, aside)
    return touched


def bucketed(df: DataFrame, key: str, buckets: int, order: Sequence[str] = (), label: str = "store") -> DataFrame:
    """Write rows in buckets of a key, sorted within them, as a table that goes with the session.

    Tables in as many buckets of the same key are joined, windowed and grouped by it, or by
    it and more, without an exchange. Each bucket is one file, so ``buckets`` follows the
    size of the data: the tasks that read the table are as many.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(*(order or [key]))
    writer.option("path", scratch_path(spark, label)).saveAsTable(name)
    atexit.register(_drop_table, spark, name)
    return spark.table(name)


def _drop_table(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
