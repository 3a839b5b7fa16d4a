"""Deliveries of files of which some rows, or whole files, may be broken: read on, and say what was lost."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.functions.semantics import nan_to_null
from backtrail.sources.tables import MISSING

#: Kinds of fault: a row with too few or too many fields or a value that is not of its type; a
#: day or moment that is none; a row that states another delivery than the one it came in.
FAULTS = ("record", "moment", "place")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_delivery(spark: SparkSession, path: str | list[str], schema: T.StructType, row_names: bool = False,
                  header: bool = True, misplaced: Column | None = None) -> DataFrame:
    """Every row of the files: the columns of ``schema``, ``file``, ``fault`` and ``line``.

    ``fault`` is NULL for a good row, else one of ``FAULTS``; ``line`` is the row as it
    stands in the file, or its fields. The columns of a faulty row hold what could be read.
    With ``row_names`` each row begins with a number that the header does not name.
    ``misplaced`` tests a row for standing in the wrong file (it may use ``file``). A file
    that breaks off is read up to there.
    """
    timed = {f.name: f.dataType for f in schema if isinstance(f.dataType, (T.TimestampNTZType, T.DateType))}
    fields = [T.StructField(f.name, T.StringType() if f.name in timed else f.dataType) for f in schema]
    named = [T.StructField("__row", T.StringType())] * row_names + fields
    raw = spark.read.schema(T.StructType([*named, T.StructField("__line", T.StringType())])).options(
        header=header, enforceSchema=True, nullValue=MISSING, nanValue="NaN", mode="PERMISSIVE",
        columnNameOfCorruptRecord="__line",
        columnPruning=False,
        ignoreCorruptFiles=True, ignoreMissingFiles=True,
    ).csv(path)
    told = raw.select(*[f.name for f in fields], "__line", F.col("_metadata.file_path").alias("file"))
    read = {n: F.col(n).try_cast(t) for n, t in timed.items()}
    lost = F.lit(False)
    for name, moment in read.items():
        lost = lost | (F.col(name).isNotNull() & moment.isNull())
    # a value is only looked at if its column is asked for: this test, never true, asks for all of them
    asked = F.hash(*[f.name for f in fields]).bitwiseAND(F.lit(0)) != 0
    fault = F.when(F.col("__line").isNotNull() | asked, "record").when(lost, "moment")
    whole = F.to_csv(F.struct(*[F.col(f.name) for f in fields]), {"nullValue": MISSING})
    marked = told.withColumn("fault", fault).withColumn("line", F.when(F.col("fault").isNotNull(), F.coalesce("__line", whole)))
    marked = nan_to_null(marked.withColumns(read).drop("__line"))
    if misplaced is None:
        return marked
    wrong = F.col("fault").isNull() & F.coalesce(misplaced, F.lit(True))
    return marked.withColumns({
        "line": F.when(wrong, F.to_csv(F.struct(*schema.names), {"nullValue": MISSING})).otherwise(F.col("line")),
        "fault": F.when(wrong, "place").otherwise(F.col("fault")),
    })


@dataclass(frozen=True)
class Delivery:
    """``good``: the rows without a fault; ``bad``: delivery, file, fault and line of the others;
    ``audit``: rows of each expected delivery, one that did not come included."""

    good: DataFrame
    bad: DataFrame
    audit: DataFrame


def folder_of(file: str = "file") -> Column:
    """Name of the folder that a file lies in."""
    return F.element_at(F.split(F.col(file), "/"), -2)


def accept(spark: SparkSession, expected: Mapping[str, str], schema: T.StructType, home: str, row_names: bool = False,
           header: bool = True, misplaced: Column | None = None) -> Delivery:
    """Read the expected deliveries (name to folder), route their rows, and count what came.

    The files are read once: rows go to one folder of ``home`` for the good and one for the
    others. A folder's last part is its name in ``expected``. A delivery that is missing, or
    has no readable row, is in the audit with zeros. The audit has ``delivery``, ``rows``,
    ``good`` and a count for each kind of fault.
    """
    wrong = {n: p for n, p in expected.items() if os.path.basename(p.rstrip("/")) != n}
    if wrong:
        raise ValueError(f"folders are not named as their deliveries: {wrong}")
    came = [p for p in expected.values() if _exists(spark, p)]
    rows = os.path.join(home, "rows")
    if came:
        read = read_delivery(spark, came, schema, row_names, header, misplaced)
        read.withColumn("delivery", folder_of()).withColumn("sound", F.col("fault").isNull()).write.partitionBy("sound").parquet(rows)
    text = T.StringType()
    stored = T.StructType([*schema.fields, *(T.StructField(n, text) for n in ("file", "fault", "line", "delivery")),
                           T.StructField("sound", T.BooleanType())])
    written = spark.read.schema(stored).parquet(rows) if came else spark.createDataFrame([], stored)
    counts = written.groupBy("delivery").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("sound").alias("good"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS])
    names = spark.createDataFrame([(n,) for n in expected], "delivery string")
    audit = names.join(counts, "delivery", "left").fillna(0)
    return Delivery(written.where("sound").select(*schema.names),
                    written.where("not sound").select("delivery", "file", "fault", "line"), audit)
