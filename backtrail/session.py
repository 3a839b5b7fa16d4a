"""Session helpers: where checkpoints go, and a local session for tests and timing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_FOLDERS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder shared by all executors, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder on this machine; on a cluster
    a missing setting is an error, since a lost executor could not be replaced.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        folder = tempfile.mkdtemp(prefix="backtrail-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # what was written goes with the session
        _LOCAL_ROOTS[context.applicationId] = folder
    return _LOCAL_ROOTS[context.applicationId]


def _removed_at_end(spark: SparkSession, path: str) -> None:
    """Make a folder, on whichever file system it lies, that goes when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)


def session_folder(spark: SparkSession) -> str:
    """The folder of this session under the checkpoint folder; it is removed when the driver ends."""
    name = spark.sparkContext.applicationId
    if name not in _FOLDERS:
        folder = os.path.join(checkpoint_root(spark), f"backtrail-{name}")
        _removed_at_end(spark, folder)
        _FOLDERS[name] = folder
    return _FOLDERS[name]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a retry reads the same rows instead of recomputing them."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        context.setCheckpointDir(session_folder(spark))
    elif folder not in _FOLDERS.values():  # Spark has made it for this session, from the setting
        _removed_at_end(spark, folder)
        _FOLDERS[folder] = folder
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder for a stage that is written once and read back; it goes with the session."""
    return os.path.join(session_folder(spark), f"{label}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder under the checkpoint folder, wherever that lies; a missing one is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def local_session(cpus: int = 8, name: str = "backtrail") -> SparkSession:
    """Session for tests and timing on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BACKTRAIL_DRIVER_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
