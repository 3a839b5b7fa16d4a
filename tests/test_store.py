"""Stores that are revised in place, bucketed tables, and stages that are written once."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from backtrail.plans import table_queries
from backtrail.session import session_folder
from backtrail.sources import stages, store

SF_DIR = "/root/testdata/sf0.001"
BY = ["height_i", "block"]


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names
            if f.startswith("part-")}


@pytest.fixture()
def kept(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 20).alias("index"), (F.col("id") % 3 * 500.0).alias("height_i"),
                                   F.col("id").alias("q"), (F.col("id") % 20 % 5).cast("int").alias("block"))
    path = str(tmp_path / "store")
    rows.repartition(1).write.partitionBy(*BY).parquet(path)
    return rows, path


def test_only_touched_partitions_are_written(spark, frame, kept):
    rows, path = kept
    before = files_of(path)
    listed = frame([(3,), (3,), (8,), (99,)], "index long")
    corrected = frame([(3, 500.0, -1, 3), (77, 500.0, -2, 2)], rows.schema)
    touched = store.revise_store(spark, path, rows.schema, BY, listed, corrected, ["index"])
    assert set(touched) == {(h, 3) for h in (0.0, 500.0, 1000.0)} | {(500.0, 2)}
    got = sorted(map(tuple, spark.read.schema(rows.schema).parquet(path).select(*rows.columns).collect()))
    assert got == sorted([tuple(r) for r in rows.collect() if r["index"] not in (3, 8)] + [tuple(r) for r in corrected.collect()])
    after = files_of(path)
    same = {f for f in before if not any(f"height_i={h}{os.sep}block={b}{os.sep}" in f for h, b in touched)}
    assert len(same) == 11 and all(after.get(f) == before[f] for f in same)


def test_a_partition_without_rows_is_removed_and_no_change_is_none(spark, frame, kept):
    rows, path = kept
    of_block = rows.where("block = 4").select("index")
    store.revise_store(spark, path, rows.schema, BY, of_block, rows.limit(0), ["index"])
    assert not any("block=4" in f for f in files_of(path))
    assert spark.read.schema(rows.schema).parquet(path).count() == rows.where("block <> 4").count()
    before = files_of(path)
    assert store.revise_store(spark, path, rows.schema, BY, frame([(500,)], "index long"), rows.limit(0), ["index"]) == []
    assert files_of(path) == before


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_bucketed_tables_meet_without_exchange(spark):
    points, sites = table_queries.bucketed_tracks(spark, SF_DIR), table_queries.bucketed_sites(spark, SF_DIR)
    for build in (table_queries.stored_origins, table_queries.stored_sweep):
        out = build(points, sites.hint("merge"))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_the_same_plan_is_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).write.parquet(path)

    def stage():
        return stages.settled(spark.read.parquet(path).groupBy((F.col("id") % 7).alias("k")).count(), "counts")

    first, again = stage(), stage()
    assert first.inputFiles() == again.inputFiles() and first.count() == 7
    other = stages.settled(spark.read.parquet(path).groupBy((F.col("id") % 5).alias("k")).count(), "counts")
    assert other.inputFiles() != first.inputFiles() and other.count() == 5
    spark.range(60).write.mode("overwrite").parquet(path)
    assert stage().inputFiles() != first.inputFiles() and stage().agg(F.sum("count")).first()[0] == 60
    assert all(f.removeprefix("file://").startswith(session_folder(spark)) for f in first.inputFiles())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_no_folder_is_left_behind(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "{tmp_path}/shared").config(
    "spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from backtrail.plans.catalog import all_queries
from backtrail.session import cut_lineage
from backtrail.sources import stages
written = []
for name in ("event_anomalies", "rolling_composite_year"):
    all_queries()[name].run(spark, "{SF_DIR}").count()
    written.append(sum(map(len, stages._WRITTEN.values())))
cut_lineage(spark.range(5)).count()
import os
assert written[0] == written[1] == 2, written
assert sum(map(len, map(os.listdir, [os.path.join("{tmp_path}/shared", f) for f in os.listdir("{tmp_path}/shared")]))) > 0
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.listdir(tmp_path / "shared") == []
