import pytest
from pyspark.sql import functions as F

from backtrail.operators.order import numbered


def test_places_follow_the_order_and_leave_no_gap(spark):
    rows = spark.range(5000, numPartitions=7).select(
        F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1000).alias("a"), (F.col("id") * 31 % 17).alias("b"), "id")
    got = numbered(rows.withColumn("__x", F.lit(1)), [F.asc_nulls_last("a"), F.desc("b"), "id"], total="n").collect()
    wanted = sorted(got, key=lambda r: (r["a"] is None, r["a"] or 0, -r["b"], r["id"]))
    assert [r["number"] for r in wanted] == list(range(1, 5001)) and {r["n"] for r in got} == {5000}


@pytest.mark.parametrize("count", [0, 1])
def test_hardly_any_rows(spark, count):
    assert [r["number"] for r in numbered(spark.range(count), ["id"]).collect()] == [1] * count


def test_ties_get_neighbouring_places_and_no_row_is_sorted_alone(spark):
    rows = spark.range(3000, numPartitions=5).select((F.col("id") % 2).alias("k"))
    out = numbered(rows, ["k"])
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    places = {k: sorted(r["number"] for r in out.where(F.col("k") == k).collect()) for k in (0, 1)}
    assert places == {0: list(range(1, 1501)), 1: list(range(1501, 3001))}
