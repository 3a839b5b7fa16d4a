import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.operators import quantiles
from backtrail.operators.quantiles import summarise
from backtrail.operators.skew import gather_totals, null_safe_join, over_ordered


@pytest.fixture(scope="module")
def log(spark):
    """One key holds a third of the rows, one key is NULL, the rest is spread out."""
    rng = np.random.default_rng(7)
    keys = [0] * 400 + [None] * 30 + [int(k) for k in rng.integers(1, 60, 770)]
    rows = [(k, i, float(np.round(v, 2))) for i, (k, v) in enumerate(zip(keys, rng.normal(0, 5, len(keys))))]
    rng.shuffle(rows)
    rows = [(None if k is None or k != k else int(k), int(i), float(v)) for k, i, v in rows]
    return spark.createDataFrame(rows, "k long, i long, v double").repartition(5).cache()


def frames(frame, window):
    near = window.rowsBetween(-3, 2)
    return frame.withColumns({
        "prev": F.lag("v").over(window), "next": F.lead("v").over(window),
        "near": F.sum("v").over(near), "n": F.count(F.lit(1)).over(near),
    })


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("rows", [3, 100])
def test_sliced_windows_equal_plain_windows(log, keys, rows):
    def run(slice_by):
        out = over_ordered(log, keys, ["i"], frames, before=3, after=2, slice_by=slice_by)
        return sorted(
            (r.i, r.prev, r.next, round(r.near, 6), r.n) for r in out.collect()
        )

    assert run(None) == run(F.floor(F.col("i") / rows))


@pytest.mark.parametrize("accuracy,most", [(10_000, 1 << 20), (200, 1 << 20), (200, 2), (30, 10)])
def test_exact_quantiles_for_small_and_large_groups(log, accuracy, most):
    out = summarise(
        log, ["k"], {"n": F.count(F.lit(1))}, medians={"m": "v"}, iqrs={"q": "v"},
        quantiles={"p90": ("v", 0.9)}, accuracy=accuracy, most=most,
    )
    values = {}
    for r in log.collect():
        values.setdefault(r.k, []).append(r.v)
    got = {r.k: r for r in out.collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        q = np.quantile(v, [0.25, 0.5, 0.75, 0.9])
        assert got[k].n == len(v)
        assert (got[k].m, got[k].q, got[k].p90) == pytest.approx((q[1], q[2] - q[0], q[3]))


def test_no_task_sorts_more_than_the_bound_in_a_heavy_tail(spark, monkeypatch):
    """One group with a far outlier: equally wide bins would leave all but one value in the first."""
    df = spark.range(0, 60_000, numPartitions=6).select(
        F.lit(1).alias("k"), F.when(F.col("id") == 0, 1e18).otherwise(F.exp(F.rand(3) * 9)).alias("v")).cache()
    sorted_rows, cells = [], quantiles._cells

    def counted(rows, group):
        found = cells(rows, group)
        sorted_rows.append(found.groupBy(*group).count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(quantiles, "_cells", counted)
    values = np.sort([r.v for r in df.collect()])
    for accuracy, most in ((10_000, 1 << 20), (1000, 500), (1000, 30)):
        row = summarise(df, ["k"], {}, medians={"m": "v"}, quantiles={"p0": ("v", 0.0), "p99": ("v", 0.99), "p1": ("v", 1.0)},
                        accuracy=accuracy, most=most).first()
        assert (row.m, row.p0, row.p99, row.p1) == tuple(np.quantile(values, [0.5, 0.0, 0.99, 1.0]))
    assert sorted_rows[0] <= 60_000 * 2 * 5 / 10_000 + 4 and sorted_rows[1] <= 500 and sorted_rows[2] <= 40


def test_global_quantiles_of_few_distinct_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("double").alias("v"), F.lit(None).cast("double").alias("w"))
    row = summarise(df, [], {}, medians={"m": "v", "none": "w"}).first()
    assert row.m == 1.0 and row.none is None


def test_totals_reach_null_keys(log):
    out = gather_totals(log, ["k"], [F.count(F.lit(1)).alias("n")])
    assert out.count() == log.count()
    assert out.where("k is null").first().n == 30


def test_null_safe_join_without_keys(spark):
    assert null_safe_join(spark.range(3), spark.range(1).withColumnRenamed("id", "o"), []).count() == 3
