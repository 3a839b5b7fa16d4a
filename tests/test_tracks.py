import re

import pytest
from pyspark.sql import functions as F

from backtrail.operators import tracks

SCHEMA = "index long, height_i double, hour_along int, sp_humidity double"


def track(index, height, values, oldest=None):
    first = -(len(values) - 1) if oldest is None else oldest
    return [(index, float(height), first + i, None if v is None else float(v)) for i, v in enumerate(values)]


def test_steps_trailing_sum_and_shares(spark):
    df = spark.createDataFrame(track(1, 500, [1, 2, 4, 3, 3, 5]), SCHEMA)
    got = tracks.uptake(df, least_reach=None).orderBy("hour_along").collect()
    assert [r.delta_q for r in got] == [None, 1, 2, -1, 0, 2]
    assert [r.delta_q6d for r in got] == [None] * 5 + [4]
    assert [r.uptake for r in got] == [None] * 5 + [1]
    assert {r.tot_uptake for r in got} == {5}
    assert [r.prop_uptake for r in got] == pytest.approx([None, 0.2, 0.4, 0, 0, 0.4])


def test_missing_humidity_is_skipped_in_the_trailing_sum(spark):
    df = spark.createDataFrame(track(1, 500, [1, None, 4, 5, 6, 7]), SCHEMA)
    last = tracks.uptake(df, least_reach=None).orderBy(F.desc("hour_along")).first()
    assert last.delta_q6d == 3.0 and last.tot_uptake == 3.0


def test_short_tracks_are_dropped(spark):
    df = spark.createDataFrame(
        track(1, 500, range(24), oldest=-23) + track(1, 1000, range(25), oldest=-24), SCHEMA
    )
    assert {r.height_i for r in tracks.uptake(df).collect()} == {1000.0}


def test_tied_heights_are_kept_unless_a_tie_break_is_given(spark):
    values = [1, 3, 2, 4] * 7
    df = spark.createDataFrame(track(1, 500, values) + track(1, 1000, values) + track(1, 1500, [1] * 28), SCHEMA)
    up = tracks.uptake(df)
    assert {r.height_i for r in tracks.dominant(up).collect()} == {500.0, 1000.0}
    assert {r.height_i for r in tracks.dominant(up, tie_break=["height_i"]).collect()} == {500.0}
    assert {r.height_i for r in tracks.uptake(df, dominant_only=True).collect()} == {500.0, 1000.0}


def test_equal_gains_in_another_order_are_a_tie(spark):
    """Sums of doubles would differ in the last digit."""
    rise = [0.1, 0.2, 0.3, 0.7, 1.1, 0.05]
    def climb(steps):
        level, out = 1.0, []
        for k, step in enumerate(steps):
            level = round(level + step, 6)
            out += [level, 0.5]
            level = 0.5
        return out
    near = [r + (1e-9 if k == 0 else 0) for k, r in enumerate(rise)]
    rows = track(1, 500, climb(rise)) + track(1, 1000, climb(rise)) + track(2, 500, climb(rise)) + track(2, 1000, climb(near)[:-1] + [0.4])
    up = tracks.uptake(spark.createDataFrame(rows, SCHEMA), least_reach=None)
    one = {(r["index"], r.height_i) for r in tracks.dominant(up).collect()}
    two = {(r["index"], r.height_i) for r in tracks.uptake(
        spark.createDataFrame(rows, SCHEMA), least_reach=None, dominant_only=True).collect()}
    assert one == two >= {(1, 500.0), (1, 1000.0)}


@pytest.fixture(scope="module")
def many(spark):
    """Event 0 holds a third of all points."""
    value = (F.xxhash64("index", "height_i", "hour_along") % 1000).cast("double") / 70
    base = spark.range(12).select(
        F.col("id").alias("index"), F.explode(F.array(F.lit(500.0), F.lit(1000.0))).alias("height_i")
    )
    points = base.withColumn(
        "hour_along", F.explode(F.sequence(F.when(F.col("index") == 0, -330).otherwise(-60), F.lit(0)))
    )
    return points.withColumn("sp_humidity", value).cache()


@pytest.mark.parametrize("dominant_only", [False, True])
def test_the_same_rows_however_they_lie(many, dominant_only):
    def run(parts):
        out = tracks.uptake(many.repartition(parts), dominant_only=dominant_only)
        return {
            (r["index"], r.height_i, r.hour_along): tuple(
                None if v is None else round(v, 8)
                for v in (r.traj_end, r.delta_q, r.delta_q6d, r.uptake, r.tot_uptake, r.prop_uptake)
            )
            for r in out.collect()
        }

    one, many_parts = run(1), run(7)
    assert one == many_parts and len(one) > 0


def test_dominant_and_length_of_large_events(many):
    up = tracks.uptake(many)
    best = tracks.dominant(up)
    assert best.select("index", "height_i").distinct().count() == 12
    lengths = tracks.with_track_length(many).groupBy("index").agg(F.min("traj_end").alias("t"))
    assert {r["index"]: r.t for r in lengths.collect()} == {0: -330} | {i: -60 for i in range(1, 12)}


def test_shares_of_a_track_sum_to_one(many):
    sums = tracks.uptake(many).groupBy("index", "height_i").agg(F.sum("prop_uptake").alias("s")).collect()
    assert [r.s for r in sums] == pytest.approx([1.0] * 24)


def test_uptake_and_dominant_share_one_exchange_and_one_sort(many):
    df = tracks.uptake(many, dominant_only=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "SinglePartition" not in plan
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_counts(spark):
    rows = [(1, 500.0, h, 1, "Winter", 5.0 if h else 6.0) for h in range(4)]
    df = spark.createDataFrame(rows, "index long, height_i double, h int, month int, season string, lon double")
    r = tracks.track_counts(df).first()
    assert r.amount_western == 75.0 and r.N == pytest.approx(4 / 121)
    assert tracks.distinct_track_counts(df).first().N == 1
    assert tracks.season_counts(tracks.track_counts(df)).first().amount_western == 75.0
