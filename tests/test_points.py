import pytest
from pyspark.sql import functions as F

from backtrail.operators import joins
from backtrail.sources import points


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = spark.range(4000, numPartitions=4).select(
        "id", (F.pmod(F.col("id") * 7919, F.lit(18_001)) / 100 - 90).alias("lat"), (F.pmod(F.col("id") * 104_729, F.lit(36_001)) / 100 - 180).alias("lon"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None, 3.0), (-2, 90.0, 180.0), (-3, -90.0, -180.0), (-4, 95.0, 0.0)], rows.schema))
    path = str(tmp_path_factory.mktemp("points") / "store")
    points.write_points(rows, path)
    return rows, path


def files_read(frame):
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    plans = [leaves.apply(k) for k in range(leaves.size())]
    return sum(p.metrics().apply("numFiles").value() for p in plans if "Scan" in p.getClass().getSimpleName())


@pytest.mark.parametrize("view", [(35, 60, -20, 20), (-90, 90, -180, 180), (10, 10.5, 100, 100.5), (80, 90, 170, 180)])
def test_a_view_finds_its_points(spark, store, view):
    rows, path = store
    got = sorted(map(tuple, points.read_view(spark, path, rows.schema, view).collect()))
    south, north, west, east = view
    wanted = sorted(tuple(r) for r in rows.collect() if r["lat"] is not None and south <= r["lat"] <= north and west <= r["lon"] <= east)
    assert got == wanted


def test_a_view_opens_few_files(spark, store):
    rows, path = store
    whole = files_read(spark.read.parquet(path))
    near = files_read(points.read_view(spark, path, rows.schema, (35, 60, -20, 20)))
    assert 0 < near < whole / 10 and near <= 2 * len(points.cells_of_view(35, 60, -20, 20))


def test_near_points_are_near_on_the_curve(spark):
    at = spark.createDataFrame([(10.0, 20.0), (10.001, 20.001), (-10.0, 20.0), (None, 1.0)], "lat double, lon double")
    a, b, c, none = [r[0] for r in at.select(points.curve_place(F.col("lat"), F.col("lon"))).collect()]
    assert abs(a - b) < 16 < abs(a - c) and none is None
    assert points.cells_of_view(10, 10, 20, 20) == [a >> 2 * (points.PLACE_BITS - points.CELL_BITS)]


def test_labels_have_a_table(spark, monkeypatch):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 4)], "l string, v int")
    assert [tuple(r) for r in joins.label_table(df, "l").collect()] == [(None, 1), ("a", 2), ("b", 3)]
    out = joins.with_ordinal(df, "l", joins.label_table(df, "l", ["b", "c"]))
    assert sorted((r["v"], r["ordinal"]) for r in out.collect()) == [(1, 1), (2, None), (3, None), (4, 1)]
    monkeypatch.setattr(joins, "MOST_LABELS", 2)
    with pytest.raises(ValueError):
        joins.label_table(df, "l")
