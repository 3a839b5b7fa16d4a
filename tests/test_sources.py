from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from backtrail.operators import quality, summaries
from backtrail.sources import tables
from backtrail.sources.schemas import TRACKS

POINT = "1,1,{hour},2020-01-02 05:00:00,50.5,-3.25,900.5,{arrival},49.62,6.22,500,850.1,290.5,280.25,0.1,700,80.5,{q},5.1,120,0,{index}"


def track_file(path, points, row_names=True):
    header = ",".join(f.name for f in TRACKS)
    lines = [header] + [(f"{i}," if row_names else "") + POINT.format(**p) for i, p in enumerate(points, 1)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_track_file_with_unnamed_row_numbers(spark, tmp_path):
    path = track_file(tmp_path / "t.csv", [
        {"hour": 0, "arrival": "2020-01-02 05:00:00", "q": "4.5", "index": 7},
        {"hour": -1, "arrival": "2020-01-02", "q": "NA", "index": 7},
        {"hour": -2, "arrival": "2020-01-02", "q": "NaN", "index": 7},
    ])
    df = tables.read_tracks(spark, path)
    assert df.schema == TRACKS
    first, second, third = df.orderBy(F.desc("hour_along")).collect()
    assert (first["index"], first.hour_along, first.lat, first.sp_humidity) == (7, 0, 50.5, 4.5)
    assert first.traj_dt_i == datetime(2020, 1, 2, 5) and second.traj_dt_i == datetime(2020, 1, 2)
    assert second.sp_humidity is None and third.sp_humidity is None


def test_broken_track_file_is_an_error(spark, tmp_path):
    path = track_file(tmp_path / "t.csv", [{"hour": "x", "arrival": "2020-01-02", "q": "1", "index": 7}])
    with pytest.raises(Exception):
        tables.read_tracks(spark, path).collect()


def test_ensemble_takes_heights_from_the_file_names(spark, tmp_path):
    point = {"hour": 0, "arrival": "2020-01-02", "q": "1", "index": 7}
    paths = {h: track_file(tmp_path / f"{h}.csv", [point]) for h in (500, 1000)}
    df = tables.load_ensemble(spark, paths)
    assert sorted(r.height_i for r in df.collect()) == [500.0, 1000.0]


def test_events_without_start_are_dropped(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(
        "No,Sampling start,Sampling end,kind,amount,a,b,c,d\n"
        "1,2020-01-01 22:00:00,2020-01-02 03:00:00,rain,2.5,-60.5,0.1,-8.5,0.1\n"
        "2,NA,2020-01-02 03:00:00,rain,2.5,-60.5,0.1,-8.5,0.1\n"
        "3,2020-01-05,2020-01-05 01:00:01,snow,NA,NA,0.1,-8.5,0.1\n"
    )
    rows = summaries.prepare_events(tables.read_events(spark, str(path))).orderBy("index").collect()
    assert [r["index"] for r in rows] == [1, 3]
    assert rows[0].date == date(2020, 1, 2) and rows[0].time == 0 and rows[0].duration == 5
    assert rows[0].d_excess == pytest.approx(-60.5 + 7.46 * 8.5 - 5.99)
    assert rows[1].duration == 2 and rows[1].P is None and rows[1].d_excess is None
    by_start = summaries.prepare_events(tables.read_events(spark, str(path)), "global", "start").orderBy("index").first()
    assert by_start.date == date(2020, 1, 1) and by_start.d_excess == pytest.approx(-60.5 + 8 * 8.5)


def test_weather_file(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("X,date,time,temp,rh,gph\n1,2020-01-01,5,3.5,80,NA\n")
    row = tables.read_weather(spark, str(path)).first()
    assert (row.date, row.time, row.temp, row.gph) == (date(2020, 1, 1), 5, 3.5, None)


def test_written_csv_reads_back(spark, tmp_path):
    source = track_file(tmp_path / "t.csv", [{"hour": 0, "arrival": "2020-01-02 05:00:00", "q": "NA", "index": 7}])
    df = tables.read_tracks(spark, source)
    out = str(tmp_path / "out")
    tables.write_csv(df, out)
    back = tables.read_tracks(spark, out, row_names=False)
    assert back.collect() == df.collect()
    store = str(tmp_path / "store")
    tables.write_tracks(df, store)
    assert spark.read.parquet(store).where("height_i = 500").count() == 1
    assert tables.materialise(df, str(tmp_path / "stage")).collect() == df.collect()


def test_requests_and_audit(spark):
    events = spark.createDataFrame([(1, date(2020, 1, 2), 5)], "index long, date date, time int")
    requests = quality.run_requests(events)
    assert sorted(r.height_i for r in requests.collect()) == [500.0, 1000.0, 1500.0, 2000.0]
    assert requests.first().run_hours == 120 and requests.first().direction == "backward"
    results = spark.createDataFrame([(1, 500.0), (1, 500.0), (1, 2000.0)], "index long, height_i double")
    missing = quality.coverage_audit(requests, results, ["index", "height_i"])
    assert sorted(r.height_i for r in missing.collect()) == [1000.0, 1500.0]
    numbered = quality.request_progress(requests.repartition(3), ["height_i"])
    got = sorted((r.height_i, r.number, r.requests, r.percent) for r in numbered.collect())
    assert got == [(500.0, 1, 4, 25.0), (1000.0, 2, 4, 50.0), (1500.0, 3, 4, 75.0), (2000.0, 4, 4, 100.0)]
