"""Broken rows and missing files: what is read, what is set aside, what the audit says."""

import gzip

import pytest
from pyspark.sql import functions as F

from backtrail.sources import delivery
from backtrail.sources.schemas import TRACKS, WEATHER

HEAD = "X,date,time,temp,rh,gph"


@pytest.fixture()
def folders(tmp_path):
    (tmp_path / "north").mkdir()
    (tmp_path / "south").mkdir()
    (tmp_path / "north" / "a.csv").write_text("\n".join([
        HEAD, "1,2020-01-01,5,3.5,80,NA", "2,2020-01-01,six,3.5,80,1", "3,2020-01-02,7", "4,2020-13-01,8,1,2,3",
        "5,NA,9,NaN,2,3", "6,2020-01-03,1,2,3,4,5"]) + "\n")
    (tmp_path / "north" / "b.csv").write_text(HEAD + "\n7,2020-01-04,5,3.5,80,1\n")
    (tmp_path / "south" / "c.csv").write_text(HEAD + "\n")
    return tmp_path


def test_faulty_rows_are_told_apart_whatever_columns_are_asked_for(spark, folders):
    rows = delivery.read_delivery(spark, str(folders / "north"), WEATHER)
    got = {r["line"] or r["rownum"]: r["fault"] for r in rows.collect()}
    assert got == {1: None, 5: None, 7: None, "2,2020-01-01,six,3.5,80,1": "record", "3,2020-01-02,7": "record",
                   "6,2020-01-03,1,2,3,4,5": "record", "4,2020-13-01,8,1.0,2.0,3.0": "moment"}
    assert rows.where("fault IS NULL").select("rownum").count() == 3  # none of the faulty columns is read here
    assert rows.where("rownum = 5").first()["temp"] is None


def test_rows_are_routed_and_deliveries_counted(spark, folders, tmp_path):
    expected = {n: str(folders / n) for n in ("north", "south", "west")}
    found = delivery.accept(spark, expected, WEATHER, str(tmp_path / "home"), misplaced=F.col("time") > 8)
    assert sorted(r["rownum"] for r in found.good.collect()) == [1, 7]
    assert found.good.columns == WEATHER.names
    bad = {(r["fault"], r["file"].rsplit("/", 1)[1]) for r in found.bad.collect()}
    assert bad == {("record", "a.csv"), ("moment", "a.csv"), ("place", "a.csv")}
    audit = {r["delivery"]: (r["rows"], r["good"], r["record"], r["moment"], r["place"]) for r in found.audit.collect()}
    assert audit == {"north": (7, 2, 3, 1, 1), "south": (0,) * 5, "west": (0,) * 5}


def test_nothing_came(spark, tmp_path):
    found = delivery.accept(spark, {"x": str(tmp_path / "x")}, WEATHER, str(tmp_path / "home"))
    assert found.good.collect() == [] and found.bad.collect() == []
    assert [tuple(r)[:2] for r in found.audit.collect()] == [("x", 0)]
    with pytest.raises(ValueError):
        delivery.accept(spark, {"y": str(tmp_path / "x")}, WEATHER, str(tmp_path / "home"))


def test_a_file_that_breaks_off_does_not_end_the_read(spark, folders, tmp_path):
    text = HEAD + "\n" + "".join(f"{k},2020-01-01,5,{k * 7 % 13}.5,80,1\n" for k in range(30_000))
    whole = gzip.compress(text.encode())
    (folders / "south" / "d.csv.gz").write_bytes(whole[:len(whole) // 2])
    found = delivery.accept(spark, {n: str(folders / n) for n in ("north", "south")}, WEATHER, str(tmp_path / "home"))
    audit = {r["delivery"]: r["good"] for r in found.audit.collect()}
    assert audit["north"] == 3 and audit["south"] < 30_000


def test_row_names_before_the_columns(spark, tmp_path):
    (tmp_path / "500").mkdir()
    fields = "1,1,0,2020-01-02 05:00:00,50.5,-3.25,900.5,2020-01-02,49.62,6.22,500,850.1,290.5,280.25,0.1,700,80.5,4.5,5.1,120,0,7"
    (tmp_path / "500" / "t.csv").write_text(",".join(TRACKS.names) + "\n1," + fields + "\n2," + fields.rsplit(",", 1)[0] + "\n")
    rows = delivery.read_delivery(spark, str(tmp_path / "500"), TRACKS, row_names=True)
    assert sorted((r["fault"] or "", r["sp_humidity"]) for r in rows.collect()) == [("", 4.5), ("record", 4.5)]
