import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.operators import models, moments

NAMES = ("a", "b", "c", "y")


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    a, b, c = r.normal(1e6, 1, 300), r.normal(0, 3, 300), r.normal(-5, 1, 300)
    y = 2 * a - b + r.normal(0, 1, 300)
    out = [(["u", "v", None][k % 3], k % 20, float(a[k]), float(b[k]), None if k % 37 == 0 else float(c[k]), float(y[k])) for k in range(300)]
    return spark.createDataFrame(out, "g string, day int, a double, b double, c double, y double").repartition(4)


def test_merged_days_equal_the_whole(rows):
    days = moments.moment_states(rows, NAMES, ["g", "day"])
    for by in (["g"], []):
        merged = {r["g"] if by else None: r for r in moments.merged_states(days, NAMES, by).collect()}
        whole = {r["g"] if by else None: r for r in moments.moment_states(rows, NAMES, by).collect()}
        assert merged.keys() == whole.keys() and len(whole) == (3 if by else 1)
        for k, r in whole.items():
            assert merged[k]["n"] == r["n"]
            assert merged[k]["mean"] == pytest.approx(r["mean"], rel=1e-12)
            assert merged[k]["products"] == pytest.approx(r["products"], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("xs", [("a", "b", "c"), ("c", "a"), ("b",)])
def test_every_formula_from_one_state(rows, xs):
    states = moments.merged_states(moments.moment_states(rows, NAMES, ["g", "day"]), NAMES, ["g"])
    got = {r["g"]: r for r in moments.fit_states(states, NAMES, "y", xs, ["g"]).collect()}
    complete = rows.na.drop(subset=list(NAMES))
    for g in ("u", "v", None):
        part = complete.where(F.col("g").eqNullSafe(g)).toPandas()
        design = np.column_stack([np.ones(len(part)), *[part[x] for x in xs]])
        coef, *_ = np.linalg.lstsq(design - [0, *part[list(xs)].mean()], part["y"] - part["y"].mean(), rcond=None)
        assert got[g]["n"] == len(part)
        assert got[g]["coef"][1:] == pytest.approx(coef[1:], rel=1e-6)
    direct = {r["g"]: r["rss"] for r in models.ols(complete, "y", xs, ["g"]).collect()}
    assert {g: r["rss"] for g, r in got.items()} == pytest.approx(direct, rel=1e-6)


def test_all_formulas_read_the_rows_once(rows):
    states = moments.moment_states(rows, NAMES)
    out = moments.compare_formulas(states, NAMES, "y", {"full": ("a", "b", "c"), "short": ("a",)})
    found = {r["formula"]: r for r in out.collect()}
    assert found["full"]["r_squared"] > found["short"]["r_squared"] > 0 and found["full"]["n"] == found["short"]["n"]


def test_no_complete_row(rows):
    empty = moments.moment_states(rows.withColumn("c", F.lit(None).cast("double")), NAMES)
    assert moments.merged_states(empty, NAMES).where("n > 0").collect() == []
    assert moments.merged_states(empty, NAMES, ["n"]).collect() == []
