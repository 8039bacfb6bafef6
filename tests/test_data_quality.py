"""Profiles of loads and filling of missing values against brute force, and their edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepline.operators.fill import fill_missing, filled_cells
from prepline.operators.quality import Limits, failed_checks, fit_baseline, profile_loads
from prepline.queries.data_quality import BANDS, NUMERIC, PLACE


def accepted(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(float(x), "Old Town") for x in rng.normal(100, 10, 500)] + [(None, None)], "x double, city string")


def test_checks(spark):
    base = fit_baseline(accepted(spark), ["x"], ["city"])
    assert len(base["x"].breaks) == 9 and base["city"].null_share == pytest.approx(1 / 501)
    rng = np.random.default_rng(2)
    good = [(1, float(x), c) for x, c in zip(rng.normal(100, 8, 300), ["Old Town", "St. Ives", "O'Hara", "Bad-Ems"] * 75)]
    bad = [(2, None if i % 4 == 0 else math.nan if i % 4 == 1 else 1e6, "x  y" if i % 2 else None) for i in range(100)]
    drifted = [(3, 101.0 + i % 2 / 10, "Old Town") for i in range(200)]
    t = spark.createDataFrame(good + bad + drifted + [(None, 100.0, "Old Town")], "load_id int, x double, city string")
    prof = profile_loads(t, "load_id", ["x"], ["city"], base, {"city": PLACE})
    found = {tuple(r) for r in failed_checks(prof, "load_id", base, {"city": PLACE}).collect()}
    assert {(l, c, k) for l, c, k in found if l == 1} == set()
    assert {(c, k) for l, c, k in found if l == 2} == {("x", "null"), ("x", "range"), ("x", "single"), ("city", "null"), ("city", "single"), ("city", "pattern")}
    assert {(c, k) for l, c, k in found if l == 3} == {("x", "drift"), ("city", "single")}
    r = {(x["load_id"], x["column_name"]): x for x in prof.collect()}
    assert r[2, "x"]["n_null"] == 50 and r[2, "x"]["n_distinct"] == 1 and r[2, "x"]["top_value"] == "1000000.0"
    assert r[None, "x"]["n_rows"] == 1 and r[3, "x"]["n_distinct"] == 2 and r[3, "x"]["top_value"] == "101.0"
    assert sum(r[1, "x"]["bins"]) == r[1, "x"]["n_inside"] and r[1, "x"]["chi2"] >= 0


@pytest.mark.parametrize("place, ok", [("Old Town", True), ("St. Ives", True), ("Érd", True), ("old", False), ("Old  Town", False), ("Old ", False), (" Old", False), ("Old\tTown", False), ("Old1", False), ("", False), ("O", True), ("Old\n", False)])
def test_place_pattern(spark, place, ok):
    assert spark.createDataFrame([(place,)], "c string").select(F.col("c").rlike(PLACE)).first()[0] == ok


def test_profile_edges(spark):
    t = spark.createDataFrame([], "load_id int, x double, city string, n bigint, number double")
    base = fit_baseline(t, ["x"], ["city"])
    assert base["x"].low is None and base["x"].breaks == ()
    prof = profile_loads(t, "load_id", ["x"], ["city"], base)
    assert prof.count() == 0 and failed_checks(prof, "load_id", base).count() == 0
    long = spark.createDataFrame([(1, -0.0, "x" * 1_000_000, 1, 1.0), (1, 0.0, "", 1, 2.0), (1, math.inf, None, None, None)], t.schema)
    r = {x["column_name"]: x for x in profile_loads(long, "load_id", ["x"], ["city"], base, {"city": PLACE}).collect()}
    assert r["x"]["n_distinct"] == 2 and r["x"]["top_count"] == 2 and r["x"]["high"] == math.inf and r["x"]["psi"] is None
    assert r["city"]["longest"] == 1_000_000 and r["city"]["shortest"] == 0 and r["city"]["n_bad"] == 2


SCHEMA = "rec_id bigint, area_id bigint, area_income double, daily_internet_usage double, daily_internet_usage_band string, ad_ts timestamp_ntz"


def test_fill(spark):
    ts = [pd.Timestamp("2024-01-05"), pd.Timestamp("2024-01-31 23:59:59"), pd.Timestamp("2024-02-01")]
    rows = [
        (1, 7, 100.0, math.nan, "LOW", ts[0]), (2, 7, None, 5.0, " low ", ts[1]), (3, 7, -1.0, 0.0, "?", ts[0]), (4, 7, None, None, None, ts[2]),
        (5, None, None, 1.0, None, ts[0]), (6, 8, math.inf, 3.0, "high", ts[0]), (7, 8, 50.0, 4.0, "none", None), (8, 7, 140.0, 6.0, "high", ts[1]),
    ]
    t = spark.createDataFrame([(a, b, c, d, e, f.to_pydatetime() if f is not None else None) for a, b, c, d, e, f in rows], SCHEMA).withColumn("group", F.lit("kept")).withColumn("area_income_filled", F.lit("replaced"))
    out = fill_missing(t, NUMERIC, BANDS, "area_id", "ad_ts")
    assert set(out.columns) == {*t.columns, *[f"{c}_filled" for c in (*NUMERIC, *BANDS)]}
    got = {r["rec_id"]: r for r in out.collect()}
    assert len(got) == 8
    cells = {tuple(r) for r in filled_cells(out, "rec_id", [*NUMERIC, *BANDS]).collect()}
    assert cells == {(1, "daily_internet_usage"), (2, "area_income"), (3, "area_income"), (3, "daily_internet_usage"), (3, "daily_internet_usage_band")}
    assert 100 <= got[2]["area_income"] <= 140 and got[2]["area_income"] == got[3]["area_income"]
    assert got[3]["daily_internet_usage_band"] == "low" and got[1]["daily_internet_usage_band"] == "LOW"
    assert got[6]["area_income"] == math.inf and got[4]["area_income"] is None and got[5]["daily_internet_usage_band"] is None
    assert got[1]["group"] == "kept" and got[1]["area_income"] == 100
    assert fill_missing(t.limit(0), NUMERIC, BANDS, "area_id", "ad_ts").count() == 0


def test_fill_predicts_better_than_the_mean(spark):
    """Held-out values of made groups and months are nearer to the prediction than to the mean and the group mean."""
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for g in range(60):
        a = rng.normal(0, 30)
        for m in range(1, 7):
            c = 200 + a + 10 * m + rng.normal(0, 5)
            for _ in range(4):
                i = len(rows)
                truth[i] = c + rng.normal(0, 10)
                rows.append((i, g, None if i % 9 == 0 else float(truth[i]), 1.0, "low" if g % 2 else "high", pd.Timestamp(2024, m, 3).to_pydatetime()))
    t = spark.createDataFrame(rows, SCHEMA)
    out = {r["rec_id"]: r["area_income"] for r in fill_missing(t, NUMERIC, BANDS, "area_id", "ad_ts").where("area_income_filled").collect()}
    gone = [i for i in truth if i % 9 == 0]
    assert set(out) == set(gone)
    error = lambda p: math.sqrt(np.mean([(p(i) - truth[i]) ** 2 for i in gone]))
    mean = np.mean([v for i, v in truth.items() if i % 9])
    cell = lambda i: np.mean([truth[j] for j in range(i // 4 * 4, i // 4 * 4 + 4) if j % 9])
    assert error(out.get) < 0.5 * error(lambda i: mean) and error(out.get) <= error(cell) * 1.02


def test_hot_group_is_filled_alike(spark):
    t = spark.range(30000).select(F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("bigint").alias("area_id"), F.when(F.col("id") % 5 > 0, 50.0).alias("area_income"), F.lit(1.0).alias("daily_internet_usage"), F.lit("low").alias("daily_internet_usage_band"), F.lit(pd.Timestamp("2024-01-01").to_pydatetime()).cast("timestamp_ntz").alias("ad_ts"))
    out = fill_missing(t, NUMERIC, BANDS, "area_id", "ad_ts")
    assert out.where("area_income_filled").count() == 2000 and out.where("area_income_filled and abs(area_income - 50) > 1e-6").count() == 0


def test_limits_are_parameters(spark):
    base = fit_baseline(accepted(spark), ["x"])
    t = spark.createDataFrame([(1, 100.0)] * 3 + [(1, 101.0)], "load_id int, x double")
    prof = profile_loads(t, "load_id", ["x"], [], base)
    assert failed_checks(prof, "load_id", base).count() == 1
    assert failed_checks(prof, "load_id", base, limits=Limits(single_share=0.8)).count() == 0


def test_categories_are_compared(spark):
    """A load of other well-formed cities departs in its shares; against brute force."""
    usual = ["Old Town"] * 60 + ["St. Ives"] * 30 + ["O\"H\\ära"] * 10
    base = fit_baseline(spark.createDataFrame([(c,) for c in [*usual, None]], "city string"), [], ["city"])
    loads = {1: usual, 2: [f"New {i % 7}" for i in range(100)], 3: ["Old Town"] * 5 + [None], 4: [None], 5: ["Old Town"] * 29999 + ["St. Ives", "Z"]}
    t = spark.createDataFrame([(k, c) for k, v in loads.items() for c in v], "load_id int, city string")
    got = {r["load_id"]: r for r in profile_loads(t, "load_id", [], ["city"], base).collect()}
    shares = {c: usual.count(c) / 100 for c in usual}
    for k, v in loads.items():
        v = [c for c in v if c is not None]
        r = got[k]
        assert r["n_other"] == sum(c not in shares for c in v) and r["psi"] is None
        if not v:
            assert r["category_psi"] is None and r["category_chi2"] is None
            continue
        cells = [(e, v.count(c)) for c, e in shares.items()] + [(1e-4, r["n_other"])]
        s = [(e, max(o / len(v), 1e-4)) for e, o in cells]
        assert r["category_psi"] == pytest.approx(sum((e - a) * math.log(e / a) for e, a in s), abs=1e-9)
        assert r["category_chi2"] == pytest.approx(sum((o - e * len(v)) ** 2 / (e * len(v)) for e, o in cells))
    assert got[1]["category_psi"] < 0.01 < 1 < got[2]["category_psi"]
