"""Mutual information against a direct count, whatever the blocks, and on wide frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepline.functions.special import digamma
from prepline.operators.infer import correlation_matrix, infer_highly_correlated
from prepline.operators.reports import corr_report
from prepline.operators.select import abs_corr, f_classif, mrmr, mrmr_engine, mutual_info


def brute(x, t, k):
    n, total = len(x), 0.0
    for i in range(n):
        own = np.sort(np.abs(x[t == t[i]] - x[i]))
        total += digamma(max(int((np.abs(x - x[i]) < own[k]).sum()), 1))
    return max(0.0, float(digamma(n) + digamma(k) - np.mean([digamma((t == v).sum()) for v in t]) - total / n))


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 2000
    t = rng.integers(0, 3, n)
    t[rng.choice(n, 4, replace=False)] = 3  # a class of four rows
    a, b, c = rng.normal(size=n) + 0.4 * t, rng.exponential(size=n), rng.normal(size=n) * 1e6 + 5e8
    rows = [(int(v), float(x), float(y), float(z)) for v, x, y, z in zip(t, a, b, c)]
    return spark.createDataFrame(rows, "t int, a double, b double, c double").repartition(4), t, {"a": a, "b": b, "c": c}


@pytest.mark.parametrize("block_rows", [2000, 700, 90, 1999])
def test_blocks_do_not_matter(frame, block_rows):
    df, t, cols = frame
    found = {r["feature"]: r["estimated_mi"] for r in mutual_info(df, "t", list(cols), block_rows=block_rows).collect()}
    for c, x in cols.items():
        assert found[c] == pytest.approx(brute(x, t, 3), abs=1e-9)


@pytest.mark.parametrize("block_rows", [10_000, 50])
def test_edges(spark, block_rows):
    rows = [(i % 2 if i % 9 else None, float(i % 40) if i % 7 else float("nan"), i % 5, None) for i in range(400)]
    df = spark.createDataFrame(rows, "t int, feature double, x int, none double")
    found = {r["feature"]: r["estimated_mi"] for r in mutual_info(df, "t", ["feature", "x", "none"], block_rows=block_rows).collect()}
    assert found["none"] is None and all(0 <= found[c] < 1 for c in ("feature", "x"))
    assert found["feature"] > 0.4
    small = df.where("t is not null and x is not null").limit(60).unionByName(spark.createDataFrame([(7, 1.0, 1, None)] * 3, df.schema))
    with pytest.raises(ValueError, match="no more than 3 rows"):
        mutual_info(small, "t", ["x"], block_rows=block_rows if block_rows > 50 else 20)
    assert mutual_info(df.limit(0), "t", ["x"], block_rows=block_rows).first()["estimated_mi"] is None


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 30)) @ rng.normal(size=(30, 30)) + 1e6
    x[:, 7] = 3.25
    x[rng.random(x.shape) < 0.1] = np.nan
    t = rng.integers(0, 3, 700)
    cols = [f"c{i}" for i in range(30)]
    rows = [(int(v), *[None if i % 3 == 0 and np.isnan(y) else float(y) for i, y in enumerate(r)]) for v, r in zip(t, x)]
    return spark.createDataFrame(rows, "t int, " + ", ".join(f"{c} double" for c in cols)).repartition(3), x, t, cols


def test_correlations_of_many_columns(wide):
    df, x, _, cols = wide
    found = correlation_matrix(df, cols)
    for i in range(30):
        for j in range(30):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if i == j or 7 in (i, j):
                assert np.isnan(found[i, j])
            else:
                assert found[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    r = infer_highly_correlated(df.drop("t"), 0.3).collect()
    assert {(a["features"], b) for a in r for b in a[1]} == {(cols[i], cols[j]) for i in range(30) for j in range(30) if found[i, j] > 0.3}
    assert np.isnan(correlation_matrix(df.limit(0), cols)).all()


def test_variance_of_many_columns(wide, spark):
    df, x, t, cols = wide
    few = {r["feature"]: r["f_value"] for r in f_classif(df, "t", cols[:4]).collect()}
    many = {r["feature"]: r["f_value"] for r in f_classif(df, "t", cols).collect()}
    assert all(many[c] == pytest.approx(few[c], rel=1e-6) for c in few) and len(many) == 30
    assert len(mrmr(df, "t", 5, cols)) == 5


def test_correlations_with_targets(wide):
    df, x, t, cols = wide
    m = {r["feature"]: r["abs_corr"] for r in abs_corr(df, "t", cols).collect()}
    few = {r["feature"]: r["abs_corr"] for i in range(0, 30, 6) for r in abs_corr(df, "t", cols[i : i + 6]).collect()}
    assert m["c7"] == few["c7"] == -999 and all(m[c] == pytest.approx(few[c], abs=1e-9) for c in cols)
    many = {r["features"]: tuple(r)[1:] for r in corr_report(df, cols[:20], ["t", "c25"]).collect()}
    one = {r["features"]: tuple(r)[1:] for r in corr_report(df, cols[:3], ["t", "c25"]).collect()}
    assert all(many[c] == pytest.approx(one[c], abs=1e-9) for c in one) and np.isnan(many["c7"]).all() and len(many) == 20


def test_rounds_of_selection(spark):
    df = spark.range(300).select(F.rand(1).alias("a"), F.rand(2).alias("b")).selectExpr("a", "b", "a + 0.01 * b near_a", "3.0 flat")
    score = {"a": 5.0, "b": 1.0, "near_a": 4.9, "flat": 0.0}
    assert mrmr_engine(df, 2, score) == ["a", "b"]
    assert mrmr_engine(df, 9, score, "knock_out") == ["a", "b"]
    assert sorted(mrmr_engine(df, 9, score, "accum_corr")) == sorted(score)
    assert mrmr_engine(df, 0, score) == []
