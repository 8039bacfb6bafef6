"""Selection by models on a frame where one feature tells the target, one helps and one is noise."""

import pytest
from pyspark.sql import functions as F

from prepline.operators import models

SMALL = {"maxIter": 2, "maxDepth": 2}


@pytest.fixture(scope="module")
def frame(spark):
    t = spark.range(1500, numPartitions=2).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("noise"), F.rand(4).alias("u"))
    return t.selectExpr("a", "b", "noise", "cast(a + 0.4 * b + 0.1 * u > 0.75 as int) y")


def test_permutation_importance(frame):
    r = {x["feature"]: x["permutation_importance"] for x in models.permutation_importance(frame, "y", SMALL, k=1).collect()}
    assert r["a"] > 0.1 > abs(r["noise"]) and r["a"] > r["b"]


def test_combinations(frame):
    table, each = models.ebfs(frame, "y", SMALL, n_comb=2)
    r = {tuple(x["fc"]): x for x in table.collect()}
    assert set(r) == {("a", "b"), ("a", "noise"), ("b", "noise")}
    assert r["a", "b"]["roc_auc"] > r["b", "noise"]["roc_auc"] and r["a", "b"]["logloss"] < r["b", "noise"]["logloss"]
    assert models.ebfs_fc_filter(table, r["a", "b"]["logloss"], r["a", "b"]["roc_auc"]) == ["a", "b"]
    assert {x["feature"]: x["avg_fi"] for x in each.collect()}["noise"] < 0.6


def test_search(frame):
    best, trials = models.suggest_hyperparams(frame, "y", ["a"], max_trials=2, metric="auc")
    rows = trials.orderBy("trial").collect()
    assert len(rows) == 2 and all(0.5 < r["value"] <= 1 for r in rows)
    assert rows[max((0, 1), key=lambda i: rows[i]["value"])]["params"]["maxDepth"] == best["maxDepth"]


def test_regression(frame):
    t = frame.withColumn("z", 3 * F.col("a"))
    scored = models.append_regression(t, models._fit_regression(t, "z", ["a", "noise"], SMALL), ["a", "noise"])
    assert scored.agg(F.avg(F.pow(F.col("z") - F.col("model_score"), 2)) < 0.5 * F.var_pop("z")).first()[0]
