"""Files, matrices, transformers and the coupon collector."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from prepline.functions.coupons import coverage_probability, subsamples_needed
from prepline.operators.impute import impute
from prepline.operators.models import get_numpy
from prepline.plans import Pipeline, StepsTransformer
from prepline.sources import scan, write
from prepline.sources.files import format_of


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_files(spark, tmp_path, kind):
    t = spark.range(10).select("id", F.concat(F.lit("n"), "id").alias("s"), (F.col("id") / 4).alias("x"))
    path = str(tmp_path / f"t.{kind}")
    write(t, path)
    assert sorted(map(tuple, scan(spark, path, schema=t.schema).select("id", "s", "x").collect())) == sorted(map(tuple, t.collect()))
    assert scan(spark, path).count() == 10


def test_formats():
    assert format_of("/a/b.csv.gz") == "csv" and format_of("/a/b.parquet/") == "parquet"
    with pytest.raises(ValueError):
        format_of("/a/b")


def test_matrix(spark):
    t = spark.range(5).select(F.col("id").alias("y"), (F.col("id") * 2.0).alias("a"))
    cube = get_numpy(t, "y")
    assert cube.features == ["a"] and cube.to_df(spark).columns == ["y", "a"]
    with pytest.raises(ValueError):
        get_numpy(t, "y", limit=3)


def test_transformer(spark):
    t = spark.createDataFrame([(1.0,), (None,)], "a double")
    m = StepsTransformer(Pipeline(t).pipe(impute, ["a"], "mean").with_columns({"b": "a + 1"}))
    assert [tuple(r) for r in PipelineModel([m.fit(t)]).transform(t).collect()] == [(1.0, 2.0), (1.0, 2.0)]
    assert m.get_feature_names_in() == ["a"] and m.get_feature_names_out() == ["a", "b"]


def test_coupons(spark):
    assert coverage_probability(spark, 50, 4, 4, 1, 1) == 1 and coverage_probability(spark, 50, 4, 1, 3, 1) == 0
    n = subsamples_needed(spark, 200, 6, 3, 1, threshold=0.9)
    assert coverage_probability(spark, 200, 6, 3, n, 1) >= 0.9 > coverage_probability(spark, 200, 6, 3, n - 1, 1)


def test_api_and_namespaces(spark):
    from prepline import api

    for n in ("impute", "scale", "one_hot_encode", "data_profile", "roc_auc", "mrmr", "train_test_split", "infer_dates", "psi", "profile_loads", "fill_missing", "Pipeline"):
        assert callable(getattr(api, n))
    t = spark.createDataFrame([(1, True, 4), (2, True, 6), (3, False, 9)], "i int, b boolean, x int")
    r = t.agg(api.num_ext("x").rms().alias("rms"), api.num_ext("b").ordered("i").alias("o")).select("rms", api.lempel_ziv_complexity("o").alias("n")).first()
    assert r["rms"] == pytest.approx((133 / 3) ** 0.5) and r["n"] == 1 + 1
    assert [x[0] for x in t.select(api.num_ext("x").gcd(6).alias("g")).collect()] == [2, 6, 3]
    assert t.select(api.str_ext(F.lit("abc")).levenshtein_dist(F.lit("abd"))).first()[0] == 1
