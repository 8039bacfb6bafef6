"""Queries over whole tables meet their null bucket and their null target; other rows are as without those."""

from pyspark.sql import functions as F

from prepline import queries as core


def test_null_bucket(spark, small):
    out = core.queries()["over_time_report_invalid_whole"](spark, small)
    assert out.where("year is null and quarter is null").count() == 1
    assert out.where("year is not null").exceptAll(core.queries()["over_time_report_invalid"](spark, small)).count() == 0


def test_null_target(spark, small):
    out = core.queries()["sparse_to_dense_target_whole"](spark, small)
    assert out.count() == spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert out.where(F.col("flag").isNull() != (F.col("l_orderkey") % 7 == 0)).count() == 0 < out.where("flag is null").count()
