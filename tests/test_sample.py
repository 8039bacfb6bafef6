"""Samples come from all of a table, wherever rows stand, and hold as many rows as asked for."""

import pytest
from pyspark.sql import functions as F

from prepline.operators import sample


@pytest.mark.parametrize("parts", [1, 16])
@pytest.mark.parametrize("n, count", [(100000, 20000), (2000, 10000), (100000, 7)])
def test_upsample_draws_from_the_whole_subgroup(spark, parts, n, count):
    t = spark.range(n, numPartitions=parts)
    drawn = sample.simple_upsample(t, "id >= 0", count).groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n"))
    tenths = [r["n"] for r in drawn.groupBy(F.floor(F.col("id") * 10 / n).alias("tenth")).agg(F.sum("n").alias("n")).orderBy("tenth").collect()]
    assert sum(tenths) == count and len(tenths) == 10
    assert all(abs(x - count / 10) < 6 * (count / 10) ** 0.5 + 3 for x in tenths)
    # with replacement: the number of rows drawn twice or more is near that of independent draws
    twice, rate = drawn.where("n >= 2").count(), count / n
    expected = n * (1 - (1 + rate) * 2.718281828459045**-rate)
    assert abs(twice - expected) < 6 * expected**0.5 + 3


@pytest.mark.parametrize("keep, size", [(50, 50), (0.05, 50), (0.0505, 51), (2000, 1000)])
def test_stratified_downsample_of_repeated_rows(spark, keep, size):
    """Groups of one key, of a hot key and of unique keys, a group of null, and a small one."""
    one = spark.range(20000).select((F.col("id") % 20).alias("g"), (F.col("id") % 20).alias("k"))
    hot = spark.range(20000).select((20 + F.col("id") % 20).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 20).otherwise(F.col("id")).alias("k"))
    unique = spark.range(1000).select(F.lit(None).cast("bigint").alias("g"), "id")
    t = one.union(hot).union(unique).union(spark.range(3).select(F.lit(-1), F.lit(7)))
    out = {r["g"]: r["count"] for r in sample.stratified_downsample(t, ["g"], keep, 2, keys=["k"]).groupBy("g").count().collect()}
    assert out == {**{g: size for g in [*range(40), None]}, -1: 2 if isinstance(keep, float) else 3}


def test_rows_of_equal_keys_are_drawn_from_all_of_them(spark):
    t = spark.range(10000).select(F.lit(1).alias("g"), F.lit(2).alias("k"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    draw = lambda x: {r["id"] for r in sample.stratified_downsample(x, ["g"], 500, keys=["k"]).collect()}
    ids = draw(t)
    assert len(ids) == 500 and all(20 < sum(i // 1000 == d for i in ids) < 85 for d in range(10))
    assert draw(t.repartition(7)) == ids
