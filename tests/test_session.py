"""Cut tables: where they go and when they go away; saved pipelines on a file system that is named by a URI."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from prepline.operators.encode import merge_infreq_categories, ordinal_auto_encode
from prepline.plans import Pipeline
from prepline.session import cut, cut_scope, shared_folder


class Conf(dict):
    pass


class Session:
    def __init__(self, **conf):
        self.conf = Conf(conf)


def test_no_folder_of_the_machine_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session(**{"spark.master": "yarn"}))
    assert shared_folder(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    assert shared_folder(Session(**{"spark.master": "local[2]"})).startswith("file:")


def test_tables_of_a_scope_are_removed(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    outer = cut(spark.range(3))
    with cut_scope(spark):
        assert cut(spark.range(5)).count() == 5 and len(set(os.listdir(folder)) - before) == 2
    assert len(set(os.listdir(folder)) - before) == 1 and outer.count() == 3


def test_pipelines_are_saved_by_uri(spark, tmp_path):
    t = spark.range(30_000).select(F.format_string("v%05d", "id").alias("v"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    p = Pipeline(t).pipe(ordinal_auto_encode, ["v"]).pipe(merge_infreq_categories, ["c"], 20_000)
    uri = f"file://{tmp_path}/p"
    p.save(uri)
    assert glob.glob(f"{tmp_path}/p/steps/*.txt") and os.path.isdir(f"{tmp_path}/p/lookup_0")
    loaded = Pipeline.load(uri)
    loaded.save(uri)  # where it came from
    for q in (p, Pipeline.load(uri)):
        r = q.apply(t)
        assert r.where("v < 0 or c <> 'c0|c1|c2'").count() == 0 and r.agg(F.count_distinct("v"), F.max("v")).first() == (30_000, 29_999)
