"""Golden cases of the operators' documentation, edge frames, round trips."""

import math

import pytest
from pyspark.sql import functions as F

from prepline.functions import numeric, special, stemmer, text
from prepline.operators import columns, diagnose, encode, impute, infer, metrics, models, reports, sample, scale, schema, select, strings
from prepline.plans import Pipeline, Step


def values(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def one(df, c):
    return [r[0] for r in df.select(c).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_hot_deck(spark):
    t = frame(spark, [(None, "cat", 0), (1, "cat", 0), (2, "cat", 0), (3, "dog", 0), (4, "dog", 1), (None, "dog", 1)], "a bigint, b string, c bigint")
    assert sorted(one(impute.hot_deck_impute(t, ["a"], ["b", "c"], "mean"), "a")) == [1, 1.5, 2, 3, 4, 4]
    assert sorted(one(impute.hot_deck_impute(t, ["a"], ["b", "c"], "max"), "a")) == [1, 2, 2, 3, 4, 4]
    with pytest.raises(ValueError):
        impute.hot_deck_impute(t, ["a"], ["a"])


def test_one_hot(spark):
    t = frame(spark, [(x,) for x in ["A", "B", "C", "D", "A", None]], "a string")
    out = encode.one_hot_encode(t, ["a"])
    assert out.columns == ["a_A", "a_B", "a_C", "a_D"]
    assert values(out)[-1] == (0, 0, 0, 0) and values(out)[0] == (1, 0, 0, 0)
    assert encode.one_hot_encode(t, ["a"], drop_first=True).columns == ["a_B", "a_C", "a_D"]


def test_one_hot_round_trip(spark):
    t = frame(spark, [("a", "y"), ("b", "n"), ("c", "y"), ("a", "n")], "a string, b string")
    out = encode.one_hot_encode(t, ["a", "b"])
    back = encode.reverse_one_hot_encode(encode.reverse_one_hot_encode(out, "a"), "b")
    assert values(back, "a", "b") == values(t)


def test_selective_one_hot(spark):
    t = frame(spark, [("A", "AA"), ("B", "BB"), ("C", "BB"), ("D", "CC"), ("A", "CC")], "a string, b string")
    out = encode.selective_one_hot_encode(t, {"a": ["A", "B"], "b": ["BB"]})
    assert values(out, "a_A", "a_B", "b_BB") == [(1, 0, 0), (0, 1, 1), (0, 0, 1), (0, 0, 0), (1, 0, 0)]


def test_quantile_bins(spark):
    t = frame(spark, [(i,) for i in range(5)], "a bigint")
    assert one(encode.quantile_binning(t, ["a"], 4), "a") == ["(-inf, 1]", "(-inf, 1]", "(1, 2]", "(2, 3]", "(3, inf]"]


def test_targets(spark):
    t = frame(spark, [(x,) for x in "ABCAB"], "target string")
    out, mapping = encode.format_categorical_target(t, "target")
    assert one(out, "target") == [0, 1, 2, 0, 1] and mapping == {"A": 0, "B": 1, "C": 2}
    s = frame(spark, [([0, 0, 1],), ([0, 1, 0],), ([1, 0, 0],)], "target array<bigint>")
    assert one(encode.sparse_to_dense_target(s, "target"), "target") == [2, 1, 0]
    d = frame(spark, [(0,), (1,), (2,), (0,)], "target bigint")
    assert one(encode.dense_to_sparse_target(d, "target"), "target") == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 0]]


def test_range_counts(spark):
    t = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 100).alias("b"))
    assert one(reports.range_counts(t, {"a": [(1, 20), (23, 55)], "b": [(121, 199)]}), "cnt") == [20, 33, 79]
    assert one(reports.range_counts(t, {"a": [(1, 20)]}, closed="none"), "cnt") == [18]


def test_scale_by(spark):
    t = frame(spark, [("a", -3), ("a", 1), ("a", 2), ("b", 200), ("b", 300), ("b", 250)], "segment string, value bigint")
    assert [round(x, 6) for x in one(scale.scale_by(t, "value", "segment", strategy="max_abs"), "value")] == [-1, 0.333333, 0.666667, 0.666667, 1, 0.833333]
    assert one(scale.scale_by(t, "value", "segment", strategy="min_max"), "value") == [0, 0.8, 1, 0, 1, 0.5]


def test_combine_zero_ones(spark):
    t = frame(spark, [(1, 1, 1), (1, 0, 1), (0, 1, 1)], "a int, b int, c int")
    assert one(scale.combine_zero_ones(t, ["a", "b", "c"], "x", rule="same"), "x") == [1, 0, 0]
    assert one(scale.combine_zero_ones(t, ["a", "b", "c"], "x"), "x") == [1, 1, 1]


def test_words_and_numbers(spark):
    t = frame(spark, [("hello world hello",), ("hello Tom",), ("test",), ("world hello",)], "s string")
    assert values(strings.extract_word_count(t, ["s"], ["hello", "world"]), "s_count_hello", "s_count_world") == [(2, 1), (1, 0), (0, 0), (1, 1)]
    u = frame(spark, [("a_1",), ("x_2",), ("c_3",), ("x_22",)], "s string")
    assert values(strings.extract_from_str(u, ["s"], ["len", "contains"], "(a_|x_)"), "s_len", "s_contains") == [(3, True), (3, True), (3, False), (4, True)]
    n = frame(spark, [("1% to 25% of my time",)], "s string")
    assert one(strings.extract_numbers(n, ["s"], join_by="-"), "s") == ["1-25"]
    assert one(strings.extract_numbers(n, ["s"], dtype="int"), "s") == [[1, 25]]
    assert one(strings.extract_patterns(n, r"\d+% to \d+%", ["s"], join_by=" "), "s") == ["1% to 25%"]
    f = frame(spark, [("$1,123.23",), ("(2,221)",), ("123!!!",), ("none",)], "s string")
    assert one(strings.extract_first_number(f, ["s"]), "s") == [1123.23, 2221.0, 123.0, None]
    assert one(strings.replace_by_pattern(frame(spark, [("a.b.b",)], "s string"), "s", "b", "$"), "s") == ["a.$.b"]


def test_json_and_lists(spark):
    t = frame(spark, [('{"id":1,"name":"a","course":{"0":"abc"}}',), ("bad",)], "a string")
    assert values(strings.extract_from_json(t, "a", paths=["id", "course.0"], dtypes=["int", "string"]), "`a.id`", "`a.course.0`") == [(1, "abc"), (None, None)]
    u = frame(spark, [([1, 2],), ([3, 3],), ([],), (None,)], "b array<bigint>")
    out = strings.extract_list_features(u, ["b"], ["min", "max", "len", "first", "last", "mean", "sum"])
    assert values(out.drop("b")) == [(1, 2, 2, 1, 2, 1.5, 3), (3, 3, 2, 3, 3, 3.0, 6), (None, None, 0, None, None, None, 0), (None, None, None, None, None, None, None)]
    assert one(strings.str_col_to_list(frame(spark, [("[1,2]",), ("x",)], "s string"), ["s"], "int"), "s")[0] == [1, 2]


def test_combine_str_cols(spark):
    t = frame(spark, [("fruit", "edible"), ("N/A", None), ("meat", ""), ("kitchen", "tool")], "a string, b string")
    assert one(strings.combine_str_cols(t, ["a", "b"], "c", to_null=["N/A", ""], separator="|"), "c") == ["fruit|edible", None, "meat", "kitchen|tool"]


def test_rank_hot(spark):
    t = frame(spark, [("bad",), ("good",), ("best",), (None,)], "q string")
    assert values(encode.rank_hot_encode(t, {"q": ["bad", "fair", "good"]})) == [(0, 0), (1, 1), (1, 1), (None, None)]


def test_multicat(spark):
    t = frame(spark, [("abc|ggg", "x"), ("abc|sss", "y"), ("ccc|abc", "y")], "t string, o string")
    out = encode.multicat_one_hot_encode(t, ["t"], drop_first=False)
    assert values(out, "t_abc", "t_ccc", "t_ggg", "t_sss") == [(1, 0, 1, 0), (1, 0, 0, 1), (1, 1, 0, 0)]


def test_merge_infrequent(spark):
    t = frame(spark, [(x,) for x in "aabbbccccc"], "c string")
    assert sorted(set(one(encode.merge_infreq_categories(t, ["c"], min_count=4), "c"))) == ["a|b", "c"]
    assert sorted(set(one(encode.merge_infreq_categories(t, ["c"], min_count=3), "c"))) == ["a", "b", "c"]


def test_sample_weight_and_jaccard(spark):
    t = frame(spark, [(0,), (1,), (1,), (1,), (2,)], "y int")
    assert [round(x, 8) for x in one(metrics.get_sample_weight(t, "y"), "weight")] == [1.66666667, 0.55555556, 0.55555556, 0.55555556, 1.66666667]
    j = frame(spark, [(["like", "hello"], ["like", "world"]), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    assert [x if x is None else round(x, 6) for x in one(metrics.df_jaccard_similarity(j, "a", "b"), "a_b_jaccard")] == [0.333333, 0, None]


def test_dates(spark):
    t = spark.sql("select * from values (date '2021-01-01'), (date '2022-02-03'), (date '2023-11-23') t(d)")
    assert values(strings.extract_dt_features(t, ["d"]).drop("d")) == [(2021, 1, 1), (2022, 1, 2), (2023, 4, 11)]


def test_upsample(spark):
    t = spark.range(1000).select(F.when(F.col("id") < 114, "B").otherwise("A").alias("g"), F.col("id").cast("double").alias("x"))
    out = sample.simple_upsample(t, "g = 'B'", 200)
    assert out.count() == 1200 and out.where("g = 'A'").count() == 886


def test_time_series_split(spark):
    t = spark.range(6)
    folds = [(sorted(one(a, "id")), sorted(one(b, "id"))) for a, b in sample.time_series_split(t, ["id"], n_splits=3)]
    assert folds == [([0, 1, 2], [3]), ([0, 1, 2, 3], [4]), ([0, 1, 2, 3, 4], [5])]


def test_segmentation(spark):
    t = frame(spark, [(1, "x"), (1, "x"), (2, None)], "g bigint, s string")
    assert [(n, d.count()) for n, d in sample.segmentation(t, [["g", "s"]])] == [("('g', 's') = (1, 'x')", 2), ("('g', 's') = (2, None)", 1)]


def test_splits_are_disjoint(spark):
    t = spark.range(2000).withColumn("x", F.rand(1))
    for keys in (None, ["id"]):
        a, b = sample.train_test_split(t, 0.75, keys=keys)
        assert a.count() + b.count() == 2000 and a.join(b, "id").count() == 0


def test_deduplicate(spark):
    t = frame(spark, [(1, 1), (1, 2), (2, 3), (None, 4), (None, 5)], "k bigint, v bigint")
    assert sorted(one(sample.deduplicate(t, ["k"], "first", ["v"]), "v")) == [1, 3, 4]
    assert sorted(one(sample.deduplicate(t, ["k"], "last", ["v"]), "v")) == [2, 3, 5]
    assert one(sample.deduplicate(t, ["k"], "none"), "v") == [3]


def test_edge_frames(spark):
    t = frame(spark, [(None, math.nan, 1.0, ""), (None, math.inf, 1.0, "né"), (None, 2.0, 1.0, None)], "n double, x double, k double, s string")
    assert infer.infer_nan(t) == ["x"]
    assert infer.infer_nulls(t, 1.0) == ["n"]
    assert infer.infer_constants(t) == ["n", "k"]
    assert one(scale.scale(t, ["k"]), "k") == [None, None, None]
    assert one(impute.impute(t, ["n"], "mean"), "n") == [None, None, None]
    p = {r["column"]: r for r in reports.data_profile(t).collect()}
    assert p["n"]["null_pct"] == 1 and p["x"]["mean"] == 2 and p["k"]["std"] == 0 and p["k"]["skew"] is None and p["s"]["min"] == ""
    assert infer.correlation_pairs(t, ["k", "x"]).keys() == {("k", "x")}
    empty = t.limit(0)
    assert reports.data_profile(empty).count() == 4
    assert infer.infer_nulls(empty) == [] and infer.infer_by_pattern(empty, "a") == []
    assert values(encode.one_hot_encode(empty, ["s"])) == []
    assert math.isnan(metrics.mse(empty, "x", "k"))
    assert math.isnan(metrics.roc_auc(empty, "k", "x"))


def test_type_checks(spark):
    t = spark.sql("select 1 a, 'x' b, true c, array(1) d, date '2020-01-01' e, map(1, 2) f")
    assert schema.kinds(t) == {"a": "numeric", "b": "string", "c": "bool", "d": "list", "e": "datetime", "f": "other/unknown"}
    assert schema.check_columns_types(t, ["a", "b"]) == "numeric|string"
    assert schema.dtype_mapping(1.5) == "numeric" and schema.dtype_mapping(True) == "bool"
    assert schema.clean_strategy_str(" Min-Max ") == "min_max"
    with pytest.raises(ValueError):
        schema.type_checker(t, ["a", "b"], "numeric", "test")


def test_metrics(spark):
    t = frame(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert metrics.roc_auc(t, "y", "p") == 0.75
    ties = frame(spark, [(0, 0.5), (1, 0.5)], "y int, p double")
    assert metrics.roc_auc(ties, "y", "p") == 0.5
    r = metrics.precision_recall(t, "y", "p").orderBy("threshold").collect()
    assert [x["recall"] for x in r] == [1, 1, 0.5, 0.5] and r[0]["precision"] == 0.5
    assert metrics.huber_loss(t, "y", "p", 1.0) == pytest.approx(0.5 * metrics.mse(t, "y", "p"))
    assert metrics.grouped_binary_metrics(t, "y", "p").auc == 0.75
    assert metrics.psi_discrete(t, "y", t, "y") == 0
    c = spark.sql("select array(1.0, 0.0) a, array(1.0, 1.0) b, array(0.0, 0.0) z")
    assert c.select(metrics.cosine_similarity("a", "b")).first()[0] == pytest.approx(1 / math.sqrt(2))
    assert math.isnan(c.select(metrics.cosine_similarity("a", "z")).first()[0])


def test_text_functions(spark):
    t = frame(spark, [("apple", "maple"), ("né", "ne"), ("a", "a"), (None, "x"), ("", "")], "a string, b string")
    assert one(t.select(text.str_jaccard("a", "b").alias("j")), "j") == [0.6, 0.0, 1.0, None, 1.0]
    assert one(t.select(text.levenshtein_dist("a", "b").alias("j")), "j") == [2, 1, 0, None, 0]
    h = frame(spark, [("abc", "abd"), ("ab", "abc"), ("", ""), (None, "")], "a string, b string")
    assert one(h.select(text.hamming_bits("a", "b").alias("j")), "j") == [3, None, 0, None]
    w = frame(spark, [("running",), ("the",), ("1e5",), (None,)], "w string")
    assert one(w.select(text.snowball_stem("w").alias("s")), "s") == ["run", None, None, None]
    g = frame(spark, [(12, 18), (None, 4), (0, 5)], "a bigint, b bigint")
    assert values(g.select(numeric.gcd("a", "b").alias("g"), numeric.lcm("a", "b").alias("l"))) == [(6, 36), (None, None), (5, 0)]
    z = frame(spark, [([True, False, False, True, True],), ([],), (None,)], "b array<boolean>")
    assert one(z.select(numeric.lempel_ziv_complexity("b").alias("n")), "n") == [3, 0, None]


# Words and stems of the published vocabulary.
STEMS = dict(
    consistency="consist", knackeries="knackeri", knaves="knave", generously="generous", communication="communic", happily="happili", hoping="hope", hopping="hop", dying="die", skies="sky", agreed="agre",
    national="nation", rational="ration", ties="tie", cries="cri", gas="gas", kiwis="kiwi", ability="abil", sky="sky", feed="feed", proceed="proceed", luxuriously="luxuri", by="by", say="say", cry="cri",
)


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stems(word):
    assert stemmer.stem_word(word) == STEMS[word]


def test_stopwords():
    assert len(stemmer.STOPWORDS) == 178


def test_special():
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert special.f_survival(4.0, 2, 10) == pytest.approx(1.8**-5)
    assert special.kolmogorov_survival(1.36) == pytest.approx(0.0495, abs=1e-3)
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)


def test_mutual_info_tells_dependence(spark):
    t = spark.range(3000).select((F.col("id") % 2).alias("y"), F.randn(1).alias("noise")).withColumn("x", F.col("y") * 3 + F.randn(2))
    mi = {r["feature"]: r["estimated_mi"] for r in select.mutual_info(t, "y", ["x", "noise"]).collect()}
    assert mi["x"] > 0.3 and mi["noise"] < 0.05
    blocks = {r["feature"]: r["estimated_mi"] for r in select.mutual_info(t, "y", ["x", "noise"], block_rows=500).collect()}
    assert blocks["x"] == pytest.approx(mi["x"], abs=1e-6)


def test_normal_and_uniform(spark):
    t = spark.range(20000).select((F.randn(1) * 2 + 25).alias("a"), (F.rand(2) * 20 + 1).alias("b"))
    assert select.suggest_normal(t) == ["a"] and select.suggest_uniform(t) == ["b"]


def test_power_transform(spark):
    t = spark.range(5000).select(F.exp(F.randn(3)).alias("x"))
    out = scale.power_transform(t, ["x"], strategy="box_cox")
    assert abs(out.agg(F.skewness("x")).first()[0]) < 0.1


def test_mrmr_avoids_copies(spark):
    t = spark.range(2000).select((F.col("id") % 2).alias("y"), F.randn(5).alias("n")).select("y", (F.col("y") + F.randn(1)).alias("a"), (F.col("y") * 0.5 + F.randn(2)).alias("b"), "n").withColumn("a_copy", F.col("a") * 2)
    assert select.mrmr(t, "y", 2, ["a", "a_copy", "b", "n"], mrmr_strategy="knock_out") == ["a", "b"]
    assert set(select.mrmr(t, "y", 2, ["a", "a_copy", "b", "n"])) != {"a", "a_copy"}


def test_dependencies(spark):
    t = frame(spark, [(i, i // 5, i % 3) for i in range(25)], "nation int, region int, other int")
    table = diagnose.dependency_detection(t)
    assert ("region", "nation") in {(r["dependent"], r["depends_on"]) for r in table.collect()}
    assert '"nation" -> "region"' in diagnose.dependency_dot(table)


def test_pipeline(spark, tmp_path):
    t = frame(spark, [(1.0, "a", "x"), (None, "b", "y"), (3.0, None, "x")], "n double, c string, k string")
    p = Pipeline(t).pipe(impute.impute, ["n"]).pipe(scale.scale, ["n"], "min_max").pipe(encode.one_hot_encode, ["k"]).with_columns({"m": "n * 2"}).filter("m >= 0").drop(["c"])
    p.save(str(tmp_path / "p"))
    q = Pipeline.load(str(tmp_path / "p"))
    assert values(q.apply(t)) == values(p.frame) and len(q) == len(p)
    assert q.get_by_mention("k") and q.get_by_action_type("filter") and "with_columns" in q.as_str()
    assert values(q.apply(t, up_to=1)) == [(1.0, "a", "x"), (2.0, "b", "y"), (3.0, None, "x")]
    with pytest.raises(ValueError):
        Step("nothing", {}).validate()


def test_large_lookup_is_a_join(spark, tmp_path):
    t = spark.range(60000).select((F.col("id") % 30000).cast("string").alias("c"), (F.col("id") % 2).cast("int").alias("y"))
    p = Pipeline(t).pipe(encode.woe_cat_encode, "y", ["c"])
    assert "path" in p.steps[0].content
    p.save(str(tmp_path / "p"))
    assert Pipeline.load(str(tmp_path / "p")).apply(t).where("c is null").count() == 0


def test_pipeline_on_stream(spark, tmp_path):
    from prepline.streaming import apply_to_stream

    t = frame(spark, [(1.0, "a"), (None, "b"), (3.0, "a")], "n double, c string")
    t.write.parquet(str(tmp_path / "in"))
    p = Pipeline(t).pipe(impute.impute, ["n"], "mean").pipe(encode.one_hot_encode, ["c"])
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = apply_to_stream(p, stream).format("memory").queryName("out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(values(spark.table("out"))) == [(1.0, 1, 0), (2.0, 0, 1), (3.0, 1, 0)]


def test_model_step(spark, tmp_path):
    t = spark.range(400).select((F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) + F.rand(1)).alias("x"), F.when(F.col("id") % 9 > 0, F.rand(2)).alias("z"))
    m = models._fit(t, "y", ["x", "z"], {"maxIter": 3, "maxDepth": 2})
    p = Pipeline(t).pipe(models.add_classif, m, str(tmp_path / "m"), ["x", "z"])
    p.save(str(tmp_path / "p"))
    scored = Pipeline.load(str(tmp_path / "p")).apply(t)
    assert metrics.roc_auc(scored, "y", "model_score") > 0.95

    class Half:
        def predict(self, x):
            return x[:, 0] / 2

    assert models.append_regression(t, Half(), ["x", "z"]).where("abs(model_score - x / 2) > 1e-12").count() == 0


def test_running_sums_and_row_numbers(spark):
    t = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(1).alias("n"))
    out = reports.running(t, ["v"], {"c": "n"})
    assert out.where("c <> v + 1").count() == 0
    assert sample.row_numbers(t, ["v"]).where("row_nr <> v + 1").count() == 0


def test_large_frames_give_the_same_quantiles(spark, monkeypatch):
    from prepline.operators import quantiles

    t = spark.range(997).select(F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(50)) / 3).alias("a"), F.lit(None).cast("double").alias("b"), F.rand(1).alias("c"), F.lit("s").alias("s"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.93, 1.0]
    small = quantiles.column_quantiles(t, ["a", "b", "c"], shares)
    large = quantiles.sorted_quantiles(t, ["a", "b", "c"], shares)
    assert large["b"] is None and small["b"] is None
    for c in "ac":
        assert large[c] == pytest.approx(small[c])
    monkeypatch.setattr(quantiles, "FEW_CELLS", 0)
    assert quantiles.column_quantiles(t, ["a"], shares)["a"] == large["a"]
    assert quantiles.is_few(t, 997) and not quantiles.is_few(t, 996)
    r = {x["column"]: x for x in reports.data_profile(t).collect()}
    for c in "ac":
        want = t.agg(F.avg(c), F.stddev_samp(c), F.skewness(c), F.kurtosis(c), F.median(c)).first()
        assert [r[c][k] for k in ("mean", "std", "skew", "kurtosis", "median")] == [pytest.approx(v) for v in want]
    assert r["b"]["mean"] is None and r["b"]["null_pct"] == 1 and r["s"]["min"] == "s"
    assert reports.data_profile(t.limit(0)).count() == 4


def test_group_statistics_keep_null_groups(spark):
    from prepline.operators import quantiles

    t = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("h"), F.pmod(F.xxhash64("id"), F.lit(40)).cast("double").alias("x"))
    t = t.withColumn("x", F.when(F.col("x") == 3, float("nan")).when(F.col("x") > 4, F.col("x")))
    for keys in (["g"], ["g", "h"]):
        key = lambda r, keys=keys: tuple(r[k] for k in keys)
        clean = t.where("not isnan(x)")
        want = {key(r): [r["a"], r["b"], r["m"]] for r in clean.groupBy(*keys).agg(F.percentile("x", F.lit(0.3)).alias("a"), F.median("x").alias("b"), F.mode("x", True).alias("m")).collect()}
        q = {key(r): [r["q0"], r["q1"]] for r in quantiles.group_quantiles(t, keys, [0.3, 0.5]).collect()}
        m = {key(r): r["mode"] for r in quantiles.group_modes(clean, keys, F.col("x")).collect()}
        assert {k: [pytest.approx(q[k][0]), q[k][1], m[k]] for k in q} == want
        scaled = scale.scale_by(t, "x", keys, "median")
        assert scaled.where("x is not null and not isnan(x)").count() == clean.where("x is not null").count()
        filled = impute.hot_deck_impute(t, ["x"], keys, "median")
        assert filled.where("x is null").count() == 0


def test_many_rare_categories(spark):
    """More of them than are named in an expression, with a column named like the lookups'."""
    t = spark.range(3000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") < 1500, F.concat(F.lit("r"), F.col("id"))).otherwise("often").alias("v"), F.lit("x").alias("hit"))
    out = encode.merge_infreq_categories(t, ["v"], 5)
    rare = sorted(f"r{i}" for i in range(1500) if i % 50)
    r = {x["v"]: x["n"] for x in out.groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert r == {"|".join(rare): len(rare), "often": 1470, None: 60} and out.columns == t.columns
    places = encode.ordinal_auto_encode(t, ["v"])
    assert places.agg(F.max("v"), F.min("v")).first() == (len(rare) + 1, 0)
    with pytest.raises(ValueError):
        encode.one_hot_encode(t, ["v"])
    assert len(encode.one_hot_encode(t, ["v"], max_flags=2000).columns) == len(rare) + 2


def test_order_and_rename(spark):
    t = frame(spark, [(2,), (None,), (1,)], "A int")
    assert one(columns.order_by(t, "A"), "A") == [None, 1, 2]
    assert one(columns.order_by(t, "A", descending=True, nulls_last=True), "A") == [2, 1, None]
    assert columns.lowercase(t).columns == ["a"] and columns.rename(t, {"A": "x", "no": "y"}).columns == ["x"]
