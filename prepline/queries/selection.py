"""Sampling, splitting, feature selection, models and recorded pipelines."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.operators import columns as C
from prepline.operators import encode as E
from prepline.operators import impute as M
from prepline.operators import models as L
from prepline.operators import sample as S
from prepline.operators import scale as Z
from prepline.operators import select as X
from prepline.plans import Pipeline
from prepline.queries.base import KEYS, Queries
from prepline.session import shared_folder

registry = Queries()
on = registry.on
K = "l_orderkey, l_linenumber"
ID = ["l_orderkey", "l_linenumber", "l_partkey", "price"]


def _union(frames) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _sizes(frames, extra: str = "l_orderkey") -> DataFrame:
    return _union([f.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(extra), F.lit(0)).alias("total")).select(F.lit(i).alias("part"), "n", "total") for i, f in enumerate(frames)])


def _share(t: DataFrame, part: DataFrame, share: float) -> DataFrame:
    """Whether a part of the rows has no row twice, none from elsewhere, and about its share of all."""
    n = t.count()
    inside = part.join(t.select(*KEYS).distinct(), KEYS, "left_semi").count()
    return part.agg((F.count(F.lit(1)) == F.count_distinct(*ID)).alias("once"), (F.count(F.lit(1)) == inside).alias("inside"), (F.abs(F.count(F.lit(1)) / n - share) < 0.03).alias("near"))


_OK = "select true once, true inside, true near"

# sampling
on("line", "lazy_sample", lambda t: _share(t, S.lazy_sample(t, 0.3, keys=ID), 0.3), _OK)
on("line", "lazy_sample_amount", lambda t: S.lazy_sample(t, sample_amt=1000, keys=ID).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*ID).alias("d")), "select 1000::bigint n, 1000::bigint d")
on("line", "deduplicate", lambda t: S.deduplicate(t, ["l_partkey", "flag"]).select("l_partkey", "flag"), "select distinct l_partkey, flag from t")
on("line", "deduplicate_first", lambda t: S.deduplicate(t, ["l_partkey"], "first", ["l_orderkey", "l_linenumber", "price"]).select("l_partkey", *KEYS), f"select l_partkey, {K} from t qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, price) = 1")
on("line", "deduplicate_last", lambda t: S.deduplicate(t, ["l_partkey"], "last", ["l_orderkey", "l_linenumber", "price"]).select("l_partkey", *KEYS), f"select l_partkey, {K} from t qualify row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, price desc) = 1")
on("line", "deduplicate_none", lambda t: S.deduplicate(t, ["l_orderkey", "flag"], "none").select(*KEYS), f"select {K} from t qualify count(*) over (partition by l_orderkey, flag) = 1")
on("cust", "simple_upsample", lambda t: S.simple_upsample(t, "seg = 'BUILDING'", 200).groupBy("seg").agg(F.count(F.lit(1)).alias("n")), "select seg, count(*) + case when seg = 'BUILDING' then 200 else 0 end n from t group by 1")
on("line", "simple_downsample", lambda t: S.simple_downsample(t, "flag = 'N'", 0.0, ID).select(*KEYS), f"select {K} from t where flag is distinct from 'N'")
on("line", "simple_downsample_share", lambda t: S.simple_downsample(t, "flag = 'N'", 0.2, ID).groupBy((F.coalesce(F.col("flag") == "N", F.lit(False))).alias("own")).agg(F.count(F.lit(1)).alias("n")).crossJoin(t.agg(F.count(F.when(F.col("flag") == "N", 1)).alias("all"))).select("own", F.when(~F.col("own"), F.col("n")).alias("others"), F.when(F.col("own"), F.abs(F.col("n") / F.col("all") - 0.2) < 0.03).alias("near")), "select false own, count(*) others, null::boolean near from t where flag is distinct from 'N' union all select true, null, true")
on("line", "stratified_downsample", lambda t: S.stratified_downsample(t, ["flag"], 50, keys=ID).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*ID).alias("d")), "select flag, least(count(*), 50) n, least(count(*), 50) d from t group by 1")
on("line", "stratified_downsample_share", lambda t: S.stratified_downsample(t, ["l_partkey"], 0.25, 3, keys=ID).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), "select l_partkey, least(count(*), ceil(greatest(count(*) * 0.25, 3)))::bigint n from t group by 1")
on("line", "train_test_split", lambda t: _union(S.train_test_split(t, 0.75, keys=ID)).select(*KEYS), f"select {K} from t")
on("line", "train_test_split_share", lambda t: _share(t, S.train_test_split(t, 0.75, keys=ID)[0], 0.75), _OK)
on("line", "train_test_split_rows", lambda t: _share(t, S.train_test_split(t, 0.6)[1], 0.4), _OK)
on("line", "time_series_split", lambda t: _sizes([x for fold in S.time_series_split(t, ["ship", *ID], 3, gap=10) for x in fold]), "+o as (select l_orderkey, row_number() over (order by ship, l_orderkey, l_linenumber, l_partkey, price) r, count(*) over () n from t), f as (select unnest([3, 2, 1]) j), p as (select *, n - j * (n // 4) + 1 b, n // 4 s from o, f) select ((3 - j) * 2)::int part, count(*) n, sum(l_orderkey)::bigint total from p where r < b group by 1 union all select ((3 - j) * 2 + 1)::int, count(*), sum(l_orderkey)::bigint from p where r >= b + 10 and r < b + 10 + s group by 1")
on("line", "time_sliding_window", lambda t: _sizes([_union(w) for w in S.time_sliding_window(t, "ship", "yearly", 2)]), "+y as (select year(ship) y, count(*) n, sum(l_orderkey) s from t group by 1), w as (select y, n + lead(n) over (order by y) n, s + lead(s) over (order by y) total, row_number() over (order by y) - 1 part from y) select part::int part, n, total::bigint total from w where n is not null")
on("line", "sliding_window", lambda t: _sizes([_union(w) for w in S.sliding_window(t, ["l_linenumber"], 3)]), "+y as (select l_linenumber y, count(*) n, sum(l_orderkey) s from t group by 1), w as (select y, sum(n) over v n, sum(s) over v total, count(*) over v c, row_number() over (order by y) - 1 part from y window v as (order by y rows between current row and 2 following)) select part::int part, n::bigint n, total::bigint total from w where c = 3")
on("line", "bootstrap", lambda t: _union([f.agg(F.lit(i).alias("part"), F.count(F.lit(1)).alias("n"), F.count_distinct(*ID).alias("d")) for i, f in enumerate(S.bootstrap(t, 3, sample_amt=500, keys=ID))]), "select unnest([0, 1, 2]) part, 500::bigint n, 500::bigint d")
on("line", "col_subsample", lambda t: t.sparkSession.createDataFrame([(i, len(f.columns), "ship" in f.columns, set(f.columns) <= set(t.columns), f.count()) for i, f in enumerate(S.col_subsample(t, 3, 4, ["ship"]))], "part int, n int, kept boolean, known boolean, n_rows bigint"), "select unnest([0, 1, 2]) part, 5 n, true kept, true known, (select count(*) from t) n_rows")
on("line", "segmentation", lambda t: _union([f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("segment"), "n") for k, f in S.segmentation(t, [["flag", "status"]])]), "select '(''flag'', ''status'') = (' || coalesce('''' || flag || '''', 'None') || ', ''' || status || ''')' segment, count(*) n from t group by 1")
on("line", "row_numbers", lambda t: S.row_numbers(t, ["ship", *ID]).select(*KEYS, F.col("row_nr").cast("bigint").alias("row_nr")), f"select {K}, row_number() over (order by ship, l_orderkey, l_linenumber, l_partkey, price) row_nr from t")

# statistics
F4 = ["qty", "price", "disc", "tax"]
on("line", "abs_corr", lambda t: X.abs_corr(t, "target", F4), " union all ".join(f"select '{c}' feature, round(abs(corr({c}, target)), 6) abs_corr from t" for c in F4))
on("line", "abs_corr_selector", lambda t: X.abs_corr_selector(t.select("qty", "price", (F.col("price") * 2).alias("twice"), "flag"), "price", 0.5), "select price, price * 2 twice, flag from t")
_IG = "(select '{0}' feature, h target_entropy, greatest(sum(n * ln(m / n)) / sum(n), 0) ce, count(distinct coalesce(x::varchar, '~')) / sum(n) u from (select {0} x, {1} y, count(*) n, sum(count(*)) over (partition by {0}) m from t group by 1, 2), (select sum(-n / s * ln(n / s)) h from (select count(*) n, sum(count(*)) over () s from t group by {1})) group by h)"
on("line", "discrete_ig", lambda t: X.discrete_ig(t, "target", ["flag", "status", "l_linenumber"]), "+g as (" + " union all ".join(_IG.format(c, "target") for c in ("flag", "status", "l_linenumber")) + ") select feature, round(target_entropy, 6) target_entropy, round(ce, 6) conditional_entropy, round(u, 6) unique_pct, round(greatest(target_entropy - ce, 0), 6) information_gain, round((1 - u) * greatest(target_entropy - ce, 0), 6) weighted_information_gain from g")
on("houses", "discrete_ig_selector", lambda t: X.discrete_ig_selector(t.select("id", "ms_zoning", "heating", "central_air", "price_over_200k"), "price_over_200k", 3).select("id", "ms_zoning", "heating", "central_air"), "select id, ms_zoning, heating, central_air from t")
_F = "(select '{0}' feature, sum(n * v) w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) b, count(*) k, sum(n) n from (select count({0}) n, avg({0}) m, var_pop({0}) v from t where {0} is not null group by {1}))"
on("line", "f_classif", lambda t: X.f_classif(t, "status", F4).select("feature", "f_value"), "+f as (" + " union all ".join(_F.format(c, "status") for c in F4) + ") select feature, round(b / w * (n - k) / (k - 1), 6) f_value from f")
on("line", "f_classif_p", lambda t: X.f_classif(t, "target", F4))
on("line", "f_score_selector", lambda t: X.f_score_selector(t.select("l_orderkey", "qty", "price", "target"), "target", 3), "select l_orderkey, qty, price, target from t")
_KS = "(select '{0}' feature, max(abs(a / na - b / nb)) ks from (select x, sum(sum((y = 1)::int)) over (order by x) a, sum(sum((y <> 1)::int)) over (order by x) b from (select {0} x, target y from t where {0} is not null) group by x), (select count(*) filter (where target = 1) na, count(*) filter (where target <> 1) nb from t where {0} is not null))"
on("line", "ks_statistic", lambda t: X.ks_statistic(t, "target", F4).select("feature", "ks"), "select feature, round(ks, 6) ks from (" + " union all ".join(_KS.format(c) for c in F4) + ")")
on("line", "ks_statistic_p", lambda t: X.ks_statistic(t, "target", F4))
_KC = "(select '{0}' feature_1, '{1}' feature_2, round(max(abs(a / na - b / nb)), 6) ks from (select x, sum(sum(s)) over (order by x) a, sum(sum(1 - s)) over (order by x) b from (select {0} x, 1 s from t union all select {1}, 0 from t) where x is not null group by x), (select count({0}) na, count({1}) nb from t))"
on("line", "ks_compare", lambda t: X.ks_compare(t, ["disc", "tax", "qty"]).select("feature_1", "feature_2", "ks"), " union all ".join(_KC.format(a, b) for a, b in (("disc", "tax"), ("disc", "qty"), ("tax", "qty"))))
on("ads", "dist_test", lambda t: X.dist_test(t.select((F.col("daily_time_spent_on_site") / 100).alias("x")), "uniform"), None)
on("line", "dist_test_uniform", lambda t: X.dist_test(t.select((F.col("qty") / 51).alias("x")), "uniform").select("feature", "ks"), "select 'x' feature, round(max(greatest(c / n - x / 51, x / 51 - (c - k) / n)), 6) ks from (select qty x, count(*) k, sum(count(*)) over (order by qty) c, sum(count(*)) over () n from t where qty is not null group by 1)")
on("line", "suggest_uniform", lambda t: X.suggest_uniform(t.select("price", "disc")))
on("ads", "suggest_normal", lambda t: X.suggest_normal(t.select("daily_time_spent_on_site")))
_MI = """+k as (
  select o_orderstatus s, o_totalprice x, count(*) over () n, count(*) over (partition by o_orderstatus) c, lag(o_totalprice, 1) over w l1, lag(o_totalprice, 2) over w l2, lag(o_totalprice, 3) over w l3,
         lead(o_totalprice, 1) over w r1, lead(o_totalprice, 2) over w r2, lead(o_totalprice, 3) over w r3
  from t window w as (partition by o_orderstatus order by o_totalprice)),
r as (select *, least(coalesce(x - l3, 'inf'::double), coalesce(r3 - x, 'inf'::double), case when l2 is null or r1 is null then 'inf'::double else greatest(x - l2, r1 - x) end, case when l1 is null or r2 is null then 'inf'::double else greatest(x - l1, r2 - x) end) r from k),
m as (select *, count(*) over (order by x range between (r - 1e-9) preceding and (r - 1e-9) following) m from r),
d as (select n, c, m, ln(n + 6) - 0.5 / (n + 6) - 1 / (12.0 * (n + 6) ** 2) + 1 / (120.0 * (n + 6) ** 4) - list_sum(list_transform(range(6), lambda i: 1 / (n + i))) dn,
             ln(c + 6) - 0.5 / (c + 6) - 1 / (12.0 * (c + 6) ** 2) + 1 / (120.0 * (c + 6) ** 4) - list_sum(list_transform(range(6), lambda i: 1 / (c + i))) dc,
             ln(m + 6) - 0.5 / (m + 6) - 1 / (12.0 * (m + 6) ** 2) + 1 / (120.0 * (m + 6) ** 4) - list_sum(list_transform(range(6), lambda i: 1 / (m + i))) dm from m)
select 'o_totalprice' feature, round(greatest(avg(dn) + (1.5 - 0.5772156649015329) - avg(dc) - avg(dm), 0), 3) estimated_mi from d"""
on("ord", "mutual_info", lambda t: X.mutual_info(t, "o_orderstatus", ["o_totalprice"]), _MI, digits=3)
on("ord", "mutual_info_blocks", lambda t: X.mutual_info(t, "o_orderstatus", ["o_totalprice"], block_rows=2000), _MI, digits=3)
on("line", "mutual_info_selector", lambda t: X.mutual_info_selector(t.select("qty", "price", "status"), "status", top_k=1))
_FS = "+f as (" + " union all ".join(_F.format(c, "target") for c in F4) + "), rel as (select feature, b / w * (n - k) / (k - 1) f from f)"
_KR = "+rel as (" + " union all ".join(f"select feature, ks f from {_KS.format(c)}" for c in F4) + ")"
_CR = ", c as (" + " union all ".join(f"select '{a}' a, '{b}' b, abs(corr({a}, {b})) r from t" for a in F4 for b in F4 if a != b) + ")"


def _rounds(rel: str, k: int, weight: float) -> str:
    """The greedy rounds of accumulated correlation in SQL."""
    out = [rel + _CR, "s1 as (select feature from rel order by f desc limit 1)"]
    for j in range(1, k):
        total = " + ".join(f"{1 - weight * i / k} * coalesce((select r from c, s{i} where a = rel.feature and b = s{i}.feature), 0)" for i in range(1, j + 1))
        gone = " and ".join(f"rel.feature not in (from s{i})" for i in range(1, j + 1))
        out.append(f"s{j + 1} as (select rel.feature from rel where {gone} order by {j} * f / ({total}) desc limit 1)")
    return ", ".join(out) + " " + " union all ".join(f"select feature column_name from s{j}" for j in range(1, k + 1))


on("line", "mrmr", lambda t: X.mrmr(t, "target", 3, F4), _rounds(_FS, 3, 1))
on("line", "mrmr_knock_out", lambda t: X.mrmr(t, "target", 3, F4, mrmr_strategy="knock_out"), _FS + _CR + ", s1 as (select feature from rel order by f desc limit 1), s2 as (select feature from rel where feature not in (from s1) and not exists (from c, s1 where a = rel.feature and b = s1.feature and r >= 0.75) order by f desc limit 1), s3 as (select feature from rel where feature not in (from s1) and feature not in (from s2) and not exists (from c, s1 where a = rel.feature and b = s1.feature and r >= 0.75) and not exists (from c, s2 where a = rel.feature and b = s2.feature and r >= 0.75) order by f desc limit 1) select feature column_name from s1 union all select feature from s2 union all select feature from s3")
on("line", "mrmr_ks", lambda t: X.mrmr(t, "target", 2, F4, relevance="ks", mrmr_strategy="accum_corr"), _rounds(_KR, 2, 0))
on("line", "f_classif_wide", lambda t: X.f_classif(t.selectExpr("status", *[f"{c} as {c}{i}" for c in F4 for i in range(3)]), "status").select("feature", "f_value"), "+f as (" + " union all ".join(_F.format(c, "status") for c in F4) + ") select feature || i feature, round(b / w * (n - k) / (k - 1), 6) f_value from f, (select unnest([0, 1, 2]) i)")
_W = "select '{0}' feature, {0}::varchar \"value\", (sum(price_over_200k) + 1) / ((select sum(price_over_200k) from t) + 2) e, (sum(1 - price_over_200k) + 1) / ((select sum(1 - price_over_200k) from t) + 2) o from t group by {0}"
on("houses", "woe_iv", lambda t: X.woe_iv(t, "price_over_200k", ["ms_zoning", "heating", "central_air"]), "+w as (" + " union all ".join(_W.format(c) for c in ("ms_zoning", "heating", "central_air")) + ") select feature, \"value\", round(ln(e / o), 6) woe, round(sum((e - o) * ln(e / o)) over (partition by feature), 6) information_value from w")

# models
_ML = ["lot_frontage", "year_built", "ms_sub_class"]


def _model(t: DataFrame):
    return L._fit(t, "price_over_200k", _ML)


on("houses", "append_classif_score", lambda t: L.append_classif_score(t, _model(t), _ML).select("id", "model_score"))
_LOT = ["year_built", "ms_sub_class", "air"]


def _regressed(t: DataFrame) -> DataFrame:
    t = t.selectExpr("id", "year_built", "ms_sub_class", "if(central_air = 'Y', 1, 0) air", "ms_sub_class * 2.0 + if(central_air = 'Y', 50, 0) y")
    return L.append_regression(t, L._fit_regression(t, "y", _LOT), _LOT)


on("houses", "append_regression", lambda t: _regressed(t).select("id", "model_score"))
on("houses", "append_regression_fit", lambda t: _regressed(t).agg(F.count("y").alias("n"), (F.sum(F.pow(F.col("y") - F.col("model_score"), 2)) < 0.1 * F.count("y") * F.var_pop("y")).alias("explains")), "select count(ms_sub_class) n, true explains from t")
on("houses", "append_classif_score_fit", lambda t: L.append_classif_score(t, _model(t), _ML).groupBy("price_over_200k").agg(F.avg("model_score").alias("m"), F.count(F.lit(1)).alias("n")).agg((F.max(F.when(F.col("price_over_200k") == 1, F.col("m"))) > F.max(F.when(F.col("price_over_200k") == 0, F.col("m")))).alias("tells"), F.sum("n").alias("n")), "select true tells, count(*) n from t")
on("houses", "permutation_importance", lambda t: L.permutation_importance(t.select("price_over_200k", *_ML), "price_over_200k"))
on("houses", "ebfs", lambda t: L.ebfs(t.select("price_over_200k", *_ML, (F.col("central_air") == "Y").cast("int").alias("air")), "price_over_200k")[0])
on("houses", "suggest_hyperparams", lambda t: L.suggest_hyperparams(t, "price_over_200k", _ML)[1].select("trial", "value"))


# pipelines
def _replayed(t: DataFrame) -> DataFrame:
    p = Pipeline(t).pipe(M.impute, ["qty", "tax"], "median").pipe(Z.scale, ["price"], "min_max").pipe(E.one_hot_encode, ["flag"]).pipe(C.filter, "qty > 10")
    folder = f"{shared_folder(t.sparkSession)}/{uuid.uuid4().hex}"
    p.save(folder)
    return Pipeline.load(folder).apply(t).select(*KEYS, "qty", "price", "flag_A", "flag_N", "flag_R")


on("line", "pipeline_replayed", _replayed, f"+f as (select *, coalesce(qty, (select median(qty) from t)) q from t) select {K}, q qty, round((price - (select min(price) from t)) / (select max(price) - min(price) from t), 6) price, " + ", ".join(f"coalesce(flag = '{v}', false)::tinyint flag_{v}" for v in "ANR") + " from f where q > 10")
