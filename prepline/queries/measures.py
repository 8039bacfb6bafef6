"""Metrics, drift and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepline.operators import metrics as M
from prepline.queries.base import KEYS, Queries

registry = Queries()
on = registry.on
A, P = "actual", "predicted"
OK = " from t where actual is not null and predicted is not null"


def one(key: str, expr, sql: str, which: str = "pairs") -> None:
    on(which, key, lambda t: t.agg(expr().alias("value")), f"select round({sql}, 6) as \"value\"" + (OK if which == "pairs" else " from t where qty is not null"))


on("line", "get_sample_weight", lambda t: M.get_sample_weight(t, "flag").select(*KEYS, "weight"), "select l_orderkey, l_linenumber, round((select count(*) from t) / (4.0 * count(*) over (partition by flag)), 6) weight from t")
on("pairs", "tp_fp_frame", lambda t: M.tp_fp_frame(t, A, P).select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr")), "+g as (select predicted threshold, count(*) n, sum(actual) p" + OK + " group by 1), c as (select threshold, sum(p) over w tp, sum(n - p) over w fp from g window w as (order by threshold desc)) select threshold, round(tp / (select sum(p) from g), 6) tpr, round(fp / (select sum(n - p) from g), 6) fpr from c", digits=None)
on("pairs", "precision_recall", lambda t: M.precision_recall(t, A, P).select("threshold", "predicted_cnt_at_threshold", "pos_cnt_at_threshold", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round("`F_1.00`", 6).alias("F_1.00")), "+g as (select predicted threshold, count(*) n, sum(actual)::bigint p" + OK + " group by 1), c as (select threshold, n, p, sum(p) over w tp, sum(n) over w pp from g window w as (order by threshold desc)), r as (select *, tp / pp pr, tp / (select sum(p) from g) re from c) select threshold, n predicted_cnt_at_threshold, p pos_cnt_at_threshold, round(re, 6) recall, round(pr, 6) \"precision\", case when pr + re > 0 then round(2 * pr * re / (pr + re), 6) else 'nan'::double end \"F_1.00\" from r", digits=None)
on("pairs", "roc_auc", lambda t: M.roc_auc_frame(t, A, P), "+g as (select predicted x, sum((actual = 1)::int) p, sum((actual <> 1)::int) q" + OK + " group by 1), c as (select p, q, sum(q) over (order by x) b from g) select round(sum(p * (b - q / 2)) / (sum(p) * sum(q)), 6) auc from c")
one("log_loss", lambda: M.log_loss_expr(A, P), "avg(-case when actual = 1 then ln(predicted) else ln(1 - predicted) end)")
one("mse", lambda: M.mse_expr(A, P), "avg((actual - predicted) ** 2)")
one("brier_loss", lambda: M.mse_expr(A, P), "avg((actual - predicted) ** 2)")
one("rmse", lambda: M.rmse_expr(A, P), "sqrt(avg((actual - predicted) ** 2))")
one("mae", lambda: M.mae_expr(A, P), "avg(abs(actual - predicted))")
one("mae_weighted", lambda: M.mae_expr(A, P, "pair_id"), "sum(pair_id * abs(actual - predicted)) / sum(pair_id)")
one("max_abs_error", lambda: M.max_abs_error_expr(A, P), "max(abs(actual - predicted))")
one("smape", lambda: M.smape_expr(A, P), "100 * sum(case when abs(actual) + abs(predicted) > 0 then abs(actual - predicted) / (abs(actual) + abs(predicted)) else 0 end) / count(*)")
one("smape_double_sum", lambda: M.smape_expr(A, P, True), "sum(abs(actual - predicted)) / sum(abs(actual) + abs(predicted))")
one("mape_weighted", lambda: M.mape_expr(A, P, True), "sum(abs(actual - predicted)) / sum(abs(actual))")
Y, Q = "qty", "l_linenumber"
one("mape", lambda: M.mape_expr(Y, Q), "avg(abs(1 - l_linenumber / qty))", "line")
one("rmsle", lambda: M.rmsle_expr(Y, Q), "sqrt(avg((ln(1 + l_linenumber) - ln(1 + qty)) ** 2))", "line")
one("r2", lambda: M.r2_expr(Y, Q), "1 - sum((qty - l_linenumber) ** 2) / (var_pop(qty) * count(*))", "line")
one("huber_loss", lambda: M.huber_loss_expr(Y, Q, 10.0), "avg(case when abs(qty - l_linenumber) < 10 then 0.5 * (qty - l_linenumber) ** 2 else 10 * (abs(qty - l_linenumber) - 5) end)", "line")
on("line", "adjusted_r2", lambda t: t.sparkSession.createDataFrame([(M.adjusted_r2(t, Y, Q, 3),)], "value double"), "+r as (select 1 - sum((qty - l_linenumber) ** 2) / (var_pop(qty) * count(*)) r, count(*) n from t where qty is not null) select round(1 - (1 - r) * (n - 1) / (n - 4), 6) as \"value\" from r")
on("line", "grouped_regression_metrics", lambda t: t.agg(M.mae_expr(Y, Q).alias("mae"), M.mse_expr(Y, Q).alias("mse"), M.rmse_expr(Y, Q).alias("rmse"), M.max_abs_error_expr(Y, Q).alias("max_error")), "select round(avg(abs(qty - l_linenumber)), 6) mae, round(avg((qty - l_linenumber) ** 2), 6) mse, round(sqrt(avg((qty - l_linenumber) ** 2)), 6) rmse, max(abs(qty - l_linenumber)) max_error from t where qty is not null")
on("line", "grouped_time_series_metrics", lambda t: t.agg(M.mse_expr(Y, Q).alias("mse"), M.mape_expr(Y, Q).alias("mape"), M.smape_expr(Y, Q).alias("smape"), M.max_abs_error_expr(Y, Q).alias("max_error")), "select round(avg((qty - l_linenumber) ** 2), 6) mse, round(avg(abs(1 - l_linenumber / qty)), 6) mape, round(100 * avg(abs(qty - l_linenumber) / (qty + l_linenumber)), 6) smape, max(abs(qty - l_linenumber)) max_error from t where qty is not null")
on("pairs", "grouped_binary_metrics", lambda t: t.sparkSession.createDataFrame([tuple(vars(M.grouped_binary_metrics(t, A, P)).values())], "auc double, log_loss double, brier_loss double, max_error double"), "+g as (select predicted x, sum((actual = 1)::int) p, sum((actual <> 1)::int) q" + OK + " group by 1), c as (select p, q, sum(q) over (order by x) b from g), r as (select sum(p * (b - q / 2)) / (sum(p) * sum(q)) auc from c) select (select round(auc, 6) from r) auc, round(avg(-case when actual = 1 then ln(predicted) else ln(1 - predicted) end), 6) log_loss, round(avg((actual - predicted) ** 2), 6) brier_loss, round(max(abs(actual - predicted)), 6) max_error" + OK)

# drift
_OLD, _NEW = "l_linenumber <= 3", "l_linenumber > 3"
on("line", "psi_discrete", lambda t: M.psi_discrete_table(t.where(_OLD), "flag", t.where(_NEW), "flag"), f"+a as (select flag v, count(*) n from t where {_OLD} group by 1), b as (select flag v, count(*) n from t where {_NEW} group by 1), s as (select coalesce(a.v, b.v) v, greatest(coalesce(a.n, 0) / (select sum(n) from a), 1e-5) e, greatest(coalesce(b.n, 0) / (select sum(n) from b), 1e-5) c from a full join b on a.v is not distinct from b.v) select v \"value\", round(e, 8) \"expected%\", round(c, 8) \"actual%\", round((e - c) * ln(e / c), 8) psi from s", digits=8)
on("line", "psi", lambda t: M.psi_table(t.where(_OLD), "price", t.where(_NEW), "price", 10).agg(F.sum("psi").alias("psi")), f"+q as (select quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) c from t where {_OLD}), k as (select l_linenumber, (select count(*) from (select unnest(c) x from q) where x < price) b from t), g as (select b, count(*) filter (where {_OLD}) / (select count(*) from t where {_OLD}) e, count(*) filter (where {_NEW}) / (select count(*) from t where {_NEW}) a from k group by 1) select round(sum((greatest(e, 1e-5) - greatest(a, 1e-5)) * ln(greatest(e, 1e-5) / greatest(a, 1e-5))), 6) psi from g")
on("line", "jaccard_similarity", lambda t: t.sparkSession.createDataFrame([(M.jaccard_similarity(t.where("flag = 'R'"), "l_partkey", t.where("flag = 'A'"), "l_partkey"),)], "value double"), "select round((select count(*) from (select l_partkey from t where flag = 'R' intersect select l_partkey from t where flag = 'A')) / (select count(distinct l_partkey) from t where flag in ('R', 'A')), 6) as \"value\"")
on("emb", "cosine_similarity", lambda t: t.select("vec_id", M.cosine_similarity("embedding", F.transform("embedding", lambda x, i: x * (i % 3))).alias("s"), M.cosine_dist("embedding", "embedding").alias("d")), "select vec_id, round(list_cosine_similarity(embedding::double[], list_transform(embedding::double[], lambda x, i: x * ((i - 1) % 3))), 6) s, 0.0::double d from t")
on("emb", "cosine_matrix", lambda t: M.cosine_matrix(t.where("vec_id % 100 = 0"), t, "vec_id", "embedding"), "select a.vec_id id_a, b.vec_id id_b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) similarity from t a, t b where a.vec_id % 100 = 0")
on("parts", "df_jaccard_similarity", lambda t: M.df_jaccard_similarity(t.select("p_partkey", F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b")), "a", "b").select("p_partkey", "a_b_jaccard"), "+g as (select p_partkey, string_split(p_name, ' ') a, string_split(p_type, ' ') b from t) select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) a_b_jaccard from g")
