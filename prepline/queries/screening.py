"""Schema, projection, inference and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepline.operators import columns as C
from prepline.operators import diagnose as D
from prepline.operators import infer as I
from prepline.operators import reports as R
from prepline.operators import schema as S
from prepline.queries.base import FRAMES, KEYS, Queries, names_sql

registry = Queries()
on = registry.on
LINE = list(FRAMES["line"][1])
NUM = ["l_orderkey", "l_linenumber", "l_partkey", "qty", "price", "disc", "tax", "target"]

# schema
on("line", "get_numeric_cols", lambda t: S.get_numeric_cols(t), names_sql(NUM))
on("line", "get_string_cols", lambda t: S.get_string_cols(t), names_sql(["flag", "status"]))
on("line", "infer_str_cols", lambda t: S.infer_str_cols(t), names_sql(["flag", "status"]))
on("line", "get_datetime_cols", lambda t: S.get_datetime_cols(t), names_sql(["ship"]))
on("line", "get_bool_cols", lambda t: S.get_bool_cols(t.withColumn("big", F.col("qty") > 10)), names_sql(["big"]))
on("line", "get_cols_regex", lambda t: S.get_cols_regex(t, "^L_", lowercase=False) + S.get_cols_regex(t, "^l_", lowercase=True), names_sql(["l_orderkey", "l_linenumber", "l_partkey"]))
on("line", "get_complement", lambda t: S.get_complement(t, NUM), names_sql(["flag", "status", "ship"]))
on("line", "get_similar_colnames", lambda t: S.get_similar_colnames(t, "stats", 2), names_sql(["status"]))
on("line", "check_columns_types", lambda t: S.check_columns_types(t).split("|"), names_sql(["datetime", "numeric", "string"]))
on("line", "type_checker", lambda t: ["ok"] if S.type_checker(t, NUM, "numeric", "q") else [], names_sql(["ok"]))

# projections
on("line", "rename", lambda t: C.rename(t, {"qty": "amount", "nope": "x"}).select(*KEYS, "amount"), "select l_orderkey, l_linenumber, qty amount from t")
on("cust", "lowercase", lambda t: C.lowercase(t.withColumnRenamed("seg", "SEG")), "select * from t")
on("line", "custom_transform", lambda t: C.custom_transform(t, {"net": "price * (1 - disc)"}).select(*KEYS, "net"), "select l_orderkey, l_linenumber, round(price * (1 - disc), 6) net from t")
on("line", "coalesce", lambda t: C.coalesce(t, ["qty", "tax", "0"], "first_known").select(*KEYS, "first_known"), "select l_orderkey, l_linenumber, coalesce(qty, tax, 0) first_known from t")
on("cust", "cast_dtype", lambda t: C.cast_dtype(t, ["c_name", "c_nationkey"], "bigint").select("c_custkey", "c_name", "c_nationkey"), "select c_custkey, try_cast(c_name as bigint) c_name, c_nationkey::bigint c_nationkey from t")
on("line", "shrink_dtype", lambda t: C.shrink_dtype(t, ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey"), "select l_orderkey, l_linenumber, l_partkey from t")
on("line", "id_passthrough", lambda t: C.id_passthrough(t, "qty").select(*KEYS, "qty_id_passthrough"), "select l_orderkey, l_linenumber, qty qty_id_passthrough from t")
on("line", "linear_passthrough", lambda t: C.linear_passthrough(t, "qty", 2.0, 1.0).select(*KEYS, "qty_linear"), "select l_orderkey, l_linenumber, 2 * qty + 1 qty_linear from t")
on("line", "logistic_passthrough", lambda t: C.logistic_passthrough(t, "qty", 0.1, -1.0).select(*KEYS, "qty_logistic"), "select l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.1 * qty - 1))), 6) qty_logistic from t")

# filters and drops
on("line", "filter", lambda t: C.filter(t, "qty > 25 and disc < 0.05").select(*KEYS), "select l_orderkey, l_linenumber from t where qty > 25 and disc < 0.05")
on("line", "drop_nulls", lambda t: C.drop_nulls(t, ["qty", "flag"]).select(*KEYS, "qty", "flag"), "select l_orderkey, l_linenumber, qty, flag from t where qty is not null and flag is not null")
on("line", "drop_non_numeric", lambda t: C.drop_non_numeric(t), f"select {', '.join(NUM)} from t")
on("line", "drop_by_regex", lambda t: C.drop_by_regex(t, "^l_"), f"select {', '.join(c for c in LINE if not c.startswith('l_'))} from t")
on("line", "drop_highly_null", lambda t: C.drop_highly_null(t, 0.12), f"select {', '.join(c for c in LINE if c not in ('tax', 'flag'))} from t")
on("line", "drop_constants", lambda t: C.drop_constants(t.withColumns({"one": F.lit(1), "one_or_null": F.when(F.col("qty") > 5, "x")})), "select * from t")
on("line", "drop_highly_unique", lambda t: C.drop_highly_unique(t, 0.9), f"select {', '.join(c for c in LINE if c != 'price')} from t")
on("line", "drop_by_var", lambda t: C.drop_by_var(t, 0.01, "target"), f"select {', '.join(c for c in LINE if c not in ('disc', 'tax'))} from t")
on("line", "drop_invalid_numeric", lambda t: C.drop_invalid_numeric(t.withColumn("bad", F.when(F.col("l_linenumber") < 7, float("nan")).otherwise(F.col("qty")))), "select * from t")
on("ord", "drop_date_cols", lambda t: C.drop_date_cols(t.withColumn("day", F.date_format("o_orderdate", "yyyy/MM/dd"))), "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from t")
on("cust", "drop_emails", lambda t: C.drop_emails(t.withColumn("mail", F.concat("c_name", F.lit("@x.org")))), "select * from t")
on("cust", "drop_by_pattern", lambda t: C.drop_by_pattern(t, "^Customer#", threshold=0.9), "select c_custkey, c_nationkey, bal, seg from t")
on("line", "drop_if_exists", lambda t: C.drop_if_exists(t, ["ship", "none"]), f"select {', '.join(c for c in LINE if c != 'ship')} from t")
on("cust", "order_by", lambda t: C.order_by(t, ["bal"], descending=True).select("c_custkey", "bal"), "select c_custkey, bal from t")

# inference

def _where(tests: dict[str, str], extra: str = "") -> str:
    """The names of columns for which a test over all rows holds."""
    return "select column_name from (" + " union all ".join(f"select '{c}' column_name, ({e}) as ok from t {extra}" for c, e in tests.items()) + ") where ok"


_NU = {c: f"count(distinct {c}) + max(({c} is null)::int)" for c in LINE}
on("line", "infer_nulls", lambda t: I.infer_nulls(t, 0.12), _where({c: f"avg(({c} is null)::int) >= 0.12" for c in LINE}))
on("line", "infer_by_var", lambda t: I.infer_by_var(t, 1.0), _where({c: f"var_samp({c}) < 1.0" for c in NUM}))
on("ads", "infer_nan", lambda t: I.infer_nan(t), _where({c: f"max((isnan({c}) or isinf({c}))::int) = 1" for c in ("daily_time_spent_on_site", "area_income", "daily_internet_usage")}))
on("ads", "infer_invalid_numeric", lambda t: I.infer_invalid_numeric(t, 0.05, True), _where({c: f"avg(({c} is null or isnan({c}) or isinf({c}))::int) >= 0.05" for c in ("daily_time_spent_on_site", "area_income", "daily_internet_usage")} | {c: f"avg(({c} is null)::int) >= 0.05" for c in ("rec_id", "id", "load_id", "area_id", "age", "clicked_on_ad")}))
on("line", "get_unique_count", lambda t: I.get_unique_count(t, True), " union all ".join(f"select '{c}' \"column\", {e} n_unique, sum(({c} is null)::int)::bigint null_count from t" for c, e in _NU.items()))
on("line", "infer_highly_unique", lambda t: I.infer_highly_unique(t, 0.2), _where({c: f"{_NU[c]} > 0.2 * count(*)" for c in LINE if c != "ship"}))
on("line", "infer_discretes", lambda t: I.infer_discretes(t, 0.0, 20), _where({c: f"{_NU[c]} < 20" for c in LINE}))
on("line", "infer_conti", lambda t: I.infer_conti(t, 0.0, 20), _where({c: f"{_NU[c]} >= 20" for c in NUM}))
on("line", "infer_binary", lambda t: I.infer_binary(t), _where({c: f"count(distinct {c}) = 2" for c in LINE}))
on("line", "infer_constants", lambda t: I.infer_constants(t.withColumns({"k1": F.lit(3), "k2": F.when(F.col("qty") > 9, "x")})), names_sql(["k1", "k2"]))
on("line", "infer_n_unique", lambda t: I.infer_n_unique(t, 3), _where({c: f"count(distinct {c}) = 3" for c in LINE}))
on("ord", "infer_dates", lambda t: I.infer_dates(t.withColumn("day", F.date_format("o_orderdate", "yyyy.MM.dd"))), names_sql(["o_orderdate", "day"]))
on("cust", "infer_by_pattern", lambda t: I.infer_by_pattern(t, "[0-9]{3}"), _where({c: f"avg(coalesce(regexp_matches({c}, '[0-9]{{3}}'), false)::int) >= 0.9" for c in ("c_name", "seg")}))
on("parts", "infer_multicategorical", lambda t: I.infer_multicategorical(t, " "), _where({c: f"avg(regexp_matches({c}, '.+ .+')::int) >= 0.5" for c in ("p_name", "p_brand", "p_type")}))
on("cust", "infer_nums_from_str", lambda t: I.infer_nums_from_str(t), _where({c: f"avg(len(regexp_extract_all({c}, '\\d*\\.?\\d+'))) >= 0.95" for c in ("c_name", "seg")}))
on("line", "estimate_n_unique", lambda t: I.estimate_n_unique(t, ["flag", "l_partkey", "qty"]).withColumnRenamed("n_unique", "e").join(I.get_unique_count(t.select("flag", "l_partkey", "qty")), "column").select("column", "n_unique", (F.abs(F.col("e") / F.col("n_unique") - 1) < 0.5).alias("near")), " union all ".join(f"select '{c}' \"column\", {_NU[c]} n_unique, true near from t" for c in ("flag", "l_partkey", "qty")))
on("parts", "infer_infreq_categories", lambda t: I.infer_infreq_categories(t, ["p_brand", "p_type", "p_name"], min_count=80), "+c as (select 'p_brand' feature, p_brand v from t union all select 'p_type', p_type from t union all select 'p_name', p_name from t), g as (select feature, v, count(*) n from c group by 1, 2) select feature, list(v order by v) categories from g where n < 80 and v is not null group by 1")
on("parts", "infer_str_most_common_len", lambda t: I.infer_str_most_common_len(t), "+c as (select 'p_brand' k, p_brand v from t union all select 'p_type', p_type from t union all select 'p_name', p_name from t), g as (select k, strlen(v) l, count(*) n from c where v is not null group by 1, 2) select k \"column\", first(l order by n desc, l) common_len, round(max(n) / sum(n), 6) share from g group by 1")
on("line", "infer_highly_correlated", lambda t: I.infer_highly_correlated(t.select("qty", "price", "disc", "tax", (-F.col("qty")).alias("neg")), 0.5), "+c as (" + " union all ".join(f"select '{a}' a, '{b}' b, corr({x}, {y}) r from t" for a, x in (("qty", "qty"), ("price", "price"), ("disc", "disc"), ("tax", "tax"), ("neg", "-qty")) for b, y in (("qty", "qty"), ("price", "price"), ("disc", "disc"), ("tax", "tax"), ("neg", "-qty")) if a != b) + ") select a features, coalesce(list(b order by array_position(['qty', 'price', 'disc', 'tax', 'neg'], b)) filter (where r > 0.5), []) \"corr > 0.50\", coalesce(list(b order by array_position(['qty', 'price', 'disc', 'tax', 'neg'], b)) filter (where r < -0.5), []) \"corr < -0.50\" from c group by 1 having max(abs(r)) > 0.5")

WIDE = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "qty": "qty", "price": "price", "disc": "disc", "tax": "tax", "net": "price * (1 - disc)", "neg": "-qty", "odd": "l_orderkey % 2 + 0.0", "same": "1.5"}


def wide(t):
    """More columns than one aggregate takes the pairs of."""
    return t.selectExpr(*[f"cast({e} as double) as {c}" for c, e in WIDE.items()])


_ORDER = ", ".join(f"'{c}'" for c in WIDE)
on("line", "infer_highly_correlated_wide", lambda t: I.infer_highly_correlated(wide(t), 0.5), "+w as (select " + ", ".join(f"({e})::double as {c}" for c, e in WIDE.items()) + " from t), c as (" + " union all ".join(f"select '{a}' a, '{b}' b, case when stddev_pop({a}) > 0 and stddev_pop({b}) > 0 then corr({a}, {b}) end r from w" for a in WIDE for b in WIDE if a != b) + f") select a features, coalesce(list(b order by array_position([{_ORDER}], b)) filter (where r > 0.5), []) \"corr > 0.50\", coalesce(list(b order by array_position([{_ORDER}], b)) filter (where r < -0.5), []) \"corr < -0.50\" from c group by 1 having max(abs(r)) > 0.5")

# reports
on("line", "check_target_cardinality", lambda t: R.check_target_cardinality(t, "target"), "select target, count(*) cnt, round(count(*) / (select count(*) from t), 6) pct from t group by 1")
on("line", "range_counts", lambda t: R.range_counts(t, {"qty": [(1, 20), (23, 45)], "disc": [(0.02, 0.05)]}), "select 'qty' \"column\", 1.0::double as lower, 20.0::double as upper, count(*) filter (where qty between 1 and 20) cnt from t union all select 'qty', 23.0::double, 45.0::double, count(*) filter (where qty between 23 and 45) from t union all select 'disc', 0.02::double, 0.05::double, count(*) filter (where disc between 0.02 and 0.05) from t")
on("line", "corr_report", lambda t: R.corr_report(t, ["qty", "disc", "tax"], ["price", "target"]), " union all ".join(f"select '{c}' features, round(corr({c}, price), 6) price, round(corr({c}, target), 6) target from t" for c in ("qty", "disc", "tax")))
on("line", "corr_report_spearman", lambda t: R.corr_report(t, ["qty", "disc"], ["price"], "spearman"), "+r as (select qty, disc, price, rank() over (partition by qty is null order by qty) + (count(*) over (partition by qty) - 1) / 2.0 rq, rank() over (order by disc) + (count(*) over (partition by disc) - 1) / 2.0 rd, rank() over (order by price) + (count(*) over (partition by price) - 1) / 2.0 rp from t) select 'qty' features, round(corr(rq, rp), 6) price from r where qty is not null union all select 'disc', round(corr(rd, rp), 6) from r")


def _profile(c: str, kind: str) -> str:
    m = f"round(avg({c}), 5)"
    d = f"({c} - (select avg({c}) from t))"
    skew = f"(select round(avg({d} ** 3) / avg({d} ** 2) ** 1.5, 5) from t where {c} is not null)"
    kurt = f"(select round(avg({d} ** 4) / avg({d} ** 2) ** 2 - 3, 5) from t where {c} is not null)"
    q = lambda p: f"round(quantile_cont({c}, {p}), 5)"
    return f"select '{c}' \"column\", '{kind}' dtype, round(avg(({c} is null)::int), 5) null_pct, min({c})::varchar \"min\", max({c})::varchar \"max\", {m} mean, round(stddev_samp({c}), 5) std, {q(0.5)} median, {skew} skew, {kurt} kurtosis, {q(0.25)} \"25.0-percentile\", {q(0.75)} \"75.0-percentile\" from t"


_TEXT = "select '{0}' \"column\", 'string' dtype, round(avg(({0} is null)::int), 5) null_pct, min({0}) \"min\", max({0}) \"max\", null::double mean, null::double std, null::double median, null::double skew, null::double kurtosis, null::double \"25.0-percentile\", null::double \"75.0-percentile\" from t"
on("line", "data_profile", lambda t: R.data_profile(t.select("l_orderkey", "l_linenumber", "l_partkey", "qty", "price", "disc", "tax", "flag", "status")), " union all ".join([*[_profile(c, k) for c, k in (("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_partkey", "bigint"), ("qty", "double"), ("price", "double"), ("disc", "double"), ("tax", "double"))], _TEXT.format("flag"), _TEXT.format("status")]), digits=5)


def _near_profile(t):
    """Approximate medians beside exact ones: near each other as a share of the range."""
    a, b = (R.data_profile(t.select("qty", "price", "disc"), accuracy=k).select("column", F.col("median").alias(m), "min", "max") for k, m in ((1000, "a"), (None, "b")))
    return a.join(b.drop("min", "max"), "column").select("column", (F.abs(F.col("a") - F.col("b")) <= 0.01 * (F.col("max").cast("double") - F.col("min").cast("double"))).alias("near"))


on("line", "data_profile_approx", _near_profile, "select unnest(['qty', 'price', 'disc']) \"column\", true near")
_META = "select '{0}' features, count(*) filter (where {0} is null) null_count, min({0}) \"min\", max({0}) \"max\", (select {0} from t where {0} is not null group by 1 order by count(*) desc, 1 limit 1) \"mode\", min(strlen({0})) min_byte_len, max(strlen({0})) max_byte_len, round(avg(strlen({0})), 6) avg_byte_len, round(median(strlen({0})), 6) median_byte_len, round(avg(len(regexp_extract_all({0}, '\\s'))), 6) avg_space_cnt, round(avg(len(regexp_extract_all({0}, '[0-9]'))), 6) avg_digit_cnt, round(avg(len(regexp_extract_all({0}, '[A-Z]'))), 6) avg_cap_cnt, round(avg(len(regexp_extract_all({0}, '[a-z]'))), 6) avg_lower_cnt, sum(len(regexp_extract_all({0}, 'a')))::bigint total_a_count from t"
on("parts", "str_meta_report", lambda t: R.str_meta_report(t, ["p_name", "p_brand", "p_type"], ["a"]), " union all ".join(_META.format(c) for c in ("p_name", "p_brand", "p_type")))
on("line", "str_cats_report", lambda t: R.str_cats_report(t, ["flag", "status"]), "+c as (select 'flag' feature, flag v, count(*) n from t group by 2 union all select 'status', status, count(*) from t group by 2), d as (select *, n - lag(n) over (partition by feature order by n, v nulls first) s from c) select feature, count(*) n_unique, bool_or(v is null) has_null, first(v order by n, v nulls first) category_w_min_count, min(n) min_count, first(v order by n desc, v desc nulls last) category_w_max_count, max(n) max_count, round(avg(n), 6) avg_count, min(s) min_successive_diff, round(avg(s), 6) avg_successive_diff, max(s) max_successive_diff from d group by 1")
_TIME = "select year(ship) \"year\", month(ship) \"month\", " + ", ".join(f"round(avg(({c} is null)::int), 6) \"{c}_null%\", max({c}) {c}_max, min({c}) {c}_min, round(avg({c}), 6) {c}_mean, round(stddev_samp({c}), 6) {c}_std, round(var_samp({c}), 6) {c}_var" for c in ("qty", "disc"))
on("line", "over_time_report", lambda t: R.over_time_report(t, "ship", ["qty", "disc"], ["null", "max", "min", "mean", "std", "var"]), _TIME + " from t group by 1, 2")
on("ads", "over_time_report_invalid", lambda t: R.over_time_report(t.where("ad_ts is not null"), "ad_ts", ["area_income"], ["invalid", "mode"], "quarterly"), "+g as (select year(ad_ts) y, quarter(ad_ts) q, area_income x, count(*) n from t where ad_ts is not null group by 1, 2, 3) select y \"year\", q \"quarter\", round(sum(case when isnan(x) or isinf(x) then n else 0 end) / sum(n), 6) \"area_income_invalid%\", first(x order by n desc, x) filter (where x is not null) area_income_mode from g group by 1, 2")
on("ads", "over_time_report_invalid_whole", lambda t: R.over_time_report(t, "ad_ts", ["area_income"], ["invalid", "mode"], "quarterly"), "+g as (select year(ad_ts) y, quarter(ad_ts) q, area_income x, count(*) n from t group by 1, 2, 3) select y \"year\", q \"quarter\", round(sum(case when isnan(x) or isinf(x) then n else 0 end) / sum(n), 6) \"area_income_invalid%\", first(x order by n desc, x) filter (where x is not null) area_income_mode from g group by 1, 2")
on("line", "over_time_report_num", lambda t: R.over_time_report_num(t, "ship", ["qty", "disc"], "yearly"), """+l as (select 'qty' feature, year(ship) y, qty x from t union all select 'disc', year(ship), disc from t),
g as (select feature, y, count(*) c, quantile_cont(x, 0.05) a, quantile_cont(x, 0.95) b, avg((x is null)::int) s, avg(x) m from l group by 1, 2),
o as (select feature, avg((x is null)::int) os, avg(x) om from l group by 1),
p as (select *, lag(s) over w ls, lag(m) over w lm from g join o using (feature) window w as (partition by feature order by y))
select feature, y "year", c "count", round(a, 6) "5%_quantile", round(b, 6) "95%_quantile", round(s, 6) "null%", round(m, 6) mean,
case when s = 0 then case when ls = 0 then 0.0 else 'nan'::double end when ls = 0 then 'inf'::double else round(s / ls - 1, 6) end "null_PoP_%chg", round(m / lm - 1, 6) "mean_PoP_%diff",
case when os = 0 then case when s = 0 then 0.0 else 'nan'::double end else round(s / os - 1, 6) end "null_%chg_overall", round(m / om - 1, 6) "mean_%diff_overall" from p""")
_HALF = lambda t: (t.where("l_linenumber <= 3"), t.where("l_linenumber > 3"))
on("line", "old_vs_new_report", lambda t: R.old_vs_new_report(*_HALF(t), ["qty", "price"]).select("column", "mean", "mean_new", "median", "median_new", "null_pct", "null_pct_new"), " union all ".join(f"select '{c}' \"column\", round(avg({c}) filter (where l_linenumber <= 3), 6) mean, round(avg({c}) filter (where l_linenumber > 3), 6) mean_new, round(median({c}) filter (where l_linenumber <= 3), 6) median, round(median({c}) filter (where l_linenumber > 3), 6) median_new, round(avg(({c} is null)::int) filter (where l_linenumber <= 3), 6) null_pct, round(avg(({c} is null)::int) filter (where l_linenumber > 3), 6) null_pct_new from t" for c in ("qty", "price")))
_D = "select '{0}' \"column\", round(sum((e - s) * ln(e / s)), 6) psi from (select greatest(count(*) filter (where o) / (select count(*) from t where l_linenumber <= 3), 1e-5) e, greatest(count(*) filter (where not o) / (select count(*) from t where l_linenumber > 3), 1e-5) s from (select {0} v, l_linenumber <= 3 o from t) group by v)"
on("line", "old_vs_new_report_psi", lambda t: R.old_vs_new_report(*_HALF(t), ["qty", "price", "flag"], compute_psi=True).select("column", "psi"), "+q as (select quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) q from t where l_linenumber <= 3), b as (select len(list_filter(q, lambda c: c < price)) v, l_linenumber <= 3 o from t, q where price is not null), p as (select count(*) filter (where o) / (select count(*) from b where o) e, count(*) filter (where not o) / (select count(*) from b where not o) s from b group by v) " + " union all ".join([_D.format("qty"), _D.format("flag"), "select 'price', round(sum((e - s) * ln(e / s)), 6) from (select greatest(e, 1e-5) e, greatest(s, 1e-5) s from p)"]))

# diagnosis
_CE2 = "(select '{0}' {2}, '{1}' {3}, round(greatest(sum(n * ln(m / n)) / sum(n), 0), 6) {4} from (select {0} x, {1} y, count(*) n, sum(count(*)) over (partition by {1}) m from t group by 1, 2))"
on("line", "conditional_entropies", lambda t: D.conditional_entropies(t, [("flag", "status"), ("status", "flag"), ("flag", "l_linenumber")]), " union all ".join(_CE2.format(a, b, "x", "y", "ce") for a, b in (("flag", "status"), ("status", "flag"), ("flag", "l_linenumber"))))
on("parts", "dependency_detection", lambda t: D.dependency_detection(t, ["p_brand", "p_type", "p_size"], return_full_table=True), " union all ".join(_CE2.format(a, b, "dependent", "depends_on", "cond_entropy") for a, b in (("p_type", "p_brand"), ("p_type", "p_size"), ("p_brand", "p_size"))))
on("houses", "dependency_violation", lambda t: D.dependency_violation(t, "central_air", "heating"), "+c as (select heating parent_value, central_air child_value, count(*) cnt from t group by 1, 2) select parent_value, (sum(cnt) over w)::bigint \"rows\", count(*) over w n_child_values, row_number() over (partition by parent_value order by cnt desc, child_value nulls first) place, child_value, cnt from c window w as (partition by parent_value) qualify n_child_values > 1")
on("ads", "str_len_outliers", lambda t: D.str_len_outliers(t, (0.05, 0.95), ["city", "country"]), "+c as (select 'city' feature, city v from t union all select 'country', country from t), s as (select feature, quantile_cont(strlen(v), 0.05) low, quantile_cont(strlen(v), 0.95) high, avg(strlen(v)) a, median(strlen(v)) m from c where v is not null group by 1) select feature, low, high, round(a, 6) avg_len, m median_len, v outlier, count(*) cnt from c join s using (feature) where strlen(v) < low or strlen(v) > high group by all")
on("houses", "str_pattern_outliers", lambda t: D.str_pattern_outliers(t, "ms_zoning", "^[A-Z]{2}$"), "select ms_zoning outlier, count(*) cnt from t where not regexp_matches(ms_zoning, '^[A-Z]{2}$') group by 1")
