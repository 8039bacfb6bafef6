"""Imputation, scaling, numeric, text, list, date and ordered operators, encoders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prepline.functions import numeric as N
from prepline.functions import text as X
from prepline.operators import encode as E
from prepline.operators import impute as M
from prepline.operators import scale as C
from prepline.operators import strings as T
from prepline.queries.base import KEYS, Queries

registry = Queries()
on = registry.on
K = "l_orderkey, l_linenumber"

# imputation
on("line", "impute", lambda t: M.impute(t, ["qty", "tax"], "median").select(*KEYS, "qty", "tax"), f"select {K}, coalesce(qty, (select median(qty) from t)) qty, coalesce(tax, (select median(tax) from t)) tax from t")
on("line", "impute_mean", lambda t: M.impute(t, ["qty", "tax"], "mean").select(*KEYS, "qty", "tax"), f"select {K}, round(coalesce(qty, (select avg(qty) from t)), 6) qty, round(coalesce(tax, (select avg(tax) from t)), 6) tax from t")
on("line", "impute_mode", lambda t: M.impute(t, ["flag"], "mode").select(*KEYS, "flag"), f"select {K}, coalesce(flag, (select flag from t where flag is not null group by 1 order by count(*) desc, 1 limit 1)) flag from t")
on("line", "impute_const", lambda t: M.impute(t, ["qty"], "const", const=-1.0).select(*KEYS, "qty"), f"select {K}, coalesce(qty, -1) qty from t")
on("ads", "impute_nan", lambda t: M.impute_nan(t, ["area_income", "daily_internet_usage"]).select("rec_id", "area_income", "daily_internet_usage"), "select rec_id, case when isfinite(area_income) then round(area_income, 6) + 0.0 end area_income, case when isfinite(daily_internet_usage) then round(daily_internet_usage, 6) + 0.0 end daily_internet_usage from t")
on("line", "hot_deck_impute", lambda t: M.hot_deck_impute(t, ["qty", "tax"], ["flag", "l_linenumber"], "mean").select(*KEYS, "qty", "tax"), f"select {K}, round(coalesce(qty, avg(qty) over w), 6) qty, round(coalesce(tax, avg(tax) over w), 6) tax from t window w as (partition by flag, l_linenumber)")
on("cust", "hot_deck_impute_mode", lambda t: M.hot_deck_impute(t, ["seg"], ["c_nationkey"], "mode").select("c_custkey", "seg"), "+g as (select c_nationkey, seg, count(*) n from t where seg is not null group by 1, 2), m as (select c_nationkey, first(seg order by n desc, seg) s from g group by 1) select c_custkey, coalesce(seg, s) seg from t left join m using (c_nationkey)")
on("line", "missing_indicator", lambda t: M.missing_indicator(t, ["qty", "tax", "flag"]).select(*KEYS, "qty_missing", "tax_missing", "flag_missing"), f"select {K}, (qty is null)::tinyint qty_missing, (tax is null)::tinyint tax_missing, (flag is null)::tinyint flag_missing from t")
on("ads", "missing_indicator_nan", lambda t: M.missing_indicator(t, ["area_income"], include_nan=True).select("rec_id", "area_income_missing"), "select rec_id, (area_income is null or not isfinite(area_income))::tinyint area_income_missing from t")

# scaling
on("line", "scale", lambda t: C.scale(t, ["qty", "price"]).select(*KEYS, "qty", "price"), f"select {K}, round((qty - (select avg(qty) from t)) / (select stddev_pop(qty) from t), 6) + 0.0 qty, round((price - (select avg(price) from t)) / (select stddev_pop(price) from t), 6) + 0.0 price from t")
on("line", "scale_min_max", lambda t: C.scale(t, ["qty"], "min_max").select(*KEYS, "qty"), f"select {K}, round((qty - (select min(qty) from t)) / (select max(qty) - min(qty) from t), 6) qty from t")
on("line", "scale_robust", lambda t: C.scale(t, ["price"], "robust").select(*KEYS, "price"), f"select {K}, round((price - (select median(price) from t)) / (select quantile_cont(price, 0.75) - quantile_cont(price, 0.25) from t), 6) price from t")
on("cust", "scale_max_abs", lambda t: C.scale(t, ["bal"], "abs_max").select("c_custkey", "bal"), "select c_custkey, round(bal / (select max(abs(bal)) from t), 6) bal from t")
on("line", "scale_by", lambda t: C.scale_by(t, "qty", ["flag"]).select(*KEYS, "qty"), f"select {K}, round((qty - avg(qty) over w) / stddev_samp(qty) over w, 6) qty from t window w as (partition by flag)")
on("line", "scale_by_max_abs", lambda t: C.scale_by(t, "price", ["l_partkey"], "max_abs").select(*KEYS, "price"), f"select {K}, round(price / max(abs(price)) over (partition by l_partkey), 6) price from t")
on("line", "normalize", lambda t: C.normalize(t, ["qty"]).select(*KEYS, "qty"), f"select {K}, round(qty / (select sum(qty) from t), 9) qty from t", digits=9)
on("line", "z_normalize", lambda t: C.z_normalize(t, ["qty"]).select(*KEYS, "qty"), f"select {K}, round((qty - (select avg(qty) from t)) / (select stddev_samp(qty) from t), 6) qty from t")
on("line", "clip", lambda t: C.clip(t, ["qty"], 5.0, 40.0).select(*KEYS, "qty"), f"select {K}, case when qty is not null then least(greatest(qty, 5.0), 40.0) end qty from t")
on("cust", "log_transform", lambda t: C.log_transform(t.withColumn("n", F.col("c_nationkey").cast("double")), ["n", "bal"], plus_one=False).select("c_custkey", "n_log", "bal_log"), "select c_custkey, case when c_nationkey = 0 then '-inf'::double else round(ln(nullif(c_nationkey, 0)), 6) end n_log, case when bal > 0 then round(ln(case when bal > 0 then bal end), 6) when bal = 0 then '-inf'::double when bal < 0 then 'nan'::double end bal_log from t")
on("line", "log_transform_base", lambda t: C.log_transform(C.log_transform(t, ["qty"], base=10, suffix="_log10"), ["disc"], plus_one=True, suffix="_log1p").select(*KEYS, "qty_log10", "disc_log1p"), f"select {K}, round(log10(qty), 6) qty_log10, round(ln(1 + disc), 6) disc_log1p from t")
on("line", "sqrt_transform", lambda t: C.sqrt_transform(t, ["qty"]).select(*KEYS, "qty_sqrt"), f"select {K}, round(sqrt(qty), 6) qty_sqrt from t")
on("cust", "cbrt_transform", lambda t: C.cbrt_transform(t, ["bal"]).select("c_custkey", "bal_cbrt"), "select c_custkey, round(cbrt(bal), 6) bal_cbrt from t")
on("line", "linear_transform", lambda t: C.linear_transform(t, ["qty", "disc"], [2.0, 3.0], [1.0, -1.0]).select(*KEYS, "qty", "disc"), f"select {K}, round(2 * qty + 1, 6) qty, round(3 * disc - 1, 6) disc from t")
on("line", "sine_cosine_transform", lambda t: C.sine_cosine_transform(t, ["qty"], ["l_linenumber"], sin_period=12.0, cos_period=7.0).select(*KEYS, "qty_sin", "l_linenumber_cos"), f"select {K}, round(sin(2 * pi() / 12 * qty), 6) + 0.0 qty_sin, round(cos(2 * pi() / 7 * l_linenumber), 6) + 0.0 l_linenumber_cos from t")
on("line", "power_transform", lambda t: C.power_transform(t, ["price", "qty"]).select(*KEYS, "price", "qty"))
on("line", "binarize", lambda t: C.binarize(t, {"qty": "qty > 25", "flag": "flag = 'R'"}).select(*KEYS, "qty", "flag"), f"select {K}, (qty > 25)::tinyint qty, (flag = 'R')::tinyint flag from t")
_FLAGS = {k: f"cast({c} % 2 as int)" for k, c in zip("abcde", ("l_orderkey", "l_linenumber", "l_partkey", "l_orderkey", "l_linenumber"))}
on("line", "combine_zero_ones", lambda t: C.combine_zero_ones(C.combine_zero_ones(t.withColumns({k: F.expr(e) for k, e in _FLAGS.items()}), ["d", "e"], "same", rule="same"), ["a", "b", "c"], "any").select(*KEYS, "any", "same"), f"select {K}, greatest(l_orderkey % 2, l_linenumber % 2, l_partkey % 2)::tinyint \"any\", (l_orderkey % 2 = l_linenumber % 2)::tinyint same from t")
on("line", "extract_horizontally", lambda t: C.extract_horizontally(t, ["qty", "tax", "disc"], ["min", "max", "sum"]).select(*KEYS, "`min(qty,tax,disc)`", "`max(qty,tax,disc)`", "`sum(qty,tax,disc)`"), f"select {K}, least(qty, tax, disc) \"min(qty,tax,disc)\", greatest(qty, tax, disc) \"max(qty,tax,disc)\", round(coalesce(qty, 0) + coalesce(tax, 0) + coalesce(disc, 0), 6) \"sum(qty,tax,disc)\" from t")
on("line", "add_dummy", lambda t: C.add_dummy(t, "l_orderkey").groupBy("_dummy").agg(F.count(F.lit(1)).alias("n")).select("_dummy", (F.abs(F.col("n") / F.sum("n").over(Window.partitionBy()) - 1 / 7) < 0.05).alias("even")), "select unnest(range(7)) _dummy, true even")

# aggregates and scalar functions
on("line", "abs_diff", lambda t: t.select(*KEYS, N.abs_diff("qty", F.lit(20.0)).alias("d")), f"select {K}, abs(20 - qty) d from t")
on("line", "num_aggregates", lambda t: t.groupBy("flag").agg(N.std_err("qty").alias("std_err"), N.harmonic_mean("qty").alias("harmonic_mean"), N.rms("qty").alias("rms"), N.cv("qty").alias("cv"), N.range_over_mean("qty").alias("range_over_mean")), "select flag, round(stddev_samp(qty) / sqrt(count(*)), 6) std_err, round(count(qty) / sum(1 / qty), 6) harmonic_mean, round(sqrt(avg(qty * qty)), 6) rms, round(stddev_samp(qty) / avg(qty), 6) cv, round((max(qty) - min(qty)) / avg(qty), 6) range_over_mean from t group by 1")
on("line", "frac", lambda t: t.select(*KEYS, N.frac("price").alias("f")), f"select {K}, round(price % 1, 6) f from t")
on("line", "gcd", lambda t: t.select(*KEYS, N.gcd("l_orderkey", "l_partkey").alias("g"), N.gcd(F.col("qty").cast("bigint"), 12).alias("h")), f"select {K}, gcd(l_orderkey, l_partkey)::bigint g, gcd(qty::bigint, 12::bigint)::bigint h from t")
on("line", "lcm", lambda t: t.select(*KEYS, N.lcm("l_linenumber", "l_partkey").alias("g")), f"select {K}, lcm(l_linenumber, l_partkey)::bigint g from t")
on("line", "lempel_ziv_complexity", lambda t: t.groupBy("l_partkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", (F.col("price") > 40000).alias("b")))), lambda x: x["b"]).alias("b")).select("l_partkey", N.lempel_ziv_complexity("b").alias("phrases"), N.lempel_ziv_complexity("b", True).alias("ratio")))

# recoding and encoders
on("line", "feature_mapping", lambda t: E.feature_mapping(t, {"flag": {"R": "returned", "A": None}, "qty": "case when qty > 45 then null else qty end"}).select(*KEYS, "flag", "qty"), f"select {K}, case when flag = 'R' then 'returned' when flag = 'A' then null else flag end flag, case when qty > 45 then null else qty end qty from t")
on("line", "merge_categories", lambda t: E.merge_categories(t, {"flag": ["A", "N"]}).select(*KEYS, "flag"), f"select {K}, case when flag in ('A', 'N') then 'A|N' else flag end flag from t")
on("parts", "merge_infreq_categories", lambda t: E.merge_infreq_categories(t, ["p_brand"], min_count=80).select("p_partkey", "p_brand"), "+g as (select p_brand from t group by 1 having count(*) < 80) select p_partkey, case when p_brand in (from g) and (select count(*) from g) > 1 then (select string_agg(p_brand, '|' order by p_brand) from g) else p_brand end p_brand from t")
on("line", "one_hot_encode", lambda t: E.one_hot_encode(t, ["flag", "status"]).select(*KEYS, "flag_A", "flag_N", "flag_R", "status_F", "status_O"), f"select {K}, " + ", ".join(f"coalesce({c} = '{v}', false)::tinyint {c}_{v}" for c, v in (("flag", "A"), ("flag", "N"), ("flag", "R"), ("status", "F"), ("status", "O"))) + " from t")
on("line", "reverse_one_hot_encode", lambda t: E.reverse_one_hot_encode(E.one_hot_encode(t, ["flag"]), "flag").select(*KEYS, "flag"), f"select {K}, flag from t")
on("line", "selective_one_hot_encode", lambda t: E.selective_one_hot_encode(t, {"flag": ["R"], "status": ["F"]}).select(*KEYS, "flag_R", "status_F"), f"select {K}, coalesce(flag = 'R', false)::tinyint \"flag_R\", (status = 'F')::tinyint \"status_F\" from t")
on("line", "sum_encode", lambda t: E.sum_encode(t, ["flag"]).select(*KEYS, "flag_N", "flag_R"), f"select {K}, case flag when 'N' then 1 when 'A' then -1 when 'R' then 0 end::tinyint \"flag_N\", case flag when 'R' then 1 when 'A' then -1 when 'N' then 0 end::tinyint \"flag_R\" from t")
_RANKS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
on("ord", "rank_hot_encode", lambda t: E.rank_hot_encode(t, {"o_orderpriority": _RANKS}).select("o_orderkey", *[f"`o_orderpriority>={v}`" for v in _RANKS[1:]]), "+r as (select *, coalesce(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH'], o_orderpriority) - 1, 4) p from t) select o_orderkey, " + ", ".join(f"(p >= {i + 1})::tinyint \"o_orderpriority>={v}\"" for i, v in enumerate(_RANKS[1:])) + " from r")
on("line", "force_binary", lambda t: E.force_binary(t.withColumn("two", F.when(F.col("qty") > 20, "x")), ["status", "two"]).select(*KEYS, "status", "two"), f"select {K}, (status = 'O')::tinyint status, coalesce(qty > 20, false)::tinyint two from t")
on("parts", "multicat_one_hot_encode", lambda t: E.multicat_one_hot_encode(t, ["p_name"], delimiter=" ", drop_first=False).transform(lambda x: x.select("p_partkey", F.array_sort(F.filter(F.array(*[F.when(F.col(f"`{c}`") == 1, c[7:]) for c in x.columns if c.startswith("p_name_")]), lambda v: v.isNotNull())).alias("tokens"))), "select p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) tokens from t")
on("line", "ordinal_auto_encode", lambda t: E.ordinal_auto_encode(t, ["flag", "status"]).select(*KEYS, "flag", "status"), f"select {K}, case when flag is null then 0 when flag = 'A' then 1 when flag = 'N' then 2 else 3 end flag, case status when 'F' then 0 else 1 end status from t")
on("line", "ordinal_encode", lambda t: E.ordinal_encode(t, {"flag": {"A": 1, "R": 2}}, default=-1).select(*KEYS, "flag"), f"select {K}, case flag when 'A' then 1 when 'R' then 2 else -1 end flag from t")
on("houses", "smooth_target_encode", lambda t: E.smooth_target_encode(t, "price_over_200k", ["ms_zoning", "heating", "central_air"], 20, 10.0).select("id", "ms_zoning", "heating", "central_air"), "select id, " + ", ".join(f"round(1 / (1 + exp(-(count(*) over (partition by {c}) - 20) / 10.0)) * avg(price_over_200k) over (partition by {c}) + (1 - 1 / (1 + exp(-(count(*) over (partition by {c}) - 20) / 10.0))) * avg(price_over_200k) over (), 6) {c}" for c in ("ms_zoning", "heating", "central_air")) + " from t")
on("houses", "woe_cat_encode", lambda t: E.woe_cat_encode(t, "price_over_200k", ["ms_zoning", "heating", "central_air"]).select("id", "ms_zoning", "heating", "central_air"), "select id, " + ", ".join(f"round(ln(((sum(price_over_200k) over (partition by {c}) + 1) / (sum(price_over_200k) over () + 2)) / ((sum(1 - price_over_200k) over (partition by {c}) + 1) / (sum(1 - price_over_200k) over () + 2))), 6) {c}" for c in ("ms_zoning", "heating", "central_air")) + " from t")
on("line", "woe_cat_encode_large", lambda t: E.woe_cat_encode(t.withColumn("part", F.col("l_partkey").cast("string")), "target", ["part"]).select(*KEYS, "part"), f"select {K}, round(ln(((sum(target) over (partition by l_partkey) + 1) / (sum(target) over () + 2)) / ((sum(1 - target) over (partition by l_partkey) + 1) / (sum(1 - target) over () + 2))), 6) part from t")
on("line", "custom_binning", lambda t: E.custom_binning(t, ["qty"], [10, 25.5, 40], suffix="_bin").select(*KEYS, "qty_bin"), f"select {K}, case when qty <= 10 then '(-inf, 10]' when qty <= 25.5 then '(10, 25.5]' when qty <= 40 then '(25.5, 40]' when qty is not null then '(40, inf]' end qty_bin from t")
on("line", "fixed_sized_binning", lambda t: E.fixed_sized_binning(t, ["qty"], 10).select(*KEYS, "qty"), f"select {K}, case when qty <= 1 then '(-inf, 1]' when qty is not null then '(' || ((ceil((qty - 1) / 10) - 1) * 10 + 1)::int || ', ' || (ceil((qty - 1) / 10) * 10 + 1)::int || ']' end qty from t")
on("line", "quantile_binning", lambda t: E.quantile_binning(t, ["qty"], 5).select(*KEYS, "qty"), f"+q as (select quantile_cont(qty, [0.2, 0.4, 0.6, 0.8]) c from t) select {K}, case when qty <= c[1] then '(-inf, ' || c[1]::int || ']' when qty <= c[2] then '(' || c[1]::int || ', ' || c[2]::int || ']' when qty <= c[3] then '(' || c[2]::int || ', ' || c[3]::int || ']' when qty <= c[4] then '(' || c[3]::int || ', ' || c[4]::int || ']' when qty is not null then '(' || c[4]::int || ', inf]' end qty from t, q")
on("line", "format_categorical_target", lambda t: E.format_categorical_target(t, "flag")[0].select(*KEYS, "flag"), f"select {K}, case flag when 'A' then 0 when 'N' then 1 when 'R' then 2 end flag from t")
on("line", "dense_to_sparse_target", lambda t: E.dense_to_sparse_target(t, "flag").select(*KEYS, "flag"), f"select {K}, [(flag = 'A')::int, (flag = 'N')::int, (flag = 'R')::int] flag from t")
on("line", "sparse_to_dense_target", lambda t: E.sparse_to_dense_target(E.dense_to_sparse_target(t.where("flag is not null"), "flag"), "flag").select(*KEYS, "flag"), f"select {K}, (case flag when 'A' then 0 when 'N' then 1 when 'R' then 2 end)::bigint flag from t where flag is not null")
on("line", "sparse_to_dense_target_whole", lambda t: E.sparse_to_dense_target(E.dense_to_sparse_target(t, "flag"), "flag").select(*KEYS, "flag"), f"select {K}, (case flag when 'A' then 0 when 'N' then 1 when 'R' then 2 end)::bigint flag from t")

# text
on("parts", "replace_by_pattern", lambda t: T.replace_by_pattern(t, "p_name", "[aeiou]", "_").select("p_partkey", "p_name"), "select p_partkey, regexp_replace(p_name, '[aeiou]', '_') p_name from t")
on("docs", "extract_word_count", lambda t: T.extract_word_count(t, ["text"], ["the", "and"]).select("doc_id", "text_count_the", "text_count_and"), "select doc_id, len(regexp_extract_all(lower(text), 'the')) text_count_the, len(regexp_extract_all(lower(text), 'and')) text_count_and from t")
on("parts", "extract_from_str", lambda t: T.extract_from_str(t, ["p_name"], ["len", "starts_with", "ends_with", "count", "contains"], "s").select("p_partkey", "p_name_len", "p_name_starts_with", "p_name_ends_with", "p_name_count", "p_name_contains"), "select p_partkey, strlen(p_name) p_name_len, starts_with(p_name, 's') p_name_starts_with, ends_with(p_name, 's') p_name_ends_with, len(regexp_extract_all(p_name, 's')) p_name_count, regexp_matches(p_name, 's') p_name_contains from t")
on("cust", "extract_numbers", lambda t: T.extract_numbers(t, ["c_name"], join_by="-").select("c_custkey", "c_name"), "select c_custkey, array_to_string(regexp_extract_all(c_name, '\\d*\\.?\\d+'), '-') c_name from t")
on("ev", "extract_numbers_typed", lambda t: T.extract_numbers(t, ["props"], dtype="int").select("event_id", "props"), "select event_id, list_transform(regexp_extract_all(props, '\\d*\\.?\\d+'), lambda x: x::int) props from t")
on("ads", "extract_first_number", lambda t: T.extract_first_number(t, ["city"], default=-1.0).select("rec_id", "city"), "select rec_id, coalesce(try_cast(nullif(regexp_extract(replace(city, ',', ''), '\\d*\\.?\\d+'), '') as double), -1) city from t")
on("parts", "extract_patterns", lambda t: T.extract_patterns(t, "[aeiou][a-z]", ["p_name"], join_by="|").select("p_partkey", "p_name"), "select p_partkey, array_to_string(regexp_extract_all(p_name, '[aeiou][a-z]'), '|') p_name from t")
on("parts", "combine_str_cols", lambda t: T.combine_str_cols(t, ["p_brand", "p_type", "p_brand"], "both", to_null=["Brand#11"], separator="|").select("p_partkey", "both"), "select p_partkey, nullif(case when p_brand = 'Brand#11' then p_type else p_brand || '|' || p_type end, '') \"both\" from t")
on("parts", "levenshtein_dist", lambda t: t.select("p_partkey", X.levenshtein_dist("p_name", "p_type").alias("d")), "select p_partkey, levenshtein(p_name, p_type)::int d from t")
on("parts", "hamming_dist", lambda t: t.select("p_partkey", X.hamming_bits("p_brand", F.lit("Brand#21")).alias("bits"), X.hamming_chars("p_brand", F.lit("Brand#21")).alias("chars")), "select p_partkey, case when strlen(p_brand) = 8 then list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(ascii(substring(p_brand, i, 1)), ascii(substring('Brand#21', i, 1))))))::int end bits, case when strlen(p_brand) = 8 then hamming(p_brand, 'Brand#21')::int end chars from t")
on("parts", "str_jaccard", lambda t: t.select("p_partkey", X.str_jaccard("p_name", "p_type").alias("j")), "+g as (select p_partkey, list_distinct(list_transform(range(1, length(p_name)), lambda i: substring(p_name, i, 2))) a, list_distinct(list_transform(range(1, length(p_type)), lambda i: substring(p_type, i, 2))) b from t) select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) j from g")
on("docs", "snowball_stem", lambda t: t.select(F.explode(F.split(F.lower("text"), "[^a-z']+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", X.snowball_stem("word")))

# json, lists, dates
on("ev", "extract_from_json", lambda t: T.extract_from_json(t, "props", ["k", "none"], ["int", "string"]).select("event_id", "`props.k`", "`props.none`"), "select event_id, (props->>'$.k')::int \"props.k\", null::varchar \"props.none\" from t")
on("ev", "str_col_to_list", lambda t: T.str_col_to_list(t.withColumn("l", F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(",2]"))), ["l"], "int").select("event_id", "l"), "select event_id, [user_id::int, 2] l from t")
on("emb", "extract_list_features", lambda t: T.extract_list_features(t, ["embedding"], ["min", "max", "mean", "len", "first", "last", "sum"]).drop("embedding", "label"), "select vec_id, round(list_min(embedding)::double, 6) embedding_min, round(list_max(embedding)::double, 6) embedding_max, round(list_sum(embedding::double[]) / len(embedding), 6) embedding_mean, len(embedding)::int embedding_len, round(embedding[1]::double, 6) embedding_first, round(embedding[-1]::double, 6) embedding_last, round(list_sum(embedding::double[]), 6) embedding_sum from t")
on("ord", "extract_dt_features", lambda t: T.extract_dt_features(t, ["o_orderdate"], ["year", "quarter", "month", "week", "day_of_week", "day_of_year"]).drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "select o_orderkey, year(o_orderdate) o_orderdate_year, quarter(o_orderdate) o_orderdate_quarter, month(o_orderdate) o_orderdate_month, week(o_orderdate) o_orderdate_week, isodow(o_orderdate) o_orderdate_day_of_week, dayofyear(o_orderdate) o_orderdate_day_of_year from t")
on("ord", "extract_dt_features_sunday", lambda t: T.extract_dt_features(t, ["o_orderdate"], ["day_of_week"], sunday_first=True).select("o_orderkey", "o_orderdate_day_of_week"), "select o_orderkey, dayofweek(o_orderdate) + 1 o_orderdate_day_of_week from t")

# ordered
on("ev", "moving_avgs", lambda t: T.moving_avgs(t, ["value"], [3, 7], ["ts", "event_id"], ["event_type"]).select("event_id", "value_ma_3", "value_ma_7"), "select event_id, " + ", ".join(f"case when count(value) over w{n} >= {n} then round(avg(value) over w{n}, 6) end value_ma_{n}" for n in (3, 7)) + " from t window w3 as (partition by event_type order by ts, event_id rows between 2 preceding and current row), w7 as (partition by event_type order by ts, event_id rows between 6 preceding and current row)")
on("line", "as_percentages", lambda t: T.as_percentages(t, ["qty"], ["l_orderkey", "l_linenumber", "price"], ["l_partkey"]).select(*KEYS, "qty"), f"select {K}, round(qty / last_value(qty ignore nulls) over (partition by l_partkey order by l_orderkey, l_linenumber, price rows between unbounded preceding and 1 preceding) - 1, 6) qty from t")
