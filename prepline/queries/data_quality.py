"""Problems 1 and 5: profiles of loads, and filling of missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepline.operators.fill import fill_missing, filled_cells
from prepline.operators.quality import Limits, failed_checks, fit_baseline, profile_loads
from prepline.queries.registry import Registry
from prepline.sources import table

registry = Registry()

NUMERIC, TEXT = ["area_income", "daily_internet_usage"], ["city"]
#: Letters, full stops, apostrophes, hyphens and single inner spaces, the first an upper-case letter.
PLACE = r"^\p{Lu}[\p{L}.'\-]*(?: [\p{L}.'\-]+)*\z"
BANDS = {"daily_internet_usage_band": ["very_low", "low", "medium", "high", "very_high"]}

_PROFILE_SQL = r"""
with base as (
  select column_name, count(*) n, count(x) v, min(x) lo, max(x) hi,
         quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) q
  from (select unnest(['area_income', 'daily_internet_usage']) column_name,
               unnest([case when isnan(area_income) then null else area_income end,
                       case when isnan(daily_internet_usage) then null else daily_internet_usage end]) x
        from ads_accepted) group by 1),
city_base as (select count(*) n, count(city) v from ads_accepted),
num as (
  select load_id, unnest(['area_income', 'daily_internet_usage']) column_name,
         unnest([case when isnan(area_income) then null else area_income end,
                 case when isnan(daily_internet_usage) then null else daily_internet_usage end]) x
  from advertising),
cnt as (select load_id, column_name, x, count(*) n from num group by 1, 2, 3),
p as (
  select load_id, column_name, sum(c.n) n_rows, sum(case when x is null then c.n else 0 end) n_null,
         sum(case when x is not null then c.n else 0 end) n_values, count(x) n_distinct,
         max(case when x is not null then c.n end) top_count, min(x) low, max(x) high,
         sum(case when x < lo or x > hi then c.n else 0 end) n_outside,
         sum(case when x between lo and hi then c.n else 0 end) n_inside,
         any_value(b.n) bn, any_value(b.v) bv,
"""
_BINS = ", ".join("sum(case when x between lo and hi" + (f" and x > q[{k}]" if k else "") + (f" and x <= q[{k + 1}]" if k < 9 else "") + " then c.n else 0 end)" for k in range(10))
_PROFILE_SQL += "         list_value(" + _BINS + ") bins\n  from cnt c join base b using (column_name) group by 1, 2),\n" + r"""
psi as (select *, case when n_inside > 0 then list_sum(list_transform(bins, lambda b:
          (0.1 - greatest(b / n_inside, 0.0001)) * ln(0.1 / greatest(b / n_inside, 0.0001)))) end psi from p),
ct as (
  select load_id, sum(n) n_rows, sum(case when city is null then n else 0 end) n_null,
         sum(case when city is not null then n else 0 end) n_values, count(city) n_distinct,
         max(case when city is not null then n end) top_count,
         sum(case when city is not null and not regexp_matches(city, '^\p{Lu}[\p{L}.''\-]*(?: [\p{L}.''\-]+)*\z') then n else 0 end) n_bad
  from (select load_id, city, count(*) n from advertising group by 1, 2) group by 1)
"""


def _profile(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    base = fit_baseline(table(spark, d, "ads_accepted"), NUMERIC, TEXT)
    return profile_loads(table(spark, d, "advertising"), "load_id", NUMERIC, TEXT, base, {"city": PLACE}), base


@registry.query(
    _PROFILE_SQL
    + """
select load_id, column_name, 'null' check_name from psi where n_null / n_rows - (bn - bv) / bn > 0.10
union all select load_id, column_name, 'range' from psi where n_outside > 0.05 * n_values
union all select load_id, column_name, 'single' from psi where top_count > 0.5 * n_values
union all select load_id, column_name, 'drift' from psi where n_inside >= 100 and psi > 0.3
union all select load_id, 'city', 'null' from ct, city_base b where n_null / n_rows - (b.n - b.v) / b.n > 0.10
union all select load_id, 'city', 'single' from ct where top_count > 0.5 * n_values
union all select load_id, 'city', 'pattern' from ct where n_bad > 0.05 * n_values"""
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads and columns that depart from the accepted load."""
    profile, base = _profile(spark, d)
    return failed_checks(profile, "load_id", base, {"city": PLACE})


@registry.query(
    _PROFILE_SQL
    + """
select load_id, column_name, n_rows::bigint n_rows, n_null::bigint n_null, n_values::bigint n_values, n_distinct, top_count, low + 0.0 low, high, n_outside::bigint n_outside,
       n_inside::bigint n_inside, 0::bigint n_bad, round(psi, 6) psi from psi
union all select load_id, 'city', n_rows::bigint, n_null::bigint, n_values::bigint, n_distinct, top_count, null, null, null, null, n_bad::bigint, null from ct"""
)
def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of three columns of every load."""
    return _profile(spark, d)[0].select("load_id", "column_name", "n_rows", "n_null", "n_values", "n_distinct", "top_count", "low", "high", "n_outside", "n_inside", "n_bad", F.round("psi", 6).alias("psi"))


_WHOLE_SQL = (
    _PROFILE_SQL
    + """,
tops as (select load_id, column_name, first(x order by n desc, x) + 0.0 top_number from cnt where x is not null group by 1, 2),
numbers as (
  select p.load_id, p.column_name, n_rows, n_null, n_values, n_distinct, top_count, top_number, null::varchar top_words, low + 0.0 low, high, null::int shortest, null::int longest, 0 n_bad,
         n_outside, n_inside, bins, psi, case when n_inside > 0 then list_sum(list_transform(bins, lambda b: (b - 0.1 * n_inside) * (b - 0.1 * n_inside) / (0.1 * n_inside))) end chi2,
         null::bigint n_other, null::double category_psi, null::double category_chi2
  from psi p left join tops t on p.load_id = t.load_id and p.column_name = t.column_name),
cb as (select city, count(*) / (select count(city) from ads_accepted) e from ads_accepted where city is not null group by 1),
cc as (select load_id, city, count(*) n from advertising where city is not null group by 1, 2),
cv as (select load_id, sum(n) v, first(city order by n desc, city) top_words, min(length(city))::int shortest, max(length(city))::int longest from cc group by 1),
cs as (
  select cv.load_id, v, sum(coalesce(n, 0)) known, sum((greatest(e, 0.0001) - greatest(coalesce(n, 0) / v, 0.0001)) * ln(greatest(e, 0.0001) / greatest(coalesce(n, 0) / v, 0.0001))) psi,
         sum((coalesce(n, 0) - e * v) * (coalesce(n, 0) - e * v) / (e * v)) chi2
  from cv cross join cb left join cc on cc.load_id = cv.load_id and cc.city = cb.city group by 1, 2),
texts as (
  select ct.load_id, 'city' column_name, n_rows, n_null, n_values, n_distinct, top_count, null::double top_number, top_words, null::double low, null::double high, shortest, longest, n_bad,
         null::bigint n_outside, null::bigint n_inside, null::bigint[] bins, null::double psi, null::double chi2, coalesce(cs.v - known, 0) n_other,
         cs.psi + (0.0001 - greatest((cs.v - known) / cs.v, 0.0001)) * ln(0.0001 / greatest((cs.v - known) / cs.v, 0.0001)) category_psi,
         cs.chi2 + (cs.v - known - 0.0001 * cs.v) * (cs.v - known - 0.0001 * cs.v) / (0.0001 * cs.v) category_chi2
  from ct left join cv on ct.load_id = cv.load_id left join cs on ct.load_id = cs.load_id),
whole as (select * from numbers union all select * from texts)
"""
)


@registry.query(
    _WHOLE_SQL
    + """
select load_id, column_name, n_rows::bigint n_rows, n_null::bigint n_null, n_values::bigint n_values, n_distinct, top_count, top_number, top_words, low, high, shortest, longest, n_bad::bigint n_bad,
       n_outside::bigint n_outside, n_inside::bigint n_inside, list_transform(bins, lambda b: b::bigint) bins, round(psi, 6) psi, round(chi2, 4) chi2, n_other::bigint n_other,
       round(category_psi, 6) category_psi, round(category_chi2, 4) category_chi2
from whole"""
)
def p1_profile_values(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile, with dominant values, lengths, bins and both measures of drift."""
    top, text = F.col("top_value"), F.col("column_name").isin(TEXT)
    out = _profile(spark, d)[0].withColumns({"top_number": F.when(~text, top.cast("double")), "top_words": F.when(text, top)} | {c: F.round(c, 6 if "psi" in c else 4) for c in ("psi", "chi2", "category_psi", "category_chi2")})
    return out.drop("top_value")


#: Chi-square of nine degrees of freedom at 0.1 %, the usual limit of a stability index, and chi-square of categories.
DRIFTS = Limits(psi=0.1, chi2=27.877, category_psi=2.0, category_chi2=5000.0)


@registry.query(
    _WHOLE_SQL
    + """
select load_id, column_name, 'drift' check_name from whole where n_inside >= 100 and psi > 0.1
union all select load_id, column_name, 'chi2' from whole where n_inside >= 100 and chi2 > 27.877
union all select load_id, column_name, 'category_psi' from whole where n_values >= 100 and category_psi > 2.0
union all select load_id, column_name, 'category_chi2' from whole where n_values >= 100 and category_chi2 > 5000"""
)
def p1_drift(spark: SparkSession, d: str) -> DataFrame:
    """Loads and columns whose distribution departs from the accepted load's, by both measures, the city's too."""
    profile, base = _profile(spark, d)
    found = failed_checks(profile, "load_id", base, {"city": PLACE}, DRIFTS)
    return found.where(F.col("check_name").isin("drift", "chi2", "category_psi", "category_chi2"))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_missing(table(spark, d, "advertising"), NUMERIC, BANDS, "area_id", "ad_ts")


@registry.query(
    """
with f as (
  select rec_id, area_id, date_trunc('month', ad_ts) m,
         coalesce(isfinite(area_income) and area_income > 0, false) a, coalesce(isfinite(daily_internet_usage) and daily_internet_usage > 0, false) b,
         coalesce(lower(trim(daily_internet_usage_band)) in ('very_low', 'low', 'medium', 'high', 'very_high'), false) c
  from advertising where area_id is not null and ad_ts is not null),
g as (select area_id, m, max(a::int) a, max(b::int) b, max(c::int) c from f group by 1, 2)
select rec_id, 'area_income' field_name from f join g using (area_id, m) where not f.a and g.a = 1
union all select rec_id, 'daily_internet_usage' from f join g using (area_id, m) where not f.b and g.b = 1
union all select rec_id, 'daily_internet_usage_band' from f join g using (area_id, m) where not f.c and g.c = 1"""
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of advertising that could be filled."""
    return filled_cells(_filled(spark, d), "rec_id", [*NUMERIC, *BANDS])


@registry.query()
def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """All rows of advertising with filled values and masks."""
    return _filled(spark, d)


@registry.query(
    """
with f as (
  select rec_id, area_id, date_trunc('month', ad_ts) m, f.field_name, coalesce(isfinite(f.x) and f.x > 0, false) known, rec_id % 20 = 7 held
  from advertising, lateral (values ('area_income', area_income), ('daily_internet_usage', daily_internet_usage)) f(field_name, x)
  where area_id is not null and ad_ts is not null),
g as (select area_id, m, field_name from f where known and not held group by all)
select field_name, count(*) n, true better_than_mean from f join g using (area_id, m, field_name) where known and held group by 1"""
)
def p5_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth record's numbers are taken away and filled: whether they come nearer than the mean of all does."""
    ads = table(spark, d, "advertising")
    held = F.col("rec_id") % 20 == 7
    usable = {c: F.when((F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c), F.col(c)) for c in NUMERIC}
    hidden = ads.withColumns({f"true_{c}": F.when(held, x) for c, x in usable.items()} | {c: F.when(~held, F.col(c)) for c in NUMERIC})
    mean = ads.where(~held).agg(*[F.avg(x).alias(c) for c, x in usable.items()]).first()
    filled = fill_missing(hidden, NUMERIC, {}, "area_id", "ad_ts")
    cells = F.array(*[F.struct(F.lit(c).alias("field_name"), F.when(F.col(f"{c}_filled"), F.col(f"true_{c}")).alias("x"), F.col(c).alias("y"), F.lit(mean[c]).alias("m")) for c in NUMERIC])
    error = lambda c: F.avg(F.pow(F.col("x") - F.col(c), 2))
    return filled.select(F.inline(cells)).where("x is not null").groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), (error("y") < error("m")).alias("better_than_mean"))
