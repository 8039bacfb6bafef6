"""Queries over the tables of a folder by the operators of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepline.llm.encoding import encode_corpus
from prepline.llm.forms import look_alike_classes, look_alike_pairs, unify_text
from prepline.llm.mixing import mix_sources
from prepline.llm.quantiles import K, build_sketches, merge_sketches, percentiles, rank_error, usable
from prepline.llm.sampling import sample_plans
from prepline.llm.terms import count_terms, mark_terms
from prepline.queries.registry import Query, Registry
from prepline.session import cut
from prepline.sources import table

registry = Registry()

_TERMS_SQL = r"""
with v as (
  select id, f.field_name, nullif(lower(trim(regexp_replace(f.x, '\s+', ' ', 'g'))), '') item
  from advertising, lateral (values ('city', city), ('country', country)) f(field_name, x)),
i as (
  select id, field_name, 'value' kind, item from v where item is not null
  union all select id, field_name, 'term', unnest(string_split(item, ' ')) from v where item is not null),
c as (select field_name, kind, item, count(*) occurrences, count(distinct id) records from i group by 1, 2, 3)
"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    ads = table(spark, d, "advertising").select("id", "city", "country")
    n = ads.agg(F.count_distinct("id")).first()[0]
    return mark_terms(count_terms(ads, ["city", "country"], "id"), n)


@registry.query(
    _TERMS_SQL
    + """select field_name, kind, item, case when records <= 2 then 'rare' else 'common' end mark
from c where records between 1 and 2 or records > 0.04 * (select count(distinct id) from advertising)"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values and terms of places that are too rare or too common."""
    return _terms(spark, d).where("mark is not null").select("field_name", "kind", "item", "mark")


@registry.query(_TERMS_SQL + "select * from c")
def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of all values and terms of places."""
    return _terms(spark, d).drop("mark")


FIELDS, DIMENSIONS = ["area_income", "daily_internet_usage"], ["country", "clicked_on_ad"]


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    return build_sketches(table(spark, d, "advertising"), ["load_id"], DIMENSIONS, FIELDS)


@registry.query()
def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per load and, where load_id is null, of all loads, per country and per clicked_on_ad."""
    loads = cut(_sketches(spark, d))
    whole = merge_sketches(loads).select(F.lit(None).cast("int").alias("load_id"), "dimension", "key", "field", "n", "sketch")
    return percentiles(loads.unionByName(whole)).withColumn("rank_error", F.when(F.col("n") > 1024, rank_error()).otherwise(0.0))


@registry.query(
    """
select d.dimension, d.key, f.field, count(*) n, true within_error
from advertising,
     lateral (values ('country', country), ('clicked_on_ad', clicked_on_ad::varchar)) d(dimension, key),
     lateral (values ('area_income', area_income), ('daily_internet_usage', daily_internet_usage)) f(field, x)
where isfinite(f.x) and f.x > 0 group by 1, 2, 3"""
)
def p3_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whether the percentiles over all loads, from sketches of each, are within twice the stated error of their ranks."""
    ads = table(spark, d, "advertising")
    found = cut(percentiles(merge_sketches(_sketches(spark, d))))
    cells = ads.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("key")) for c in DIMENSIONS])), *[usable(f).alias(f"x{i}") for i, f in enumerate(FIELDS)]
    ).select("dimension", "key", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x{i}").alias("x")) for i, f in enumerate(FIELDS)])))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("dimension", "key", "field")])
    joined = cells.where("x is not null").alias("a").join(found.alias("b"), same).select("b.*", "x")
    shares = {0.05: "p05", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.95: "p95"}
    below = joined.groupBy("dimension", "key", "field", "n").agg(*[F.avg((F.col("x") < F.col(c)).cast("double")).alias(f"l_{c}") for c in shares.values()], *[F.avg((F.col("x") <= F.col(c)).cast("double")).alias(f"u_{c}") for c in shares.values()])
    slack = F.when(F.col("n") > K, 2 * rank_error()).otherwise(0.0) + 1e-9
    ok = [(F.col(f"l_{c}") <= s + slack) & (F.col(f"u_{c}") >= s - slack) for s, c in shares.items()]
    return below.select("dimension", "key", "field", "n", functools.reduce(lambda a, b: a & b, ok).alias("within_error"))


@registry.query(
    """
with k as (
  select load_id, d.dimension, d.key, f.field, f.x
  from advertising,
       lateral (values ('country', country), ('clicked_on_ad', clicked_on_ad::varchar)) d(dimension, key),
       lateral (values ('area_income', area_income), ('daily_internet_usage', daily_internet_usage)) f(field, x)
  where isfinite(f.x) and f.x > 0)
select load_id, dimension, key, field, count(*) n, quantile_disc(x, 0.05) p05, quantile_disc(x, 0.25) p25, quantile_disc(x, 0.5) p50,
       quantile_disc(x, 0.75) p75, quantile_disc(x, 0.95) p95
from k group by 1, 2, 3, 4"""
)
def p3_load_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per load; a load's groups are small enough for exact ones."""
    return percentiles(_sketches(spark, d))


@registry.query(
    """
select plan_id, category from sample_plans p left join (
  select load_id, coalesce(clicked_on_ad::varchar, 'none') category, count(distinct id) n from advertising group by 1, 2) a using (load_id, category)
where greatest(floor(target_share * sample_size + 0.5), coalesce(min_rows, 0)) > coalesce(n, 0)"""
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of plans that can't be met."""
    return sample_plans(table(spark, d, "advertising"), table(spark, d, "sample_plans")).report.where("short").select("plan_id", "category")


@registry.query(
    """
with u as (select load_id, id, coalesce(clicked_on_ad::varchar, 'none') category from advertising where id is not null group by all),
a as (select load_id, category, count(*) n from u group by all),
o as (select load_id, id, first(category order by n, category) category from u join a using (load_id, category) group by all),
m as (select load_id, category, count(*) m from o group by all),
l as (select plan_id, load_id, category, greatest(floor(target_share * sample_size + 0.5)::bigint, coalesce(min_rows, 0)) required, coalesce(n, 0) available, coalesce(m, 0) m
      from sample_plans left join a using (load_id, category) left join m using (load_id, category))
select plan_id, load_id, category, required, available, round(case when required > 0 and available > 0 then ln(required / available) end, 6) tilt,
       round(case when required > 0 and m > 0 then least(1, required / m) else 0 end, 6) probability,
       least(required, m) sampled, required - least(required, m) gap, required > available short
from l"""
)
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Required, available and sampled ids of all lines of plans."""
    report = sample_plans(table(spark, d, "advertising"), table(spark, d, "sample_plans")).report
    return report.withColumns({c: F.round(c, 6) + 0.0 for c in ("tilt", "probability")})


@registry.query()
def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The samples of all plans."""
    return sample_plans(table(spark, d, "advertising"), table(spark, d, "sample_plans")).sample


@registry.query()
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


@registry.query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of mixes whose source can't fill its target."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).report.where("short").select("mix_id", "source_name")


@registry.query()
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Targets and actual shares of all lines of all mixes."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


@registry.query()
def p7_picks(spark: SparkSession, d: str) -> DataFrame:
    """The documents of all mixes with their copies."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).picks


@registry.query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same but differ."""
    return look_alike_pairs(table(spark, d, "documents"))


@registry.query()
def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document that looks like another one, with its class and the number of its links."""
    return look_alike_classes(table(spark, d, "documents"))


@registry.query()
def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in the common form."""
    return unify_text(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "form")


def queries() -> dict[str, Query]:
    return dict(registry.queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry.sql)
