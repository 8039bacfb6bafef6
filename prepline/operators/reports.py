"""Report tables about columns, categories, targets, correlations and time."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepline.functions.safe import INF, NAN, fdiv, finite, is_invalid, safe_corr
from prepline.functions.sqltext import name
from prepline.operators.encode import interval_sql
from prepline.operators.infer import FEW_COLUMNS, category_counts, correlation_matrix, infer_discretes
from prepline.operators.quantiles import SortedCounts, column_modes, column_quantiles, group_modes, group_quantiles, running, same
from prepline.operators.schema import get_numeric_cols, get_string_cols, kinds
from prepline.operators.strings import time_buckets


def check_target_cardinality(df: DataFrame, target: str, raise_null: bool = True) -> DataFrame:
    """``<target>, cnt, pct`` sorted by value; a null raises if wanted."""
    t = F.col(name(target))
    if raise_null and df.where(t.isNull()).limit(1).count():
        raise ValueError(f"{target} has nulls")
    counts = df.groupBy(t.alias(target)).agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.agg(F.sum("cnt")).first()[0] or 1
    return counts.withColumn("pct", F.col("cnt") / F.lit(total)).orderBy(F.col(name(target)).asc_nulls_first())


def range_counts(df: DataFrame, ranges: Mapping[str, Sequence[tuple[float, float]]], closed: str = "both") -> DataFrame:
    """``column, lower, upper, cnt``: values of each range; closed on both sides, left, right or none. One aggregate."""
    todo = [(c, float(a), float(b)) for c, rs in ranges.items() for a, b in rs]

    def inside(x: Column, a: float, b: float) -> Column:
        low = x >= a if closed in ("both", "left") else x > a
        return low & (x <= b if closed in ("both", "right") else x < b)

    if closed not in ("both", "left", "right", "none"):
        raise ValueError(f"unknown side {closed}")
    wide = df.agg(*[F.count(F.when(inside(F.col(name(c)), a, b), 1)).alias(f"r{i}") for i, (c, a, b) in enumerate(todo)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(a).alias("lower"), F.lit(b).alias("upper"), F.col(f"r{i}").alias("cnt")) for i, (c, a, b) in enumerate(todo)])))


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column's average rank as ``r{i}`` beside all columns.

    Ranks come from the counts of distinct values (their running sum), joined back, so ties are cheap.
    """
    for i, c in enumerate(cols):
        counts = df.where(finite(name(c)).isNotNull()).groupBy(finite(name(c)).alias(f"v{i}")).agg(F.count(F.lit(1)).alias("n"))
        ranked = running(counts, [f"v{i}"], {"below": "n"}).select(f"v{i}", (F.col("below") - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{i}"))
        df = df.join(ranked, finite(name(c)) == F.col(f"v{i}"), "left").drop(f"v{i}")
    return df


def corr_report(df: DataFrame, features: Sequence[str], targets: Sequence[str], method: str = "pearson") -> DataFrame:
    """``features`` and one column of correlations per target; all pairs in one aggregate, of many columns in matrices."""
    cols = list(dict.fromkeys([*features, *targets]))
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method}")
    if method == "pearson" and len(cols) > FEW_COLUMNS and len(cols) == len(features) + len(targets):
        m = correlation_matrix(df, cols)[: len(features), len(features) :]
        return df.sparkSession.createDataFrame([(f, *map(float, r)) for f, r in zip(features, m)], "features string, " + ", ".join(f"{name(t)} double" for t in targets))
    if method == "spearman":
        df, at = average_ranks(df.select(*map(name, cols)), cols), {c: f"r{i}" for i, c in enumerate(cols)}
    else:
        at = {c: name(c) for c in cols}
    wide = df.agg(*[safe_corr(at[f], at[t]).alias(f"{i}_{j}") for i, f in enumerate(features) for j, t in enumerate(targets)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f).alias("features"), *[F.col(f"{i}_{j}").alias(t) for j, t in enumerate(targets)]) for i, f in enumerate(features)])))


def data_profile(df: DataFrame, percentiles: Sequence[float] = (0.25, 0.75), exclude: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """One row per numeric, text and boolean column.

    ``column, dtype, null_pct, min, max`` (as text), ``mean, std, median, skew, kurtosis`` (population) and
    ``<q>-percentile``; text columns have null moments. NaN and infinities take part in min and max only, decimals
    count as doubles. Percentiles are exact, or approximate with an ``accuracy``.

    Numbers are unpivoted to counts of their values once; moments and percentiles are read off these sorted counts,
    so no task holds the values of a column. Nulls and bounds of all columns are one aggregate.
    """
    k = kinds(df)
    cols = [c for c in df.columns if k[c] in ("numeric", "string", "bool") and c not in set(exclude)]
    numbers, texts = [c for c in cols if k[c] != "string"], [c for c in cols if k[c] == "string"]
    types = {f.name: f.dataType for f in df.schema.fields}
    qs = [0.5, *percentiles]
    rows: list[tuple] = []
    if cols:
        # bounds and nulls keep the columns' own types; a few numbers per column come to the driver
        wide = df.agg(F.count(F.lit(1)).alias("n"), *[a for i, c in enumerate(cols) for a in (F.count(name(c)).alias(f"c{i}"), F.min(name(c)).cast("string").alias(f"a{i}"), F.max(name(c)).cast("string").alias(f"b{i}"))], *[F.avg(finite(name(c))).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        q, m = _approximate(df, numbers, qs, accuracy) if accuracy is not None else _exact(df, numbers, qs, [wide[f"m{i}"] for i in range(len(numbers))])
        none = (None,) * 4
        for c in [*numbers, *texts]:
            i = cols.index(c)
            rows.append((c, types[c].simpleString(), (wide["n"] - wide[f"c{i}"]) / wide["n"] if wide["n"] else None, wide[f"a{i}"], wide[f"b{i}"], *m.get(c, none), q.get(c)))
    long = df.sparkSession.createDataFrame(rows, "column string, dtype string, null_pct double, min string, max string, mean double, std double, skew double, kurtosis double, q array<double>")
    return long.select("column", "dtype", "null_pct", "min", "max", "mean", "std", F.get("q", F.lit(0)).alias("median"), "skew", "kurtosis", *[F.get("q", F.lit(j + 1)).alias(f"{q * 100:.1f}-percentile") for j, q in enumerate(percentiles)])


def _exact(df: DataFrame, numbers: Sequence[str], qs: Sequence[float], centers: Sequence[float]) -> tuple[dict, dict]:
    if not numbers:
        return {}, {}
    counts = SortedCounts(df, numbers, centers)
    return counts.quantiles(qs), counts.moments()


def _approximate(df: DataFrame, numbers: Sequence[str], qs: Sequence[float], accuracy: int) -> tuple[dict, dict]:
    if not numbers:
        return {}, {}
    cells = [F.struct(F.lit(i).alias("i"), finite(name(c)).alias("x")) for i, c in enumerate(numbers)]
    found = df.select(F.inline(F.array(*cells))).groupBy("i").agg(F.avg("x"), F.stddev_samp("x"), F.skewness("x"), F.kurtosis("x")).collect()
    return column_quantiles(df, numbers, qs, accuracy), {numbers[r["i"]]: tuple(r)[1:] for r in found}


def str_meta_report(df: DataFrame, cols: Sequence[str] | None = None, words_to_count: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: nulls, min, max, mode, byte lengths, average counts of character classes, words."""
    cols = list(cols or get_string_cols(df))
    modes = column_modes(df, cols)
    found: dict[str, list[Column]] = {}
    for c in cols:
        x = F.col(name(c))
        n = F.octet_length(x)
        count = lambda p, x=x: F.regexp_count(x, F.lit(p))
        found[c] = [
            F.count(F.when(x.isNull(), 1)).alias("null_count"), F.min(x).alias("min"), F.max(x).alias("max"), F.max(F.lit(modes[c])).alias("mode"), F.min(n).alias("min_byte_len"), F.max(n).alias("max_byte_len"),
            F.avg(n).alias("avg_byte_len"), F.median(n).alias("median_byte_len"), F.avg(count(r"\s")).alias("avg_space_cnt"), F.avg(count("[0-9]")).alias("avg_digit_cnt"),
            F.avg(count("[A-Z]")).alias("avg_cap_cnt"), F.avg(count("[a-z]")).alias("avg_lower_cnt"), *[F.sum(count(w)).alias(f"total_{w}_count") for w in words_to_count or ()],
        ]
    wide = df.agg(*[F.struct(*v).alias(f"s{i}") for i, v in enumerate(found.values())])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("features"), F.col(f"s{i}").alias("s")) for i, c in enumerate(cols)]))).select("features", "s.*")


def str_cats_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per text column the counts of its categories: number, rarest, most common, average, successive differences.

    The sums of successive differences telescope, so only the smallest and largest difference need the sorted
    counts; equal counts are folded before they are sorted.
    """
    counts = category_counts(df, list(cols or get_string_cols(df)))
    w = Window.partitionBy("feature").orderBy("n")
    folded = counts.groupBy("feature", "n").agg(F.count(F.lit(1)).alias("m")).withColumn("d", F.col("n") - F.lag("n").over(w))
    steps = folded.groupBy("feature").agg(F.least(F.min("d"), F.min(F.when(F.col("m") > 1, 0))).alias("min_successive_diff"), F.greatest(F.max("d"), F.max(F.when(F.col("m") > 1, 0))).alias("max_successive_diff"))
    order = F.struct("n", F.coalesce(F.col("category").isNotNull(), F.lit(False)).alias("known"), "category")
    base = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"), F.max(F.col("category").isNull()).alias("has_null"), F.min(order).alias("a"), F.max(order).alias("b"), F.avg("n").alias("avg_count"))
    return base.join(steps, "feature").select(
        "feature", "n_unique", "has_null", F.col("a.category").alias("category_w_min_count"), F.col("a.n").alias("min_count"), F.col("b.category").alias("category_w_max_count"), F.col("b.n").alias("max_count"), "avg_count",
        "min_successive_diff", F.try_divide(F.col("b.n") - F.col("a.n"), F.col("n_unique") - 1).alias("avg_successive_diff"), "max_successive_diff",
    )


def over_time_report(df: DataFrame, time_col: str, cols: Sequence[str] | None = None, metrics: str | Sequence[str] = "null", interval: str = "monthly") -> DataFrame:
    """Per time bucket, wide: ``<col>_null%, _invalid%, _max, _min, _mean, _std, _var, _mode`` as asked, sorted."""
    buckets = time_buckets(time_col, interval)
    cols = [c for c in (cols or get_numeric_cols(df)) if c != time_col]
    make = {
        "null": lambda x: F.avg(x.isNull().cast("double")), "invalid": lambda x: F.avg(is_invalid(x).cast("double")), "max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp,
    }
    wanted = [metrics] if isinstance(metrics, str) else list(metrics)
    label = lambda c, m: f"{c}_{m}{'%' if m in ('null', 'invalid') else ''}"
    keys = [f"__{k}" for k in buckets]
    timed = df.withColumns({f"__{k}": F.expr(v) for k, v in buckets.items()})
    out = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[make[m](F.col(name(c))).alias(label(c, m)) for c in cols for m in wanted if m != "mode"])
    for c in cols if "mode" in wanted else []:
        modes = group_modes(timed, keys, F.col(name(c)) + 0).withColumnRenamed("mode", label(c, "mode"))  # makes -0.0 and 0.0 one value
        out = out.alias("a").join(modes.alias("b"), same("a", "b", keys), "left").select("a.*", F.col(f"b.{name(label(c, 'mode'))}"))
    return out.select(*[F.col(f"__{k}").alias(k) for k in buckets], *[name(label(c, m)) for c in cols for m in wanted]).orderBy(*buckets)


def over_time_report_num(df: DataFrame, time_col: str, cols: Sequence[str] | None = None, interval: str = "monthly") -> DataFrame:
    """Per feature and time bucket: count, 5 % and 95 % quantile, nulls and mean, and how they change.

    ``null_PoP_%chg`` and ``mean_PoP_%diff`` compare with the bucket before, ``null_%chg_overall`` and
    ``mean_%diff_overall`` with all rows. The columns are unpivoted and grouped once.
    """
    buckets = time_buckets(time_col, interval)
    cols = [c for c in (cols or get_numeric_cols(df)) if c != time_col]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(name(c)).cast("double").alias("x")) for c in cols])
    long = df.select(*[F.expr(v).alias(k) for k, v in buckets.items()], F.inline(cells))
    keys = ["feature", *buckets]
    per = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.avg(F.col("x").isNull().cast("double")).alias("null%"), F.avg("x").alias("mean"))
    per = per.alias("a").join(group_quantiles(long, keys, [0.05, 0.95]).alias("b"), same("a", "b", keys), "left").select("a.*", "q0", "q1")
    overall = df.agg(*[a for i, c in enumerate(cols) for a in (F.avg(F.col(name(c)).isNull().cast("double")).alias(f"n{i}"), F.avg(F.col(name(c)).cast("double")).alias(f"m{i}"))]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("all_null"), F.col(f"m{i}").alias("all_mean")) for i, c in enumerate(cols)]))
    )
    w = Window.partitionBy("feature").orderBy(*buckets)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    share, mean = F.col("`null%`"), F.col("mean")
    last_share, last_mean = F.lag(share).over(w), F.last("mean", True).over(before)
    to_inf = lambda x: F.when(F.isnan(x), INF).otherwise(x)
    return per.join(overall, "feature").select(
        "feature", *buckets, "count", F.col("q0").alias("5%_quantile"), F.col("q1").alias("95%_quantile"), "null%", "mean",
        F.when(share == 0, F.when(last_share == 0, 0.0).otherwise(NAN)).otherwise(fdiv(share, last_share) - 1).alias("null_PoP_%chg"),
        to_inf(fdiv(mean, last_mean) - 1).alias("mean_PoP_%diff"),
        F.when(F.col("all_null") == 0, F.when(share == 0, 0.0).otherwise(NAN)).otherwise(fdiv(share, F.col("all_null")) - 1).alias("null_%chg_overall"),
        to_inf(fdiv(mean, F.col("all_mean")) - 1).alias("mean_%diff_overall"),
    )


def old_vs_new_report(old: DataFrame, new: DataFrame, features: Sequence[str], percentiles: Sequence[float] = (0.25, 0.75), compute_psi: bool = False, psi_bins: int = 10) -> DataFrame:
    """The profiles of two frames side by side (``_new``), and the stability index of each feature if wanted."""
    a = data_profile(old.select(*map(name, features)), percentiles)
    b = data_profile(new.select(*map(name, features)), percentiles)
    out = a.join(b.select("column", *[F.col(name(c)).alias(f"{c}_new") for c in b.columns if c not in ("column", "dtype")]), "column")
    if not compute_psi:
        return out
    return out.join(_stability(old, new, features, psi_bins), "column")


def _stability(old: DataFrame, new: DataFrame, features: Sequence[str], bins: int, clip: float = 1e-5) -> DataFrame:
    """``column, psi`` of all features by one count: categories (null is one) or bins between the old quantiles.

    -1 for a continuous feature without old values.
    """
    k = kinds(old)
    discrete = set(infer_discretes(old.select(*map(name, features)))) | {c for c in features if k[c] in ("string", "bool")}
    numbers = [c for c in features if c not in discrete]
    cuts = {c: v for c, v in column_quantiles(old, numbers, [i / bins for i in range(1, bins)]).items() if v}
    known = [c for c in features if c in discrete or c in cuts]

    def side(df: DataFrame, of: str) -> DataFrame:
        plain = df.select(*[F.col(name(c)).cast("string").alias(c) if c in discrete else finite(name(c)).alias(c) for c in known])
        cells = [F.struct(F.lit(c).alias("column"), (F.col(name(c)) if c in discrete else F.expr(interval_sql(name(c), cuts[c]))).alias("v"), F.lit(c in discrete).alias("d")) for c in known]
        return plain.select(F.inline(F.array(*cells))).where("d or v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias(of))

    none = old.sparkSession.createDataFrame([(c, -1.0) for c in features if c not in known], "column string, psi double")
    if not known:
        return none
    both = side(old, "a").withColumn("b", F.lit(0).cast("bigint")).unionByName(side(new, "b").withColumn("a", F.lit(0).cast("bigint"))).groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = Window.partitionBy("column")
    share = lambda c: F.greatest(F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1)), F.lit(clip))
    return both.select("column", share("a").alias("e"), share("b").alias("s")).groupBy("column").agg(F.sum((F.col("e") - F.col("s")) * F.log(F.col("e") / F.col("s"))).alias("psi")).unionByName(none)
