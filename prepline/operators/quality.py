"""Profiles of the columns of every load of a table, and their comparison with an accepted load."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.operators.quantiles import column_quantiles

#: Least share of a bin in the population stability index.
LEAST_SHARE = 0.0001
#: Most values of a text column that are categories of their own in its baseline; others count as one.
MOST_CATEGORIES = 20_000


@dataclass(frozen=True)
class Baseline:
    """What later loads of a numeric or text column are compared with; numeric: range and inner breaks of bins; text: shares of values."""

    null_share: float
    low: float | None = None
    high: float | None = None
    breaks: tuple[float, ...] = ()
    shares: tuple[tuple[str, float], ...] = ()


def _number(c: str) -> Column:
    """A numeric column as double; NaN counts as null."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def fit_baseline(accepted: DataFrame, numeric: Sequence[str], text: Sequence[str] = (), bins: int = 10) -> dict[str, Baseline]:
    """One aggregate over the accepted load, its quantiles, and one count of values per text column; only a few numbers
    per numeric column come to the driver, and the shares of the most frequent ``MOST_CATEGORIES`` values of a text.

    Breaks are the inner quantiles of the finite values by linear interpolation, from sorted counts of values where
    the load isn't small, so that no task holds a whole column. A column without values has
    no range and no breaks; an empty table has null shares of 0.
    """
    qs = [i / bins for i in range(1, bins)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(numeric):
        x = _number(c)
        aggs += [F.count(x).alias(f"c{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    aggs += [F.count(f"`{c}`").alias(f"t{i}") for i, c in enumerate(text)]
    r = accepted.agg(*aggs).first()
    n = max(r["n"], 1)
    q = column_quantiles(accepted, numeric, qs)
    found = {c: Baseline((r["n"] - r[f"c{i}"]) / n, r[f"l{i}"], r[f"h{i}"], tuple(q[c] or ())) for i, c in enumerate(numeric)}
    for i, c in enumerate(text):
        words = accepted.select(F.col(f"`{c}`").alias("words")).where("words is not null").groupBy("words").agg(F.count(F.lit(1)).alias("n"))
        top = words.orderBy(F.desc("n"), "words").limit(MOST_CATEGORIES).collect()
        found[c] = Baseline((r["n"] - r[f"t{i}"]) / n, shares=tuple((x["words"], x["n"] / r[f"t{i}"]) for x in top))
    return found


def value_counts(df: DataFrame, by: str, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """``by, column_name, number, words, n``: how often each exact value of each column occurs in each load.

    The columns are unpivoted within the row and counted before the shuffle, so a load that holds a large share
    of the rows is reduced where it is read. A null value is a value of its own (number and words both null).
    """
    none_n, none_t = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = [F.struct(F.lit(c).alias("column_name"), _number(c).alias("number"), none_t.alias("words")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("column_name"), none_n.alias("number"), F.col(f"`{c}`").alias("words")) for c in text]
    return df.select(F.col(f"`{by}`").alias(by), F.inline(F.array(*cells))).groupBy(by, "column_name", "number", "words").agg(F.count(F.lit(1)).alias("n"))


def profile_loads(df: DataFrame, by: str, numeric: Sequence[str], text: Sequence[str] = (), baseline: Mapping[str, Baseline] | None = None, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row per load and column: an exact profile from the counts of its values.

    ``by, column_name, n_rows, n_null, n_values, n_distinct, top_count, top_value`` (the most frequent value as
    text, of equal ones the smallest), ``low, high`` (numeric), ``shortest, longest`` (text, in characters),
    ``n_bad`` (text that doesn't match the column's pattern) and, if the column has a baseline with a range,
    ``n_outside``, ``n_inside`` (values within it), ``bins`` (their counts by bin, right-closed), ``psi`` and
    ``chi2`` against equal shares. If a text column's baseline has shares: ``n_other`` (values that aren't among
    them), ``category_psi`` and ``category_chi2`` of those categories and the others against them.

    NaN counts as null, infinities are values. Rows with null load form a load of their own; an empty table has
    no rows; a load without values of a column has null extremes. Repeated rows all count; texts may have any
    length, the empty text is a value. Other columns are ignored, whatever their names.
    """
    counts = value_counts(df, by, numeric, text)
    n, x, w = F.col("n"), F.col("number"), F.col("words")
    has = x.isNotNull() | w.isNotNull()
    base, pats = baseline or {}, patterns or {}
    name = F.col("column_name")

    def per_column(values: Mapping[str, object], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for c, v in values.items():
            out = F.when(name == c, F.lit(v)).otherwise(out)
        return out

    ranged = {c: b for c, b in base.items() if b.low is not None and c in numeric}
    low, high = per_column({c: b.low for c, b in ranged.items()}, "double"), per_column({c: b.high for c, b in ranged.items()}, "double")
    inside = x.between(low, high)
    n_bins = max([len(b.breaks) + 1 for b in ranged.values()], default=0)
    if n_bins:
        place = F.lit(0)
        for k in range(n_bins - 1):
            place = place + F.when(x > per_column({c: b.breaks[k] for c, b in ranged.items()}, "double"), 1).otherwise(0)
    bad = F.lit(False)
    for c, p in pats.items():
        bad = F.when(name == c, ~w.rlike(p)).otherwise(bad)
    zero, known_share = F.lit(0), F.lit(None).cast("double")
    shared = {c: b.shares for c, b in base.items() if b.shares and c in text}
    if shared:  # small enough for the planner to broadcast
        cells = json.dumps([{"base_column": c, "base_words": value, "base_share": e} for c, s in shared.items() for value, e in s])
        table = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(cells), "array<struct<base_column:string,base_words:string,base_share:double>>")))
        counts = counts.join(table, (name == F.col("base_column")) & (w == F.col("base_words")), "left")
        known_share = F.col("base_share")
    aggs = [
        F.sum(n).alias("n_rows"),
        F.sum(F.when(has, zero).otherwise(n)).alias("n_null"),
        F.sum(F.when(has, n).otherwise(zero)).alias("n_values"),
        F.count(F.when(has, 1)).alias("n_distinct"),
        F.max(F.when(has, n)).alias("top_count"),
        F.min(F.when(has, F.struct(-n, x.alias("number"), w.alias("words")))).alias("top"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.min(F.length(w)).alias("shortest"),
        F.max(F.length(w)).alias("longest"),
        F.sum(F.when(has & bad, n).otherwise(zero)).alias("n_bad"),
        F.sum(F.when(has & ~inside, n).otherwise(zero)).alias("n_outside"),
        F.sum(F.when(inside, n).otherwise(zero)).alias("n_inside"),
        F.collect_list(F.when(known_share.isNotNull(), F.struct(known_share.alias("e"), n.alias("n")))).alias("seen"),
        *[F.sum(F.when(inside & (place == k), n).otherwise(zero)).alias(f"bin{k}") for k in range(n_bins)],
    ]
    out = counts.groupBy(by, "column_name").agg(*aggs)
    known = name.isin(list(ranged))
    bins = F.array(*[F.col(f"bin{k}") for k in range(n_bins)]) if n_bins else F.lit(None).cast("array<bigint>")
    expected = 1.0 / max(n_bins, 1)
    total = F.col("n_inside")
    share = lambda b: F.greatest(b / total, F.lit(LEAST_SHARE))
    psi = F.aggregate(bins, F.lit(0.0), lambda s, b: s + (expected - share(b)) * F.log(F.lit(expected) / share(b)))
    chi2 = F.aggregate(bins, F.lit(0.0), lambda s, b: s + (b - expected * total) * (b - expected * total) / (expected * total))
    has_shares, values = name.isin(list(shared)), F.col("n_values")
    least = lambda x: F.greatest(x, F.lit(LEAST_SHARE))
    term = lambda e, s: (least(e) - least(s)) * F.log(least(e) / least(s))
    square = lambda e, o: (o - e * values) * (o - e * values) / (e * values)
    seen, n_other = F.array_sort("seen"), values - F.aggregate("seen", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    # all categories as if none occurred, corrected for those that do
    unseen = {c: sum((max(e, LEAST_SHARE) - LEAST_SHARE) * math.log(max(e, LEAST_SHARE) / LEAST_SHARE) for _, e in s) for c, s in shared.items()}
    whole = {c: sum(e for _, e in s) for c, s in shared.items()}
    rest = per_column({c: max(1 - x, LEAST_SHARE) for c, x in whole.items()}, "double")
    category_psi = F.aggregate(seen, per_column(unseen, "double"), lambda s, x: s + term(x["e"], x["n"] / values) - term(x["e"], F.lit(0.0))) + term(rest, n_other / values)
    category_chi2 = F.aggregate(seen, per_column(whole, "double") * values, lambda s, x: s + square(x["e"], x["n"]) - x["e"] * values) + square(rest, n_other)
    return out.select(
        by, "column_name", "n_rows", "n_null", "n_values", "n_distinct", "top_count", F.coalesce(F.col("top.words"), F.col("top.number").cast("string")).alias("top_value"), "low", "high", "shortest", "longest", "n_bad",
        F.when(known, F.col("n_outside")).alias("n_outside"), F.when(known, total).alias("n_inside"), F.when(known, bins).alias("bins"),
        F.when(known & (total > 0), psi).alias("psi"), F.when(known & (total > 0), chi2).alias("chi2"),
        F.when(has_shares, n_other).alias("n_other"), F.when(has_shares & (values > 0), category_psi).alias("category_psi"), F.when(has_shares & (values > 0), category_chi2).alias("category_chi2"),
    )


@dataclass(frozen=True)
class Limits:
    """When a check of a load holds; see ``failed_checks``. Checks whose limit is None aren't made."""

    null_rise: float = 0.10
    outside_share: float = 0.05
    single_share: float = 0.5
    bad_share: float = 0.05
    least_values: int = 100
    psi: float = 0.3
    chi2: float | None = None
    category_psi: float | None = None
    category_chi2: float | None = None


def failed_checks(profile: DataFrame, by: str, baseline: Mapping[str, Baseline], patterns: Mapping[str, str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """``by, column_name, check_name``: one row per load, column and check that holds.

    ``null`` (share of nulls above the baseline's by more than null_rise), ``range`` (more than outside_share of
    the values outside the baseline's range), ``single`` (one value is more than single_share of the values),
    ``pattern`` (more than bad_share of the values don't match), ``drift`` (at least least_values inside the
    range, stability index above psi). If asked for: ``chi2`` (at least least_values inside the range, chi-square
    above its critical value), ``category_psi`` and ``category_chi2`` (at least least_values, the same of the
    categories of a text column).
    """
    name, v = F.col("column_name"), F.col("n_values")
    base_nulls = F.lit(None).cast("double")
    for c, b in baseline.items():
        base_nulls = F.when(name == c, F.lit(b.null_share)).otherwise(base_nulls)
    checks = {
        "null": F.col("n_null") / F.col("n_rows") - base_nulls > limits.null_rise,
        "range": F.col("n_outside") > limits.outside_share * v,
        "single": F.col("top_count") > limits.single_share * v,
        "pattern": name.isin(list(patterns or {})) & (F.col("n_bad") > limits.bad_share * v),
        "drift": (F.col("n_inside") >= limits.least_values) & (F.col("psi") > limits.psi),
    }
    for key, enough in (("chi2", F.col("n_inside")), ("category_psi", v), ("category_chi2", v)):
        if (limit := getattr(limits, key)) is not None:
            checks[key] = (enough >= limits.least_values) & (F.col(key) > limit)
    held = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return profile.select(by, "column_name", F.explode(held).alias("check_name"))
