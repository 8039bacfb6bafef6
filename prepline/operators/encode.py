"""Category recoding, encoders and binning."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.functions.safe import fdiv, finite, flog
from prepline.functions.sqltext import lit, name, number
from prepline.operators.infer import category_counts, infer_binary
from prepline.operators.quantiles import column_quantiles
from prepline.operators.schema import get_string_cols
from prepline.operators.sample import row_numbers
from prepline.plans.steps import KEPT, Step, lookup_step, recorded

#: Columns (or branches of an expression) that an encoder may make for one column unless it is told otherwise.
MAX_FLAGS = 1000
#: Infrequent categories that are named in an expression; more are looked up in a table.
NAMED = 200


def _categories(df: DataFrame, cols: Sequence[str], limit: int = MAX_FLAGS, with_null: bool = False) -> dict[str, list]:
    """The sorted distinct values of columns; raises beyond the limit instead of collecting on."""
    if not cols:
        return {}
    out = {}
    for c in cols:
        rows = df.select(F.col(name(c)).alias("v")).distinct().limit(limit + 2).collect()
        values = [r["v"] for r in rows if r["v"] is not None]
        if len(values) > limit:
            raise ValueError(f"{c} has more than {limit} categories")
        out[c] = ([None] if with_null and len(values) < len(rows) else []) + sorted(values)
    return out


@recorded
def feature_mapping(df: DataFrame, mapping: Mapping[str, Mapping[Any, Any]] | Mapping[str, str]) -> list[Step]:
    """Replaces values by dictionaries (others stay), or columns by SQL expressions."""

    def text(c: str, m: Mapping[Any, Any] | str) -> str:
        if isinstance(m, str):
            return m
        return f"CASE {' '.join(f'WHEN {name(c)} <=> {lit(k)} THEN {lit(v)}' for k, v in m.items())} ELSE {name(c)} END"

    return [Step("with_columns", {c: text(c, m) for c, m in mapping.items()})]


@recorded
def merge_categories(df: DataFrame, merge_what: Mapping[str, Sequence[str]], separator: str = "|") -> list[Step]:
    """The listed categories of each column become one, named by all of them."""
    return [Step("with_columns", {c: f"CASE WHEN {name(c)} IN ({', '.join(map(lit, v))}) THEN {lit(separator.join(v))} ELSE {name(c)} END" for c, v in merge_what.items()})]


@recorded
def merge_infreq_categories(df: DataFrame, cols: Sequence[str], min_count: int = 10, min_frac: float | None = None, separator: str = "|") -> list[Step]:
    """Categories below the minimum become one, named by all of them in order, where there are at least two.

    Any number of them: many are looked up in a table, and only the name they share comes to the driver.
    """
    least = min_count if min_frac is None else min_frac * df.count()
    rare = category_counts(df, cols).where((F.col("n") < least) & F.col("category").isNotNull())
    kept = F.sort_array(F.collect_list("category"))
    found = rare.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) <= NAMED, kept).alias("own"), F.array_join(kept, separator).alias("name")).where("n > 1").collect()
    steps = []
    for r in sorted(found, key=lambda r: list(cols).index(r["feature"])):
        c = r["feature"]
        if r["own"] is not None:
            steps += merge_categories.fit(df, {c: r["own"]}, separator)
        else:
            steps += [lookup_step(rare.where(F.col("feature") == c).select(F.col("category").alias(c), F.lit(True).alias("__hit")), [c], {"__rare": "__hit"}), Step("with_columns", {c: f"CASE WHEN __rare THEN {lit(r['name'])} ELSE {name(c)} END"}), Step("drop", ["__rare"])]
    return steps


def _flags(c: str, values: Sequence[Any], separator: str) -> dict[str, str]:
    return {f"{c}{separator}{v}": f"CAST(COALESCE({name(c)} = {lit(v)}, FALSE) AS TINYINT)" for v in values}


@recorded
def one_hot_encode(df: DataFrame, cols: Sequence[str] | None = None, separator: str = "_", drop_first: bool = False, max_flags: int = MAX_FLAGS) -> list[Step]:
    """A 0/1 column for each category in order; null is 0 everywhere; columns with fewer than two categories are dropped.

    A column with more than ``max_flags`` categories raises instead of making so many columns.
    """
    cols = list(cols or get_string_cols(df))
    found = _categories(df, cols, max_flags)
    new = {k: v for c in cols if len(found[c]) > 1 for k, v in _flags(c, found[c][1 if drop_first else 0 :], separator).items()}
    return [Step("with_columns", new), Step("drop", cols)]


@recorded
def reverse_one_hot_encode(df: DataFrame, root_col_name: str, separator: str = "_") -> list[Step]:
    """The category of the first highest flag; a row without any flag gives null."""
    flags = [c for c in df.columns if c.startswith(root_col_name + separator)]
    top = f"GREATEST({', '.join(map(name, flags))})" if len(flags) > 1 else name(flags[0])
    cases = " ".join(f"WHEN {name(f)} = {top} THEN {lit(f[len(root_col_name + separator) :])}" for f in flags)
    return [Step("with_columns", {root_col_name: f"CASE WHEN {top} = 0 THEN NULL {cases} END"}), Step("drop", flags)]


@recorded
def selective_one_hot_encode(df: DataFrame, selected: Mapping[str, Sequence[Any]], separator: str = "_") -> list[Step]:
    """Flags of the given categories only; nothing is fitted."""
    return [Step("with_columns", {k: v for c, values in selected.items() for k, v in _flags(c, values, separator).items()}), Step("drop", list(selected))]


@recorded
def sum_encode(df: DataFrame, cols: Sequence[str] | None = None, separator: str = "_", max_flags: int = MAX_FLAGS) -> list[Step]:
    """One column for each category but the first: 1 for it, -1 for the first, else 0; null stays null."""
    cols = list(cols or get_string_cols(df))
    new = {}
    for c, values in _categories(df, cols, max_flags).items():
        new |= {f"{c}{separator}{v}": f"CAST(CASE WHEN {name(c)} = {lit(v)} THEN 1 WHEN {name(c)} = {lit(values[0])} THEN -1 WHEN {name(c)} IS NOT NULL THEN 0 END AS TINYINT)" for v in values[1:]}
    return [Step("with_columns", new), Step("drop", cols)]


@recorded
def rank_hot_encode(df: DataFrame, col_ranks: Mapping[str, Sequence[str]]) -> list[Step]:
    """``col>=v`` for each value but the lowest of a ranking; unknown values rank highest, null is null."""
    new = {}
    for c, ranks in col_ranks.items():
        place = f"CASE {' '.join(f'WHEN {name(c)} = {lit(v)} THEN {i}' for i, v in enumerate(ranks))} WHEN {name(c)} IS NOT NULL THEN {len(ranks)} END"
        new |= {f"{c}>={v}": f"CAST(({place}) >= {i} AS TINYINT)" for i, v in enumerate(ranks) if i}
    return [Step("with_columns", new), Step("drop", list(col_ranks))]


@recorded
def force_binary(df: DataFrame, cols: Sequence[str] | None = None) -> list[Step]:
    """Columns of two values become 0 and 1 in order; null, if one of the two, is 0."""
    cols = list(cols or infer_binary(df, include_null=False))
    found = _categories(df, cols, with_null=True)
    return [Step("with_columns", {c: f"CAST(CASE WHEN {name(c)} <=> {lit(v[0])} THEN 0 WHEN {name(c)} <=> {lit(v[1])} THEN 1 END AS TINYINT)" for c, v in found.items() if len(v) == 2})]


@recorded
def multicat_one_hot_encode(df: DataFrame, cols: Sequence[str] | None = None, delimiter: str = "|", drop_first: bool = True, max_flags: int = MAX_FLAGS) -> list[Step]:
    """A 0/1 column for each token of delimited texts; tokens count as a whole."""
    cols = list(cols or get_string_cols(df))
    split = lambda c: f"SPLIT({name(c)}, {lit(re.escape(delimiter))})"
    new = {}
    for c in cols:
        tokens = _categories(df.select(F.explode(F.expr(split(c))).alias("t")), ["t"], max_flags)["t"]
        new |= {f"{c}_{t}": f"CAST(COALESCE(ARRAY_CONTAINS({split(c)}, {lit(t)}), FALSE) AS TINYINT)" for t in tokens[1 if drop_first else 0 :]}
    return [Step("with_columns", new), Step("drop", cols)]


@recorded
def ordinal_auto_encode(df: DataFrame, cols: Sequence[str] | None = None, descending: bool = False, exclude: Sequence[str] = ()) -> list[Step]:
    """The place of each value among the sorted distinct ones; null, if there is one, is the lowest.

    Columns of many values are numbered in ranges and looked up in a table.
    """
    steps = []
    for c in [c for c in (cols or get_string_cols(df)) if c not in set(exclude or ())]:
        values = df.select(F.col(name(c))).distinct()
        head = [r[0] for r in values.limit(KEPT + 1).collect()]
        if len(head) <= KEPT:
            order = sorted((v for v in head if v is not None), reverse=descending)
            order = order + [None] * (None in head) if descending else [None] * (None in head) + order
            table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"{name(c)} {df.schema[c].dataType.simpleString()}, __v int")
        else:
            numbered = row_numbers(values, [c], "__r")
            place = F.lit(numbered.count()) - F.col("__r") if descending else F.col("__r") - 1
            table = numbered.select(name(c), place.cast("int").alias("__v"))
        steps.append(lookup_step(table, [c], {c: "__v"}))
    return steps


@recorded
def ordinal_encode(df: DataFrame, ordinal_mapping: Mapping[str, Mapping[Any, int]], default: int | None = None) -> list[Step]:
    """Numbers by a given mapping; others get the default."""
    return [Step("with_columns", {c: f"CASE {' '.join(f'WHEN {name(c)} <=> {lit(k)} THEN {lit(v)}' for k, v in m.items())} ELSE {lit(default)} END" for c, m in ordinal_mapping.items()})]


def check_binary_target(df: DataFrame, target: str) -> bool:
    """True if the distinct values of the target are 0 and 1."""
    return sorted(r[0] if r[0] is not None else -1 for r in df.select(name(target)).distinct().limit(3).collect()) == [0, 1]


def _need_binary(df: DataFrame, target: str, wanted: bool) -> None:
    if wanted and not check_binary_target(df, target):
        raise ValueError(f"{target} must hold 0 and 1 and nothing else")


def target_counts(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """``feature, value, n, events``: rows and sum of the target per value of each column, unpivoted and grouped once."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(name(c)).cast("string").alias("value")) for c in cols])
    return df.select(F.col(name(target)).cast("double").alias("t"), F.inline(cells)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("events"))


def _per_column(df: DataFrame, table: DataFrame, cols: Sequence[str], default: float | None) -> list[Step]:
    """Lookups of ``feature, value, v`` for each column."""
    return [lookup_step(table.where(F.col("feature") == c).select(F.col("value").cast(df.schema[c].dataType).alias(c), F.col("v").alias("__v")), [c], {c: "__v"}, {c: default}) for c in cols]


def smoothed_target(df: DataFrame, target: str, cols: Sequence[str], min_samples_leaf: int = 20, smoothing: float = 10.0) -> DataFrame:
    """``feature, value, v``: alpha * mean of the value + (1 - alpha) * mean, alpha = 1 / (1 + exp(-(n - k) / f))."""
    p = df.agg(F.avg(F.col(name(target)).cast("double"))).first()[0]
    alpha = F.lit(1.0) / (1.0 + F.exp(-(F.col("n") - float(min_samples_leaf)) / float(smoothing)))
    return target_counts(df, target, cols).select("feature", "value", (alpha * F.col("events") / F.col("n") + (1.0 - alpha) * F.lit(p)).alias("v"))


@recorded
def smooth_target_encode(df: DataFrame, target: str, cols: Sequence[str], min_samples_leaf: int = 20, smoothing: float = 10.0, check_binary: bool = True, default: float | None = None) -> list[Step]:
    """Each value becomes its smoothed mean of the target; null is a value, unseen values get the default."""
    _need_binary(df, target, check_binary)
    return _per_column(df, smoothed_target(df, target, cols, min_samples_leaf, smoothing), cols, default)


def woe_table(df: DataFrame, target: str, cols: Sequence[str], min_count: float = 1.0) -> DataFrame:
    """``feature, value, ev_rate, nonev_rate, woe`` with ``min_count`` added to each count."""
    r = df.agg(F.sum(F.col(name(target)).cast("double")), F.count(F.lit(1))).first()
    events, others = (r[0] or 0.0), r[1] - (r[0] or 0.0)
    m = float(min_count)
    ev, non = (F.col("events") + m) / (events + 2 * m), (F.col("n") - F.col("events") + m) / (others + 2 * m)
    return target_counts(df, target, cols).select("feature", "value", ev.alias("ev_rate"), non.alias("nonev_rate"), flog(fdiv(ev, non)).alias("woe"))


@recorded
def woe_cat_encode(df: DataFrame, target: str, cols: Sequence[str] | None = None, min_count: float = 1.0, check_binary: bool = True, default: float = -10.0) -> list[Step]:
    """Each value becomes its weight of evidence; null is a value, unseen values get the default."""
    _need_binary(df, target, check_binary)
    cols = list(cols or get_string_cols(df))
    return _per_column(df, woe_table(df, target, cols, min_count).select("feature", "value", F.col("woe").alias("v")), cols, default)


def interval_sql(x: str, cuts: Sequence[float]) -> str:
    """SQL text of the right-closed interval ``(a, b]`` that holds x, as text; null for null."""
    cuts = sorted({float(c) for c in cuts})
    edges = [-math.inf, *cuts, math.inf]
    label = lambda a, b: f"({number(a)}, {number(b)}]" if b < math.inf else f"({number(a)}, inf]"
    cases = " ".join(f"WHEN {x} <= {lit(b)} THEN {lit(label(a, b))}" for a, b in zip(edges, cuts))
    last = lit(label(edges[-2], math.inf))
    return f"CASE {cases} WHEN {x} IS NOT NULL THEN {last} END" if cuts else f"CASE WHEN {x} IS NOT NULL THEN {last} END"


@recorded
def custom_binning(df: DataFrame, cols: Sequence[str], cuts: Sequence[float], suffix: str = "") -> list[Step]:
    """The interval of given cuts as text."""
    return [Step("with_columns", {c + suffix: interval_sql(name(c), cuts) for c in cols})]


@recorded
def fixed_sized_binning(df: DataFrame, cols: Sequence[str], interval: float, suffix: str = "", max_bins: int = MAX_FLAGS) -> list[Step]:
    """Intervals of one size from the minimum on, up to the first cut at or above the maximum."""
    r = df.agg(*[a.alias(f"{i}{k}") for i, c in enumerate(cols) for k, a in enumerate((F.min(finite(name(c))), F.max(finite(name(c)))))]).first()
    new = {}
    for i, c in enumerate(cols):
        low, high = r[2 * i], r[2 * i + 1]
        n = 0 if low is None else math.floor((high - low) / interval) + 2
        if n > max_bins:
            raise ValueError(f"{c} needs more than {max_bins} intervals")
        new[c + suffix] = interval_sql(name(c), [low + k * interval for k in range(n)])
    return [Step("with_columns", new)]


@recorded
def quantile_binning(df: DataFrame, cols: Sequence[str], n_bins: int, suffix: str = "", accuracy: int | None = None) -> list[Step]:
    """Intervals between quantiles (exact, or approximate with an accuracy); null stays null."""
    q = column_quantiles(df, cols, [k / n_bins for k in range(1, n_bins)], accuracy)
    return [Step("with_columns", {c + suffix: interval_sql(name(c), q[c] or []) for c in cols})]


def format_categorical_target(df: DataFrame, target: str, max_values: int = MAX_FLAGS) -> tuple[DataFrame, dict[Any, int]]:
    """The sorted distinct values of the target become 0 .. n - 1; returns the frame and the mapping."""
    values = _categories(df, [target], max_values)[target]
    mapping = {v: i for i, v in enumerate(values)}
    return df.withColumn(target, F.expr(f"CASE {' '.join(f'WHEN {name(target)} = {lit(v)} THEN {i}' for v, i in mapping.items())} END")), mapping


@recorded
def sparse_to_dense_target(df: DataFrame, target: str) -> list[Step]:
    """The place (from 0) of the first largest element of an array."""
    return [Step("with_columns", {target: f"ARRAY_POSITION({name(target)}, ARRAY_MAX({name(target)})) - 1"})]


@recorded
def dense_to_sparse_target(df: DataFrame, target: str, max_values: int = MAX_FLAGS) -> list[Step]:
    """A unit vector over the sorted distinct values."""
    values = _categories(df, [target], max_values)[target]
    return [Step("with_columns", {target: f"ARRAY({', '.join(f'CAST({name(target)} = {lit(v)} AS INT)' for v in values)})"})]
