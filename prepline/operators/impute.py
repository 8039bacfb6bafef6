"""Imputation by fitted constants and by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.functions.safe import finite
from prepline.functions.sqltext import lit, name
from prepline.operators.quantiles import column_modes, column_quantiles, group_modes, group_quantiles, same
from prepline.operators.schema import clean_strategy_str, get_numeric_cols
from prepline.plans.steps import Step, lookup_step, recorded


def _statistic(c: str, strategy: str) -> Column:
    """Aggregate that fills a column; NaN and infinities don't take part."""
    x = finite(name(c))
    found = {"mean": F.avg, "avg": F.avg, "max": F.max, "min": F.min}
    if strategy not in found:
        raise ValueError(f"unknown strategy {strategy}")
    return found[strategy](x)


@recorded
def impute(df: DataFrame, cols: Sequence[str], strategy: str = "median", const: float = 1.0) -> list[Step]:
    """Fills nulls with median, mean, mode (of equal ones the smallest) or a constant; all columns in one aggregate.

    A column without values stays null.
    """
    s = clean_strategy_str(strategy)
    if s in ("const", "constant"):
        values = [const] * len(cols)
    else:
        if s == "mode":
            found = column_modes(df, cols)
        elif s == "median":
            found = {c: v and v[0] for c, v in column_quantiles(df, cols, [0.5]).items()}
        else:
            found = dict(zip(cols, df.agg(*[_statistic(c, s).alias(str(i)) for i, c in enumerate(cols)]).first() if cols else []))
        values = [found[c] for c in cols]
    return [Step("with_columns", {c: f"COALESCE({name(c)}, {lit(v)})" for c, v in zip(cols, values) if v is not None})]


@recorded
def impute_nan(df: DataFrame, cols: Sequence[str] | None = None, by: float | None = None) -> list[Step]:
    """NaN and infinities become ``by`` (null by default)."""
    bad = lambda c: f"ISNAN({name(c)}) OR ABS({name(c)}) = DOUBLE('Infinity')"
    return [Step("with_columns", {c: f"CASE WHEN {bad(c)} THEN {lit(by)} ELSE {name(c)} END" for c in (cols or get_numeric_cols(df))})]


@recorded
def hot_deck_impute(df: DataFrame, cols: Sequence[str], group_by: Sequence[str], strategy: str = "mean") -> list[Step]:
    """Fills nulls with a statistic (mean, median, max, min, mode) of the group; null is a group.

    Groups without values, and groups that weren't there when it was fitted, stay null.
    """
    if set(cols) & set(group_by):
        raise ValueError("a column can't be filled by itself")
    s = clean_strategy_str(strategy)
    if s in ("median", "mode"):  # by counts of values, as a group may hold any share of the rows
        table = df.select(*map(name, group_by)).distinct()
        for i, c in enumerate(cols):
            own = group_quantiles(df, group_by, [0.5], c).withColumnRenamed("q0", f"s{i}") if s == "median" else group_modes(df, group_by, F.col(name(c))).withColumnRenamed("mode", f"s{i}")
            table = table.alias("a").join(own.alias("b"), same("a", "b", group_by), "left").select("a.*", f"s{i}")
    else:
        table = df.groupBy(*[name(g) for g in group_by]).agg(*[_statistic(c, s).alias(f"s{i}") for i, c in enumerate(cols)])
    new = {f"__fill{i}": f"s{i}" for i in range(len(cols))}
    fill = {c: f"COALESCE({name(c)}, __fill{i})" for i, c in enumerate(cols)}
    return [lookup_step(table, list(group_by), new), Step("with_columns", fill), Step("drop", list(new))]


@recorded
def missing_indicator(df: DataFrame, cols: Sequence[str] | None = None, include_nan: bool = False, suffix: str = "_missing") -> list[Step]:
    """1 for null (and, if wanted, NaN and infinities of numeric columns), else 0."""
    numbers = set(get_numeric_cols(df))
    bad = lambda c: f" OR COALESCE(ISNAN({name(c)}) OR ABS({name(c)}) = DOUBLE('Infinity'), FALSE)" if include_nan and c in numbers else ""
    return [Step("with_columns", {c + suffix: f"CAST({name(c)} IS NULL{bad(c)} AS TINYINT)" for c in (cols or df.columns)})]
