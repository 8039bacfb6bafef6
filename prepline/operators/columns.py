"""Projections, renames, filters and drops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepline.functions.sqltext import lit, name
from prepline.operators import infer
from prepline.operators.schema import get_bool_cols, get_cols_regex, get_numeric_cols
from prepline.plans.steps import Step, recorded


@recorded
def rename(df: DataFrame, rename_dict: Mapping[str, str]) -> list[Step]:
    """Renames columns; unknown names are ignored."""
    return [Step("rename", {k: v for k, v in rename_dict.items() if k in df.columns})]


@recorded
def lowercase(df: DataFrame) -> list[Step]:
    return [Step("rename", {c: c.lower() for c in df.columns})]


@recorded
def custom_transform(df: DataFrame, exprs: Mapping[str, str]) -> list[Step]:
    """Adds columns given as SQL text."""
    return [Step("with_columns", dict(exprs))]


@recorded
def coalesce(df: DataFrame, exprs: Sequence[str], new_col_name: str) -> list[Step]:
    return [Step("with_columns", {new_col_name: f"COALESCE({', '.join(exprs)})"})]


@recorded
def cast_dtype(df: DataFrame, cols: Sequence[str], dtype: str) -> list[Step]:
    """Casts columns; what can't be cast becomes null."""
    return [Step("with_columns", {c: f"TRY_CAST({name(c)} AS {dtype})" for c in cols})]


@recorded
def shrink_dtype(df: DataFrame, cols: Sequence[str] | None = None) -> list[Step]:
    """The smallest type that holds all values: integers by their range, doubles to float if nothing is lost."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols or get_numeric_cols(df)) if not isinstance(types[c], T.DecimalType)]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(name(c))
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")] if isinstance(types[c], T.IntegralType) else [F.max(x.cast("float").cast("double") != x.cast("double")).alias(f"a{i}"), F.lit(0).alias(f"b{i}")]
    if not cols:
        return []
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        low, high = r[f"a{i}"], r[f"b{i}"]
        if isinstance(types[c], T.IntegralType):
            bits = next(b for b in (8, 16, 32, 64) if low is None or (-(2 ** (b - 1)) <= low and high < 2 ** (b - 1)))
            out[c] = f"CAST({name(c)} AS {({8: 'TINYINT', 16: 'SMALLINT', 32: 'INT', 64: 'BIGINT'})[bits]})"
        elif not low:
            out[c] = f"CAST({name(c)} AS FLOAT)"
    return [Step("with_columns", out)]


@recorded
def id_passthrough(df: DataFrame, col: str, suffix: str = "_id_passthrough") -> list[Step]:
    return [Step("with_columns", {col + suffix: name(col)})]


@recorded
def linear_passthrough(df: DataFrame, col: str, coeff: float = 1.0, const: float = 0.0, suffix: str = "_linear") -> list[Step]:
    return [Step("with_columns", {col + suffix: f"{lit(float(coeff))} * {name(col)} + {lit(float(const))}"})]


@recorded
def logistic_passthrough(df: DataFrame, col: str, coeff: float = 1.0, const: float = 0.0, k: float = 1.0, suffix: str = "_logistic") -> list[Step]:
    return [Step("with_columns", {col + suffix: f"1D / (1D + EXP(-{lit(float(k))} * ({lit(float(coeff))} * {name(col)} + {lit(float(const))})))"})]


@recorded
def filter(df: DataFrame, condition: str) -> list[Step]:  # noqa: A001
    return [Step("filter", condition)]


@recorded
def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> list[Step]:
    """Drops rows with a null in any of the columns."""
    return [Step("filter", " AND ".join(f"{name(c)} IS NOT NULL" for c in (subset or df.columns)))]


def _drop(cols: Sequence[str]) -> list[Step]:
    return [Step("drop", list(cols))]


@recorded
def drop_non_numeric(df: DataFrame, include_bools: bool = False) -> list[Step]:
    """Drops columns that aren't numbers; booleans too only if ``include_bools``."""
    keep = set(get_numeric_cols(df)) | (set() if include_bools else set(get_bool_cols(df)))
    return _drop([c for c in df.columns if c not in keep])


@recorded
def drop_by_pattern(df: DataFrame, pattern: str, threshold: float = 0.9, count_null: bool = False, **sampling) -> list[Step]:
    return _drop(infer.infer_by_pattern(df, pattern, threshold=threshold, count_null=count_null, **sampling))


@recorded
def drop_emails(df: DataFrame, email_pattern: str = r"\S+@\S+\.\S+") -> list[Step]:
    return _drop(infer.infer_by_pattern(df, email_pattern))


@recorded
def drop_date_cols(df: DataFrame) -> list[Step]:
    return _drop(infer.infer_dates(df))


@recorded
def drop_invalid_numeric(df: DataFrame, threshold: float = 0.5, include_null: bool = False) -> list[Step]:
    return _drop(infer.infer_invalid_numeric(df, threshold, include_null))


@recorded
def drop_highly_null(df: DataFrame, threshold: float = 0.5) -> list[Step]:
    return _drop(infer.infer_nulls(df, threshold))


@recorded
def drop_by_var(df: DataFrame, threshold: float, target: str | None = None) -> list[Step]:
    return _drop([c for c in infer.infer_by_var(df, threshold) if c != target])


@recorded
def drop_by_regex(df: DataFrame, pattern: str, lowercase: bool = False) -> list[Step]:
    return _drop(get_cols_regex(df, pattern, lowercase))


@recorded
def drop_highly_unique(df: DataFrame, threshold: float = 0.9) -> list[Step]:
    return _drop(infer.infer_highly_unique(df, threshold))


@recorded
def drop_constants(df: DataFrame, include_null: bool = True) -> list[Step]:
    return _drop(infer.infer_constants(df, include_null))


@recorded
def drop_if_exists(df: DataFrame, cols: Sequence[str]) -> list[Step]:
    return _drop([c for c in cols if c in df.columns])


@recorded
def order_by(df: DataFrame, by: Sequence[str], descending: bool = False, nulls_last: bool = False) -> list[Step]:
    """Sorts; nulls come first in either direction unless ``nulls_last``."""
    by = [by] if isinstance(by, str) else by
    return [Step("sort", [[c, descending, nulls_last] for c in by])]
