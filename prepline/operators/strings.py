"""Features of text, JSON, list and date columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepline.functions.sqltext import lit, name
from prepline.operators.schema import get_string_cols
from prepline.plans.steps import Step, recorded

NUMBER = r"\d*\.?\d+"


@recorded
def replace_by_pattern(df: DataFrame, c: str, pattern: str, by: str) -> list[Step]:
    """Replaces the first match only; ``by`` is plain text."""
    plain = by.replace("\\", "\\\\").replace("$", "\\$")
    return [Step("with_columns", {c: f"REGEXP_REPLACE({name(c)}, {lit('(?s)^(.*?)(?:' + pattern + ')')}, {lit('$1' + plain)}, 1)" if not pattern.startswith("^") else f"REGEXP_REPLACE({name(c)}, {lit(pattern)}, {lit(plain)})"})]


@recorded
def extract_word_count(df: DataFrame, cols: Sequence[str], words: Sequence[str], lower: bool = True) -> list[Step]:
    """Occurrences of each pattern, in lower-case text if wanted, as ``<col>_count_<word>``."""
    x = lambda c: f"LOWER({name(c)})" if lower else name(c)
    return [Step("with_columns", {f"{c}_count_{w}": f"REGEXP_COUNT({x(c)}, {lit(w)})" for c in cols for w in words})]


@recorded
def extract_from_str(df: DataFrame, cols: Sequence[str], extract: str | Sequence[str], pattern: str | None = None) -> list[Step]:
    """len (bytes), starts_with, ends_with (plain text), count, contains (pattern), as ``<col>_<what>``."""
    new = {}
    for e in [extract] if isinstance(extract, str) else extract:
        if e != "len" and pattern is None:
            raise ValueError(f"{e} needs a pattern")
        text = {"len": "OCTET_LENGTH({0})", "starts_with": "STARTSWITH({0}, {1})", "ends_with": "ENDSWITH({0}, {1})", "count": "REGEXP_COUNT({0}, {1})", "contains": "{0} RLIKE {1}"}.get(e)
        if text is None:
            raise ValueError(f"unknown feature {e}")
        for c in cols:
            new[f"{c}_{e}"] = text.replace("{0}", name(c)).replace("{1}", lit(pattern))
    return [Step("with_columns", new)]


def _plain(c: str, ignore_comma: bool) -> str:
    return f"REPLACE({name(c)}, ',', '')" if ignore_comma else name(c)


@recorded
def extract_numbers(df: DataFrame, cols: Sequence[str] | None = None, ignore_comma: bool = False, join_by: str = "", dtype: str = "string") -> list[Step]:
    """All numbers of a text: as a list of texts, joined, or as a list of another type."""
    new = {}
    for c in cols or get_string_cols(df):
        found = f"REGEXP_EXTRACT_ALL({_plain(c, ignore_comma)}, {lit(NUMBER)}, 0)"
        new[c] = f"TRANSFORM({found}, x -> TRY_CAST(x AS {dtype}))" if dtype != "string" else f"ARRAY_JOIN({found}, {lit(join_by)})" if join_by else found
    return [Step("with_columns", new)]


@recorded
def extract_first_number(df: DataFrame, cols: Sequence[str] | None = None, ignore_comma: bool = True, dtype: str = "double", default: float | None = None) -> list[Step]:
    new = {c: f"COALESCE(TRY_CAST(REGEXP_SUBSTR({_plain(c, ignore_comma)}, {lit(NUMBER)}) AS {dtype}), {lit(default)})" for c in cols or get_string_cols(df)}
    return [Step("with_columns", new)]


@recorded
def extract_patterns(df: DataFrame, pattern: str, cols: Sequence[str], lowercase: bool = False, join_by: str = "") -> list[Step]:
    """All whole matches, as a list or joined."""
    x = lambda c: f"LOWER({name(c)})" if lowercase else name(c)
    found = lambda c: f"REGEXP_EXTRACT_ALL({x(c)}, {lit(pattern)}, 0)"
    return [Step("with_columns", {c: f"ARRAY_JOIN({found(c)}, {lit(join_by)})" if join_by else found(c) for c in cols})]


@recorded
def combine_str_cols(df: DataFrame, cols: Sequence[str], new_name: str, to_null: Sequence[str] | None = None, ignore_null: bool = True, empty_as_null: bool = True, separator: str = "") -> list[Step]:
    """Texts of a row as a list or, with a separator, joined.

    Values in ``to_null`` become null; ``ignore_null`` leaves nulls and repetitions out; what is then empty is
    null unless ``empty_as_null`` is false.
    """
    item = lambda c: f"CASE WHEN {name(c)} NOT IN ({', '.join(map(lit, to_null))}) THEN {name(c)} END" if to_null else name(c)
    found = f"ARRAY({', '.join(f'CAST({item(c)} AS STRING)' for c in cols)})"
    if ignore_null:
        found = f"ARRAY_EXCEPT({found}, ARRAY(CAST(NULL AS STRING)))"
    joined = f"ARRAY_JOIN({found}, {lit(separator)})" if separator else found
    if empty_as_null:
        joined = f"NULLIF({joined}, '')" if separator else f"CASE WHEN SIZE({found}) > 0 THEN {found} END"
    return [Step("with_columns", {new_name: joined})]


@recorded
def extract_from_json(df: DataFrame, json_col: str, paths: Sequence[str], dtypes: Sequence[str]) -> list[Step]:
    """``$.path`` of JSON text as ``<col>.<path>``; what is missing, invalid or can't be cast is null."""
    if len(paths) != len(dtypes):
        raise ValueError("there must be one type for each path")
    return [Step("with_columns", {f"{json_col}.{p}": f"TRY_CAST(GET_JSON_OBJECT({name(json_col)}, {lit('$.' + p)}) AS {t})" for p, t in zip(paths, dtypes)})]


@recorded
def str_col_to_list(df: DataFrame, cols: Sequence[str], inner: str = "string") -> list[Step]:
    """A text such as ``[1,2]`` as a list; invalid text is null."""
    return [Step("with_columns", {c: f"FROM_JSON({name(c)}, {lit(f'array<{inner}>')})" for c in cols})]


@recorded
def extract_list_features(df: DataFrame, cols: Sequence[str], extract: Sequence[str] = ("min", "max")) -> list[Step]:
    """min, max, mean, len, first, last, sum of lists, as ``<col>_<what>``; of an empty list null (len 0, sum 0)."""
    total = "AGGREGATE({0}, 0D, (s, x) -> s + COALESCE(CAST(x AS DOUBLE), 0D))"
    known = "SIZE(FILTER({0}, x -> x IS NOT NULL))"
    ops = {
        "min": "ARRAY_MIN({0})", "max": "ARRAY_MAX({0})", "len": "CASE WHEN {0} IS NOT NULL THEN SIZE({0}) END", "first": "GET({0}, 0)", "last": "GET({0}, SIZE({0}) - 1)",
        "sum": f"CASE WHEN {{0}} IS NOT NULL THEN {total} END", "mean": f"CASE WHEN {known} > 0 THEN {total} / {known} END",
    }
    return [Step("with_columns", {f"{c}_{e}": ops[e].replace("{0}", name(c)) for c in cols for e in ([extract] if isinstance(extract, str) else extract)})]


@recorded
def extract_dt_features(df: DataFrame, cols: Sequence[str], extract: Sequence[str] = ("year", "quarter", "month"), sunday_first: bool = False) -> list[Step]:
    """year, quarter, month, week (ISO), day_of_week (Monday 1, or Sunday 1), day_of_year, as ``<col>_<what>``."""
    ops = {
        "year": "YEAR({0})", "quarter": "QUARTER({0})", "month": "MONTH({0})", "week": "WEEKOFYEAR({0})",
        "day_of_week": "DAYOFWEEK({0})" if sunday_first else "WEEKDAY({0}) + 1", "day_of_year": "DAYOFYEAR({0})",
    }
    return [Step("with_columns", {f"{c}_{e}": ops[e].replace("{0}", name(c)) for c in cols for e in ([extract] if isinstance(extract, str) else extract)})]


def time_buckets(time_col: str, interval: str) -> dict[str, str]:
    """SQL text of the columns that name a row's bucket: yearly, quarterly, monthly or weekly."""
    x = name(time_col)
    parts = {"yearly": [], "quarterly": [("quarter", f"QUARTER({x})")], "monthly": [("month", f"MONTH({x})")], "weekly": [("week", f"WEEKOFYEAR({x})")]}
    if interval not in parts:
        raise ValueError(f"unknown interval {interval}")
    year = f"YEAR({x})" if interval != "weekly" else f"YEAR(DATE_ADD({x}, 3 - WEEKDAY({x})))"
    return {"year": year} | dict(parts[interval])


def moving_avgs(df: DataFrame, cols: Sequence[str], window_sizes: Sequence[int], order_by: Sequence[str], partition_by: Sequence[str] = (), min_periods: int | None = None) -> DataFrame:
    """Trailing means ``<col>_ma_<w>`` of w rows in an explicit order; null until there are min_periods values.

    Without ``partition_by`` all rows pass through one task.
    """
    w = Window.partitionBy(*map(name, partition_by)).orderBy(*map(name, order_by))
    new = {}
    for c in cols:
        for n in window_sizes:
            if n > 1:
                part = w.rowsBetween(-(n - 1), 0)
                new[f"{c}_ma_{n}"] = F.when(F.count(name(c)).over(part) >= (min_periods or n), F.avg(name(c)).over(part))
    return df.withColumns(new)


def as_percentages(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """The change against the last value that isn't null, in an explicit order; null for null and for the first."""
    w = Window.partitionBy(*map(name, partition_by)).orderBy(*map(name, order_by)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({c: F.try_divide(F.col(name(c)).cast("double"), F.last(name(c), True).over(w)) - 1 for c in cols})
