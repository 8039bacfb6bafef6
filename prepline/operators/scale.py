"""Scaling and numeric transforms."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.functions.safe import finite, ratio_sql
from prepline.functions.sqltext import lit, name
from prepline.operators.quantiles import column_quantiles, group_quantiles
from prepline.operators.schema import clean_strategy_str
from prepline.plans.steps import Step, lookup_step, recorded


def _fitted(strategy: str, ddof: int, c: str) -> list:
    """Aggregates (center, width) of a strategy that needs no quantiles."""
    x = finite(name(c))
    zero = F.lit(0.0)
    found = {
        "standard": lambda: [F.avg(x), F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x)],
        "min_max": lambda: [F.min(x), F.max(x) - F.min(x)],
        "max_abs": lambda: [zero, F.greatest(F.abs(F.max(x)), F.abs(F.min(x)))],
        "abs_max": lambda: [zero, F.greatest(F.abs(F.max(x)), F.abs(F.min(x)))],
        "mean": lambda: [zero, F.avg(x)],
        "max": lambda: [zero, F.max(x)],
    }
    if strategy not in found:
        raise ValueError(f"unknown strategy {strategy}")
    return found[strategy]()


@recorded
def scale(df: DataFrame, cols: Sequence[str], strategy: str = "standard", const: float = 1.0, qcuts: Sequence[float] = (0.25, 0.5, 0.75)) -> list[Step]:
    """(x - center) / width: standard (population deviation), min_max, robust (quantiles), max_abs, or x / const.

    All columns are fitted in one aggregate; a width of 0 gives null.
    """
    s = clean_strategy_str(strategy)
    if s in ("const", "constant"):
        return [Step("with_columns", {c: ratio_sql(name(c), lit(float(const))) for c in cols})]
    if s in ("robust", "median"):
        q = column_quantiles(df, cols, qcuts if s == "robust" else [0.5])
        r = [v for c in cols for v in ((None, None) if not q[c] else (q[c][1], q[c][2] - q[c][0]) if s == "robust" else (0.0, q[c][0]))]
    else:
        r = df.agg(*[a.alias(f"{i}{k}") for i, c in enumerate(cols) for k, a in enumerate(_fitted(s, 0, c))]).first() if cols else []
    return [Step("with_columns", {c: ratio_sql(f"({name(c)} - {lit(r[2 * i])})", lit(r[2 * i + 1])) for i, c in enumerate(cols)})]


@recorded
def scale_by(df: DataFrame, c: str, by: Sequence[str] | str, strategy: str = "standard", qcuts: Sequence[float] = (0.25, 0.5, 0.75)) -> list[Step]:
    """Scales a column inside each segment (standard with the sample deviation); unknown segments give null."""
    keys = [by] if isinstance(by, str) else list(by)
    s = clean_strategy_str(strategy)
    if s in ("robust", "median"):  # by sorted counts, as a segment may hold any share of the rows
        q = group_quantiles(df, keys, qcuts if s == "robust" else [0.5], c)
        table = q.select(*map(name, keys), *([F.col("q1").alias("a"), (F.col("q2") - F.col("q0")).alias("b")] if s == "robust" else [F.lit(0.0).alias("a"), F.col("q0").alias("b")]))
    else:
        center, width = _fitted(s, 1, c)
        table = df.groupBy(*[name(k) for k in keys]).agg(center.alias("a"), width.alias("b"))
    return [lookup_step(table, keys, {"__center": "a", "__width": "b"}), Step("with_columns", {c: ratio_sql(f"({name(c)} - __center)", "__width")}), Step("drop", ["__center", "__width"])]


@recorded
def normalize(df: DataFrame, cols: Sequence[str]) -> list[Step]:
    """x / sum of x."""
    r = df.agg(*[F.sum(finite(name(c))).alias(str(i)) for i, c in enumerate(cols)]).first() if cols else []
    return [Step("with_columns", {c: ratio_sql(name(c), lit(r[i])) for i, c in enumerate(cols)})]


@recorded
def z_normalize(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> list[Step]:
    """(x - mean) / deviation."""
    dev = F.stddev_samp if ddof == 1 else F.stddev_pop
    r = df.agg(*[a.alias(f"{i}{k}") for i, c in enumerate(cols) for k, a in enumerate((F.avg(finite(name(c))), dev(finite(name(c)))))]).first()
    return [Step("with_columns", {c: ratio_sql(f"({name(c)} - {lit(r[2 * i])})", lit(r[2 * i + 1])) for i, c in enumerate(cols)})]


@recorded
def clip(df: DataFrame, cols: Sequence[str], min_clip: float | None = None, max_clip: float | None = None) -> list[Step]:
    """Clips from one or both sides; null stays null."""
    if min_clip is None and max_clip is None:
        raise ValueError("clip needs a lower or an upper bound")
    x = lambda c: name(c) if min_clip is None else f"GREATEST({name(c)}, {lit(min_clip)})"
    y = lambda c: x(c) if max_clip is None else f"LEAST({x(c)}, {lit(max_clip)})"
    return [Step("with_columns", {c: f"CASE WHEN {name(c)} IS NOT NULL THEN {y(c)} END" for c in cols})]


@recorded
def log_transform(df: DataFrame, cols: Sequence[str], base: float = math.e, plus_one: bool = False, suffix: str = "_log") -> list[Step]:
    """Logarithm to a base, or of 1 + x; of 0 minus infinity, of negative numbers NaN."""

    def text(c: str) -> str:
        x = f"CAST({name(c)} + 1 AS DOUBLE)" if plus_one else f"CAST({name(c)} AS DOUBLE)"
        value = f"LN({x})" if plus_one or base == math.e else f"LN({x}) / {lit(math.log(base))}"
        return f"CASE WHEN {x} > 0 THEN {value} WHEN {x} = 0 THEN {lit(-math.inf)} WHEN {x} < 0 THEN {lit(math.nan)} END"

    return [Step("with_columns", {c + suffix: text(c) for c in cols})]


@recorded
def sqrt_transform(df: DataFrame, cols: Sequence[str], suffix: str = "_sqrt") -> list[Step]:
    return [Step("with_columns", {c + suffix: f"SQRT({name(c)})" for c in cols})]


@recorded
def cbrt_transform(df: DataFrame, cols: Sequence[str], suffix: str = "_cbrt") -> list[Step]:
    return [Step("with_columns", {c + suffix: f"CBRT({name(c)})" for c in cols})]


@recorded
def linear_transform(df: DataFrame, cols: Sequence[str], coeffs: float | Sequence[float] = 1.0, consts: float | Sequence[float] = 0.0, suffix: str = "") -> list[Step]:
    """coefficient * x + constant, the same or one for each column."""
    a, b = ([float(v)] * len(cols) if isinstance(v, (int, float)) else [float(x) for x in v] for v in (coeffs, consts))
    if not len(a) == len(b) == len(cols):
        raise ValueError("there must be one coefficient and one constant for each column")
    return [Step("with_columns", {c + suffix: f"{lit(x)} * {name(c)} + {lit(y)}" for c, x, y in zip(cols, a, b)})]


@recorded
def sine_cosine_transform(df: DataFrame, sin_cols: Sequence[str] = (), cos_cols: Sequence[str] = (), sin_amplitude: float = 1.0, cos_amplitude: float = 1.0, sin_period: float = 1.0, cos_period: float = 1.0) -> list[Step]:
    """amplitude * sin(2 pi / period * x), and the same with cos, as new columns ``_sin`` and ``_cos``."""
    out = {f"{c}_sin": f"{lit(float(sin_amplitude))} * SIN({lit(2 * math.pi / sin_period)} * {name(c)})" for c in sin_cols or ()}
    return [Step("with_columns", out | {f"{c}_cos": f"{lit(float(cos_amplitude))} * COS({lit(2 * math.pi / cos_period)} * {name(c)})" for c in cos_cols or ()})]


def _power_sql(x: str, lam: float, strategy: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    if strategy == "box_cox":
        return f"CASE WHEN {x} > 0 THEN " + (f"LN({x})" if abs(lam) < 1e-12 else f"(POWER({x}, {lit(lam)}) - 1) / {lit(lam)}") + " END"
    up = f"LN({x} + 1)" if abs(lam) < 1e-12 else f"(POWER({x} + 1, {lit(lam)}) - 1) / {lit(lam)}"
    down = f"-LN(1 - {x})" if abs(lam - 2) < 1e-12 else f"-(POWER(1 - {x}, {lit(2 - lam)}) - 1) / {lit(2 - lam)}"
    return f"CASE WHEN {x} >= 0 THEN {up} WHEN {x} < 0 THEN {down} END"


@recorded
def power_transform(df: DataFrame, cols: Sequence[str], strategy: str = "yeo_johnson", low: float = -4.0, high: float = 4.0, rounds: int = 5, grid: int = 17) -> list[Step]:
    """Yeo-Johnson or Box-Cox with the exponent of highest likelihood for each column.

    The exponent is searched on a grid that narrows round by round; a round is one aggregate for all columns and
    candidates.
    """
    s = clean_strategy_str(strategy)
    if s not in ("yeo_johnson", "box_cox"):
        raise ValueError(f"unknown strategy {strategy}")
    span = {c: (low, high) for c in cols}
    best: dict[str, float] = {}
    for _ in range(rounds):
        grids = {c: np.linspace(*span[c], grid) for c in cols}
        aggs = []
        for i, c in enumerate(cols):
            x = finite(name(c))
            x = F.when(x > 0, x) if s == "box_cox" else x
            logs = F.log(x) if s == "box_cox" else F.signum(x) * F.log(F.abs(x) + 1)
            aggs += [F.count(x).alias(f"n{i}"), F.sum(logs).alias(f"l{i}"), *[F.var_pop(finite(F.expr(_power_sql(name(c), float(v), s)))).alias(f"v{i}_{j}") for j, v in enumerate(grids[c])]]
        r = df.agg(*aggs).first() if cols else None
        for i, c in enumerate(cols):
            score = [-math.inf if not r[f"v{i}_{j}"] else -r[f"n{i}"] / 2 * math.log(r[f"v{i}_{j}"]) + (v - 1) * r[f"l{i}"] for j, v in enumerate(grids[c])]
            k = int(np.argmax(score))
            best[c] = float(grids[c][k])
            step = grids[c][1] - grids[c][0]
            span[c] = (best[c] - step, best[c] + step)
    return [Step("with_columns", {c: _power_sql(name(c), best[c], s) for c in cols})]


@recorded
def binarize(df: DataFrame, rules: Mapping[str, str]) -> list[Step]:
    """For each column a condition in SQL: 1 where it holds, 0 where not, null where unknown."""
    return [Step("with_columns", {c: f"CAST(({r}) AS TINYINT)" for c, r in rules.items()})]


@recorded
def combine_zero_ones(df: DataFrame, cols: Sequence[str], new_name: str, rule: str = "union") -> list[Step]:
    """union: any is 1, intersection: all are 1, same: all are equal; the columns are dropped."""
    text = ", ".join(map(name, cols))
    total = " + ".join(f"CAST({name(c)} AS INT)" for c in cols)
    rules = {"union": f"CAST(GREATEST({text}) AS TINYINT)", "intersection": f"CAST(LEAST({text}) AS TINYINT)", "same": f"CAST(({total}) IN (0, {len(cols)}) AS TINYINT)"}
    if rule not in rules:
        raise ValueError(f"unknown rule {rule}")
    return [Step("with_columns", {new_name: rules[rule] if len(cols) > 1 else f"CAST({text} AS TINYINT)"}), Step("drop", [c for c in cols if c != new_name])]


@recorded
def extract_horizontally(df: DataFrame, cols: Sequence[str], extract: Sequence[str] = ("min", "max")) -> list[Step]:
    """Row-wise min, max, sum (nulls are 0), any, all, as ``op(a,b,c)``."""
    listed = ", ".join(map(name, cols))
    ops = {
        "min": f"LEAST({listed})", "max": f"GREATEST({listed})", "sum": " + ".join(f"COALESCE({name(c)}, 0)" for c in cols),
        "any": " OR ".join(map(name, cols)), "all": " AND ".join(map(name, cols)),
    }
    return [Step("with_columns", {f"{e}({','.join(cols)})": ops[e] for e in ([extract] if isinstance(extract, str) else extract)})]


@recorded
def add_dummy(df: DataFrame, id_col: str, dummy_col_name: str = "_dummy", period: int = 7, seed: int = 42) -> list[Step]:
    """A meaningless category: the hash of the id modulo ``period``."""
    return [Step("with_columns", {dummy_col_name: f"PMOD(XXHASH64({seed}, {name(id_col)}), {period})"})]

