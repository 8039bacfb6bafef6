"""Columns found by what they hold. Every function runs one aggregate over the columns it asks about."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.functions.safe import is_invalid, safe_corr
from prepline.functions.sqltext import name
from prepline.operators.schema import get_datetime_cols, get_numeric_cols, get_string_cols, kinds


def shares(df: DataFrame, cols: Sequence[str], cond: Callable[[Column], Column]) -> dict[str, float]:
    """For each column the share of rows for which the condition is true; 0 in an empty table."""
    if not cols:
        return {}
    r = df.agg(*[F.coalesce(F.avg(F.coalesce(cond(F.col(name(c))), F.lit(False)).cast("double")), F.lit(0.0)).alias(str(i)) for i, c in enumerate(cols)]).first()
    return {c: r[i] for i, c in enumerate(cols)}


def infer_nulls(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """Columns with a share of nulls of at least the threshold."""
    return [c for c, s in shares(df, df.columns, lambda x: x.isNull()).items() if s >= threshold]


def infer_invalid_numeric(df: DataFrame, threshold: float = 0.5, include_null: bool = False) -> list[str]:
    """Numeric columns with a share of NaN and infinities (and nulls) of at least the threshold."""
    return [c for c, s in shares(df, get_numeric_cols(df), lambda x: is_invalid(x) | (x.isNull() if include_null else F.lit(False))).items() if s >= threshold]


def infer_nan(df: DataFrame) -> list[str]:
    """Numeric columns with any NaN or infinity."""
    return [c for c, s in shares(df, get_numeric_cols(df), is_invalid).items() if s > 0]


def infer_by_var(df: DataFrame, threshold: float) -> list[str]:
    """Numeric columns with a sample variance below the threshold; those without a variance don't count."""
    cols = get_numeric_cols(df)
    if not cols:
        return []
    r = df.agg(*[F.var_samp(name(c)).alias(str(i)) for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if r[i] is not None and r[i] < threshold]


#: Columns up to which all pairs are aggregates of one plan; of more, tasks add up matrices.
FEW_COLUMNS = 8
#: Rows looked at for a value near which the sums of a column are made.
SHIFT_ROWS = 1000
#: Share of the sum of squares below which a variance is rounding error.
NO_VARIANCE = 1e-12


def number_matrix(columns: Sequence[pa.Array]) -> np.ndarray:
    """Rows by columns; null is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in columns])


def as_numbers(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Columns as doubles; what is one already is no expression, so that a wide frame is read column by column."""
    kinds_ = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [F.col(name(c)) if kinds_[c] == "double" else F.col(name(c)).cast("double").alias(c) for c in cols]


def middle_values(numbers: DataFrame) -> np.ndarray:
    """A value of each column from its first rows; sums of differences from it lose fewer digits, and of a constant none."""
    first = numbers.limit(SHIFT_ROWS).toPandas().to_numpy(float)
    middle = lambda v: np.sort(v)[len(v) // 2] if len(v) else 0.0
    return np.array([middle(v[np.isfinite(v)]) for v in first.T])


def _co_sums(shift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per pair of columns: the sums of the task over rows that have both, with columns moved by ``shift``."""
        d = len(shift)
        n, x, xx, xy = (np.zeros((d, d)) for _ in range(4))  # [i, j]: rows with both, sums of i, of i * i and of i * j
        for b in batches:
            z = number_matrix(b.columns) - shift
            known = np.isfinite(z)
            if known.all():
                n += len(z)
                x += z.sum(0)[:, None]
                xx += np.einsum("ij,ij->j", z, z)[:, None]
            else:
                z[~known] = 0.0
                m = known.astype(float)
                n += m.T @ m
                x += z.T @ m
                xx += (z * z).T @ m
            xy += z.T @ z
        i, j = np.triu_indices(d, 1)
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000], j[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"i": p.astype(np.int32), "j": q.astype(np.int32), "n": n[p, q], "x": x[p, q], "y": x[q, p], "xx": xx[p, q], "yy": xx[q, p], "xy": xy[p, q]})

    return run


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlations of all pairs of columns over the rows where both are finite; NaN with a constant column.

    Each task adds up matrices of its rows and emits one row per pair, so the cost of the plan doesn't grow with the
    pairs; there are no more tasks than cores, and only the correlations come to the driver. A few columns are one
    aggregate in generated code instead.
    """
    d = len(cols)
    out = np.full((d, d), np.nan)
    at = [(i, j) for i in range(d) for j in range(i + 1, d)]
    if not at:
        return out
    if d <= FEW_COLUMNS:
        r = df.agg(*[safe_corr(name(cols[i]), name(cols[j])).alias(str(k)) for k, (i, j) in enumerate(at)]).first()
        for (i, j), v in zip(at, r):
            out[i, j] = out[j, i] = np.nan if v is None else v
        return out
    numbers = df.select(*as_numbers(df, cols))
    shift = middle_values(numbers)
    tasks = df.sparkSession.sparkContext.defaultParallelism
    sums = numbers.coalesce(tasks).mapInArrow(_co_sums(shift), "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    pairs = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).where("n > 0")
    spread = lambda s, q: F.when(F.col(q) - F.col(s) * F.col(s) / F.col("n") > NO_VARIANCE * F.col(q), F.col(q) - F.col(s) * F.col(s) / F.col("n"))
    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread("x", "xx") * spread("y", "yy"))
    found = pairs.select("i", "j", r.alias("r")).where("r is not null").toPandas()
    out[found["i"], found["j"]] = out[found["j"], found["i"]] = found["r"].clip(-1.0, 1.0)
    return out


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float]:
    """Pearson correlations of all pairs in one pass; NaN with a constant column."""
    m = correlation_matrix(df, cols)
    return {(a, b): float(m[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j}


def infer_highly_correlated(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``features``, and its partners with a correlation above and below the threshold; rows without any are left out."""
    cols = get_numeric_cols(df)
    found = correlation_pairs(df, cols)
    high: dict[str, list[str]] = {c: [] for c in cols}
    low: dict[str, list[str]] = {c: [] for c in cols}
    for (a, b), r in found.items():
        for x, y in ((a, b), (b, a)):
            if r > threshold:
                high[x].append(y)
            elif r < -threshold:
                low[x].append(y)
    rows = [(c, high[c], low[c]) for c in cols if high[c] or low[c]]
    return df.sparkSession.createDataFrame(rows, f"features string, `corr > {threshold:.2f}` array<string>, `corr < -{threshold:.2f}` array<string>")


def unique_counts(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, tuple[int, int]]]:
    """Rows, and for each column the number of distinct values (null is one) and of nulls.

    The columns are unpivoted to slots of their kind (whole numbers, floating point, text) and grouped once, so that
    not every column is expanded for itself and numbers stay numbers; -0.0 and 0.0 are one value.
    """
    if not cols:
        return df.count(), {}
    types, kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}, kinds(df)

    def cell(i: int, c: str) -> Column:
        x, t = F.col(name(c)), types[c]
        l, d, s = (F.lit(None).cast(k) for k in ("bigint", "double", "string"))
        if t in ("tinyint", "smallint", "int", "bigint", "boolean"):
            l = x.cast("bigint")
        elif t == "date":
            l = F.unix_date(x).cast("bigint")
        elif t == "timestamp":
            l = F.unix_micros(x)
        elif t in ("float", "double"):
            d = x.cast("double")
        else:
            s = F.to_json(x) if kind[c] == "list" else x.cast("string")
        return F.struct(F.lit(i).alias("c"), l.alias("l"), d.alias("d"), s.alias("s"))

    counts = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(cols)]))).groupBy("c", "l", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("v", F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull())
    rows = counts.groupBy("c").agg(F.count(F.lit(1)).alias("d"), F.sum(F.when(~F.col("v"), F.col("n")).otherwise(0)).alias("nulls"), F.sum("n").alias("n")).collect()
    by = {r["c"]: r for r in rows}
    return (rows[0]["n"] if rows else 0), {c: (by[i]["d"], by[i]["nulls"]) if i in by else (0, 0) for i, c in enumerate(cols)}


def get_unique_count(df: DataFrame, include_null_count: bool = False) -> DataFrame:
    """``column, n_unique`` (null is a value) and, if wanted, ``null_count``."""
    _, found = unique_counts(df, df.columns)
    rows = [(c, d, nulls) for c, (d, nulls) in found.items()]
    out = df.sparkSession.createDataFrame(rows, "column string, n_unique bigint, null_count bigint")
    return out if include_null_count else out.drop("null_count")


def infer_highly_unique(df: DataFrame, threshold: float = 0.9) -> list[str]:
    """Numeric and text columns with more distinct values than the threshold's share of the rows."""
    n, found = unique_counts(df, [*get_numeric_cols(df), *get_string_cols(df)])
    return [c for c in df.columns if c in found and found[c][0] > threshold * n]


def infer_discretes(df: DataFrame, threshold: float = 0.1, max_n_unique: int = 100, exclude: Iterable[str] | None = None) -> list[str]:
    """Columns with fewer than max_n_unique distinct values or than the threshold's share of the rows."""
    gone = set(exclude or ())
    n, found = unique_counts(df, [c for c in df.columns if c not in gone])
    return [c for c, (d, _) in found.items() if d < max_n_unique or d < threshold * n]


def infer_conti(df: DataFrame, discrete_threshold: float = 0.1, discrete_max_n_unique: int = 100, exclude: Iterable[str] | None = None) -> list[str]:
    """Numeric columns that aren't discrete."""
    cols = get_numeric_cols(df, exclude)
    discrete = set(infer_discretes(df.select(*[name(c) for c in cols]), discrete_threshold, discrete_max_n_unique)) if cols else set()
    return [c for c in cols if c not in discrete]


def infer_n_unique(df: DataFrame, n: int, include_null: bool = True, leq: bool = False) -> list[str]:
    """Columns with exactly (or at most) n distinct values; with ``include_null`` a null doesn't count as one."""
    _, found = unique_counts(df, df.columns)
    value = {c: d - (1 if include_null and nulls else 0) for c, (d, nulls) in found.items()}
    return [c for c, d in value.items() if (d <= n if leq else d == n)]


def infer_constants(df: DataFrame, include_null: bool = True) -> list[str]:
    """Columns of one value; with ``include_null`` a null beside it doesn't matter, and all null is constant."""
    _, found = unique_counts(df, df.columns)
    return [c for c, (d, nulls) in found.items() if d == 1 or (include_null and d == 2 and nulls > 0)]


def infer_binary(df: DataFrame, include_null: bool = True) -> list[str]:
    """Columns of two values; with ``include_null`` a null may come with them."""
    _, found = unique_counts(df, df.columns)
    return [c for c, (d, nulls) in found.items() if d == 2 or (include_null and d == 3 and nulls > 0)]


def infer_by_pattern(df: DataFrame, pattern: str, sample_count: int | None = None, sample_rounds: int = 3, threshold: float = 0.9, count_null: bool = False, seed: int = 42) -> list[str]:
    """Text columns in which the pattern is found in at least the threshold's share of the values.

    All rows are looked at; with ``sample_count`` it must hold in each of ``sample_rounds`` samples of about that
    many rows. With ``count_null`` nulls count as matches.
    """
    cols = get_string_cols(df)
    if not cols:
        return []
    found = set(cols)
    n = df.count() if sample_count else 0
    parts = [df.sample(min(1.0, sample_count / max(n, 1)), seed + i) for i in range(sample_rounds)] if sample_count else [df]
    for part in parts:
        s = shares(part, cols, lambda x: x.rlike(pattern) | (x.isNull() if count_null else F.lit(False)))
        found &= {c for c, share in s.items() if share >= threshold}
    return [c for c in cols if c in found]


def infer_multicategorical(df: DataFrame, delimiter: str = "|") -> list[str]:
    """Text columns in which at least half of the values have the delimiter between other characters."""
    return infer_by_pattern(df, f".+{re.escape(delimiter)}.+", threshold=0.5)


def infer_dates(df: DataFrame, threshold: float = 0.15) -> list[str]:
    """Date and time columns, and text columns of which at least the threshold's share reads as a date."""
    cols = get_string_cols(df)
    first = lambda x: F.split(F.regexp_replace(F.trim(x), "[/.]", "-"), " ")[0]
    reads = lambda x: functools.reduce(lambda a, b: a | b, [F.try_to_date(first(x), f).isNotNull() for f in ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy")])
    s = shares(df, cols, lambda x: F.coalesce(reads(x), F.lit(False)))
    return [c for c in df.columns if c in set(get_datetime_cols(df)) or s.get(c, 0) >= threshold]


def infer_nums_from_str(df: DataFrame, ignore_comma: bool = True) -> list[str]:
    """Text columns with at least 0.95 numbers to a value on average."""
    cols = get_string_cols(df)
    if not cols:
        return []
    text = lambda c: F.regexp_replace(name(c), ",", "") if ignore_comma else F.col(name(c))
    r = df.agg(*[F.avg(F.regexp_count(text(c), F.lit(r"\d*\.?\d+"))).alias(str(i)) for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if (r[i] or 0) >= 0.95]


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, category, n`` of text columns, unpivoted and grouped once; null is a category."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(name(c)).cast("string").alias("category")) for c in cols]))).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))


def infer_infreq_categories(df: DataFrame, cols: Sequence[str] | None = None, min_count: int = 10, min_frac: float | None = None) -> DataFrame:
    """``feature, categories``: for each text column its categories with fewer rows than the minimum, sorted."""
    counts = category_counts(df, cols or get_string_cols(df))
    least = F.lit(min_count) if min_frac is None else F.lit(min_frac * df.count())
    return counts.where((F.col("n") < least) & F.col("category").isNotNull()).groupBy("feature").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def infer_str_most_common_len(df: DataFrame) -> DataFrame:
    """``column, common_len, share``: the most frequent byte length of each text column, of equal ones the smallest."""
    cols = get_string_cols(df)
    lengths = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.octet_length(name(c)).alias("l")) for c in cols]))).where("l is not null").groupBy("column", "l").agg(F.count(F.lit(1)).alias("n"))
    best = lengths.groupBy("column").agg(F.min(F.struct(-F.col("n"), F.col("l").alias("l"), F.col("n").alias("n"))).alias("b"), F.sum("n").alias("all"))
    return best.select("column", F.col("b.l").alias("common_len"), (F.col("b.n") / F.col("all")).alias("share"))


def estimate_n_unique(df: DataFrame, cols: Sequence[str] | None = None, rsd: float = 0.05) -> DataFrame:
    """``column, n_unique``: HyperLogLog estimates."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.approx_count_distinct(name(c), rsd).alias(c) for c in cols])
    return wide.unpivot([], [name(c) for c in cols], "column", "n_unique")
