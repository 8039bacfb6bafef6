"""Exact quantiles and modes of columns at any size."""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepline.functions.safe import finite
from prepline.functions.sqltext import name
from prepline.session import cut

#: Cells (rows times columns) up to which one aggregate may hold all values of a frame; the rows are counted.
FEW_CELLS = 2_000_000


def is_few(df: DataFrame, rows: int) -> bool:
    """Whether the frame has at most so many rows; no more than those are read of it."""
    return df.select(F.lit(1)).limit(rows + 1).toArrow().num_rows <= rows


def same(a: str, b: str, cols: Sequence[str]) -> Column:
    """Whether two sides of a join (by alias) agree in columns, nulls included."""
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{name(c)}").eqNullSafe(F.col(f"{b}.{name(c)}")) for c in cols])


def running(df: DataFrame, order_by: Sequence[str], sums: Mapping[str, str], within: Sequence[str] = (), totals: bool = False) -> DataFrame:
    """``df`` with running sums (new column: column) in an order, within groups, ties included; null is a group.

    Rows are range-partitioned and summed inside each partition; only one row of sums per group and partition
    passes through a window over partitions, so no task sees all rows of a group. The range-partitioned rows are
    written once, as the sums and the rows must agree on the partitions. With ``totals`` the sum of the whole group
    is ``<new column>_total``.
    """
    ranged = cut(df.repartitionByRange(*map(name, [*within, *order_by])).withColumn("__part", F.spark_partition_id()))
    groups = [*within, "__part"]
    parts = ranged.groupBy(*map(name, groups)).agg(*[F.sum(name(c)).alias(f"__t_{k}") for k, c in sums.items()])
    whole = Window.partitionBy(*map(name, within))
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*map(name, groups), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums], *[F.sum(f"__t_{k}").over(whole).alias(f"{k}_total") for k in sums if totals])
    inside = Window.partitionBy(*map(name, groups)).orderBy(*map(name, order_by))
    summed = ranged.select("*", *[F.sum(name(c)).over(inside).alias(f"__i_{k}") for k, c in sums.items()]).alias("a").join(starts.alias("b"), same("a", "b", groups))
    return summed.select(*[F.col(f"a.{name(c)}") for c in df.columns], *[(F.col(f"__i_{k}") + F.col(f"__s_{k}")).alias(k) for k in sums], *[F.col(f"{k}_total") for k in sums if totals])


def cumulative_counts(long: DataFrame) -> DataFrame:
    """``feature, x, n, upto, upto_total`` of rows feature, x: counts of values and their running sums per feature."""
    counts = long.where("x is not null").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    return running(counts, ["x"], {"upto": "n"}, ["feature"], totals=True)


def group_quantiles(long: DataFrame, keys: Sequence[str], shares: Sequence[float], x: str = "x") -> DataFrame:
    """``*keys, q0, q1, ...``: quantiles of the finite values of each group by linear interpolation; null is a group.

    Values are counted per group before and after a shuffle and summed up in ranges, so a group may hold any share
    of the rows. Groups without values have no row.
    """
    counts = long.select(*map(name, keys), finite(name(x)).alias("__x")).where("__x is not null").groupBy(*map(name, keys), "__x").agg(F.count(F.lit(1)).alias("__n"))
    at = running(counts, ["__x"], {"__upto": "__n"}, keys, totals=True)
    aggs = []
    for i, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("__upto_total") - 1)
        holds = lambda k: F.max(F.when((F.col("__upto") > k) & (F.col("__upto") - F.col("__n") <= k), F.col("__x")))
        aggs += [holds(F.floor(place)).alias(f"__a{i}"), holds(F.ceil(place)).alias(f"__b{i}"), F.max(place - F.floor(place)).alias(f"__w{i}")]
    value = lambda i: F.when(F.col(f"__w{i}") == 0, F.col(f"__a{i}")).otherwise((1 - F.col(f"__w{i}")) * F.col(f"__a{i}") + F.col(f"__w{i}") * F.col(f"__b{i}"))
    return at.groupBy(*map(name, keys)).agg(*aggs).select(*map(name, keys), *[value(i).alias(f"q{i}") for i in range(len(shares))])


def group_modes(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """``*keys, mode``: the most frequent value of each group, of equal ones the smallest; -0.0 is 0.0, null doesn't count."""
    counts = df.select(*map(name, keys), value.alias("__v")).where("__v is not null").groupBy(*map(name, keys), "__v").agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*map(name, keys)).agg(F.min(F.struct(-F.col("__n"), F.col("__v").alias("v")))["v"].alias("mode"))


def column_quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float], accuracy: int | None = None) -> dict[str, list[float] | None]:
    """Quantiles of the finite values by linear interpolation; None for a column without values.

    Frames of at most ``FEW_CELLS`` cells: one aggregate. Others: read off sorted counts of values, with the same
    result. With an ``accuracy`` they are approximate.
    """
    if not cols:
        return {}
    if accuracy is not None or is_few(df, FEW_CELLS // len(cols)):
        ps = F.array(*[F.lit(float(s)) for s in shares])
        f = (lambda x: F.percentile(x, ps)) if accuracy is None else (lambda x: F.percentile_approx(x, ps, accuracy))
        r = df.agg(*[f(finite(name(c))).alias(str(i)) for i, c in enumerate(cols)]).first()
        return {c: None if r[i] is None else list(r[i]) for i, c in enumerate(cols)}
    return sorted_quantiles(df, cols, shares)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of a few rows that are known on the driver, as a constant of the plan."""
    names = [f.split()[0] for f in schema.split(", ")]
    kind = f"array<struct<{','.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), kind)))


class SortedCounts:
    """How often each finite value of some columns occurs, sorted in ranges and kept: quantiles and moments are read off.

    The columns are unpivoted and counted once, before and after a shuffle. The driver learns one row per column and
    range, and of the values only those asked for. Moments are those about ``centers`` (some value of each column
    near its mean).
    """

    def __init__(self, df: DataFrame, cols: Sequence[str], centers: Sequence[float] | None = None):
        self.cols, self.centers = list(cols), [float(c or 0.0) for c in centers or [0.0] * len(cols)]
        cells = [F.struct(F.lit(i).alias("i"), finite(name(c)).alias("x")) for i, c in enumerate(cols)]
        counts = df.select(F.inline(F.array(*cells))).where("x is not null").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
        self.ranged = cut(counts.repartitionByRange("i", "x").withColumn("part", F.spark_partition_id()))
        d = F.col("x") - F.get(F.array(*map(F.lit, self.centers)), F.col("i"))
        powers = [F.sum(functools.reduce(lambda a, b: a * b, [d] * k, F.col("n").cast("double"))).alias(f"d{k}") for k in range(1, 5)] if centers else []
        parts = self.ranged.groupBy("i", "part").agg(F.sum("n").alias("n"), *powers).collect()
        self.parts: list[list] = [sorted((r for r in parts if r["i"] == i), key=lambda r: r["part"]) for i in range(len(self.cols))]

    def quantiles(self, shares: Sequence[float]) -> dict[str, list[float] | None]:
        wanted: dict[tuple[int, int], set[int]] = {}  # column and part: places in the part
        places: dict[str, list[tuple]] = {}
        for i, parts in enumerate(self.parts):
            ends = list(itertools.accumulate(r["n"] for r in parts))
            for s in shares if ends else []:
                p = s * (ends[-1] - 1)
                both = []
                for k in (math.floor(p), math.ceil(p)):
                    j = bisect.bisect_right(ends, k)
                    both.append((i, parts[j]["part"], k - (ends[j] - parts[j]["n"])))
                    wanted.setdefault(both[-1][:2], set()).add(both[-1][2])
                places.setdefault(self.cols[i], []).append((*both, p - math.floor(p)))
        if not wanted:
            return dict.fromkeys(self.cols)
        asked = small_table(self.ranged.sparkSession, [(*k, sorted(v)) for k, v in wanted.items()], "i int, part int, ks array<bigint>")
        upto = F.sum("n").over(Window.partitionBy("i", "part").orderBy("x"))
        # as many rows as there are columns and shares
        held = self.ranged.join(F.broadcast(asked), ["i", "part"]).withColumn("upto", upto).withColumn("ks", F.filter("ks", lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)))
        found = {(r["i"], r["part"], k): r["x"] for r in held.where(F.size("ks") > 0).select("i", "part", "ks", "x").collect() for k in r["ks"]}
        value = lambda a, b, w: found[a] if w == 0 else (1 - w) * found[a] + w * found[b]
        return {c: [value(*x) for x in places[c]] if c in places else None for c in self.cols}

    def moments(self) -> dict[str, tuple[float | None, float | None, float | None, float | None]]:
        """Mean, sample deviation, skewness and excess kurtosis (both of the population) of each column."""
        out: dict[str, tuple] = {}
        for c, center, parts in zip(self.cols, self.centers, self.parts):
            n = sum(r["n"] for r in parts)
            if not n:
                out[c] = (None,) * 4
                continue
            a, b2, b3, b4 = (math.fsum(r[f"d{k}"] for r in parts) / n for k in range(1, 5))
            m2 = max(b2 - a * a, 0.0)
            m3, m4 = b3 - 3 * a * b2 + 2 * a**3, b4 - 4 * a * b3 + 6 * a * a * b2 - 3 * a**4
            if m2 <= 1e-14 * b2:  # the mean was the center but for rounding
                m2 = 0.0
            out[c] = (center + a, math.sqrt(m2 * n / (n - 1)) if n > 1 else None, m3 / m2**1.5 if m2 else None, m4 / m2**2 - 3 if m2 else None)
        return out


def sorted_quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """``column_quantiles`` by sorted counts."""
    return SortedCounts(df, cols).quantiles(shares)


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """The most frequent value of each column, of equal ones the smallest; null doesn't count.

    Each column's values are counted before and after a shuffle, so that no aggregate holds all of them.
    """
    out = {}
    for c in cols:
        counts = df.where(F.col(name(c)).isNotNull()).groupBy(F.col(name(c)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        r = counts.agg(F.min(F.struct(-F.col("n"), F.col("v").alias("v")))["v"].alias("v")).first()
        out[c] = None if r is None else r["v"]
    return out
