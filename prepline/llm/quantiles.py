"""Percentiles of large numeric columns from mergeable sketches: hierarchies of randomized compactors (KLL)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the top compactor. Groups of up to this many values are kept whole, so their percentiles are exact.
K = 1024


def rank_error(k: int = K) -> float:
    """The distance of a percentile's rank from the wanted one, as a share of the values, that holds with 99 %.

    The published bound of the sketch for a single percentile; merging sketches doesn't raise it.
    """
    return 2.296 / k**0.9021


def usable(c: str) -> Column:
    """The value if it is a finite number above 0, else null."""
    x = F.col(f"`{c}`").cast("double")
    return F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x)


def build_sketches(df: DataFrame, parts: Sequence[str], dimensions: Sequence[str], fields: Sequence[str], k: int = K) -> DataFrame:
    """``*parts, dimension, key, field, n, sketch``: a sketch of each field per part, dimension and key.

    ``parts`` (such as a load or a day) can be joined later by ``merge_sketches``; ``key`` is the value of the
    dimension as text, null for null; a null part is a part of its own. Only finite numbers above 0 count; groups
    without any have no row, an empty table has none; repeated rows all count; ties are values like others. Other
    columns are ignored, whatever their names. Each task sketches what it reads before the shuffle, so of a hot
    group only sketches of bounded size are moved.
    """
    keyed = df.select(
        *[F.col(f"`{p}`") for p in parts],
        *[usable(f).alias(f"x{i}") for i, f in enumerate(fields)],
        F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"`{d}`").cast("string").alias("key")) for d in dimensions])),
    ).where(F.coalesce(*[F.col(f"x{i}") for i in range(len(fields))]).isNotNull())
    aggs = [a for i in range(len(fields)) for a in (F.count(f"x{i}").alias(f"n{i}"), F.kll_sketch_agg_double(f"x{i}", k).alias(f"s{i}"))]
    wide = keyed.groupBy(*parts, "dimension", "key").agg(*aggs)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, f in enumerate(fields)])
    return wide.select(*parts, "dimension", "key", F.inline(cells)).where("n > 0")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("dimension", "key", "field"), k: int = K) -> DataFrame:
    """Joins the sketches of each group of ``by`` level by level: any union of parts, such as all loads."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def column_of(share: float) -> str:
    """``p05`` for 0.05, ``p0_1`` for 0.001: no two shares have the same name."""
    percent = f"{share * 100:.10f}".rstrip("0").rstrip(".")
    return "p" + (percent.zfill(2) if percent.isdigit() else percent.replace(".", "_"))


def percentiles(sketches: DataFrame, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """``sketches`` with the percentiles ``p05`` ... instead of the sketch: the value of the sketch at that rank.

    Exact (the smallest value with at least that share of all at or below it) up to K values, else within
    ``rank_error``.
    """
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, shares)))
    at = sketches.withColumn("__q", found)
    return at.select("*", *[F.col("__q")[i].alias(column_of(s)) for i, s in enumerate(shares)]).drop("sketch", "__q")
