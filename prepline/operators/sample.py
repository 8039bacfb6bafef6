"""Sampling, splitting, resampling, deduplication.

Draws come from hashes of a row's key where one is given, so that they don't depend on the partitioning and a lost
executor repeats the same ones.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepline.functions.sqltext import lit, name
from prepline.operators.strings import time_buckets
from prepline.session import cut

#: Draws are hashes modulo this.
GRAIN = 1 << 30
#: Distance of the seeds of repeated draws.
AGAIN = 1_000_003


def draw(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(F.lit(seed), *map(name, keys)), F.lit(GRAIN)) / F.lit(float(GRAIN))


def _draw(df: DataFrame, keys: Sequence[str] | None, seed: int) -> Column:
    return draw(keys, seed) if keys else F.rand(seed)


def _contents(df: DataFrame, keys: Sequence[str] | None, seed: int) -> list[Column]:
    """Orders rows of equal keys by chance and alike in every run: a hash of all columns that have one."""
    cols = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return [F.xxhash64(F.lit(seed), *map(name, cols))] if keys and cols else []


def lazy_sample(df: DataFrame, sample_frac: float = 0.75, sample_amt: int | None = None, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """About a fraction of the rows, or exactly an amount."""
    if sample_amt is not None:
        return df.orderBy(_draw(df, keys, seed), *map(name, keys or ())).limit(sample_amt)
    return df.where(draw(keys, seed) < sample_frac) if keys else df.sample(sample_frac, seed)


def deduplicate(df: DataFrame, subset: Sequence[str], keep: str = "any", order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per combination of the subset: any, the first or last in an order, or none of those that repeat."""
    if keep == "any":
        return df.dropDuplicates(list(subset))
    part = Window.partitionBy(*map(name, subset))
    if keep == "none":
        n = df.groupBy(*map(name, subset)).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(*[F.col(name(c)).alias(f"__{i}") for i, c in enumerate(subset)])
        on = functools.reduce(lambda a, b: a & b, [F.col(name(c)).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(subset)])
        return df.join(n, on, "left_semi")
    if keep not in ("first", "last") or not order_by:
        raise ValueError("keep is any, none, or first or last with an order")
    order = [F.col(name(c)).asc() if keep == "first" else F.col(name(c)).desc() for c in order_by]
    return df.withColumn("__r", F.row_number().over(part.orderBy(*order))).where("__r = 1").drop("__r")


def simple_upsample(df: DataFrame, subgroup: str, count: int, epsilon: float = 0.01, include: Sequence[str] | None = None, exclude: Sequence[str] = (), positive: bool = False, seed: int = 42) -> DataFrame:
    """Appends ``count`` rows drawn with replacement from a subgroup (condition in SQL), with noise on its float columns.

    Rows are drawn independently, some more than wanted; those with the least random numbers are taken, wherever
    they stand. Noise is uniform in (-epsilon, epsilon), or (0, epsilon) if positive.
    """
    own = df.where(subgroup)
    n = own.count()
    if n == 0:
        return df
    # mean ``count``, ten deviations above: too few are drawn once in e^50, and then others are drawn
    share = (count + 10 * math.sqrt(count) + 50) / n
    for again in itertools.count():
        drawn = row_numbers(own.sample(True, share, seed + again * AGAIN).withColumn("__u", F.rand(seed - 1)), ["__u"], "__i")
        if drawn.count() >= count:
            break
    drawn = drawn.where(F.col("__i") <= count).select(*map(name, df.columns))
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("float", "double")}
    cols = [c for c in (include or floats) if c in floats and c not in set(exclude)]
    low = 0.0 if positive else -epsilon
    noisy = drawn.withColumns({c: (F.col(name(c)) + low + (epsilon - low) * F.rand(seed + 1 + i)).cast(df.schema[c].dataType) for i, c in enumerate(cols)})
    return df.unionByName(noisy)


def simple_downsample(df: DataFrame, subgroup: str, sample_frac: float, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Keeps about a fraction of a subgroup (condition in SQL) and all other rows."""
    return df.where(~F.coalesce(F.expr(subgroup), F.lit(False)) | (_draw(df, keys, seed) < sample_frac))


def stratified_downsample(df: DataFrame, group: Sequence[str], keep: int | float, min_keep: int = 1, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``keep`` rows of each group, or a fraction of it but at least ``min_keep``.

    Only rows whose draw is below a bound that leaves enough of each group are ranked, so a hot group's ranking
    sees about as many rows as it keeps. Rows of equal keys share a draw, and hashes of their contents order them;
    give no keys for draws by row.
    """
    counts = df.groupBy(*map(name, group)).agg(F.count(F.lit(1)).alias("__n"))
    wanted = F.lit(float(keep)) if isinstance(keep, int) else F.greatest(F.col("__n") * F.lit(float(keep)), F.lit(float(min_keep)))
    sized = counts.select(*[F.col(name(g)).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__n"), wanted.alias("__k"))
    on = functools.reduce(lambda a, b: a & b, [F.col(name(g)).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)])
    # mean k, ten deviations above: independent draws leave a group fewer than k rows once in e^50
    sized = sized.withColumn("__b", F.col("__k") + 10 * F.sqrt("__k") + 50)
    drawn, passes = df.withColumn("__u", _draw(df, keys, seed)), F.col("__u") * F.col("__n") <= F.col("__b")
    if keys:  # rows of equal keys share a draw: all rows of a group that the bound leaves too few are ranked
        of = [f"__g{i}" for i in range(len(group))]
        left = drawn.join(sized.where("__n > __b"), on).where(passes).groupBy(*of).agg(F.count(F.lit(1)).alias("__p")).select(*[F.col(g).alias(f"_{g}") for g in of], "__p")
        enough = F.col("__p") >= F.ceil("__k")
        sized = sized.join(left, functools.reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in of]), "left").withColumn("__b", F.when(enough, F.col("__b")).otherwise(F.col("__n")))
    near = drawn.join(sized, on).where(passes)
    w = Window.partitionBy(*map(name, group)).orderBy("__u", *map(name, keys or ()), *_contents(df, keys, seed))
    whole = F.floor("__k") == F.col("__k")
    rank = F.row_number().over(w)
    return near.withColumn("__r", rank).where(F.when(whole, F.col("__r") <= F.col("__k")).otherwise(F.col("__r") < F.col("__k") + 1)).select(*map(name, df.columns))


def train_test_split(df: DataFrame, train_frac: float = 0.75, seed: int = 42, keys: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two frames without common rows; by hash of the keys if given, else by drawn number of a kept copy."""
    if keys:
        u = draw(keys, seed)
        return df.where(u < train_frac), df.where(u >= train_frac)
    kept = cut(df.withColumn("__u", F.rand(seed)))
    return kept.where(F.col("__u") < train_frac).drop("__u"), kept.where(F.col("__u") >= train_frac).drop("__u")


def row_numbers(df: DataFrame, order_by: Sequence[str], out: str = "row_nr") -> DataFrame:
    """Numbers rows from 1 in an order: by ranges, numbered inside each and shifted by the rows of those before."""
    order = [F.col(name(c)) for c in order_by]
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__i", inside).join(before, "__part").select(*map(name, df.columns), (F.col("__i") + F.col("__s")).alias(out))


def time_series_split(df: DataFrame, order_by: Sequence[str], n_splits: int = 5, test_size: int | None = None, offset: int = 0, gap: int = 0) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Expanding training rows and the test rows after them (and a gap), fold by fold; empty folds are skipped."""
    numbered = cut(row_numbers(df, order_by, "__row"))
    n = numbered.count()
    size = test_size or n // (n_splits + 1)
    for j in range(n_splits, 0, -1):
        right = offset + n - j * size + 1
        if right <= 1 or right + gap > n:
            continue
        r = F.col("__row")
        yield numbered.where(r < right).drop("__row"), numbered.where((r >= right + gap) & (r < right + gap + size)).drop("__row")


def _windows(df: DataFrame, keys: Sequence[str], length: int) -> Iterator[list[DataFrame]]:
    values = [tuple(r) for r in df.select(*map(name, keys)).distinct().orderBy(*map(name, keys)).collect()]
    of = lambda v: df.where(functools.reduce(lambda a, b: a & b, [F.col(name(k)).eqNullSafe(F.lit(x)) for k, x in zip(keys, v)]))
    for i in range(len(values) - length + 1):
        yield [of(v) for v in values[i : i + length]]


def sliding_window(df: DataFrame, cols: Sequence[str], length: int = 2) -> Iterator[list[DataFrame]]:
    """Lists of the (lazy) frames of ``length`` consecutive segments; the distinct segments come to the driver."""
    return _windows(df, list(cols), length)


def time_sliding_window(df: DataFrame, time_col: str, interval: str, length: int = 2) -> Iterator[list[DataFrame]]:
    """The same over time buckets; a frame also has the columns that name its bucket."""
    buckets = time_buckets(time_col, interval)
    return _windows(df.withColumns({f"_{k}": F.expr(v) for k, v in buckets.items()}), [f"_{k}" for k in buckets], length)


def bootstrap(df: DataFrame, times: int, sample_frac: float = 0.25, sample_amt: int | None = None, seed: int = 42, keys: Sequence[str] | None = None) -> Iterator[DataFrame]:
    for i in range(times):
        yield lazy_sample(df, sample_frac, sample_amt, seed + i, keys)


def col_subsample(df: DataFrame, times: int, sample_amt: int, always_keep: Sequence[str] = (), seed: int = 42) -> Iterator[DataFrame]:
    """Frames of random subsets of the columns and those always kept."""
    rng = random.Random(seed)
    others = [c for c in df.columns if c not in set(always_keep)]
    for _ in range(times):
        chosen = set(rng.sample(others, min(sample_amt, len(others)))) | set(always_keep)
        yield df.select(*[name(c) for c in df.columns if c in chosen])


def segmentation(df: DataFrame, segments: Sequence[Sequence[str]]) -> Iterator[tuple[str, DataFrame]]:
    """(name, lazy frame) of each group of each list of columns, in order."""
    for cols in segments:
        for r in df.select(*map(name, cols)).distinct().orderBy(*map(name, cols)).collect():
            yield f"{tuple(cols)} = {tuple(r)}", df.where(" AND ".join(f"{name(c)} <=> {lit(v)}" for c, v in zip(cols, r)))


