"""Feature selection by statistics."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepline.functions.safe import fdiv, finite, safe_corr
from prepline.functions.special import digamma, f_survival, ks_p_value
from prepline.functions.sqltext import name
from prepline.operators.encode import _need_binary, woe_table
from prepline.operators.infer import FEW_COLUMNS, as_numbers, correlation_matrix, infer_conti, middle_values, number_matrix
from prepline.operators.quantiles import cumulative_counts, running
from prepline.operators.schema import get_complement, get_numeric_cols, get_string_cols
from prepline.session import cut


#: Width of the noise that breaks ties, as a share of a column's mean.
NOISE = 4e-12


def _numeric(df: DataFrame, target: str, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols else get_numeric_cols(df, [target])


def _long(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """``t, feature, x``: columns unpivoted, numbers finite or null."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), finite(name(c)).alias("x")) for c in cols])
    return df.select(F.col(name(target)).alias("t"), F.inline(cells))


def _keep(df: DataFrame, table: DataFrame, score: str, top_k: int, among: Sequence[str]) -> DataFrame:
    """``df`` with the top features by a score and all columns that weren't scored."""
    best = [r["feature"] for r in table.orderBy(F.desc_nulls_last(score), "feature").limit(top_k).collect()]
    keep = set(best) | set(get_complement(df, among))
    return df.select(*[name(c) for c in df.columns if c in keep])


def abs_corr(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``feature, abs_corr``: absolute Pearson correlation with the target in one pass; -999 if undefined.

    A few columns are one aggregate, more are rows of ``correlation_matrix``.
    """
    cols = _numeric(df, target, cols)
    if len(cols) > FEW_COLUMNS:
        found = np.abs(correlation_matrix(df, [*cols, target])[:-1, -1])
        rows = [(c, -999.0 if np.isnan(v) else float(v)) for c, v in zip(cols, found)]
        return df.sparkSession.createDataFrame(rows, "feature string, abs_corr double").orderBy(F.desc("abs_corr"), "feature")
    wide = df.agg(*[safe_corr(name(c), name(target)).alias(f"r{i}") for i, c in enumerate(cols)])
    value = lambda i: F.when(F.isnan(f"r{i}") | F.col(f"r{i}").isNull(), -999.0).otherwise(F.abs(f"r{i}"))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), value(i).alias("abs_corr")) for i, c in enumerate(cols)]))).orderBy(F.desc("abs_corr"), "feature")


def abs_corr_selector(df: DataFrame, target: str, threshold: float) -> DataFrame:
    """Keeps columns with a correlation of at least the threshold, the target, and all that aren't numbers."""
    cols = _numeric(df, target, None)
    good = {r["feature"] for r in abs_corr(df, target, cols).where(F.col("abs_corr") >= threshold).collect()}
    return df.select(*[name(c) for c in df.columns if c in good or c not in set(cols)])


def discrete_ig(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``feature, target_entropy, conditional_entropy, unique_pct, information_gain, weighted_information_gain``.

    Entropies use the natural logarithm; null is a value. Columns are unpivoted as text and grouped once.
    """
    cols = list(cols) if cols else [c for c in get_string_cols(df) if c != target]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(name(c)).cast("string").alias("v")) for c in cols])
    counts = df.select(F.col(name(target)).cast("string").alias("t"), F.inline(cells)).groupBy("feature", "v", "t").agg(F.count(F.lit(1)).alias("n"))
    nln = lambda c: F.sum(F.col(c) * F.log(c))
    by_v = counts.groupBy("feature", "v").agg(F.sum("n").alias("m"), nln("n").alias("own"))
    per = by_v.groupBy("feature").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("d"), (nln("m") - F.sum("own")).alias("ce"))
    by_t = df.groupBy(F.col(name(target)).alias("t")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), nln("n").alias("own")).first()
    total = max(by_t["all"] or 0, 1)
    entropy = math.log(total) - (by_t["own"] or 0.0) / total
    ce = F.greatest(F.col("ce") / F.col("n"), F.lit(0.0))
    gain = F.greatest(F.lit(entropy) - ce, F.lit(0.0))
    unique = F.col("d") / F.col("n")
    return per.select("feature", F.lit(entropy).alias("target_entropy"), ce.alias("conditional_entropy"), unique.alias("unique_pct"), gain.alias("information_gain"), ((1 - unique) * gain).alias("weighted_information_gain"))


discrete_mi = discrete_ig


def discrete_ig_selector(df: DataFrame, target: str, top_k: int) -> DataFrame:
    cols = [c for c in get_string_cols(df) if c != target]
    return _keep(df, discrete_ig(df, target, cols), "information_gain", top_k, cols)


def _radii(x: np.ndarray, k: int) -> np.ndarray:
    """The distance of each of the sorted numbers to its k-th neighbour."""
    n = len(x)
    at = np.arange(n)
    best = np.full(n, np.inf)
    for left in range(k + 1):  # the k nearest are some to the left and the rest to the right
        a, b = at - left, at + (k - left)
        ok = (a >= 0) & (b < n)
        far = np.maximum(x[at[ok]] - x[a[ok]], x[b[ok]] - x[at[ok]])
        best[ok] = np.minimum(best[ok], far)
    return best


def _nearer(x: np.ndarray, here: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many of the sorted numbers are nearer than r to each of some of them.

    The k-th neighbour lies exactly at r; sums are rounded, so the ends are set right by the differences.
    """
    low, high = np.searchsorted(x, here - r, side="left"), np.searchsorted(x, here + r, side="right")
    last = len(x) - 1
    for _ in range(3):
        low = np.where((low > 0) & (here - x[np.maximum(low - 1, 0)] < r), low - 1, np.where(here - x[np.minimum(low, last)] >= r, low + 1, low))
        high = np.where((high <= last) & (x[np.minimum(high, last)] - here < r), high + 1, np.where(x[np.maximum(high - 1, 0)] - here >= r, high - 1, high))
    return high - low


def _class_radii(x: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """The distance of each of the sorted numbers to its k-th neighbour in its own class; infinite if there is none."""
    r = np.full(len(x), np.inf)
    order = np.argsort(codes, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(own) > k:
            r[own] = _radii(x[own], k)
    return r


def _tie_breaker(x: np.ndarray, feature: str, seed: int) -> np.ndarray:
    """The sorted numbers with a noise too small to matter but between equal ones, sorted again by the caller."""
    draw = np.random.default_rng([seed, zlib.crc32(feature.encode())])
    return x + NOISE * max(abs(float(x.mean())), 1.0) * (draw.random(len(x)) - 0.5)


def _chunks(cols: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns rows into one row per column: its finite values and the codes of their classes, as bytes."""
        for b in batches:
            label = b.column(0).dictionary_encode()
            codes = label.indices.to_numpy(zero_copy_only=False).astype("<i4")
            out: tuple[list, list] = ([], [])
            for c in b.columns[1:]:
                x = c.to_numpy(zero_copy_only=False).astype("<f8", copy=False)
                known = np.isfinite(x)
                out[0].append(x[known].tobytes())
                out[1].append(codes[known].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.string()), pa.array([label.dictionary.to_pylist()] * len(cols), pa.list_(pa.string())), pa.array(out[1], pa.binary()), pa.array(out[0], pa.binary())], names=["feature", "labels", "codes", "x"])

    return run


def _whole_feature(k: int, seed: int):
    def score(t: pa.Table) -> pa.Table:
        """The estimate from all values of a feature, and the rows of its smallest class."""
        feature = t["feature"][0].as_py()
        known: dict[str, int] = {}
        codes = [np.array([known.setdefault(x, len(known)) for x in names] or [0])[np.frombuffer(c, "<i4")] for names, c in zip(t["labels"].to_pylist(), t["codes"].to_pylist())]
        x, codes = np.concatenate([np.frombuffer(v, "<f8") for v in t["x"].to_pylist()]), np.concatenate(codes)
        n, mi, least = len(x), None, None
        if n:
            names = sorted(known)
            codes = np.array([names.index(v) for v in known])[codes]
            order = np.lexsort((codes, x))
            x, codes = _tie_breaker(x[order], feature, seed), codes[order]
            order = np.argsort(x, kind="stable")
            x, codes = x[order], codes[order]
            sizes = np.bincount(codes)
            sizes = sizes[sizes > 0]
            least = int(sizes.min())
            if least > k:
                m = np.maximum(_nearer(x, x, _class_radii(x, codes, k)), 1)
                mi = max(0.0, float(digamma(n) + digamma(k) - np.sum(sizes * digamma(sizes)) / n - np.sum(digamma(m)) / n))
        return pa.table({"feature": [feature], "estimated_mi": pa.array([mi], pa.float64()), "least": pa.array([least], pa.int64())})

    return score


_BLOCK = "kind int, feature string, t string, block int, at bigint, size bigint, first bigint, x array<double>, s double"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table, bool, bool]]:
    """(feature, its rows sorted by x, whether other features stand before and after it) of what a task holds."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held).sort_by([("feature", "ascending"), ("x", "ascending")])
    f = t["feature"].combine_chunks().dictionary_encode()
    cuts = np.flatnonzero(np.diff(f.indices.to_numpy())) + 1
    ends = [0, *cuts.tolist(), len(t)]
    for a, b in zip(ends, ends[1:]):
        yield t["feature"][a].as_py(), t.slice(a, b - a), a > 0, b < len(t)


def _score_block(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: the sum of a feature over the rows whose neighbours are all in this block.

        Kind 1: each other row with its place ``at`` in its class (of ``size`` rows in the block) and the values of
        the class from place ``first`` on, k to either side. Kind 2: the first and the last k values of each class.
        """
        block = TaskContext.get().partitionId()
        for feature, t, starts, ends in _segments(batches):
            x = t["x"].to_numpy()
            label = t["t"].combine_chunks().dictionary_encode()
            codes, names = label.indices.to_numpy(), label.dictionary.to_pylist()
            r = _class_radii(x, codes, k)
            here = np.isfinite(r) & (starts | (x - r >= x[0])) & (ends | (x + r <= x[-1]))
            s = float(np.sum(digamma(np.maximum(_nearer(x, x[here], r[here]), 1)))) if here.any() else 0.0
            rows: list[tuple] = [(0, feature, None, block, None, None, None, None, s)]
            order = np.argsort(codes, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                v, name_, m = x[own], names[codes[own[0]]], len(own)
                rows += [(2, feature, name_, block, None, m, a, v[a:b].tolist(), None) for a, b in {(0, min(k, m)), (max(m - k, 0), m)}]
                rows += [(1, feature, name_, block, int(i), m, max(int(i) - k, 0), v[max(i - k, 0) : i + k + 1].tolist(), None) for i in np.flatnonzero(~here[own])]
            yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK_NAMES, row)) for row in rows], schema=_BLOCK_SCHEMA)

    return run


_BLOCK_NAMES = [p.split()[0] for p in _BLOCK.split(", ")]
_BLOCK_SCHEMA = pa.schema(list(zip(_BLOCK_NAMES, [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64()])))


def _open_radii(k: int):
    def run(t: pa.Table) -> pa.Table:
        """The radii of a class's rows of kind 1 from all values that came with the rows of kinds 1 and 2."""
        sizes = np.array([len(v) for v in t["x"].to_pylist()])
        block = np.repeat(t["block"].to_numpy(), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(t["first"].to_numpy(), sizes)
        x = t["x"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((place, block))
        new = np.concatenate([[True], (np.diff(block[order]) != 0) | (np.diff(place[order]) != 0)])
        x, block, place = x[order][new], block[order][new], place[order][new]  # blocks are in the order of the values
        r = _radii(x, k)
        open_ = t.filter(pc.equal(t["kind"], 1))
        key = lambda b, p: b.astype(np.int64) << 40 | p
        at = np.searchsorted(key(block, place), key(open_["block"].to_numpy(), open_["at"].to_numpy()))
        n = len(open_)
        return pa.table({"feature": pa.array([t["feature"][0].as_py()] * n, pa.string()), "here": pa.array(x[at], pa.float64()), "r": pa.array(r[at], pa.float64())})

    return run


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the values (r is null) of a feature in this range, and those before each end of an interval (r is given)."""
    part = TaskContext.get().partitionId()
    for feature, t, _, _ in _segments(batches):
        value = t["r"].is_null().to_numpy()
        x = t["x"].to_numpy()[value]
        ends = t.filter(pa.array(~value))
        here, r, side = (ends[c].to_numpy() for c in ("here", "r", "side"))
        below = np.searchsorted(x, ends["x"].to_numpy())
        for _ in range(3):  # ends are rounded sums: differences decide, as for values of one block
            low, high = np.maximum(below - 1, 0), np.minimum(below, max(len(x) - 1, 0))
            if len(x):
                out_l, out_h = (below > 0) & (here - x[low] < r), (below < len(x)) & (here - x[high] >= r)
                in_l, in_h = (below > 0) & (x[low] - here >= r), (below < len(x)) & (x[high] - here < r)
                below = np.where(side < 0, below - out_l + (out_h & ~out_l), below - in_l + (in_h & ~in_l))
        n = len(ends)
        yield pa.RecordBatch.from_pydict({"feature": [feature] * (n + 1), "part": np.full(n + 1, part, np.int32), "n": np.append(np.zeros(n, np.int64), len(x)), "here": np.append(here, np.nan), "r": np.append(r, np.nan), "side": np.append(side, 0).astype(np.int32), "below": np.append(below, 0).astype(np.int64)})


def _in_ranges(df: DataFrame, target: str, cols: Sequence[str], k: int, seed: int, block_rows: int) -> dict[str, float | None]:
    """``mutual_info`` of features of any size, in ranges of values; see there."""
    long = _long(df, target, cols).where("t is not null and x is not null")
    classes = long.groupBy("feature", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s")).collect()
    sizes = {(r["feature"], r["t"]): r["n"] for r in classes}
    _need_neighbours(min(sizes.values(), default=None), k)
    noise = F.lit(0.0)
    for c in cols:
        own = [r for r in classes if r["feature"] == c]
        mean = abs(sum(r["s"] for r in own) / max(sum(r["n"] for r in own), 1))
        noise = F.when(F.col("feature") == c, F.lit(NOISE * max(mean, 1.0))).otherwise(noise)
    noisy = cut(long.select("feature", F.col("t").cast("string").alias("t"), (F.col("x") + noise * (F.rand(seed) - 0.5)).alias("x")))
    n_blocks = max(1, math.ceil(sum(sizes.values()) / block_rows))
    blocks = cut(noisy.repartitionByRange(n_blocks, "feature", "x").mapInArrow(_score_block(k), _BLOCK))
    sums = blocks.where("kind = 0").groupBy("feature").agg(F.sum("s").alias("s"))
    radii = cut(blocks.where("kind > 0").groupBy("feature", "t").applyInArrow(_open_radii(k), "feature string, here double, r double"))
    ends = radii.select("feature", "here", "r", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    none = F.lit(None).cast("double")
    both = noisy.select("feature", "x", none.alias("here"), none.alias("r"), F.lit(None).cast("int").alias("side")).unionByName(ends.select("feature", (F.col("here") + F.col("side") * F.col("r")).alias("x"), "here", "r", "side"))
    ranks = cut(both.repartitionByRange(n_blocks, "feature", "x").mapInArrow(_ranks, "feature string, part int, n bigint, here double, r double, side int, below bigint"))
    starts = ranks.where("side = 0").select("feature", "part", F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # rows of equal value and radius add up alike, so that they need no key of their own
    inside = ranks.where("side <> 0").join(starts, ["feature", "part"]).groupBy("feature", "here", "r").agg(F.sum(F.col("side") * (F.col("before") + F.col("below"))).alias("m"), F.sum((F.col("side") > 0).cast("bigint")).alias("rows"))
    per_count = inside.groupBy("feature", (F.col("m") / F.col("rows")).cast("bigint").alias("m")).agg(F.sum("rows").alias("rows"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b["rows"].to_numpy() * digamma(np.maximum(b["m"].to_numpy(), 1)), pa.float64())], names=["feature", "s"])

    sums = sums.unionByName(per_count.mapInArrow(add, "feature string, s double"))
    found = {r["feature"]: r["s"] for r in sums.groupBy("feature").agg(F.sum("s").alias("s")).collect()}
    out: dict[str, float | None] = dict.fromkeys(cols)
    for c in found:
        own = np.array([n for (f, _), n in sizes.items() if f == c])
        n = own.sum()
        out[c] = max(0.0, float(digamma(n) + digamma(k) - np.sum(own * digamma(own)) / n - found[c] / n))
    return out


def _need_neighbours(least: int | None, k: int) -> None:
    if least is not None and least <= k:
        raise ValueError(f"a class has no more than {k} rows")


def mutual_info(df: DataFrame, target: str, conti_cols: Sequence[str] | None = None, n_neighbors: int = 3, seed: int = 42, block_rows: int = 1_000_000) -> DataFrame:
    """``feature, estimated_mi``: mutual information of continuous columns with a discrete target by nearest neighbours.

    For each value: radius to its k-th neighbour in its own class, number of values of any class within it. A tiny
    noise breaks ties; rows with a null in either column, and values that aren't finite, take no part; classes of at
    most k rows raise; a feature without values has null.

    Frames of at most ``block_rows`` rows are turned from rows to columns, a task for each feature. In larger ones the
    values of all features are range-partitioned into blocks of about that many. Rows whose neighbours are all in
    their block are done there. For the others (some k of each class at either end of a block, and rows of classes
    that are rare) the neighbours come from the first and last k values of the class in each block, and the values
    inside the radius are counted by the ranks of its two ends among all values of the feature. So the result doesn't
    depend on the blocks.
    """
    cols = list(conti_cols) if conti_cols else infer_conti(df, exclude=[target])
    k = n_neighbors
    known = df.where(F.col(name(target)).isNotNull())
    if len(known.select(F.lit(1)).limit(block_rows + 1).toArrow()) > block_rows:
        found = _in_ranges(known, target, cols, k, seed, block_rows)
    else:
        chunks = known.select(F.col(name(target)).cast("string").alias("t"), *as_numbers(known, cols)).mapInArrow(_chunks(cols), "feature string, labels array<string>, codes binary, x binary")
        rows = chunks.groupBy("feature").applyInArrow(_whole_feature(k, seed), "feature string, estimated_mi double, least bigint").collect()
        _need_neighbours(min((r["least"] for r in rows if r["least"] is not None), default=None), k)
        found = {r["feature"]: r["estimated_mi"] for r in rows}
    return df.sparkSession.createDataFrame([(c, found.get(c)) for c in cols], "feature string, estimated_mi double")


def mutual_info_selector(df: DataFrame, target: str, n_neighbors: int = 3, top_k: int = 50, seed: int = 42) -> DataFrame:
    cols = infer_conti(df, exclude=[target])
    return _keep(df, mutual_info(df, target, cols, n_neighbors, seed), "estimated_mi", top_k, cols)


def _class_sums(shift: np.ndarray, cols: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per class and column: count, mean and mean square of the task's values less ``shift``."""
        sums: dict[str | None, np.ndarray] = {}
        for b in batches:
            z = number_matrix(b.columns[1:]) - shift
            known = np.isfinite(z)
            z[~known] = 0.0
            label = b.column(0).dictionary_encode(null_encoding="encode")
            codes = label.indices.to_numpy(zero_copy_only=False)
            for c, t in enumerate(label.dictionary.to_pylist()):
                own = codes == c
                x = z[own]
                found = np.stack([known[own].sum(0), x.sum(0), np.einsum("ij,ij->j", x, x)])
                sums[t] = sums[t] + found if t in sums else found
        for t, (n, x, q) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.string()), pa.array([t] * len(cols), pa.string()), pa.array(n.astype(np.int64)), pa.array(x), pa.array(q)], names=["feature", "t", "n", "s", "q"])

    return run


def class_moments(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """``feature, t, n, m, v``: count, mean and population variance of the finite values of each column and class.

    A few columns are unpivoted and grouped in the JVM; of more, each task adds up arrays. Means of a wide frame are
    those of the values less one near their middle, the same in all classes.
    """
    if len(cols) <= FEW_COLUMNS:
        return _long(df, target, cols).where("x is not null").groupBy("feature", "t").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    numbers = df.select(F.col(name(target)).cast("string").alias("t"), *as_numbers(df, cols))
    shift = middle_values(numbers.drop("t") if "t" not in cols else df.select(*as_numbers(df, cols)))
    sums = numbers.mapInArrow(_class_sums(shift, list(cols)), "feature string, t string, n bigint, s double, q double")
    total = sums.groupBy("feature", "t").agg(*[F.sum(c).alias(c) for c in "nsq"]).where("n > 0")
    mean = F.col("s") / F.col("n")
    return total.select("feature", "t", "n", mean.alias("m"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)).alias("v"))


def f_classif(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``feature, f_value, p_value`` of a one-way analysis of variance; one class raises.

    From ``class_moments`` of all columns; null, NaN and infinities take no part.
    """
    cols = _numeric(df, target, cols)
    # means near 0 keep the digits of their squares
    per = class_moments(df, target, cols).withColumn("m", F.col("m") - F.avg("m").over(Window.partitionBy("feature")))
    rows = per.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q")).collect()
    out = []
    for r in rows:
        if r["k"] < 2:
            raise ZeroDivisionError("the target has one class")
        between = r["q"] - r["s"] ** 2 / r["n"]
        f = math.inf if r["within"] == 0 else between / r["within"] * (r["n"] - r["k"]) / (r["k"] - 1)
        out.append((r["feature"], f, f_survival(f, r["k"] - 1, r["n"] - r["k"])))
    return df.sparkSession.createDataFrame(out, "feature string, f_value double, p_value double")


def f_score_selector(df: DataFrame, target: str, top_k: int) -> DataFrame:
    cols = _numeric(df, target, None)
    return _keep(df, f_classif(df, target, cols), "f_value", top_k, cols)


def _ks_table(long: DataFrame) -> DataFrame:
    """``feature, ks, n1, n0`` from rows feature, x, side (1 or 0): largest distance of the two distributions.

    Counts of distinct values are summed up over ranges of values of all features together.
    """
    counts = long.where("x is not null").groupBy("feature", "x").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"))
    cum = running(counts, ["x"], {"ca": "a", "cb": "b"}, ["feature"], totals=True)
    gap = F.abs(fdiv(F.col("ca"), F.col("ca_total")) - fdiv(F.col("cb"), F.col("cb_total")))
    return cum.groupBy("feature").agg(F.max(gap).alias("ks"), F.max("ca_total").alias("n1"), F.max("cb_total").alias("n0"))


def _with_p(table: DataFrame) -> DataFrame:
    rows = [(r["feature"], r["ks"], ks_p_value(r["ks"], r["n1"] * r["n0"] / (r["n1"] + r["n0"])) if r["n1"] and r["n0"] else None) for r in table.collect()]
    return table.sparkSession.createDataFrame(rows, "feature string, ks double, p_value double")


def ks_statistic(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``feature, ks, p_value``: two-sample Kolmogorov-Smirnov distance of class 1 and class 0 (asymptotic p)."""
    cols = _numeric(df, target, cols)
    return _with_p(_ks_table(_long(df, target, cols).where("t is not null").select("feature", "x", (F.col("t") == 1).cast("bigint").alias("side"))))


def ks_compare(df: DataFrame, test_cols: Sequence[str] | None = None, skip: int = 0, max_comp: int | None = None) -> DataFrame:
    """``feature_1, feature_2, ks, p_value`` of all pairs of continuous columns, or of ``max_comp`` after the first ``skip``."""
    cols = list(test_cols or infer_conti(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]][skip : None if max_comp is None else skip + max_comp]
    cells = F.array(*[F.struct(F.lit(str(i)).alias("feature"), finite(name(c)).alias("x"), F.lit(s).cast("bigint").alias("side")) for i, p in enumerate(pairs) for c, s in zip(p, (1, 0))])
    found = {r["feature"]: r for r in _with_p(_ks_table(df.select(F.inline(cells)))).collect()} if pairs else {}
    rows = [(*p, found[str(i)]["ks"], found[str(i)]["p_value"]) for i, p in enumerate(pairs) if str(i) in found]
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, ks double, p_value double")


def _normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a published polynomial whose error is at most 7.5e-8, which bounds the distances."""
    t = F.lit(1.0) / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


_CDF = {
    "norm": _normal_cdf,
    "uniform": lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)),
    "expon": lambda x: F.when(x > 0, 1 - F.exp(-x)).otherwise(0.0),
    "logistic": lambda x: 1 / (1 + F.exp(-x)),
    "cauchy": lambda x: 0.5 + F.atan(x) / math.pi,
    "laplace": lambda x: F.when(x < 0, 0.5 * F.exp(x)).otherwise(1 - 0.5 * F.exp(-x)),
}


def _one_sample(df: DataFrame, exprs: dict[str, Column], which: str) -> DataFrame:
    """``feature, ks, p_value`` of columns against a distribution."""
    if which not in _CDF:
        raise ValueError(f"unknown distribution {which}; known: {', '.join(_CDF)}")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), x.alias("x")) for c, x in exprs.items()])
    cum = cumulative_counts(df.select(F.inline(cells)))
    f = _CDF[which](F.col("x"))
    ks = F.greatest(F.col("upto") / F.col("upto_total") - f, f - (F.col("upto") - F.col("n")) / F.col("upto_total"))
    rows = [(r["feature"], r["ks"], ks_p_value(r["ks"], r["n"])) for r in cum.groupBy("feature").agg(F.max(ks).alias("ks"), F.max("upto_total").alias("n")).collect()]
    return df.sparkSession.createDataFrame(rows, "feature string, ks double, p_value double")


def dist_test(df: DataFrame, which_dist: str, cols: Sequence[str] | None = None) -> DataFrame:
    """One-sample Kolmogorov-Smirnov test of numeric columns against a standard distribution (asymptotic p)."""
    cols = list(cols or get_numeric_cols(df))
    return _one_sample(df, {c: finite(name(c)) for c in cols}, which_dist)


def suggest_normal(df: DataFrame, threshold: float = 0.05) -> list[str]:
    """Numeric columns that, standardised, a test doesn't tell from the normal distribution."""
    cols = get_numeric_cols(df)
    r = df.agg(*[a for i, c in enumerate(cols) for a in (F.avg(finite(name(c))).alias(f"m{i}"), F.stddev_samp(finite(name(c))).alias(f"s{i}"))]).first() if cols else None
    scaled = {c: (finite(name(c)) - r[f"m{i}"]) / r[f"s{i}"] for i, c in enumerate(cols) if r[f"s{i}"]}
    found = {x["feature"] for x in _one_sample(df, scaled, "norm").where(F.col("p_value") > threshold).collect()} if scaled else set()
    return [c for c in cols if c in found]


def suggest_uniform(df: DataFrame, threshold: float = 0.05) -> list[str]:
    """Numeric columns that, scaled to [0, 1], a test doesn't tell from the uniform distribution."""
    cols = get_numeric_cols(df)
    r = df.agg(*[a for i, c in enumerate(cols) for a in (F.min(finite(name(c))).alias(f"a{i}"), F.max(finite(name(c))).alias(f"b{i}"))]).first() if cols else None
    scaled = {c: (finite(name(c)) - r[f"a{i}"]) / (r[f"b{i}"] - r[f"a{i}"]) for i, c in enumerate(cols) if r[f"a{i}"] is not None and r[f"b{i}"] > r[f"a{i}"]}
    found = {x["feature"] for x in _one_sample(df, scaled, "uniform").where(F.col("p_value") > threshold).collect()} if scaled else set()
    return [c for c in cols if c in found]


# minimum redundancy, maximum relevance
def relevance_scores(df: DataFrame, target: str, cols: Sequence[str], relevance: str = "f") -> dict[str, float]:
    """Scores by f, mis (mutual information), ks or model (importance of trees); undefined ones are 0."""
    if relevance == "f":
        found = {r["feature"]: r["f_value"] for r in f_classif(df, target, cols).collect()}
    elif relevance in ("mis", "mi", "mutual_info"):
        found = {r["feature"]: r["estimated_mi"] for r in mutual_info(df, target, cols).collect()}
    elif relevance == "ks":
        found = {r["feature"]: r["ks"] for r in ks_statistic(df, target, cols).collect()}
    elif relevance in ("model", "lgbm"):
        from prepline.operators.models import tree_importances

        found = tree_importances(df, target, cols)
    else:
        raise ValueError(f"unknown relevance {relevance}")
    return {c: v if (v := found.get(c)) is not None and math.isfinite(v) else 0.0 for c in cols}


def mrmr_engine(df: DataFrame, k: int, relevance: dict[str, float], strategy: str = "weighted_accum_corr", corr_threshold: float = 0.75) -> list[str]:
    """Picks k features: accum_corr, weighted_accum_corr (earlier picks count more) or knock_out.

    The correlations of all pairs come from one pass; the rounds run on that matrix.
    """
    if any(v < 0 for v in relevance.values()):
        raise ValueError("relevance must not be negative")
    cols = list(relevance)
    most = min(k, len(cols))
    corr = np.abs(correlation_matrix(df, cols))
    corr[np.isnan(corr)] = 1.0
    place = {c: i for i, c in enumerate(cols)}
    of = lambda a, b: corr[place[a], place[b]]
    if strategy == "knock_out":
        left, out = sorted(cols, key=lambda c: -relevance[c]), []
        while left and len(out) < most:
            best, *left = left
            out.append(best)
            left = [c for c in left if of(best, c) < corr_threshold]
        return out
    if strategy not in ("accum_corr", "weighted_accum_corr"):
        raise ValueError(f"unknown strategy {strategy}")
    weight = 1 if strategy == "weighted_accum_corr" else 0
    score, total, left = np.array([relevance[c] for c in cols]), np.zeros(len(cols)), np.ones(len(cols), bool)
    out: list[int] = []
    for j in range(most):
        if j:
            total += (1 - weight * j / k) * corr[:, out[-1]]
        rank = np.where(total > 0, j * score / np.where(total > 0, total, 1.0), np.where(score > 0, np.inf, 0.0)) if j else score
        out.append(int(np.argmax(np.where(left, rank, -1.0))))
        left[out[-1]] = False
    return [cols[i] for i in out]


def mrmr(df: DataFrame, target: str, k: int, cols: Sequence[str] | None = None, relevance: str = "f", mrmr_strategy: str = "weighted_accum_corr", **kwargs) -> list[str]:
    cols = _numeric(df, target, cols)
    return mrmr_engine(df, k, relevance_scores(df, target, cols, relevance), mrmr_strategy, **kwargs)


def woe_iv(df: DataFrame, target: str, cols: Sequence[str] | None = None, min_count: float = 1.0, check_binary: bool = True) -> DataFrame:
    """``feature, value, woe, information_value`` (of the feature, on each of its rows)."""
    _need_binary(df, target, check_binary)
    t = woe_table(df, target, list(cols or get_string_cols(df)), min_count)
    iv = t.groupBy("feature").agg(F.sum((F.col("ev_rate") - F.col("nonev_rate")) * F.col("woe")).alias("information_value"))
    return t.select("feature", "value", "woe").join(iv, "feature")

