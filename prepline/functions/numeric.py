"""Numeric column functions and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from prepline.functions.safe import fdiv


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def abs_diff(x: Column | str, to: Column | str) -> Column:
    """|to - x|."""
    return F.abs(_col(to) - _col(x))


def _std(x: Column, ddof: int) -> Column:
    return F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)


def std_err(x: Column | str, ddof: int = 1) -> Column:
    """Aggregate: standard deviation by the root of the number of rows."""
    return fdiv(_std(_col(x), ddof), F.sqrt(F.count(F.lit(1))))


def harmonic_mean(x: Column | str) -> Column:
    """Aggregate: number of values by the sum of their reciprocals."""
    return fdiv(F.count(_col(x)), F.sum(fdiv(F.lit(1.0), x)))


def rms(x: Column | str) -> Column:
    """Aggregate: root of the mean square."""
    x = _col(x).cast("double")
    return F.sqrt(F.avg(x * x))


def cv(x: Column | str, ddof: int = 1) -> Column:
    """Aggregate: standard deviation by mean."""
    return fdiv(_std(_col(x), ddof), F.avg(_col(x)))


def range_over_mean(x: Column | str) -> Column:
    """Aggregate: range by mean."""
    x = _col(x)
    return fdiv(F.max(x) - F.min(x), F.avg(x))


def frac(x: Column | str) -> Column:
    """x modulo 1."""
    return _col(x) % 1


def _integers(f: np.ufunc, a: Column | str, b: Column | str | int) -> Column:
    @F.arrow_udf("bigint")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            gone = x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False)
            yield pa.array(f(x.fill_null(1).to_numpy(zero_copy_only=False), y.fill_null(1).to_numpy(zero_copy_only=False)), pa.int64(), mask=gone)

    return run(_col(a).cast("bigint"), (F.lit(b) if isinstance(b, int) else _col(b)).cast("bigint"))


def gcd(a: Column | str, b: Column | str | int) -> Column:
    """Greatest common divisor of integers; null if either is null."""
    return _integers(np.gcd, a, b)


def lcm(a: Column | str, b: Column | str | int) -> Column:
    """Least common multiple of integers; null if either is null."""
    return _integers(np.lcm, a, b)


def count_phrases(items: list | bytes) -> int:
    """Lempel-Ziv phrases: the text is cut greedily where a phrase wasn't seen before; an unfinished last one is none."""
    seen: set = set()
    phrase: tuple = ()
    for x in items:
        phrase += (x,)
        if phrase not in seen:
            seen.add(phrase)
            phrase = ()
    return len(seen)


def lempel_ziv_complexity(values: Column | str, as_ratio: bool = False) -> Column:
    """Lempel-Ziv phrases of an array of booleans (null counts as false), or their number by its length.

    The empty array has 0 phrases (ratio null), null gives null.
    """

    @F.arrow_udf("double" if as_ratio else "bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = [None if v is None else [bool(x) for x in v] for v in b.to_pylist()]
            if as_ratio:
                yield pa.array([None if not v else count_phrases(v) / len(v) for v in rows], pa.float64())
            else:
                yield pa.array([None if v is None else count_phrases(v) for v in rows], pa.int64())

    return run(_col(values))
