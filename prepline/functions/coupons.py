"""How many subsamples are needed until every item was drawn often enough (the coupon collector's problem)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def coverage_probability(spark: SparkSession, trials: int, total: int, subsample: int, times: int, least: int, seed: int = 42) -> float:
    """The share of ``trials`` in which ``times`` subsamples of ``subsample`` out of ``total`` hold every item ``least`` times.

    Trials are rows of a distributed range, each with a generator of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = 0
            for i in b["id"].to_pylist():
                rng = np.random.default_rng([seed, i])
                seen = np.zeros(total, dtype=np.int64)
                for _ in range(times):
                    seen[rng.choice(total, min(subsample, total), replace=False)] += 1
                hit += bool((seen >= least).all())
            yield pa.RecordBatch.from_arrays([pa.array([hit], pa.int64())], names=["hit"])

    return (spark.range(trials).mapInArrow(run, "hit bigint").agg(F.sum("hit")).first()[0] or 0) / max(trials, 1)


def subsamples_needed(spark: SparkSession, trials: int, total: int, subsample: int, least: int, start_at: int = 0, threshold: float = 0.95, seed: int = 42, most: int = 10_000) -> int:
    """The smallest number of subsamples above ``start_at`` whose probability reaches the threshold.

    The number is doubled until it is enough and then halved in; more than ``most`` raises.
    """
    enough = lambda n: coverage_probability(spark, trials, total, subsample, n, least, seed) >= threshold
    low, step = start_at, 1
    while not enough(low + step):
        low, step = low + step, step * 2
        if low > most:
            raise ValueError(f"more than {most} subsamples are needed")
    high = low + step
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high
