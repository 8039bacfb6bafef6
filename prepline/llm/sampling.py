"""Samples that match target shares of categories, by calibration and the pivotal method."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.session import cut

#: Newton steps; each brings the tilt nearer by 1 or, close to the solution, squares the error.
STEPS = 60


@dataclass(frozen=True)
class PlannedSample:
    """``sample``: plan_id, id, category. ``report``: one row per line of a plan, see ``sample_plans``."""

    sample: DataFrame
    report: DataFrame


def tilt(moment: Column, target: Column) -> Column:
    """The exponent by which every record of a category is tilted so that the weights add up to the target.

    Newton on the dual ``moment * exp(x) - target * x`` from 0 (all weights 1), with steps of at most 1. Above 0
    the category would need weights over 1: it has too few records. Null if there are none or none are wanted.
    """
    n, t = moment.cast("double"), target.cast("double")
    step = lambda x, _: x - F.greatest(F.lit(-1.0), F.lit(1.0) - t / (n * F.exp(x)))
    return F.when((n > 0) & (t > 0), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step))


def _duels(group: np.ndarray, mass: np.ndarray, whole: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The pivotal method as rounds of duels inside groups (``group`` is sorted): new masses.

    A probability is a whole number ``mass`` out of ``whole`` (the same in a group), so no sum is ever rounded: a
    duel of two keeps their sum and both expectations and decides at least one of them (0 or ``whole``). At the end
    a group has at most one undecided member, and none if its masses add up to a multiple of ``whole``.
    """
    mass = mass.copy()
    open_ = np.flatnonzero((mass > 0) & (mass < whole))
    while len(open_) > 1:
        g = group[open_]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        a = np.flatnonzero((rank[:-1] % 2 == 0) & (g[1:] == g[:-1]))
        if not len(a):
            break
        i, j = open_[a], open_[a + 1]
        x, y, w = mass[i], mass[j], whole[i]
        s = x + y
        low = s < w  # below it the loser gets 0, else the winner gets all of ``whole``
        i_wins = np.where(low, draw.integers(0, s) < x, draw.integers(0, np.where(low, 1, 2 * w - s)) < w - y)
        top, rest = np.where(low, s, w), np.where(low, 0, s - w)
        mass[i], mass[j] = np.where(i_wins, top, rest), np.where(i_wins, rest, top)
        open_ = open_[(mass[open_] > 0) & (mass[open_] < whole[open_])]
    return mass


_DUEL = pa.schema([("plan_id", pa.int64()), ("category", pa.string()), ("id", pa.int64()), ("mass", pa.int64()), ("whole", pa.int64()), ("u", pa.int64())])


def _starts(t: pa.Table) -> np.ndarray:
    """Whether each row of a sorted table is the first of its plan and category; nulls are equal."""
    change = np.zeros(len(t), bool)
    change[:1] = True
    for c in ("plan_id", "category"):
        codes = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return change


def _pivotal(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by plan_id and category: emits the chosen (mass = whole) and the undecided one of each line.

        A batch is worked off with the one row of the line it starts in the middle of that is still undecided, so
        a task holds one batch, however many lines or rows of a line it has.
        """
        left: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).cast(_DUEL)
            t = t if left is None else pa.concat_tables([left, t])
            group = np.cumsum(_starts(t))
            whole = t["whole"].to_numpy()
            draw = np.random.default_rng([seed & 0xFFFFFFFF, int(t["u"][0].as_py()) & 0xFFFFFFFF, len(t)])
            mass = _duels(group, t["mass"].to_numpy(), whole, draw)
            t = t.set_column(t.schema.get_field_index("mass"), "mass", pa.array(mass))
            stays = (mass > 0) & (mass < whole) & (group == group[-1])
            yield from t.filter(pa.array((mass > 0) & ~stays)).to_batches()
            left = t.filter(pa.array(stays)) if stays.any() else None
        if left is not None:
            yield from left.to_batches()

    return run


def sample_plans(df: DataFrame, plans: DataFrame, id_col: str = "id", part_col: str = "load_id", category_col: str = "clicked_on_ad", seed: int = 42) -> PlannedSample:
    """Draws the sample of every plan from the distinct ids of its part (load).

    ``plans`` has plan_id, ``part_col``, category (text; ``none`` for null), target_share, min_rows, sample_size.
    A line requires the larger of target_share * sample_size (rounded half up) and min_rows (null: 0) distinct
    ids of its category; the ids of a category are drawn with equal probabilities and the count of each line is
    met exactly, or by all ids there are.

    The report has plan_id, ``part_col``, category, required, available (distinct ids of the part with that
    category in any row), tilt, probability, sampled, gap (required - sampled) and short (required > available,
    which the tilt above 0 finds).

    An id with rows of several categories in a part counts as available in each but is drawn at most once, under
    the category with the fewest ids (of equal ones the smaller name). A null plan is a plan. Null shares and sizes are 0, repeated
    lines of a plan one line with the sum of shares and the largest minimum and size; lines of parts without
    rows have nothing available, so without rows every line is short that requires any; null ids are no records;
    repeated rows are one record. Ids of categories without a line are never drawn. Other columns are ignored,
    whatever their names.

    Category moments are counted before the shuffle. Duels are held where the rows lie, sorted by line; only the at
    most one undecided id of each task and line is moved, so a part with a third of all rows is no task of its own.
    A probability is kept as a whole number out of the category's ids, so that it may be as small or as near to 1
    as it likes: the masses of a line add up to exactly ``required`` times those ids, also after every duel.
    """
    seen = (
        df.where(F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{part_col}`").alias("part"), F.col(f"`{id_col}`").alias("id"))
        .agg(F.collect_set(F.coalesce(F.col(f"`{category_col}`").cast("string"), F.lit("none"))).alias("cats"))
    )
    units = cut(seen)
    available = units.select("part", F.explode("cats").alias("category")).groupBy("part", "category").agg(F.count(F.lit(1)).alias("available"))
    several = units.where(F.size("cats") > 1).select("part", "id", F.explode("cats").alias("category")).join(available, ["part", "category"])
    several = several.groupBy("part", "id").agg(F.min(F.struct("available", "category"))["category"].alias("category"))
    own = units.where(F.size("cats") == 1).select("part", "id", F.col("cats")[0].alias("category")).unionByName(several)
    moments = own.groupBy("part", "category").agg(F.count(F.lit(1)).alias("moment"))
    lines = (
        plans.groupBy("plan_id", F.col(f"`{part_col}`").alias("part"), "category")
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("min_rows", F.lit(0))).alias("least"), F.max(F.coalesce("sample_size", F.lit(0))).alias("size"))
        .withColumn("required", F.greatest(F.floor(F.col("share") * F.col("size") + 0.5), F.col("least").cast("bigint")))
        .join(available, ["part", "category"], "left")
        .join(moments, ["part", "category"], "left")
        .withColumns({"available": F.coalesce("available", F.lit(0)), "moment": F.coalesce("moment", F.lit(0))})
        .withColumn("tilt", tilt(F.col("available"), F.col("required")))
        .withColumn("probability", F.when((F.col("required") > 0) & (F.col("moment") > 0), F.least(F.lit(1.0), F.exp(tilt(F.col("moment"), F.col("required"))))).otherwise(0.0))
    )
    mass = F.least(F.col("moment"), F.greatest(F.lit(1), F.round(F.col("probability") * F.col("moment")).cast("bigint")))
    wanted = lines.where("probability > 0").select("plan_id", "part", "category", mass.alias("mass"), F.col("moment").alias("whole"))
    kind = "plan_id bigint, category string, id bigint, mass bigint, whole bigint, u bigint"
    line, order = ["plan_id", "category"], ["plan_id", "category", "u", "id"]
    drawn = own.join(wanted, ["part", "category"]).select(F.col("plan_id").cast("bigint"), "category", F.col("id").cast("bigint"), "mass", "whole", F.xxhash64(F.lit(seed), "plan_id", "id").alias("u"))
    decided = cut(drawn.sortWithinPartitions(*order).mapInArrow(_pivotal(seed), kind))
    last = decided.where("mass < whole").repartition(*line).sortWithinPartitions(*order).mapInArrow(_pivotal(seed + 1), kind)
    sample = decided.where("mass = whole").unionByName(last.where("mass = whole")).select("plan_id", "id", "category")
    counts = sample.groupBy("plan_id", "category").agg(F.count(F.lit(1)).alias("sampled"))
    report = (
        lines.alias("l")
        .join(counts.alias("c"), F.col("l.plan_id").eqNullSafe(F.col("c.plan_id")) & (F.col("l.category") == F.col("c.category")), "left")
        .select("l.*", "sampled")
        .withColumn("sampled", F.coalesce("sampled", F.lit(0)))
        .withColumn("gap", F.col("required") - F.col("sampled"))
        .withColumn("short", (F.col("gap") > 0) & ((F.col("tilt") > 0) | (F.col("available") == 0)) & (F.col("required") > F.col("available")))
        .select("plan_id", F.col("part").alias(part_col), "category", "required", "available", "tilt", "probability", "sampled", "gap", "short")
    )
    return PlannedSample(sample, report)
