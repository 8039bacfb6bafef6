"""Filling missing values from records of the same group and month, by mixed effects with shrinkage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepline.session import cut

#: Records that the prior of a category weighs as much as.
PRIOR_WEIGHT = 2.0


def _number(c: str) -> Column:
    """The value if it is a finite number above 0, else null."""
    x = F.col(f"`{c}`").cast("double")
    return F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x)


def _level(c: str) -> Column:
    return F.lower(F.trim(F.col(f"`{c}`")))


def _variances(cells: DataFrame, months: DataFrame, means: Sequence[float]) -> list[tuple[float, float, float]]:
    """For each field the ratios of the residual variance to those of groups, of group-months and of months.

    Moments of a nested analysis of variance, from the cells' sums of differences from the field's mean and their
    sums of squares about their own means, which lose no digits to large values; a few numbers come to the driver.
    """
    aggs, areas, by_month = [], [], []
    square = lambda s, n: F.sum(F.try_divide(s * s, n))
    for i, mean in enumerate(means):
        n, q = F.col(f"n{i}"), F.col(f"q{i}")
        c = F.col(f"s{i}") - n * mean
        areas += [F.sum(n).alias(f"n{i}"), F.sum(c).alias(f"s{i}"), F.sum(q).alias(f"q{i}"), F.count(F.when(n > 0, 1)).alias(f"c{i}"), square(c, n).alias(f"b{i}"), F.sum(n * n).alias(f"m{i}")]
        aggs += [
            F.sum(n).alias(f"N{i}"), F.sum(q).alias(f"Q{i}"), F.sum(f"c{i}").alias(f"C{i}"), F.count(F.when(n > 0, 1)).alias(f"G{i}"), F.sum(f"b{i}").alias(f"B{i}"),
            square(F.col(f"s{i}"), n).alias(f"A{i}"), F.sum(n * n).alias(f"M{i}"), F.sum(F.try_divide(F.col(f"m{i}"), n)).alias(f"K{i}"),
        ]
        m = F.col(f"m_n{i}")
        by_month += [F.count(F.when(m > 0, 1)).alias(f"G{i}"), square(F.col(f"m_s{i}") - m * mean, m).alias(f"A{i}"), F.sum(m * m).alias(f"M{i}")]
    if not means:
        return []
    r, t = cells.groupBy("group").agg(*areas).agg(*aggs).first(), months.agg(*by_month).first()
    out = []
    for i in range(len(means)):
        total, n_cells, groups = r[f"N{i}"] or 0, r[f"C{i}"] or 0, r[f"G{i}"] or 0
        within = (r[f"Q{i}"] or 0.0) / max(total - n_cells, 1)
        size = lambda x, k: max((total - x) / max(k - 1, 1), 1e-9)
        above = lambda x, k, n: max((x or 0.0) / max(k, 1) - within, 0.0) / n
        of_groups = above(r[f"A{i}"], groups - 1, size((r[f"M{i}"] or 0) / max(total, 1), groups))
        of_cells = above((r[f"B{i}"] or 0.0) - (r[f"A{i}"] or 0.0), n_cells - groups, size(r[f"K{i}"] or 0.0, n_cells - groups + 1))
        of_months = above(t[f"A{i}"], t[f"G{i}"] - 1, size((t[f"M{i}"] or 0) / max(total, 1), t[f"G{i}"]))
        out.append(tuple(min(within / v, 1e9) if v > 0 else 1e9 for v in (of_groups, of_cells, of_months)))
    return out


def fit_fills(df: DataFrame, numeric: Sequence[str], levels: Mapping[str, Sequence[str]], group: str, when: str, prior: float = PRIOR_WEIGHT) -> DataFrame:
    """``group, month`` and a prediction ``f{i}`` of each field for every group and month that has a value of it.

    A number is predicted as mean + month effect + group effect + effect of the group in the month, all of them
    shrunk by ratios of variances, so that an effect of few records stays small; a category as the most probable
    level of a multinomial whose counts in the group and month are joined with ``prior`` records spread by the
    main effects of group and month (of equally probable levels the first of ``levels``). Everything comes from
    one table of sums per group and month, counted before the shuffle.
    """
    aggs = []
    for i, c in enumerate(numeric):
        x = _number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{i}"), F.coalesce(F.count(x) * F.var_pop(x), F.lit(0.0)).alias(f"q{i}")]
    fields = range(len(numeric), len(numeric) + len(levels))
    for i, (c, names) in zip(fields, levels.items()):
        aggs += [F.count(F.when(_level(c) == v, 1)).alias(f"k{i}_{j}") for j, v in enumerate(names)]
    keyed = df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{when}`").isNotNull())
    cells = cut(keyed.groupBy(F.col(f"`{group}`").alias("group"), month_of(when).alias("month")).agg(*aggs))

    sums = [c for c in cells.columns if c[0] in "nsk"]
    months = cells.groupBy("month").agg(*[F.sum(c).alias(f"m_{c}") for c in sums])
    by_group = Window.partitionBy("group")  # as many rows as the group has months
    # a calendar has at most 12 months in 9999 years, so this table is small whatever the data
    at = cells.join(F.broadcast(months), "month")
    at = at.select("*", *[F.sum(c).over(by_group).alias(f"g_{c}") for c in sums if c[0] in "nk"])
    numbers = range(len(numeric))
    r = cells.agg(F.count(F.lit(1)), *[F.sum(c).alias(c) for c in sums]).first()
    means = [(r[f"s{i}"] or 0.0) / max(r[f"n{i}"] or 0, 1) for i in numbers]
    moments = _variances(cells, months, means)
    at = at.select("*", *[(means[i] + F.coalesce((F.col(f"m_s{i}") - F.col(f"m_n{i}") * means[i]) / (F.col(f"m_n{i}") + moments[i][2]), F.lit(0.0))).alias(f"e{i}") for i in numbers])
    at = at.select("*", *[F.sum(F.col(f"s{i}") - F.col(f"n{i}") * F.col(f"e{i}")).over(by_group).alias(f"g_r{i}") for i in numbers])
    at = at.select("*", *[(F.col(f"e{i}") + F.col(f"g_r{i}") / (F.col(f"g_n{i}") + moments[i][0])).alias(f"main{i}") for i in numbers])
    found = []
    for i in numbers:
        n, main = F.col(f"n{i}"), F.col(f"main{i}")
        found.append(F.when(n > 0, main + (F.col(f"s{i}") - n * main) / (n + moments[i][1])).alias(f"f{i}"))
    for i, names in zip(fields, levels.values()):
        totals = [float(r[f"k{i}_{j}"] or 0) for j in range(len(names))]
        shares = F.array(*[F.lit((t + 1) / (sum(totals) + len(names))) for t in totals])
        own, of_group, of_month = (F.array(*[F.col(f"{p}k{i}_{j}").cast("double") for j in range(len(names))]) for p in ("", "g_", "m_"))
        smooth = lambda counts: F.zip_with(counts, shares, lambda k, p: k + prior * p)
        at = at.select("*", F.zip_with(F.zip_with(smooth(of_group), smooth(of_month), lambda x, y: x * y), shares, lambda x, p: x / p).alias(f"main{i}"), own.alias(f"own{i}"))
        at = at.select("*", F.aggregate(f"main{i}", F.lit(0.0), lambda x, y: x + y).alias(f"norm{i}"))
        at = at.select("*", F.zip_with(f"own{i}", f"main{i}", lambda k, x: k + prior * x / F.col(f"norm{i}")).alias(f"score{i}"))
        best = F.element_at(F.array(*map(F.lit, names)), F.array_position(f"score{i}", F.array_max(f"score{i}")).cast("int"))
        found.append(F.when(F.exists(f"own{i}", lambda k: k > 0), best).alias(f"f{i}"))
    return at.select("group", "month", *found)


def month_of(when: str) -> Column:
    """The calendar month of a date or time as a number."""
    return (F.year(F.col(f"`{when}`")) * 12 + F.month(F.col(f"`{when}`"))).cast("int")


def missing_mask(c: str, names: Sequence[str] | None = None) -> Column:
    """True where a number isn't finite and above 0, or a category isn't one of ``names`` (case and outer spaces aside)."""
    return ~F.coalesce(_level(c).isin(list(names)), F.lit(False)) if names else _number(c).isNull()


def fill_missing(df: DataFrame, numeric: Sequence[str], levels: Mapping[str, Sequence[str]], group: str, when: str, prior: float = PRIOR_WEIGHT, suffix: str = "_filled") -> DataFrame:
    """``df`` with missing values of its fields filled, and for each field a mask ``<field>_filled``.

    ``levels`` gives the levels of each categorical field in lower case. A value is filled if a record of the
    same group and calendar month has a value of that field; else it stays as it is and its mask is false, as for
    rows without group or time. Values that aren't missing stay exactly as they are. Mask columns replace columns
    of their names; an empty table stays empty; repeated rows are filled alike.

    Only rows with something missing are joined with the predictions (the hot keys of that join are split by
    adaptive execution, the other side has one row per key); all others pass through without a shuffle.
    """
    fields = [*numeric, *levels]
    masks = {c: missing_mask(c, levels.get(c)) for c in fields}
    some = reduce(lambda a, b: a | b, masks.values())
    fills = fit_fills(df, numeric, levels, group, when, prior)
    whole = df.where(~some).withColumns({f"{c}{suffix}": F.lit(False) for c in fields})
    keys = {"__fill_group": F.col(f"`{group}`"), "__fill_month": month_of(when)}
    short = df.where(some).withColumns(keys).join(fills.withColumnsRenamed({"group": "__fill_group", "month": "__fill_month"} | {f"f{i}": f"__fill_{i}" for i in range(len(fields))}), ["__fill_group", "__fill_month"], "left")
    can = {c: masks[c] & F.col(f"__fill_{i}").isNotNull() for i, c in enumerate(fields)}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    short = short.withColumns({f"{c}{suffix}": can[c] for c in fields} | {f"__fill_value_{i}": F.when(can[c], F.col(f"__fill_{i}").cast(kinds[c])).otherwise(F.col(f"`{c}`")) for i, c in enumerate(fields)})
    filled = {c: F.col(f"__fill_value_{i}").alias(c) for i, c in enumerate(fields)}
    return short.select(*[filled.get(c, F.col(f"`{c}`")) for c in whole.columns]).unionByName(whole)


def filled_cells(filled: DataFrame, id_col: str, fields: Sequence[str], suffix: str = "_filled") -> DataFrame:
    """``id_col, field_name``: one row per value that was filled."""
    names = F.array_compact(F.array(*[F.when(F.col(f"`{c}{suffix}`"), F.lit(c)) for c in fields]))
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}{suffix}`") for c in fields])
    return filled.where(some).select(id_col, F.explode(names).alias("field_name"))
