"""Dependencies between columns, and outliers among texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepline.functions.sqltext import name
from prepline.operators.infer import unique_counts
from prepline.operators.schema import get_string_cols, kinds


def conditional_entropies(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``x, y, ce``: the entropy of x given y (natural logarithm) of each pair.

    All pairs are unpivoted as text and counted in one grouping, then summed per value of y; null is a value.
    """
    text = lambda c: F.col(name(c)).cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), text(a).alias("a"), text(b).alias("b")) for i, (a, b) in enumerate(pairs)])
    counts = df.select(F.inline(cells)).groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    # sum n ln(N_b / n) over pairs, from two groupings: sum N_b ln N_b over b less sum n ln n over (a, b)
    by_b = counts.groupBy("i", "b").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("own"))
    total = by_b.groupBy("i").agg(((F.sum(F.col("m") * F.log("m")) - F.sum("own")) / F.sum("m")).alias("ce"))
    names = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    return total.withColumn("p", F.get(names, F.col("i"))).select("p.x", "p.y", F.greatest("ce", F.lit(0.0)).alias("ce"))


def dependency_detection(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.05, return_full_table: bool = False) -> DataFrame:
    """``dependent, depends_on, cond_entropy``: columns that another one (with more values) determines.

    Constants are left out; of two columns the one with fewer distinct values can depend on the other.
    """
    cols = list(cols or [c for c, k in kinds(df).items() if k in ("string", "bool", "numeric")])
    _, found = unique_counts(df, cols)
    order = [c for c in sorted(cols, key=lambda c: found[c][0]) if found[c][0] > 1]
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "dependent string, depends_on string, cond_entropy double")
    table = conditional_entropies(df, pairs).select(F.col("x").alias("dependent"), F.col("y").alias("depends_on"), F.col("ce").alias("cond_entropy"))
    return table if return_full_table else table.where(F.col("cond_entropy") < threshold)


def dependency_dot(table: DataFrame, threshold: float = 0.05) -> str:
    """The dependencies as DOT text, without edges that follow from others; the table has a row per column pair."""
    edges = {(r["depends_on"], r["dependent"]) for r in table.where(F.col("cond_entropy") < threshold).collect()}
    direct = {(a, b) for a, b in edges if not any((a, m) in edges and (m, b) in edges for m in {x for e in edges for x in e} - {a, b})}
    return "digraph dependencies {\n" + "".join(f'  "{a}" -> "{b}";\n' for a, b in sorted(direct)) + "}"


def dependency_violation(df: DataFrame, child: str, parent: str) -> DataFrame:
    """``parent_value, rows, child_values`` (value and count) of parents with more than one child value."""
    counts = df.groupBy(F.col(name(parent)).alias("parent_value"), F.col(name(child)).alias("child_value")).agg(F.count(F.lit(1)).alias("cnt"))
    many = counts.groupBy("parent_value").agg(F.sum("cnt").alias("rows"), F.count(F.lit(1)).alias("n_child_values")).where("n_child_values > 1")
    w = Window.partitionBy("parent_value").orderBy(F.desc("cnt"), "child_value")
    own = counts.join(many.withColumnRenamed("parent_value", "pv"), F.col("parent_value").eqNullSafe(F.col("pv"))).drop("pv")
    return own.withColumn("place", F.row_number().over(w)).select("parent_value", "rows", "n_child_values", "place", "child_value", "cnt")


def str_len_outliers(df: DataFrame, quantile_range: tuple[float, float] = (0.05, 0.95), cols: Sequence[str] | None = None) -> DataFrame:
    """``feature, low, high, avg_len, median_len, outlier, cnt``: values whose byte length is outside the quantiles."""
    cols = list(cols or get_string_cols(df))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(name(c)).alias("value")) for c in cols])
    counts = df.select(F.inline(cells)).where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt")).withColumn("l", F.octet_length("value"))
    points = F.array(F.lit(quantile_range[0]), F.lit(quantile_range[1]), F.lit(0.5))
    stats = counts.groupBy("feature").agg(F.percentile("l", points, F.col("cnt")).alias("q"), (F.sum(F.col("l") * F.col("cnt")) / F.sum("cnt")).alias("avg_len"))
    return counts.join(stats, "feature").where((F.col("l") < F.col("q")[0]) | (F.col("l") > F.col("q")[1])).select("feature", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "avg_len", F.col("q")[2].alias("median_len"), F.col("value").alias("outlier"), "cnt")


def str_pattern_outliers(df: DataFrame, c: str, pattern: str) -> DataFrame:
    """``outlier, cnt``: distinct values that don't match a pattern of the form ``^...$``."""
    if not re.fullmatch(r"\^.*\$", pattern):
        raise ValueError("the pattern must begin with ^ and end with $")
    return df.where(~F.col(name(c)).rlike(pattern)).groupBy(F.col(name(c)).alias("outlier")).agg(F.count(F.lit(1)).alias("cnt"))
