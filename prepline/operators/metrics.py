"""Metrics of classifiers, regressors and time series, drift and similarity.

Actual and predicted values are two columns of a frame. Rows in which either is null take no part; NaN is a value
of its own and, where order matters, above all others.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.functions.safe import fdiv, finite, flog
from prepline.functions.sqltext import lit, name
from prepline.operators.encode import check_binary_target, interval_sql
from prepline.operators.quantiles import column_quantiles, running
from prepline.plans.steps import Step, lookup_step, recorded


@dataclass(frozen=True)
class BinaryClassifMetrics:
    auc: float
    log_loss: float
    brier_loss: float
    max_abs_error: float


@dataclass(frozen=True)
class RegressionMetrics:
    mae: float
    mse: float
    rmse: float
    rmsle: float
    r2: float
    huber_loss: float
    max_abs_error: float


@dataclass(frozen=True)
class TimeSeriesMetrics:
    mse: float
    mape: float
    smape: float
    max_abs_error: float


@recorded
def get_sample_weight(df: DataFrame, y: str, strategy: str = "balanced", weight_dict: Mapping | None = None, weight_col: str = "weight") -> list[Step]:
    """Weights of rows: balanced (n / (classes * count of the class)), none (1), or custom by class."""
    if strategy == "none":
        return [Step("with_columns", {weight_col: "1.0D"})]
    if strategy == "custom":
        if not weight_dict:
            raise ValueError("custom weights need a dictionary")
        return [Step("with_columns", {weight_col: f"CASE {' '.join(f'WHEN {name(y)} = {lit(k)} THEN {lit(float(v))}' for k, v in weight_dict.items())} END"})]
    if strategy != "balanced":
        raise ValueError(f"unknown strategy {strategy}")
    counts = df.groupBy(name(y)).agg(F.count(F.lit(1)).alias("n"))
    r = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    return [lookup_step(counts.withColumn("w", F.lit(float(r[0] or 0)) / (F.lit(float(r[1])) * F.col("n"))), [y], {weight_col: "w"})]


def _pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.select(F.col(name(actual)).alias("y"), F.col(name(predicted)).alias("p")).where("y is not null and p is not null")


def tp_fp_frame(df: DataFrame, actual: str, predicted: str, ratio: bool = True) -> DataFrame:
    """Per distinct prediction, in order: counts, tp, fp and precision, or the rates tpr and fpr.

    Running sums are made inside ranges of thresholds, see ``running``, so no task sees all of them.
    """
    counts = _pairs(df, actual, predicted).groupBy(F.col("p").alias("threshold")).agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col("y").cast("bigint")).alias("pos"))
    run = running(counts, ["threshold"], {"cum_cnt": "cnt", "cum_pos": "pos"})
    total = run.agg(F.sum("cnt").alias("n"), F.sum("pos").alias("p")).first()
    n, p = total["n"] or 0, total["p"] or 0
    full = (
        run.withColumn("predicted_positive", F.lit(n) - F.col("cum_cnt") + F.col("cnt"))
        .withColumn("tp", F.lit(p) - F.col("cum_pos") + F.col("pos"))
        .withColumn("fp", F.col("predicted_positive") - F.col("tp"))
    )
    if ratio:
        return full.select("threshold", fdiv(F.col("tp"), F.lit(p)).alias("tpr"), fdiv(F.col("fp"), F.lit(n - p)).alias("fpr"))
    return full.select("threshold", F.col("cnt").alias("predicted_cnt_at_threshold"), F.col("pos").alias("pos_cnt_at_threshold"), "predicted_positive", "tp", "fp", fdiv(F.col("tp"), F.col("predicted_positive")).alias("precision"), fdiv(F.col("tp"), F.lit(p)).alias("recall"))


def precision_recall(df: DataFrame, actual: str, predicted: str, beta: float = 1.0, around: float | None = None, classes: Sequence | None = None) -> DataFrame:
    """``threshold, predicted_cnt_at_threshold, pos_cnt_at_threshold, recall, precision, F_<beta>``.

    ``around`` keeps thresholds within 0.02 of it. With ``classes``, ``predicted`` is an array with one score for
    each class and ``class_no`` comes with the rows.
    """
    if classes is not None:
        parts = [
            precision_recall(df.select((F.col(name(actual)) == F.lit(c)).cast("int").alias("y"), F.col(name(predicted))[i].alias("p")), "y", "p", beta, around).select(F.lit(i).alias("class_no"), "*") for i, c in enumerate(classes)
        ]
        return functools.reduce(DataFrame.unionByName, parts)
    t = tp_fp_frame(df, actual, predicted, ratio=False)
    if around is not None:
        t = t.where(F.col("threshold").between(around - 0.02, around + 0.02))
    p, r, b = F.col("precision"), F.col("recall"), beta * beta
    return t.select("threshold", "predicted_cnt_at_threshold", "pos_cnt_at_threshold", "recall", "precision", fdiv((b + 1) * p * r, b * p + r).alias(f"F_{beta:.2f}"))


def roc_auc_frame(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``auc`` as one row: the share of pairs of a positive and a negative in order, ties as half."""
    counts = _pairs(df, actual, predicted).groupBy("p").agg(F.sum((F.col("y") == 1).cast("bigint")).alias("pos"), F.sum((F.col("y") != 1).cast("bigint")).alias("neg"))
    run = running(counts, ["p"], {"below": "neg"})
    return run.agg(fdiv(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc_auc(df: DataFrame, actual: str, predicted: str, classes: Sequence | None = None, strategy: str = "balanced") -> float:
    """Exact area under the ROC curve; NaN with one class. Several classes: mean, or weighted by class counts."""
    if classes is None:
        v = roc_auc_frame(df, actual, predicted).first()[0]
        return math.nan if v is None else v
    aucs = [roc_auc(df.select((F.col(name(actual)) == F.lit(c)).cast("int").alias("y"), F.col(name(predicted))[i].alias("p")), "y", "p") for i, c in enumerate(classes)]
    if strategy != "weighted":
        return sum(aucs) / len(aucs)
    n = {r[0]: r[1] for r in df.groupBy(name(actual)).count().collect()}
    return sum(a * n.get(c, 0) for a, c in zip(aucs, classes)) / max(sum(n.get(c, 0) for c in classes), 1)


def mean_of(loss: Column, weight: str | None = None) -> Column:
    """Aggregate: mean of a loss, or mean weighted by a column."""
    return F.avg(loss) if weight is None else fdiv(F.sum(loss * F.col(name(weight))), F.sum(F.when(loss.isNotNull(), F.col(name(weight)))))


def _yp(actual: str, predicted: str) -> tuple[Column, Column]:
    a, p = F.col(name(actual)).cast("double"), F.col(name(predicted)).cast("double")
    both = a.isNotNull() & p.isNotNull()
    return F.when(both, a), F.when(both, p)


# Aggregate expressions; each goes with any others into one pass.
def log_loss_expr(actual: str, predicted: str, weight: str | None = None) -> Column:
    y, p = _yp(actual, predicted)
    return mean_of(-F.when(y == 1, flog(p)).when(y == 0, flog(1 - p)).otherwise(y * flog(p) + (1 - y) * flog(1 - p)), weight)


def mse_expr(actual: str, predicted: str, weight: str | None = None) -> Column:
    y, p = _yp(actual, predicted)
    return mean_of((y - p) * (y - p), weight)


def mae_expr(actual: str, predicted: str, weight: str | None = None) -> Column:
    y, p = _yp(actual, predicted)
    return mean_of(F.abs(y - p), weight)


def rmse_expr(actual: str, predicted: str, weight: str | None = None) -> Column:
    return F.sqrt(mse_expr(actual, predicted, weight))


def rmsle_expr(actual: str, predicted: str) -> Column:
    y, p = _yp(actual, predicted)
    d = flog(1 + p) - flog(1 + y)
    return F.sqrt(F.avg(d * d))


def max_abs_error_expr(actual: str, predicted: str) -> Column:
    y, p = _yp(actual, predicted)
    return F.max(F.abs(y - p))


def mape_expr(actual: str, predicted: str, weighted: bool = False) -> Column:
    y, p = _yp(actual, predicted)
    return fdiv(F.sum(F.abs(y - p)), F.sum(F.abs(y))) if weighted else F.avg(F.abs(fdiv(y - p, y)))


def smape_expr(actual: str, predicted: str, double_sum: bool = False) -> Column:
    y, p = _yp(actual, predicted)
    top, low = F.abs(y - p), F.abs(y) + F.abs(p)
    if double_sum:
        return fdiv(F.sum(top), F.sum(low))
    return 100 * fdiv(F.sum(F.when(low > 0, fdiv(top, low)).when(low == 0, 0.0)), F.count(y))


def r2_expr(actual: str, predicted: str) -> Column:
    y, p = _yp(actual, predicted)
    return 1 - fdiv(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def huber_loss_expr(actual: str, predicted: str, delta: float, weight: str | None = None) -> Column:
    y, p = _yp(actual, predicted)
    d = F.abs(y - p)
    return mean_of(F.when(d < delta, 0.5 * d * d).when(d.isNotNull(), delta * (d - delta / 2)), weight)


def _value(df: DataFrame, e: Column) -> float:
    v = df.agg(e).first()[0]
    return math.nan if v is None else v


def log_loss(df: DataFrame, actual: str, predicted: str, weight: str | None = None, check_binary: bool = False) -> float:
    """Mean log loss without clipping; NaN of an empty frame, as for all metrics here."""
    if check_binary and not check_binary_target(df, actual):
        raise ValueError(f"{actual} must hold 0 and 1 and nothing else")
    return _value(df, log_loss_expr(actual, predicted, weight))


def mse(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> float:
    return _value(df, mse_expr(actual, predicted, weight))


l2_loss = brier_loss = mse


def rmse(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> float:
    return _value(df, rmse_expr(actual, predicted, weight))


def rmsle(df: DataFrame, actual: str, predicted: str) -> float:
    return _value(df, rmsle_expr(actual, predicted))


def mae(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> float:
    return _value(df, mae_expr(actual, predicted, weight))


l1_loss = mae


def max_abs_error(df: DataFrame, actual: str, predicted: str) -> float:
    return _value(df, max_abs_error_expr(actual, predicted))


def mape(df: DataFrame, actual: str, predicted: str, weighted: bool = False) -> float:
    return _value(df, mape_expr(actual, predicted, weighted))


def smape(df: DataFrame, actual: str, predicted: str, double_sum: bool = False) -> float:
    return _value(df, smape_expr(actual, predicted, double_sum))


def r2(df: DataFrame, actual: str, predicted: str) -> float:
    return _value(df, r2_expr(actual, predicted))


def adjusted_r2(df: DataFrame, actual: str, predicted: str, p: int) -> float:
    y, _ = _yp(actual, predicted)
    r = df.agg(r2_expr(actual, predicted), F.count(y)).first()
    return 1 - (1 - r[0]) * (r[1] - 1) / (r[1] - 1 - p) if r[0] is not None and r[1] - 1 - p else math.nan


def huber_loss(df: DataFrame, actual: str, predicted: str, delta: float, weight: str | None = None) -> float:
    return _value(df, huber_loss_expr(actual, predicted, delta, weight))


def grouped_binary_metrics(df: DataFrame, actual: str, predicted: str, check_binary: bool = True) -> BinaryClassifMetrics:
    if check_binary and not check_binary_target(df.where(f"{name(actual)} is not null"), actual):
        raise ValueError(f"{actual} must hold 0 and 1 and nothing else")
    r = df.agg(log_loss_expr(actual, predicted), mse_expr(actual, predicted), max_abs_error_expr(actual, predicted)).first()
    return BinaryClassifMetrics(roc_auc(df, actual, predicted), *r)


def grouped_regression_metrics(df: DataFrame, actual: str, predicted: str, delta: float) -> RegressionMetrics:
    """All in one pass."""
    one = (mae_expr, mse_expr, rmse_expr, rmsle_expr, r2_expr)
    return RegressionMetrics(*df.agg(*[f(actual, predicted) for f in one], huber_loss_expr(actual, predicted, delta), max_abs_error_expr(actual, predicted)).first())


def grouped_time_series_metrics(df: DataFrame, actual: str, predicted: str) -> TimeSeriesMetrics:
    """All in one pass."""
    return TimeSeriesMetrics(*df.agg(*[f(actual, predicted) for f in (mse_expr, mape_expr, smape_expr, max_abs_error_expr)]).first())


# drift
def psi_discrete_table(expected: DataFrame, c1: str, actual: DataFrame, c2: str, clip: float = 1e-5) -> DataFrame:
    """``value, expected%, actual%, psi``: categories of either side, shares at least ``clip``."""
    a = expected.groupBy(F.col(name(c1)).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("a"))
    b = actual.groupBy(F.col(name(c2)).cast("string").alias("value_b")).agg(F.count(F.lit(1)).alias("b"))
    na, nb = expected.count(), actual.count()
    both = a.join(b, F.col("value").eqNullSafe(F.col("value_b")), "full").select(F.coalesce("value", "value_b").alias("value"), F.greatest(F.coalesce("a", F.lit(0)) / F.lit(max(na, 1)), F.lit(clip)).alias("e"), F.greatest(F.coalesce("b", F.lit(0)) / F.lit(max(nb, 1)), F.lit(clip)).alias("s"))
    return both.select("value", F.col("e").alias("expected%"), F.col("s").alias("actual%"), ((F.col("e") - F.col("s")) * F.log(F.col("e") / F.col("s"))).alias("psi"))


def psi_discrete(expected: DataFrame, c1: str, actual: DataFrame, c2: str) -> float:
    return psi_discrete_table(expected, c1, actual, c2).agg(F.sum("psi")).first()[0] or 0.0


def psi_table(expected: DataFrame, c1: str, actual: DataFrame, c2: str, n_bins: int = 10, clip: float = 1e-5) -> DataFrame:
    """``range, expected%, actual%, psi`` over the quantile bins of the expected values; empty bins are clipped."""
    x, y = finite(name(c1)), finite(name(c2))
    cuts = column_quantiles(expected, [c1], [k / n_bins for k in range(1, n_bins)])[c1]
    if not cuts:
        raise ValueError(f"{c1} has no values")
    a = expected.select(x.alias("x")).where("x is not null").groupBy(F.expr(interval_sql("x", cuts)).alias("range")).agg(F.count(F.lit(1)).alias("a"))
    b = actual.select(y.alias("x")).where("x is not null").groupBy(F.expr(interval_sql("x", cuts)).alias("range")).agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, "range", "full").na.fill(0)
    total = j.agg(F.sum("a"), F.sum("b")).first()
    e, s = F.greatest(F.col("a") / F.lit(max(total[0] or 1, 1)), F.lit(clip)), F.greatest(F.col("b") / F.lit(max(total[1] or 1, 1)), F.lit(clip))
    return j.select("range", e.alias("expected%"), s.alias("actual%"), ((e - s) * F.log(e / s)).alias("psi"))


def psi(expected: DataFrame, c1: str, actual: DataFrame, c2: str, n_bins: int = 10) -> float:
    return psi_table(expected, c1, actual, c2, n_bins).agg(F.sum("psi")).first()[0] or 0.0


# similarity
def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; NaN with a zero vector, null with null or unequal lengths."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) == F.size(b), fdiv(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def cosine_dist(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine_similarity(a, b)


def cosine_matrix(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, query_rows: int = 512, base_rows: int = 4096) -> DataFrame:
    """``id_a, id_b, similarity`` of a stated set of query vectors against all vectors of a table.

    Both sides are gathered into blocks of about ``query_rows`` and ``base_rows`` vectors, every block of queries
    is sent to every block of the table, and two blocks are multiplied as matrices. Rows are dealt to blocks by
    their place, so repeated ids don't fill one block. Null vectors have no rows; zero vectors give NaN.
    """

    def blocks(df: DataFrame, rows: int, side: str) -> tuple[DataFrame, int]:
        known = df.select(F.col(name(id_col)).alias("id"), F.col(name(vec_col)).cast("array<double>").alias("v")).where("v is not null")
        n = max(1, math.ceil(known.count() / rows))
        dealt = known.withColumn(side, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
        return dealt.groupBy(side).agg(F.collect_list("id").alias(f"ids_{side}"), F.flatten(F.collect_list("v")).alias(f"vs_{side}")), n

    b, n_blocks = blocks(base, base_rows, "b")
    q, _ = blocks(queries, query_rows, "a")
    pairs = q.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint")))).join(b, "b").select("ids_a", "vs_a", "ids_b", "vs_b")
    kind = f"id_a {queries.schema[id_col].dataType.simpleString()}, id_b {base.schema[id_col].dataType.simpleString()}, similarity double"

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids = [batch[f"ids_{k}"][i].values for k in "ab"]
                x, y = (batch[f"vs_{k}"][i].values.to_numpy(zero_copy_only=False).reshape(len(v), -1) for k, v in zip("ab", ids))
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
                left, right = np.repeat(np.arange(len(ids[0])), len(ids[1])), np.tile(np.arange(len(ids[1])), len(ids[0]))
                yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(left)), ids[1].take(pa.array(right)), pa.array(s.ravel())], names=["id_a", "id_b", "similarity"])

    return pairs.mapInArrow(multiply, kind)


def jaccard_similarity(df1: DataFrame, c1: str, df2: DataFrame, c2: str, include_null: bool = False) -> float:
    """Jaccard similarity of the sets of values of two columns; 0 if both are empty."""
    a = df1.select(F.col(name(c1)).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = df2.select(F.col(name(c2)).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    if a.schema["v"].dataType != b.schema["v"].dataType:
        raise TypeError(f"{a.schema['v'].dataType} and {b.schema['v'].dataType} can't be compared")
    u = a.unionByName(b)
    u = u if include_null else u.where("v is not null")
    r = u.groupBy("v").agg(F.max("a").alias("a"), F.max("b").alias("b")).agg(F.sum(F.col("a") * F.col("b")), F.count(F.lit(1))).first()
    return r[0] / r[1] if r[1] else 0.0


@recorded
def df_jaccard_similarity(df: DataFrame, c1: str, c2: str, include_null: bool = True) -> list[Step]:
    """Row-wise Jaccard similarity of two lists as ``<c1>_<c2>_jaccard``; of two empty lists 0, of null lists null."""
    a, b = (f"ARRAY_DISTINCT({name(c)})" if include_null else f"ARRAY_EXCEPT({name(c)}, ARRAY(NULL))" for c in (c1, c2))
    return [Step("with_columns", {f"{c1}_{c2}_jaccard": f"CASE WHEN {name(c1)} IS NOT NULL AND {name(c2)} IS NOT NULL THEN COALESCE(TRY_DIVIDE(SIZE(ARRAY_INTERSECT({a}, {b})), SIZE(ARRAY_UNION({a}, {b}))), 0D) END"})]

