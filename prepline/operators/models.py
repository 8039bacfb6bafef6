"""Model steps, selection by models, and tuning; trees of the ML library stand for boosted trees."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.functions.safe import finite
from prepline.functions.sqltext import name
from prepline.operators.metrics import log_loss_expr, roc_auc
from prepline.operators.sample import row_numbers, train_test_split
from prepline.plans.steps import Step, recorded
from prepline.session import cut
from prepline.sources import DataCube


class ClassifModel(Protocol):
    """Anything with predict_proba over a matrix."""

    def predict_proba(self, x: Any) -> Any: ...


class RegressionModel(Protocol):
    """Anything with predict over a matrix."""

    def predict(self, x: Any) -> Any: ...


#: Stands for null, NaN and infinities in vectors, which the trees don't take; a split tells it from all numbers.
MISSING = -1e18


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """A vector column of the features; what isn't a finite number becomes ``MISSING``."""
    filled = {f"__f{i}": F.coalesce(finite(name(c)), F.lit(MISSING)) for i, c in enumerate(features)}
    return VectorAssembler(inputCols=list(filled), outputCol=out).transform(df.withColumns(filled)).drop(*filled)


def get_numpy(df: DataFrame, target: str, limit: int = 1_000_000) -> DataCube:
    """Matrix and target as NumPy; for frames of at most ``limit`` rows, else it raises."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"the frame has more than {limit} rows; use assemble")
    features = [c for c in df.columns if c != target]
    return DataCube(rows[features].to_numpy(), rows[target].to_numpy(), features, target)


def _score(df: DataFrame, model: Any, features: Sequence[str], out: str, idx: int | None) -> DataFrame:
    if isinstance(model, Model):
        at = model.getOrDefault("featuresCol")
        scored = model.transform(assemble(df, features, at))
        x = F.col(model.getOrDefault("predictionCol")) if idx is None else F.element_at(vector_to_array(model.getOrDefault("probabilityCol")), idx + 1 if idx >= 0 else idx)
        return scored.select(*[F.col(name(c)) for c in df.columns if c != out], x.alias(out))

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cols in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in cols])
            y = model.predict(x) if idx is None else np.asarray(model.predict_proba(x))[:, idx]
            yield pa.array(np.asarray(y, dtype=float))

    if len(features) == 1:

        @F.arrow_udf("double")
        def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for c in batches:
                x = np.asarray(c.to_numpy(zero_copy_only=False), dtype=float).reshape(-1, 1)
                yield pa.array(np.asarray(model.predict(x) if idx is None else np.asarray(model.predict_proba(x))[:, idx], dtype=float))

        return df.withColumn(out, run_one(F.col(name(features[0])).cast("double")))
    return df.withColumn(out, run(*[F.col(name(c)).cast("double") for c in features]))


def append_classif_score(df: DataFrame, model: Any, features: Sequence[str], score_idx: int = -1, score_col: str = "model_score") -> DataFrame:
    """The probability of one class (the last by default) of an ML model or anything with ``predict_proba``."""
    return _score(df, model, features, score_col, score_idx)


def append_regression(df: DataFrame, model: Any, features: Sequence[str], score_col: str = "model_score") -> DataFrame:
    """The prediction of an ML model or anything with ``predict``."""
    return _score(df, model, features, score_col, None)


def model_step(model: Model, path: str, features: Sequence[str], score_idx: int | None = -1, score_col: str = "model_score") -> Step:
    """Saves an ML model and gives the pipeline step that scores with it (``score_idx`` None: a regression)."""
    model.write().overwrite().save(path)
    return Step("model", {"path": path, "features": list(features), "score_idx": score_idx, "score_col": score_col}, "model")


def apply_model(df: DataFrame, path: str, features: Sequence[str], score_idx: int | None, score_col: str) -> DataFrame:
    return _score(df, DefaultParamsReader.loadParamsInstance(path, df.sparkSession.sparkContext), features, score_col, score_idx)


@recorded
def add_classif(df: DataFrame, model: Model, path: str, features: Sequence[str], score_idx: int = -1, score_col: str = "model_score") -> list[Step]:
    """Recorded classifier step."""
    return [model_step(model, path, features, score_idx, score_col)]


@recorded
def add_regression(df: DataFrame, model: Model, path: str, features: Sequence[str], score_col: str = "model_score") -> list[Step]:
    """Recorded regression step."""
    return [model_step(model, path, features, None, score_col)]


def _fit(df: DataFrame, target: str, features: Sequence[str], params: dict | None = None, seed: int = 42):
    p = {"maxIter": 20, "maxDepth": 4, "seed": seed} | (params or {})
    data = assemble(df.where(F.col(name(target)).isNotNull()), features, "__x").select(F.col(name(target)).cast("double").alias("__y"), "__x")
    return GBTClassifier(labelCol="__y", featuresCol="__x", **p).fit(data)


def _fit_regression(df: DataFrame, target: str, features: Sequence[str], params: dict | None = None, seed: int = 42):
    """The same trees for a numeric target."""
    p = {"maxIter": 20, "maxDepth": 4, "seed": seed} | (params or {})
    data = assemble(df.where(finite(name(target)).isNotNull()), features, "__x").select(finite(name(target)).alias("__y"), "__x")
    return GBTRegressor(labelCol="__y", featuresCol="__x", **p).fit(data)


def tree_importances(df: DataFrame, target: str, cols: Sequence[str], params: dict | None = None) -> dict[str, float]:
    return dict(zip(cols, map(float, _fit(df, target, cols, params).featureImportances.toArray())))


def ebfs(df: DataFrame, target: str, params: dict | None = None, n_comb: int = 3, train_frac: float = 0.75, features: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All combinations of n features: (combination, log loss, AUC, importances), and the same per feature.

    A model is trained for each combination on a kept copy of the split; meant for few features.
    """
    features = list(features or [c for c in df.columns if c != target])
    train, test = (cut(x) for x in train_test_split(df.select(*map(name, [target, *features])), train_frac))
    rows = []
    for comb in itertools.combinations(features, n_comb):
        model = _fit(train, target, comb, params)
        scored = append_classif_score(test, model, comb, score_col="__s")
        loss = scored.agg(log_loss_expr(target, "__s")).first()[0]
        rows.append((list(comb), float(loss), roc_auc(scored, target, "__s"), [float(v) for v in model.featureImportances.toArray()]))
    table = df.sparkSession.createDataFrame(rows, "fc array<string>, logloss double, roc_auc double, importances array<double>")
    each = table.select("logloss", "roc_auc", F.explode(F.arrays_zip("fc", "importances")).alias("z")).groupBy(F.col("z.fc").alias("feature")).agg(F.avg("logloss").alias("avg_logloss"), F.avg("roc_auc").alias("avg_roc_auc"), F.avg("z.importances").alias("avg_fi"), F.max("z.importances").alias("max_fi"))
    return table, each


def ebfs_fc_filter(fc: DataFrame, logloss_threshold: float, roc_auc_threshold: float) -> list[str]:
    """Features of the combinations that pass both thresholds."""
    good = fc.where((F.col("logloss") <= logloss_threshold) & (F.col("roc_auc") >= roc_auc_threshold))
    return sorted(r[0] for r in good.select(F.explode("fc")).distinct().collect())


def permutation_importance(df: DataFrame, target: str, params: dict | None = None, k: int = 5, features: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """``feature, permutation_importance``: AUC less the mean AUC with the feature shuffled, k times with k seeds.

    A column is shuffled by numbering the rows in two random orders and joining on the number.
    """
    features = list(features or [c for c in df.columns if c != target])
    model = _fit(df, target, features, params)
    base = cut(row_numbers(df.select(*map(name, [target, *features])).withColumn("__o", F.rand(seed)), ["__o"], "__n"))
    whole = roc_auc(append_classif_score(base, model, features, score_col="__s"), target, "__s")
    rows = []
    for i, f in enumerate(features):
        total = 0.0
        for j in range(k):
            other = row_numbers(base.select(F.col(name(f)).alias("__v"), F.xxhash64(F.lit(seed + 1 + i * k + j), "__n").alias("__h")), ["__h"], "__n")
            mixed = base.drop(f).join(other.select("__n", F.col("__v").alias(f)), "__n")
            total += roc_auc(append_classif_score(mixed, model, features, score_col="__s"), target, "__s")
        rows.append((f, whole - total / k))
    return df.sparkSession.createDataFrame(rows, "feature string, permutation_importance double")


def suggest_hyperparams(df: DataFrame, target: str, features: Sequence[str] | None = None, max_trials: int = 10, metric: str = "log_loss", train_frac: float = 0.75, seed: int = 42) -> tuple[dict, DataFrame]:
    """Random search of tree parameters on one split: (best parameters, table of trials)."""
    rng = random.Random(seed)
    features = list(features or [c for c in df.columns if c != target])
    train, test = (cut(x) for x in train_test_split(df.select(*map(name, [target, *features])), train_frac, seed))
    rows = []
    for t in range(max_trials):
        p = {"maxDepth": rng.randint(2, 6), "maxIter": rng.choice([10, 20, 30]), "stepSize": round(10 ** rng.uniform(-2, -0.3), 4), "subsamplingRate": round(rng.uniform(0.5, 1), 3)}
        scored = append_classif_score(test, _fit(train, target, features, p, seed), features, score_col="__s")
        value = float(scored.agg(log_loss_expr(target, "__s")).first()[0]) if metric == "log_loss" else roc_auc(scored, target, "__s")
        rows.append((t, value, {k: float(v) for k, v in p.items()}, p))
    best = min(rows, key=lambda r: r[1] if metric == "log_loss" else -r[1])
    return best[3], df.sparkSession.createDataFrame([r[:3] for r in rows], "trial int, value double, params map<string,double>")
