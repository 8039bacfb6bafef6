"""Recorded steps as a transformer of the ML library."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from prepline.plans.pipeline import Pipeline


class StepsTransformer(Transformer):
    """Applies a pipeline; errors are raised. Remembers the names it was given and gave."""

    def __init__(self, pipeline: Pipeline):
        super().__init__()
        self.pipeline = pipeline
        self._names: tuple[list[str], list[str]] = ([], [])

    def fit(self, df: DataFrame) -> StepsTransformer:
        self._names = (df.columns, self.pipeline.apply(df).columns)
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.pipeline.apply(df)
        self._names = (df.columns, out.columns)
        return out

    def get_feature_names_in(self) -> list[str]:
        return self._names[0]

    def get_feature_names_out(self) -> list[str]:
        return self._names[1]
