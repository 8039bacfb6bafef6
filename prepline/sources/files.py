"""Reading and writing files by their format, and frames as matrices."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "orc", "text")


def format_of(path: str) -> str:
    """The format by the ending of a path, also before ``.gz`` and the like; raises for unknown ones."""
    parts = path.rstrip("/").lower().split(".")
    found = next((p for p in reversed(parts[1:]) if p in FORMATS), None)
    if found is None:
        raise ValueError(f"no known format in the name {path}")
    return found


def scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None, stream: bool = False, **options: Any) -> DataFrame:
    """A lazy frame of a file or folder; CSV has a header unless told otherwise.

    Give a schema for CSV and JSON at scale: else the files are read once more to infer it. Streams need one.
    """
    kind = options.pop("format", None) or format_of(path)
    if kind == "csv":
        options = {"header": True, "inferSchema": schema is None} | options
    reader = (spark.readStream if stream else spark.read).format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: Any) -> None:
    """Writes a frame in the format of the path's ending."""
    kind = options.pop("format", None) or format_of(path)
    if kind == "csv":
        options = {"header": True} | options
    w = df.write.format(kind).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


@dataclass
class DataCube:
    """A matrix, its target and the names of both, on the driver."""

    x: Any
    y: Any
    features: list[str]
    target: str

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The frame again, target first."""
        if len(self.x) != len(self.y):
            raise ValueError("matrix and target differ in their rows")
        import pandas as pd

        return spark.createDataFrame(pd.concat([pd.Series(self.y, name=self.target), pd.DataFrame(self.x, columns=self.features)], axis=1))


def release(df: DataFrame) -> DataFrame:
    """Gives up what is kept of a frame, as a step between others."""
    return df.unpersist()
