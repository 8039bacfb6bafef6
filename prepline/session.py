"""Session helper and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are tuned for; an existing one is returned as it is.

    ``extra`` takes further settings with dots written as two underscores.
    """
    b = SparkSession.builder.appName("prepline")
    if master:
        b = b.master(master)
    for k, v in CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), str(v))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local master (tests, a laptop) does without that setting: its folder is one of this machine. On a
    cluster each executor would write to a disk of its own and read a part of the files, so it raises there.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "prepline-shared")


_scope: ContextVar[list[str] | None] = ContextVar("tables cut in the innermost cut_scope", default=None)


@contextmanager
def cut_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``cut`` has written inside the block when it is left.

    For long sessions: results that are computed lazily must be written or collected inside.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            _remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table into the shared folder and reads it: lineage ends there.

    The files survive the loss of executors, are compressed by column, and later steps read only the columns
    they use. They are removed when the innermost ``cut_scope`` is left, or without one when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is None:
        atexit.register(_remove, spark, path)
    else:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before
        pass
