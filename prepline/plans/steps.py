"""Fitted steps: what an operator learned from data, as plain values and SQL text.

A fitted operator is a list of steps. Applying a step to another DataFrame is a projection, filter or lookup, so
that it runs on batches and streams alike and can be saved as JSON.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepline.functions.sqltext import lit, name
from prepline.session import cut

#: Entries up to which a lookup is part of the projection; above, it is a join.
INLINE = 200
#: Entries up to which a fitted lookup is kept as values; above, it stays a Parquet table and only its path is kept.
KEPT = 20_000

ACTIONS = ("with_columns", "select", "drop", "filter", "lookup", "rename", "model", "sort")


@dataclass(frozen=True)
class Step:
    """One action and its content. ``label`` names the operator that made it."""

    action: str
    content: Any
    label: str = ""

    def validate(self) -> Step:
        if self.action not in ACTIONS:
            raise ValueError(f"no action is named {self.action}")
        if self.content is None:
            raise ValueError(f"the step {self.action} has no content")
        return self

    def mentions(self, word: str) -> bool:
        """True if the step's content speaks of the column ``word``."""
        c = self.content
        texts = [*c.keys(), *map(str, c.values())] if isinstance(c, dict) else [str(c)] if isinstance(c, str) else [str(x) for x in c]
        return any(t == word or name(word) in t for t in texts)

    def __str__(self) -> str:
        return f"[{self.label or 'step'}] {self.action}: {self.content}"


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    c = step.content
    if step.action == "with_columns":
        return df.withColumns({k: F.expr(v) for k, v in c.items()}) if c else df
    if step.action == "select":
        return df.selectExpr(*c)
    if step.action == "drop":
        return df.drop(*c)
    if step.action == "filter":
        return df.where(c)
    if step.action == "rename":
        return df.withColumnsRenamed(c)
    if step.action == "sort":
        return df.orderBy(*[getattr(F.col(name(x)), f"{'desc' if down else 'asc'}_nulls_{'last' if last else 'first'}")() for x, down, last in c])
    if step.action == "lookup":
        return _lookup(df, **c)
    if step.action == "model":
        from prepline.operators.models import apply_model

        return apply_model(df, **c)
    raise ValueError(f"no action is named {step.action}")


def apply_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    return functools.reduce(apply_step, steps, df)


def recorded(fit: Callable[..., list[Step]]) -> Callable[..., DataFrame]:
    """Makes of a fit function (frame to steps) the one-shot operator; the fit function is its attribute ``fit``."""

    @functools.wraps(fit)
    def one_shot(df: DataFrame, *args: Any, **kwargs: Any) -> DataFrame:
        return apply_steps(df, fit(df, *args, **kwargs))

    one_shot.fit = fit
    return one_shot


def lookup_step(table: DataFrame, keys: list[str], outs: dict[str, str], default: dict[str, Any] | None = None, label: str = "") -> Step:
    """A step that finds, by null-safe equality of ``keys``, values of ``table`` for new columns.

    ``table`` has the columns of ``keys`` (each combination once) and those named in ``outs`` (new column: column
    of the table). A missing combination gives ``default``. Small tables are kept in the step, large ones as
    Parquet in the shared folder; the driver never holds more than ``KEPT`` rows.
    """
    table = table.select(*[name(k) for k in keys], *[F.col(name(v)).alias(f"__{i}") for i, v in enumerate(outs.values())])
    head = table.limit(KEPT + 1).collect()
    types = [f.dataType.simpleString() for f in table.schema.fields]
    content = {"keys": keys, "outs": list(outs), "types": types, "default": {k: (default or {}).get(k) for k in outs}}
    if len(head) <= KEPT:
        content["rows"] = [list(r) for r in head]
    else:
        kept = cut(table)
        content["path"] = os.path.dirname(kept.inputFiles()[0])
    return Step("lookup", content, label)


def _lookup(df: DataFrame, keys: list[str], outs: list[str], types: list[str], default: dict, rows: list | None = None, path: str | None = None) -> DataFrame:
    n = len(keys)
    if rows is not None and len(rows) <= INLINE:
        found = {}
        for i, o in enumerate(outs):
            kind = types[n + i]
            branches = " ".join("WHEN " + " AND ".join(f"{name(k)} <=> CAST({lit(v)} AS {types[j]})" for j, (k, v) in enumerate(zip(keys, r))) + f" THEN CAST({lit(r[n + i])} AS {kind})" for r in rows)
            other = f"CAST({lit(default.get(o))} AS {kind})"
            found[o] = F.expr(f"CASE {branches} ELSE {other} END" if branches else other)
        return df.withColumns(found)
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(n)] + [f"__{i}" for i in range(len(outs))]
    schema = ", ".join(f"{a} {b}" for a, b in zip(names, types))
    table = spark.read.parquet(path).toDF(*names) if path else spark.createDataFrame([tuple(r) for r in rows], schema)
    table = table.withColumn("__hit", F.lit(True))
    on = functools.reduce(lambda a, b: a & b, [F.col(name(k)).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    joined = df.join(table, on, "left")
    new = {o: F.when(F.col("__hit"), F.col(f"__{i}")).otherwise(F.lit(default.get(o)).cast(types[n + i])) for i, o in enumerate(outs)}
    return joined.withColumns(new).select(*[name(c) for c in df.columns if c not in outs], *[name(o) for o in outs]) if not set(outs) & set(df.columns) else joined.withColumns(new).select(*[name(c) for c in [*df.columns, *[o for o in outs if o not in df.columns]]])
