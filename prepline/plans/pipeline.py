"""A recorded chain of fitted operators: applied, saved, loaded and replayed on other frames."""

from __future__ import annotations

import copy
import datetime
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepline.plans.steps import Step, apply_steps


class Pipeline:
    """Steps in order, and the frame they were fitted on so far.

    ``Pipeline(df).pipe(impute, ["a"]).pipe(one_hot_encode, ["b"])`` fits each operator on the frame that the
    steps before give. ``frame`` is the transformed frame; ``apply`` replays the steps on another one.
    """

    def __init__(self, df: DataFrame | None = None, steps: Iterable[Step] = ()):
        self.steps: list[Step] = [s.validate() for s in steps]
        self.frame = df

    # building
    def pipe(self, op: Callable, *args: Any, **kwargs: Any) -> Pipeline:
        """Fits a recorded operator and appends its steps; any other function only changes the frame."""
        if self.frame is None:
            raise ValueError("the pipeline has no frame to fit on")
        fit = getattr(op, "fit", None)
        if fit is None:
            return self._with(op(self.frame, *args, **kwargs), [])
        new = [Step(s.action, s.content, s.label or op.__name__) for s in fit(self.frame, *args, **kwargs)]
        return self._with(apply_steps(self.frame, new), new)

    def _with(self, frame: DataFrame | None, new: list[Step]) -> Pipeline:
        out = Pipeline(frame)
        out.steps = [*self.steps, *new]
        return out

    def add(self, step: Step) -> Pipeline:
        step.validate()
        return self._with(apply_steps(self.frame, [step]) if self.frame is not None else None, [step])

    def with_columns(self, exprs: dict[str, str]) -> Pipeline:
        return self.add(Step("with_columns", exprs, "with_columns"))

    def filter(self, condition: str) -> Pipeline:
        return self.add(Step("filter", condition, "filter"))

    def select(self, exprs: list[str]) -> Pipeline:
        return self.add(Step("select", exprs, "select"))

    def drop(self, cols: list[str]) -> Pipeline:
        return self.add(Step("drop", cols, "drop"))

    # reading
    def get_step(self, n: int) -> Step:
        return self.steps[n]

    def get_steps(self, indices: Iterable[int]) -> list[Step]:
        return [self.steps[i] for i in indices]

    def get_content_at_step(self, n: int) -> Any:
        return copy.deepcopy(self.steps[n].content)

    def get_by_action_type(self, action: str) -> list[Step]:
        return [s for s in self.steps if s.action == action]

    def get_by_mention(self, word: str) -> list[Step]:
        return [s for s in self.steps if s.mentions(word)]

    def as_str(self, n: int | None = None) -> str:
        """The text of the first n steps, of the last -n if n is negative, of all if None."""
        own = self.steps if n is None else self.steps[:n] if n >= 0 else self.steps[n:]
        return "\n".join(f"{i}. {s}" for i, s in enumerate(own))

    def show(self, n: int | None = None) -> None:
        print(self.as_str(n))

    def __len__(self) -> int:
        return len(self.steps)

    # using
    def apply(self, df: DataFrame, up_to: int | None = None) -> DataFrame:
        """The first ``up_to`` steps (all if None) on another frame, batch or streaming."""
        return apply_steps(df, self.steps[:up_to])

    transform = apply

    def fit(self, df: DataFrame) -> Pipeline:
        """Itself: its steps are fitted already."""
        return self

    def deep_copy(self) -> Pipeline:
        return Pipeline(self.frame, copy.deepcopy(self.steps))

    def save(self, folder: str, spark: SparkSession | None = None) -> None:
        """Writes the steps and copies of large lookup tables below ``folder``, on any file system Spark writes to."""
        session = spark or (self.frame.sparkSession if self.frame is not None else SparkSession.active())
        out = []
        for i, s in enumerate(self.steps):
            d = asdict(s)
            if s.action == "lookup" and "path" in s.content:
                if (at := f"{folder.rstrip('/')}/lookup_{i}") != s.content["path"]:
                    session.read.parquet(s.content["path"]).write.mode("overwrite").parquet(at)
                d["content"] = s.content | {"path": at}
            out.append(d)
        text = json.dumps(out, default=_plain)  # one line
        session.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/steps")

    @staticmethod
    def load(folder: str, spark: SparkSession | None = None) -> Pipeline:
        text = (spark or SparkSession.active()).read.text(f"{folder.rstrip('/')}/steps").first()
        raw = json.loads(text["value"], object_hook=_typed) if text else None
        if not isinstance(raw, list) or any(set(r) != {"action", "content", "label"} for r in raw):
            raise ValueError(f"{folder} holds no pipeline")
        return Pipeline(steps=[Step(**r) for r in raw])


def _plain(v: Any) -> Any:
    if isinstance(v, datetime.datetime):
        return {"__time": v.isoformat()}
    if isinstance(v, datetime.date):
        return {"__date": v.isoformat()}
    if isinstance(v, Decimal):
        return {"__decimal": str(v)}
    raise TypeError(f"a step can't hold {type(v)}")


def _typed(d: dict) -> Any:
    if "__time" in d:
        return datetime.datetime.fromisoformat(d["__time"])
    if "__date" in d:
        return datetime.date.fromisoformat(d["__date"])
    return Decimal(d["__decimal"]) if "__decimal" in d else d
