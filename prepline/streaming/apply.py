"""Fitted steps are stateless, so a saved pipeline also runs on a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from prepline.plans import Pipeline


def apply_to_stream(pipeline: Pipeline, stream: DataFrame, output_mode: str = "append") -> DataStreamWriter:
    """A writer of the transformed stream, ready for a sink; sorting steps raise, as they need the whole input."""
    if not stream.isStreaming:
        raise ValueError("the frame is no stream")
    if pipeline.get_by_action_type("sort"):
        raise ValueError("a stream can't be sorted")
    return pipeline.apply(stream).writeStream.outputMode(output_mode)
