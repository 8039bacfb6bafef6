"""Fitted pipelines on streams."""

from prepline.streaming.apply import apply_to_stream

__all__ = ["apply_to_stream"]
