"""Recorded pipelines of fitted steps."""

from prepline.plans.pipeline import Pipeline
from prepline.plans.steps import Step, apply_steps, recorded
from prepline.plans.transformer import StepsTransformer

__all__ = ["Pipeline", "Step", "StepsTransformer", "apply_steps", "recorded"]
