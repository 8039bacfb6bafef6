"""Queries over the tables of a folder by the core operators, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from prepline.queries.registry import Query


def _modules():
    for m in pkgutil.iter_modules(__path__):
        module = importlib.import_module(f"{__name__}.{m.name}")
        if hasattr(module, "registry"):
            yield module


def queries() -> dict[str, Query]:
    return {k: v for m in _modules() for k, v in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.registry.sql.items()}
