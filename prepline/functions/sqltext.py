"""SQL text of names and literals; fitted steps are kept as such text."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from typing import Any


def name(c: str) -> str:
    """A column name in back quotes."""
    return "`" + c.replace("`", "``") + "`"


def lit(v: Any) -> str:
    """A Python value as a Spark SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v) if abs(v) < 2**31 else f"{v}L"
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return f"CAST('{'NaN' if math.isnan(v) else 'Infinity' if v > 0 else '-Infinity'}' AS DOUBLE)"
        return f"{v!r}D"
    if isinstance(v, Decimal):
        return f"{v}BD"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP_NTZ '{v:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(v, datetime.date):
        return f"DATE '{v:%Y-%m-%d}'"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(v: float) -> str:
    """A number as people write it: 1, not 1.0."""
    return "inf" if v == math.inf else "-inf" if v == -math.inf else str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))
