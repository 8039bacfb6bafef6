"""Arithmetic that never raises under ANSI mode and treats zero, NaN and infinity in a defined way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fdiv(a: Column | str, b: Column | str) -> Column:
    """a / b as floating point does it: x/0 is signed infinity, 0/0 NaN; null if either is null."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.when(b != 0, a / b).when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)))


def flog(x: Column | str) -> Column:
    """Natural logarithm: of 0 minus infinity, of negative numbers NaN, of null null."""
    x = _col(x).cast("double")
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def finite(x: Column | str) -> Column:
    """The number as double if it is finite, else null."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def is_invalid(x: Column | str) -> Column:
    """True for NaN and infinities, false for other numbers and null."""
    x = _col(x).cast("double")
    return F.coalesce(F.isnan(x) | (F.abs(x) == INF), F.lit(False))


def ratio_sql(a: str, b: str) -> str:
    """SQL text of a / b, null where b is 0."""
    return f"TRY_DIVIDE(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows where both are finite; NaN if either is constant there."""
    x, y = finite(x), finite(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return fdiv(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
