"""Column functions grouped as namespaces of one column: ``num_ext(col).gcd(other)``, ``str_ext(col).str_jaccard(other)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prepline.functions import numeric, text
from prepline.functions.safe import fdiv


class NumExt:
    """Functions of a numeric column; std_err, harmonic_mean, rms, cv and range_over_mean are aggregates."""

    def __init__(self, c: Column | str):
        self.c = F.col(c) if isinstance(c, str) else c

    def abs_diff(self, to: Column | str) -> Column:
        return numeric.abs_diff(self.c, to)

    def std_err(self, ddof: int = 1) -> Column:
        return numeric.std_err(self.c, ddof)

    def harmonic_mean(self) -> Column:
        return numeric.harmonic_mean(self.c)

    def rms(self) -> Column:
        return numeric.rms(self.c)

    def cv(self, ddof: int = 1) -> Column:
        return numeric.cv(self.c, ddof)

    def range_over_mean(self) -> Column:
        return numeric.range_over_mean(self.c)

    def z_normalize(self, mean: float, std: float) -> Column:
        """(x - mean) / std by fitted values; ``operators.scale.z_normalize`` fits them."""
        return fdiv(self.c - mean, F.lit(std))

    def frac(self) -> Column:
        return numeric.frac(self.c)

    def gcd(self, other: Column | str | int) -> Column:
        return numeric.gcd(self.c, other)

    def lcm(self, other: Column | str | int) -> Column:
        return numeric.lcm(self.c, other)

    def lempel_ziv_complexity(self, order_by: Column | str, as_ratio: bool = False) -> Column:
        """Of the booleans of a group in an explicit order: use over the result of ``ordered``, see there."""
        return numeric.lempel_ziv_complexity(self.ordered(order_by), as_ratio)

    def ordered(self, order_by: Column | str) -> Column:
        """Aggregate: the group's values in an order, as an array; meant for groups of bounded size."""
        o = F.col(order_by) if isinstance(order_by, str) else order_by
        return F.transform(F.sort_array(F.collect_list(F.struct(o.alias("o"), self.c.alias("x")))), lambda s: s["x"])


class StrExt:
    """Functions of a text column."""

    def __init__(self, c: Column | str):
        self.c = F.col(c) if isinstance(c, str) else c

    def str_jaccard(self, other: Column | str, substr_size: int = 2) -> Column:
        return text.str_jaccard(self.c, other, substr_size)

    def levenshtein_dist(self, other: Column | str) -> Column:
        return text.levenshtein_dist(self.c, other)

    def hamming_dist(self, other: Column | str) -> Column:
        return text.hamming_bits(self.c, other)

    def snowball(self, no_stopword: bool = True) -> Column:
        return text.snowball_stem(self.c, no_stopword)


num_ext, str_ext = NumExt, StrExt
