"""String distances, n-gram similarity and the English stemmer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from prepline.functions.stemmer import STOPWORDS, stem_word


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def levenshtein_dist(a: Column | str, b: Column | str) -> Column:
    """Edit distance in characters; null if either is null."""
    return F.levenshtein(_col(a), _col(b))


def hamming_bits(a: Column | str, b: Column | str) -> Column:
    """Differing bits of the UTF-8 bytes of two texts of equal byte length, else null."""
    x, y = F.encode(_col(a), "utf-8"), F.encode(_col(b), "utf-8")
    byte = lambda s, i: F.conv(F.hex(F.substring(s, i, F.lit(1))), 16, 10).cast("int")
    n = F.octet_length(x)
    bits = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.bit_count(byte(x, i).bitwiseXOR(byte(y, i))))
    return F.when((n == F.octet_length(y)) & (n == 0), 0).when(n == F.octet_length(y), bits)


hamming_dist = hamming_bits


def hamming_chars(a: Column | str, b: Column | str) -> Column:
    """Differing characters of two texts of equal length, else null."""
    x, y = F.split(_col(a), ""), F.split(_col(b), "")
    same = F.length(_col(a)) == F.length(_col(b))
    return F.when(same, F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda z: z)))


def _grams(s: Column, n: int) -> Column:
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def str_jaccard(a: Column | str, b: Column | str, substr_size: int = 2) -> Column:
    """Jaccard similarity of the character n-gram sets.

    Texts both shorter than n: 1 if equal, else 0; one shorter: 0; null if either is null.
    """
    a, b = _col(a), _col(b)
    x, y = _grams(a, substr_size), _grams(b, substr_size)
    short_a, short_b = F.length(a) < substr_size, F.length(b) < substr_size
    both = F.size(F.array_intersect(x, y))
    score = F.when(short_a & short_b, (a == b).cast("double")).when(short_a | short_b, 0.0).otherwise(both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1)))
    return F.when(a.isNotNull() & b.isNotNull(), score)


def snowball_stem(word: Column | str, no_stopword: bool = True) -> Column:
    """English Porter2 stem of a lower-case word; stopwords and numbers become null (stopwords stay if wanted)."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, str | None] = {}
        for b in batches:
            if len(memo) > 1 << 17:
                memo.clear()
            out = []
            for w in b.to_pylist():
                if w is not None and w not in memo:
                    memo[w] = None if is_number(w) or (no_stopword and w in STOPWORDS) else stem_word(w)
                out.append(None if w is None else memo[w])
            yield pa.array(out, pa.string())

    return run(_col(word))


def is_number(w: str) -> bool:
    """True for what reads as a floating point number, such as 1e5, inf, nan."""
    try:
        float(w)
    except ValueError:
        return False
    return "_" not in w and w == w.strip()
