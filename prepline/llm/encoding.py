"""Encoding of a corpus with a public tokenizer, and counting its tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.llm.bpe import DEFAULT_VOCABULARY, Encoder, Vocabulary, load_vocabulary

_ENCODERS: dict[int, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    """The worker's encoder for a vocabulary; kept between tasks with its bounded memo."""
    key = hash((v.pattern, v.hash.n, v.hash.seed, v.ids.tobytes(), b"\0".join(v.tokens)))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(v)
    return _ENCODERS[key]


def token_ids(text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """``array<int>``: the ids of ``text`` by the rank file ``vocabulary``, without special tokens.

    Null and empty texts give the empty list. Whole texts are encoded, of any length. Strings that look like
    special tokens are ordinary text.
    """
    v = load_vocabulary(vocabulary)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = _encoder(v)
        for batch in batches:
            parts = [e.encode(t) if t else b"" for t in batch.to_pylist()]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"), pa.int32()))

    return encode(text)


def token_count(text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """``bigint``: the number of ids ``token_ids`` gives; 0 for null and empty texts."""
    v = load_vocabulary(vocabulary)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = _encoder(v)
        for batch in batches:
            yield pa.array([e.count(t) if t else 0 for t in batch.to_pylist()], pa.int64())

    return count(text)


def encode_corpus(df: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the token ids of ``text_col`` in ``ids_col``; a column of that name is replaced.

    One narrow pass without a shuffle: only the text goes to Python, all other columns stay in the JVM. Repeated
    rows are encoded each by itself; an empty table gives an empty table.
    """
    return df.withColumn(ids_col, token_ids(F.col(f"`{text_col}`"), vocabulary))
