"""One form for texts that look the same: compatibility forms, combining marks, zero-width, spaces, look-alikes."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.session import cut

# Letters drawn like a Latin letter, each above the Latin letter it counts as. Held not to be drawn like
# one, though public lists of confusable letters name them: the Cyrillic ге, ка, ве, те, мягкий знак (small ones differ
# in height or strokes), the Greek gamma, kappa, sigma, tau, eta, omega. Compatibility forms such as the lunate sigma
# count as the letter they are a form of. Other scripts (Armenian, Cherokee, Coptic, phonetic letters) stay.
CYRILLIC = "АВЕЅІЈКМНОРСТУХԚԜԌӀҮѴ" "аеѕіјорсухԛԝһԁӏүѵ"
CYRILLIC_AS = "ABESIJKMHOPCTYXQWGIYV" "aesijopcyxqwhdlyv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϜϺ" "νοραιϳυ"
GREEK_AS = "ABEZHIKMNOPTYXJFM" "vopaiju"
# Hyphens (soft hyphens are without width, dashes and the minus sign are other characters).
HYPHENS = "‐‑֊᐀⁃﹣-"
# Characters without width that are no format characters.
WIDTHLESS = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]

#: Bytes of text whose code points are laid out at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21


@dataclass(frozen=True)
class Tables:
    """Code point tables: length and start of each decomposition in ``flat``, combining classes, compositions."""

    length: np.ndarray
    start: np.ndarray
    flat: np.ndarray
    marks: np.ndarray
    pairs: np.ndarray
    composed: np.ndarray
    late: np.ndarray


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    """Built once in each worker from the Unicode database and the fixed values above."""
    look = dict(zip(map(ord, CYRILLIC + GREEK), map(ord, CYRILLIC_AS + GREEK_AS)))
    look |= {ord(c): ord("-") for c in HYPHENS} | {0x09: 0x20}
    gone = set(WIDTHLESS)
    size = sys.maxunicode + 1
    length, start = np.ones(size, np.uint8), np.arange(size, dtype=np.int32)
    marks, flat = np.zeros(size, np.uint8), [np.arange(size, dtype=np.uint32)]
    extra: list[int] = []
    pairs: dict[int, int] = {}
    late = np.zeros(size, bool)
    for c in range(size):
        if 0xD800 <= c < 0xE000 or 0xE000 <= c < 0xF900 or 0xF0000 <= c:
            continue
        s = chr(c)
        marks[c] = unicodedata.combining(s)
        kind = unicodedata.category(s)
        if kind == "Cf" or c in gone:
            length[c] = 0
            continue
        parts = [0x20 if unicodedata.category(p) == "Zs" else look.get(ord(p), ord(p)) for p in unicodedata.normalize("NFKD", s) if unicodedata.category(p) != "Cf" and ord(p) not in gone]
        if len(parts) != 1 or parts[0] != c:
            length[c], start[c] = len(parts), size + len(extra)
            extra += parts
        d = unicodedata.decomposition(s)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", s) == s:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.combining(chr(b)):
                pairs[a << 21 | b] = c
            else:
                late[b] = True
    late[0x1161:0x1176] = late[0x11A8:0x11C3] = True  # jamo that join a syllable
    keys = np.array(sorted(pairs), dtype=np.int64)
    return Tables(length, start, np.concatenate([flat[0], np.array(extra, np.uint32)]), marks, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32), late)


def _sort_marks(cp: np.ndarray, doc: np.ndarray, cls: np.ndarray) -> None:
    """Orders each run of combining marks by class, stably and in place."""
    is_mark = cls > 0
    wrong = np.flatnonzero(is_mark[1:] & is_mark[:-1] & (cls[1:] < cls[:-1]) & (doc[1:] == doc[:-1]))
    if not len(wrong):
        return
    run = np.cumsum(~is_mark | np.concatenate([[True], doc[1:] != doc[:-1]]))  # a run has the number of its starter
    at = np.flatnonzero(is_mark & np.isin(run, run[wrong]))
    order = at[np.lexsort((at, cls[at], run[at]))]
    cp[at], cls[at] = cp[order], cls[order]


def _compose(cp: np.ndarray, doc: np.ndarray, cls: np.ndarray, t: Tables) -> np.ndarray:
    """Joins starters with the marks that follow unless a mark of the same or higher class stands between; in place.

    Returns which code points stay.
    """
    keep = np.ones(len(cp), bool)
    m = np.flatnonzero(cls > 0)
    if not len(m):
        return keep
    head = np.concatenate([[True], (m[1:] != m[:-1] + 1) | (doc[m[1:]] != doc[m[:-1]])])
    first = m[head]
    size = np.diff(np.concatenate([np.flatnonzero(head), [len(m)]]))
    base = first - 1
    ok = (base >= 0) & (doc[np.maximum(base, 0)] == doc[first])
    first, size, base = first[ok], size[ok], base[ok]
    last = np.zeros(len(first), np.uint8)  # class of the last mark that stays
    for r in range(int(size.max()) if len(size) else 0):
        live = size > r
        first, size, base, last = first[live], size[live], base[live], last[live]
        at = first + r
        key = cp[base].astype(np.int64) << 21 | cp[at]
        where = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        joins = (t.pairs[where] == key) & (last < cls[at])
        cp[base[joins]] = t.composed[where[joins]]
        keep[at[joins]] = False
        last = np.where(joins, last, cls[at])
    return keep


def _one_form(batch: pa.Array) -> pa.Array:
    """The texts of an Arrow array in one form; nulls stay null. Worked off in slices of some ``SLICE_BYTES``."""
    batch = batch.cast(pa.large_string()) if batch.type != pa.large_string() else batch
    n = len(batch)
    ends = np.frombuffer(batch.buffers()[1], np.int64)[batch.offset : batch.offset + n + 1] if n else np.zeros(1, np.int64)
    starts = np.searchsorted(ends - ends[0], np.arange(SLICE_BYTES, ends[-1] - ends[0], SLICE_BYTES), side="right") - 1
    cuts = [0, *np.unique(starts[starts > 0]).tolist(), n]
    parts = [_one_slice(batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
    return pa.concat_arrays(parts)


def _one_slice(batch: pa.Array) -> pa.Array:
    t = tables()
    nulls = batch.is_null().to_numpy(zero_copy_only=False)
    batch = batch.fill_null("")
    n = len(batch)
    ends = np.frombuffer(batch.buffers()[1], np.int64)[batch.offset : batch.offset + n + 1]
    data = bytes(memoryview(batch.buffers()[2])[ends[0] : ends[-1]]) if batch.buffers()[2] is not None else b""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return pa.array([None if x else "" for x in nulls], pa.string())
    # positioned code points of all texts of the batch
    seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    sizes = np.diff(seen[ends - ends[0]])
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    # the decomposition and look-alike mapping of each
    length, start = t.length[cp], t.start[cp]
    if (length != 1).any():
        doc, begin = np.repeat(doc, length), np.repeat(start, length)
        step = np.arange(len(begin)) - np.repeat(np.cumsum(length, dtype=np.int64) - length, length)
        cp = t.flat[begin + step]
    else:
        cp = t.flat[start]
    cls = t.marks[cp]
    _sort_marks(cp, doc, cls)
    late = np.unique(doc[t.late[cp]])  # texts with joining letters that are no marks, such as Korean ones
    keep = _compose(cp, doc, cls, t)
    cp, doc = cp[keep], doc[keep]
    # the strings
    sizes = np.bincount(doc, minlength=n)
    width = 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
    out = cp.tobytes().decode("utf-32-le").encode("utf-8")
    done = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(out))
    if len(late) or nulls.any():
        late_set = set(late.tolist())
        done = pa.array([None if nulls[i] else unicodedata.normalize("NFC", x) if i in late_set else x for i, x in enumerate(done.to_pylist())], pa.large_string())
    return done.cast(pa.string())


def one_form(text: Column | str) -> Column:
    """``string``: ``text`` in the form that all texts that look the same share.

    Compatibility forms and combining accents are decomposed, characters without width dropped, spaces (tabs
    too) and hyphens made plain, look-alike Cyrillic and Greek letters made Latin, marks ordered by class and
    composed again. Line breaks, case, accents, digits and plain Latin letters stay. Null gives null, the empty
    text itself; giving the result again gives the same.
    """

    @F.arrow_udf("string")
    def form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _one_form(batch)

    return form(text)


def unify_text(df: DataFrame, text_col: str = "text", form_col: str = "form") -> DataFrame:
    """``df`` with the common form of ``text_col`` in ``form_col``; a column of that name is replaced.

    Texts are exploded to code points inside the Arrow batch, so nothing is shuffled. Repeated rows stay repeated,
    an empty table stays empty, texts may have any length.
    """
    return df.withColumn(form_col, one_form(F.col(f"`{text_col}`")))


def look_alike_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, text_id, n_links``: the documents that look like another one with a different text.

    ``class_id`` is the smallest id of all documents that look the same, ``text_id`` the smallest of those with
    exactly the document's text, ``n_links`` the number of documents of the class with another text. The table has
    one row per document, however large its class; the pairs of ``text_id`` within a class stand for all others.

    Null and blank texts (nothing but spaces and line breaks in their form) and null ids are in no class; repeated
    rows count once; an id with several texts has a row for each; texts may have any length; an empty table has no
    classes; other columns are ignored, whatever their names. Texts are compared by SHA-256. Copies are counted
    before the shuffle, and only the sums of a class and text are joined, so a class may hold most of the rows.
    """
    return _classes(df, id_col, text_col).drop("text_key")


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    formed = unify_text(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    # the form is used in one projection only, else it would be made once for each use
    keys = formed.select("doc_id", F.when(F.col("form").rlike(r"\S"), F.unhex(F.sha2("form", 256))).alias("form_key"), F.unhex(F.sha2("text", 256)).alias("text_key"))
    keyed = cut(keys).where(F.col("form_key").isNotNull() & F.col("doc_id").isNotNull())
    ends = keyed.groupBy("form_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("form_key")
    mixed = keyed.join(ends, "form_key", "left_semi").distinct()
    texts = mixed.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("copies"))
    classes = texts.groupBy("form_key").agg(F.min("text_id").alias("class_id"), F.sum("copies").alias("members"))
    of_text = texts.join(classes, "form_key").select("text_key", "class_id", "text_id", (F.col("members") - F.col("copies")).alias("n_links"))
    return mixed.join(of_text, "text_key").select("doc_id", "class_id", "text_id", "n_links", "text_key")


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id_a, doc_id_b``: documents whose texts differ but have the same form, the smaller id first.

    The classes of ``look_alike_classes`` written out as pairs: as many rows as documents have partners, so use the
    classes where copies abound. Documents are joined through the pairs of texts of their class, so copies of one
    text never meet each other; each pair comes once. Defined cases are those of the classes.
    """
    classes = cut(_classes(df, id_col, text_col).select("doc_id", "class_id", "text_key"))
    texts = classes.select("class_id", "text_key").distinct()
    pairs = texts.alias("x").join(texts.alias("y"), "class_id").where("x.text_key <> y.text_key").select(F.col("x.text_key").alias("text_a"), F.col("y.text_key").alias("text_b"))
    a = classes.select(F.col("doc_id").alias("doc_id_a"), F.col("text_key").alias("text_a"))
    b = classes.select(F.col("doc_id").alias("doc_id_b"), F.col("text_key").alias("text_b"))
    return a.join(pairs, "text_a").join(b, "text_b").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()
