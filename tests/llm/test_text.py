"""Encoding, forms and mixing against public tokenizers, the Unicode database and brute force."""

import base64
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prepline.llm import forms
from prepline.llm.bpe import DEFAULT_VOCABULARY, PATTERN, Encoder, PerfectHash, load_vocabulary
from prepline.llm.encoding import encode_corpus, token_count
from prepline.llm.forms import _one_form, look_alike_classes, look_alike_pairs, unify_text
from prepline.llm.mixing import mix_placed, mix_sources, order_sources


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_vocabulary())


@pytest.fixture(scope="module")
def public():
    with open(DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = PerfectHash.build(keys)
    from prepline.llm.bpe import _slot

    assert sorted(_slot(h.seed, h.shift, h.n, k) for k in keys) == list(range(5000))


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "it's  we'll", "\n\n x\n", "ab\tc", "Ünï çode", "школа 12,5", "<|endoftext|>", "é", "\U0001f600\U0001f600", "a" * 5000, "x y" * 300, " a　b", "a\r\n b"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.sampled_from(TEXTS), st.text(max_size=60), st.text(alphabet=" \n\t'sartéж1., ", max_size=40)))
def test_ids_are_those_of_the_public_library(encoder, public, text):
    want = public.encode_ordinary(text)
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == want
    assert encoder.count(text) == len(want)


def test_encode_corpus(spark, public):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(100, None, "old"), (101, "a b", None), (101, "a b", None)]
    t = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = encode_corpus(t).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == (public.encode_ordinary(r["text"]) if r["text"] else [])
    assert encode_corpus(t.limit(0)).count() == 0
    assert t.select(token_count("text").alias("n")).agg({"n": "sum"}).first()[0] == sum(len(r["ids"]) for r in out)


def test_ids_are_those_of_the_other_library(encoder):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in TEXTS:
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_very_long_text(encoder, public):
    text = "lorem ipsum dolor " * 100_000
    assert encoder.count(text) == len(public.encode_ordinary(text))


def brute(s):
    m = str.maketrans(forms.CYRILLIC + forms.GREEK, forms.CYRILLIC_AS + forms.GREEK_AS)
    s = unicodedata.normalize("NFKD", s)
    s = "".join(" " if unicodedata.category(c) == "Zs" or c == "\t" else "-" if c in forms.HYPHENS else c for c in s if unicodedata.category(c) != "Cf" and ord(c) not in forms.WIDTHLESS)
    return unicodedata.normalize("NFC", s.translate(m))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aeсоνΆ̧̣̀ͅ  ​­ﬁé각가각й", max_size=20)), max_size=6))
def test_forms_are_those_of_the_unicode_database(texts):
    assert _one_form(pa.array(texts, pa.string())).to_pylist() == [None if t is None else brute(t) for t in texts]


def test_forms_of_slices(monkeypatch):
    monkeypatch.setattr(forms, "SLICE_BYTES", 7)
    texts = ["ab́", "", None, "x" * 50, "́a", "ﬁ"]
    assert _one_form(pa.array(texts, pa.string())).to_pylist() == [None if t is None else brute(t) for t in texts]
    assert _one_form(pa.array(texts, pa.string()).slice(2, 3)).to_pylist() == [None, "x" * 50, "́a"]
    assert _one_form(pa.array([], pa.string())).to_pylist() == []


def test_one_form_keeps_and_joins(spark):
    same = [("ﬁne Ａ", "fine A"), ("café", "café"), ("a​b", "ab"), ("a b", "a b"), ("a‐b", "a-b"), ("раураl", "paypal"), ("Τορ", "Top")]
    differ = ["l", "1", "I", "O", "0", "rn", "m", "A", "a", "é", "e", "a\nb", "a b"]
    assert all(_one_form(pa.array([a])).to_pylist() == _one_form(pa.array([b])).to_pylist() for a, b in same[:6])
    assert len(set(_one_form(pa.array(differ)).to_pylist())) == len(differ)
    t = spark.createDataFrame([("é", 1), (None, 2)], "text string, form int")
    assert [r[0] for r in unify_text(t).select("form").collect()] == ["é", None]


def test_look_alike_pairs(spark):
    rows = [(1, "top page"), (2, "tοp page"), (3, "top page"), (4, "top page"), (5, None), (6, " "), (7, " "), (8, "other"), (9, "TOP page"), (10, "")]
    t = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' form", "1 form_key")
    want = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    assert sorted(tuple(r) for r in look_alike_pairs(t).collect()) == want
    assert sorted(tuple(r) for r in look_alike_pairs(t.unionByName(t)).collect()) == want
    assert look_alike_pairs(t.limit(0)).count() == 0


def test_classes(spark):
    rows = [(1, "top page"), (2, "tοp page"), (3, "top page"), (4, "top page"), (5, None), (6, " "), (7, " "), (8, "other"), (None, "tορ page"), (10, ""), (3, "top page"), (8, "οther")]
    t = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' form", "1 class_id")
    assert sorted(tuple(r) for r in look_alike_classes(t).collect()) == [(1, 1, 1, 1), (2, 1, 2, 3), (3, 1, 1, 1), (4, 1, 1, 1), (8, 8, 8, 1), (8, 8, 8, 1)]
    several = spark.createDataFrame([(8, "other"), (8, "οther"), (9, "other")], "doc_id bigint, text string")
    assert [tuple(r) for r in look_alike_pairs(several).collect()] == [(8, 9)]
    assert look_alike_classes(t.limit(0)).count() == 0


def test_a_class_of_most_rows(spark):
    """Its classes are one row per document, where pairs would be 400 million."""
    t = spark.range(40_000).selectExpr("id doc_id", "case when id % 2 = 0 then 'ｓame' else 'same' end text")
    r = look_alike_classes(t).groupBy("class_id", "text_id", "n_links").count().orderBy("text_id").collect()
    assert [tuple(x) for x in r] == [(0, 0, 20_000, 20_000), (0, 1, 20_000, 20_000)]


def test_many_copies_of_one_text(spark):
    t = spark.range(30000).selectExpr("id doc_id", "case when id = 7 then 'ｓame' when id % 3 = 0 then 'same' else concat('t', id) end text")
    pairs = look_alike_pairs(t).collect()
    assert len(pairs) == 10000 and all(7 in tuple(r) for r in pairs)


def mixes(spark, rows):
    return spark.createDataFrame(rows, "mix_id bigint, source_name string, weight double, max_repeats int, budget_tokens bigint")


def test_mix(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'b' when id < 20 then 'tiny' else 'c' end source", "repeat('word ', cast(id % 7 + 1 as int)) text", "1 n_tokens", "0 key")
    targets = mixes(spark, [(1, "hot", 50.0, 1, 4000), (1, "tiny", 50.0, 3, 4000), (2, "b", 1.0, None, 900), (2, "none", 0.0, 2, 900), (3, "missing", 0.5, 2, 10), (3, "c", 0.5, 5, 10), (4, None, 1.0, 1, 100), (5, "b", None, 1, 50), (6, "tiny", 2.0, 2, 60)])
    mix = mix_sources(docs, targets)
    r = {(x["mix_id"], x["source_name"]): x for x in mix.report.collect()}
    assert len(r) == 9
    sizes = {row[0]: row[1] for row in docs.select("doc_id", token_count("text").alias("n")).collect()}
    tokens = {s: sum(sizes[d[0]] for d in docs.where(f"source = '{s}'").select("doc_id").collect()) for s in ("hot", "b", "tiny", "c")}
    assert r[1, "tiny"]["short"] and r[1, "tiny"]["picked_tokens"] == 3 * tokens["tiny"]
    assert not r[1, "hot"]["short"] and 0 <= 2000 - r[1, "hot"]["picked_tokens"] < max(sizes.values())
    assert r[3, "missing"]["short"] and r[3, "missing"]["available_tokens"] == 0 and r[2, "none"]["picked_tokens"] == 0 and not r[2, "none"]["short"]
    assert r[4, None]["short"] and r[5, "b"]["target_tokens"] == 0
    assert sum(x["actual_share"] for k, x in r.items() if k[0] == 1) == pytest.approx(1)
    picks = mix.picks.collect()
    assert all(p["copies"] <= {"tiny": 3, "hot": 1, "b": 1, "c": 5}[p["source_name"]] for p in picks)
    for key, x in r.items():
        own = [p for p in picks if (p["mix_id"], p["source_name"]) == key]
        assert x["picked_tokens"] == sum(sizes[p["doc_id"]] * p["copies"] for p in own)
        assert x["picked_docs"] == sum(p["copies"] for p in own)
    if tokens["tiny"] < 60:
        assert {p["copies"] for p in picks if p["mix_id"] == 6} <= {1, 2}
    no_ids = mix_sources(docs.withColumn("doc_id", F.lit(None).cast("bigint")), targets).report.where("mix_id = 1 and source_name = 'hot'").first()
    assert no_ids["source_tokens"] == tokens["hot"] and 0 <= 2000 - no_ids["picked_tokens"] < max(sizes.values())
    assert mix_sources(docs.limit(0), targets).picks.count() == 0
    assert mix_sources(docs, targets.limit(0)).report.count() == 0


@pytest.mark.parametrize("size", [10**10, 3 * 10**9 + 1])
def test_mix_of_huge_sources(spark, size):
    """A source of some 1e14 tokens, placed by hand: blocks grow with it, so no line has a long array of them."""
    placed = spark.range(10_000).selectExpr("id doc_id", "'big' source_name", f"{size} n_tokens", f"id * {size} start_token", "id place")
    placed = placed.unionByName(spark.range(50).selectExpr("100000 + id doc_id", "'small' source_name", "3L n_tokens", "3 * id start_token", "id place"))
    totals = placed.groupBy("source_name").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    budget = 6_000 * size + 5
    targets = mixes(spark, [(1, "big", 1.0, 1, budget), (2, "big", 1.0, 2, 2 * budget), (3, "big", 1.0, 1, size - 1), (4, "big", 1.0, 1, 4 * budget), (5, "small", 1.0, 2, 290)])
    mix = mix_placed(placed, totals, targets)
    r = {x["mix_id"]: (x["picked_tokens"], x["picked_docs"], x["short"]) for x in mix.report.collect()}
    assert r == {1: (6_000 * size, 6_000, False), 2: (12_000 * size, 12_000, False), 3: (0, 0, False), 4: (10_000 * size, 10_000, True), 5: (288, 96, False)}
    picks = {x["mix_id"]: (x["t"], x["c"]) for x in mix.picks.groupBy("mix_id").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.sum("copies").alias("c")).collect()}
    assert picks == {k: v[:2] for k, v in r.items() if v[1]}


def test_order_is_a_partition_of_the_source(spark, monkeypatch):
    from prepline.llm import mixing

    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    docs = spark.range(500).selectExpr("id doc_id", "if(id % 2 = 0, 'a', 'b') source", "repeat('x ', cast(id % 5 as int)) text")
    placed, totals = order_sources(docs)
    for s, total, _ in totals.collect():
        rows = sorted((r["start_token"], r["n_tokens"], r["place"]) for r in placed.where(f"source_name = '{s}'").collect())
        at = 0
        for i, (start, n, place) in enumerate(rows):
            assert start == at and place == i
            at += n
        assert at == total


@pytest.mark.parametrize("letter, latin", [("Ӏ", "I"), ("Ү", "Y"), ("ү", "y"), ("Ѵ", "V"), ("ѵ", "v"), ("Ϳ", "J"), ("ρ", "p"), ("α", "a"), ("ι", "i"), ("ϳ", "j"), ("ά", "á"), ("υ", "u"), ("Ϝ", "F"), ("Ϻ", "M")])
def test_rarer_look_alikes(letter, latin):
    assert _one_form(pa.array([f"x{letter}z"])).to_pylist() == [f"x{latin}z"]
