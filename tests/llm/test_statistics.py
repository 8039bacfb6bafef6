"""Terms, sketches and planned samples against brute force, and their edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect
from pyspark.sql import functions as F

from prepline.llm import queries as llm
from prepline.llm import terms
from prepline.llm.quantiles import build_sketches, merge_sketches, percentiles, rank_error
from prepline.llm.sampling import _duels, _pivotal, sample_plans
from prepline.llm.terms import BurstTrie, count_terms, mark_terms

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    assert_same(llm.queries()[name](spark, small), connect(small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert llm.queries()[name](spark, small).count() > 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé ", max_size=6), max_size=200), st.integers(1, 8))
def test_trie_counts(words, limit):
    trie = BurstTrie(limit)
    for w in words:
        trie.add(w, (1, 0, 2, 0))
    found = {p + s: c for p, held in trie.containers() for s, c in held.items()}
    assert found == {w: [n, 0, 2 * n, 0] for w, n in Counter(words).items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="abé", max_size=7), max_size=60), max_size=5), st.integers(1, 8), st.integers(1, 8))
def test_tries_merge(workers, limit, other):
    merged = BurstTrie(other)
    for words in workers:
        trie = BurstTrie(limit)
        for w in words:
            trie.add(w, (1, 0, 2, 0))
        for prefix, held in trie.containers():
            merged.graft(prefix, held)
    want = Counter(w for words in workers for w in words)
    assert {p + s: c for p, held in merged.containers() for s, c in held.items()} == {w: [n, 0, 2 * n, 0] for w, n in want.items()}
    assert merged.entries == len(want)


def test_trie_of_long_paths():
    trie = BurstTrie(16)
    words = ["x" * 10_000 + str(i) for i in range(600)] + ["y" * i for i in range(3000)] + ["z" * 50_000]
    for w in words * 2:
        trie.add(w, (1, 1, 1, 1))
    assert {p + s: c[0] for p, held in trie.containers() for s, c in held.items()} == dict.fromkeys(words, 2)
    assert trie.chars < 200_000


def brute_terms(rows):
    occ, rec = Counter(), defaultdict(set)
    for i, v in rows:
        v = " ".join((v or "").split()).lower()
        for kind, items in (("value", [v] if v else []), ("term", v.split())):
            for x in items:
                occ[kind, x] += 1
                if i is not None:
                    rec[kind, x].add(i)
    return {(*k, n, len(rec[k])) for k, n in occ.items()}


@pytest.mark.parametrize("held, emitted", [(1, 300), (10**6, 1), (10, 10**6)])
def test_workers_empty_their_tries(monkeypatch, held, emitted):
    for k, v in {"HELD": held, "GATHER": 50, "BURST": 4, "EMIT_CHARS": emitted}.items():
        monkeypatch.setattr(terms, k, v)
    rng = np.random.default_rng(0)
    items = [f"{'pre' * (i % 3)}{i}" for i in rng.integers(0, 80, 500)]
    names = ["field", "item", "c0", "c1", "c2", "c3"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, [["f"] * 25, items[k : k + 25], *[[1] * 25] * 4]))) for k in range(0, 500, 25)]
    out = pa.Table.from_batches(list(terms._count_locally(iter(batches))))
    split = [pa.Table.from_batches([b]).append_column("route", pa.array(["r"] * b.num_rows)).append_column("parts", pa.array([3] * b.num_rows)) for b in out.to_batches()]
    parts = pa.Table.from_batches(list(terms._splitter()(iter([b for t in split for b in t.to_batches()]))))
    found = Counter()
    for p in range(3):
        own = parts.filter(pa.compute.equal(parts["part"], p))
        merged = terms._merge(own)
        assert not set(merged["item"].to_pylist()) & set(found)
        found.update(dict(zip(merged["item"].to_pylist(), merged["c0"].to_pylist())))
    assert found == Counter(items)


@pytest.mark.parametrize("route, length", [(50_000, 32), (3, 32), (3, 1), (20, 0)])
def test_terms(spark, monkeypatch, route, length):
    monkeypatch.setattr(terms, "ROUTE_ENTRIES", route)
    monkeypatch.setattr(terms, "PREFIX_CHARS", length)
    rng = np.random.default_rng(0)
    rows = [(int(i), " ".join(rng.choice(["New", "old", "Port", "saint saint", "x", " y\t"], rng.integers(0, 4)))) for i in rng.integers(0, 150, 400)]
    rows += [(1, None), (None, "New Port"), (None, None), (2, " \n "), (3, "NEW port"), (3, "NEW port")] + [(5, f"p{i % 40}") for i in range(200)]
    t = spark.createDataFrame(rows, "id bigint, city string").selectExpr("*", "1 record", "'z' item", "'z' field")
    found = {(r["kind"], r["item"], r["occurrences"], r["records"]) for r in count_terms(t, ["city"], "id").collect()}
    assert found == brute_terms(rows)
    assert count_terms(t.limit(0), ["city"], "id").count() == 0


def test_very_long_value(spark):
    t = spark.createDataFrame([(1, "ab " * 50_000), (2, "z" * 300_000)], "id bigint, city string")
    r = {(x["kind"], x["item"][:3]): x["occurrences"] for x in count_terms(t, ["city"], "id").collect()}
    assert r == {("term", "ab"): 50_000, ("value", "ab "): 1, ("value", "zzz"): 1, ("term", "zzz"): 1}


def test_common_prefix_of_any_length(spark):
    t = spark.range(600).selectExpr("id", "concat(repeat('x', 10000), id) city")
    assert count_terms(t, ["city"], "id").where("records = 1 and occurrences = 1").count() == 1200


def test_marks(spark):
    t = spark.createDataFrame([("a", 0), ("b", 2), ("c", 3), ("d", 41)], "item string, records bigint")
    assert [r["mark"] for r in mark_terms(t, 1000).orderBy("item").collect()] == [None, "rare", None, "common"]


def test_sketches_merge_within_the_error(spark):
    t = spark.range(200_000).select((F.col("id") % 50).cast("int").alias("load_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("country"), F.exp(F.randn(1)).alias("x"), F.lit(1).alias("n"))
    t = t.withColumn("x", F.when(F.col("load_id") == 3, float("nan")).when(F.col("load_id") == 4, float("inf")).when(F.col("load_id") == 5, -1.0).otherwise(F.col("x")))
    sketches = build_sketches(t, ["load_id"], ["country"], ["x"])
    assert {r["load_id"] for r in sketches.select("load_id").distinct().collect()} == set(range(50)) - {3, 4, 5}
    some = merge_sketches(sketches.where("load_id < 20"))
    for r in percentiles(some).collect():
        own = np.sort([x["x"] for x in t.where(F.col("country") == r["key"]).where("load_id < 20 and load_id not in (3, 4, 5)").select("x").collect()])
        assert r["n"] == len(own)
        for p, share in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95)):
            rank = np.searchsorted(own, r[p], side="right") / len(own)
            assert abs(rank - share) <= 1.5 * rank_error() + 1 / len(own)


def test_names_of_percentiles(spark):
    t = spark.range(5000).selectExpr("1 load_id", "'a' country", "id + 1.0 x")
    out = percentiles(build_sketches(t, ["load_id"], ["country"], ["x"]), (0.001, 0.002, 0.05, 0.5, 0.999, 1.0))
    assert out.columns[-6:] == ["p0_1", "p0_2", "p05", "p50", "p99_9", "p100"]


def test_sketch_edges(spark):
    t = spark.createDataFrame([(1, None, 5.0, 0), (1, None, 5.0, 0), (1, "a", None, 0), (None, "a", 2.0, None)], "load_id int, country string, x double, clicked int")
    r = {(x["load_id"], x["dimension"], x["key"]): x for x in percentiles(build_sketches(t, ["load_id"], ["country", "clicked"], ["x"])).collect()}
    assert set(r) == {(1, "country", None), (None, "country", "a"), (1, "clicked", "0"), (None, "clicked", None)}
    assert r[1, "country", None]["n"] == 2 and r[1, "country", None]["p50"] == 5.0
    assert build_sketches(t.limit(0), ["load_id"], ["country"], ["x"]).count() == 0


def test_duels_keep_sums_and_expectations():
    rng = np.random.default_rng(7)
    m = np.array([20, 30, 50, 90, 10, 40, 60, 25, 75])
    g = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2])
    whole = np.full(len(m), 100)
    mean = np.zeros(len(m))
    for _ in range(4000):
        q = _duels(g, m, whole, rng)
        assert all(q[g == i].sum() == m[g == i].sum() for i in range(3))
        assert ((q == 0) | (q == 100)).all()
        mean += q / 4000
    assert np.abs(mean - m).max() < 3.5


@pytest.mark.parametrize("taken", [1, 2_000_000_000 - 1])
def test_duels_of_tiny_and_nearly_whole_probabilities(taken):
    """2e9 records of which one (or all but one) is wanted, in blocks of 100,000."""
    whole, block = 2_000_000_000, 100_000
    rng = np.random.default_rng(3)
    left, chosen = [], 0
    for _ in range(20):
        q = _duels(np.zeros(block, int), np.full(block, taken), np.full(block, whole), rng)
        assert q.sum() == block * taken
        chosen += int((q == whole).sum())
        left += q[(q > 0) & (q < whole)].tolist()
    rest = (whole // block - 20) * [block * taken % whole]  # the undecided ones of the other blocks
    chosen += (whole // block - 20) * (block * taken // whole)
    q = _duels(np.zeros(len(left) + len(rest), int), np.array(left + rest), np.full(len(left) + len(rest), whole), rng)
    assert ((q == 0) | (q == whole)).all() and chosen + (q == whole).sum() == taken


@pytest.mark.parametrize("size", [1, 13, 64, 10_000])
def test_pivotal_over_batches(size):
    names = ["plan_id", "category", "id", "mass", "whole", "u"]
    rows = [(None, "a", 5, 1, 2, 0)] + [(1, "a", i, 1, 4, (i * 2654435761) % 2**40) for i in range(100)] + [(1, "b", i, 3, 10, i) for i in range(7)] + [(1, None, i, 1, 2, i) for i in range(2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size])], names=names) for k in range(0, len(rows), size)]
    out = pa.Table.from_batches(list(_pivotal(1)(iter(batches)))).to_pylist()
    assert sum(r["mass"] == r["whole"] for r in out if r["category"] == "a" and r["plan_id"]) == 25
    b = [r["mass"] for r in out if r["category"] == "b"]
    assert sum(b) == 21 and sum(0 < x < 10 for x in b) == 1
    assert [r["mass"] for r in out if r["plan_id"] is None] == [1] and sum(r["mass"] == 2 for r in out if r["category"] is None) == 1


def test_many_lines(spark):
    """More lines than a batch has rows, each met exactly."""
    t = spark.range(60_000).selectExpr("cast(id % 20000 as int) load_id", "id", "cast(id % 2 as int) clicked_on_ad")
    plans = spark.range(20_000).selectExpr("id plan_id", "cast(id as int) load_id", "string(id % 2) category", "1.0 target_share", "cast(null as int) min_rows", "2 sample_size")
    r = sample_plans(t, plans).report
    assert r.where("sampled = 2 and gap = 0 and required = 2 and available = 3").count() == 20_000


def test_tiny_share_of_many(spark):
    t = spark.range(300_000).selectExpr("1 load_id", "id", "1 clicked_on_ad")
    plans = spark.createDataFrame([(i, 1, "1", 1.0, None, n) for i, n in enumerate([1, 3, 299_999, 300_000])] + [(None, 1, "1", 1.0, None, 7)], "plan_id bigint, load_id int, category string, target_share double, min_rows int, sample_size int")
    got = sample_plans(t, plans)
    assert {x["plan_id"]: (x["sampled"], x["gap"]) for x in got.report.collect()} == {0: (1, 0), 1: (3, 0), 2: (299_999, 0), 3: (300_000, 0), None: (7, 0)}


def test_sample_plans(spark):
    rows = [(1, i, i % 10 == 0) for i in range(1000)] + [(2, i, None) for i in range(5)] + [(1, 0, False), (1, 0, None), (None, 3, True), (1, None, True)]
    t = spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in rows] * 2, "load_id int, id bigint, clicked_on_ad int").selectExpr("*", "1 part", "'q' category", "0 plan_id")
    plans = spark.createDataFrame(
        [(1, 1, "0", 0.5, None, 200), (1, 1, "1", 0.5, None, 200), (1, 1, "none", 0.0, 1, 200), (2, 2, "none", 1.0, 3, 4), (2, 2, "1", 0.0, 2, 4), (3, 9, "0", 1.0, None, 10), (4, 1, "0", None, None, None), (5, 1, "1", 0.005, None, 100)],
        "plan_id bigint, load_id int, category string, target_share double, min_rows int, sample_size int",
    )
    got = sample_plans(t, plans)
    r = {(x["plan_id"], x["category"]): x for x in got.report.collect()}
    assert (r[1, "0"]["required"], r[1, "0"]["available"], r[1, "0"]["sampled"], r[1, "0"]["short"]) == (100, 901, 100, False)
    assert (r[1, "1"]["required"], r[1, "1"]["available"]) == (100, 100)
    assert r[1, "none"]["sampled"] == 1 and not r[1, "none"]["short"]
    assert r[2, "none"]["sampled"] == 4 and r[2, "1"]["short"] and r[3, "0"]["short"] and r[3, "0"]["gap"] == 10
    assert r[3, "0"]["probability"] == 0 and r[2, "none"]["probability"] == pytest.approx(0.8)
    assert r[4, "0"]["required"] == 0 and r[4, "0"]["sampled"] == 0 and r[5, "1"]["required"] == 1
    assert r[1, "0"]["tilt"] == pytest.approx(math.log(100 / 901), abs=1e-9)
    s = got.sample
    assert s.groupBy("plan_id", "id").count().where("count > 1").count() == 0
    assert {x["category"]: x["count"] for x in s.where("plan_id = 1").groupBy("category").count().collect()} == {"0": 100, "1": r[1, "1"]["sampled"], "none": 1}
    assert sample_plans(t.limit(0), plans).sample.count() == 0 and sample_plans(t, plans.limit(0)).report.count() == 0


def test_samples_are_fair(spark):
    t = spark.range(4000).selectExpr("cast(1 as int) load_id", "id", "cast(id % 2 as int) clicked_on_ad")
    plans = spark.createDataFrame([(i, 1, "0", 1.0, None, 500) for i in range(40)], "plan_id bigint, load_id int, category string, target_share double, min_rows int, sample_size int")
    s = sample_plans(t, plans).sample
    assert s.count() == 20_000
    hits = s.groupBy((F.col("id") / 400).cast("int").alias("b")).count().collect()
    assert all(abs(x["count"] - 2000) < 250 for x in hits)
