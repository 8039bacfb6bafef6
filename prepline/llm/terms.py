"""Occurrences and records of every distinct value and term, counted in burst tries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.session import cut

#: Entries of a container, beyond which it bursts into one container for each next character.
BURST = 512
#: Rows and bytes that a worker gathers before it adds them to its tries.
GATHER, GATHER_BYTES = 200_000, 64 << 20
#: Entries and characters of a worker's tries, beyond which their containers are emitted and the tries emptied.
HELD, HELD_CHARS = 400_000, 64 << 20
#: Characters of the containers of one emitted batch.
EMIT_CHARS = 8 << 20
#: Most entries of a route; an entry of many characters weighs as much as several.
ROUTE_ENTRIES = 50_000
#: Characters that weigh as much as an entry.
ENTRY_CHARS = 128
#: Prefixes are lengthened until the containers below one weigh no more than a route, or than all entries divided by this ...
ROUTES = 4096
#: ... up to this many characters; routes that are still too heavy are split by a hash of their items.
PREFIX_CHARS = 32

_COUNTERS = 4  # occurrences and records as a value, occurrences and records as a term


class _Node:
    """What follows one path: a shared ``label``, then branches by the next character or, without any, a container."""

    __slots__ = ("label", "kids", "held")

    def __init__(self, label: str = "", held: dict[str, list[int]] | None = None):
        self.label = label
        self.kids: dict[str, _Node] | None = None
        self.held: dict[str, list[int]] = {} if held is None else held  # of a node with branches only the entry that ends here


class BurstTrie:
    """Strings with counters: path-compressed nodes branch by character down to containers, which burst when full.

    Paths of any length are walked without recursion; characters that all entries below a node share are its label.
    """

    def __init__(self, limit: int = 0):
        self.limit = limit or BURST
        self.root = _Node()
        self.entries = self.chars = 0
        self._last = ("", self.root)  # the path of the last container; neighbours in an order mostly share it

    def _reach(self, key: str) -> tuple[_Node, str]:
        """The node at or above the end of ``key`` that has a container, or ends where ``key`` does, and the rest of ``key``."""
        node, at = self.root, 0
        while True:
            label = node.label
            if label and not key.startswith(label, at):
                n = len(commonprefix((label, key[at : at + len(label)])))
                below = _Node(label[n + 1 :], node.held)
                below.kids = node.kids
                node.label, node.kids, node.held = label[:n], {label[n]: below}, {}
                label = node.label
            at += len(label)
            if node.kids is None or at == len(key):
                return node, key[at:]
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = _Node()
            node, at = kid, at + 1

    def add(self, key: str, counts: Sequence[int]) -> None:
        prefix, node = self._last
        if node.kids is None and node is not self.root and key.startswith(prefix):
            rest = key[len(prefix) :]
        else:
            node, rest = self._reach(key)
            self._last = (key[: len(key) - len(rest)], node)
        old = node.held.get(rest)
        if old is None:
            node.held[rest] = list(counts)
            self.entries += 1
            self.chars += len(rest)
            if node.kids is None and len(node.held) > self.limit:
                self._burst(node)
        else:
            for i, c in enumerate(counts):
                old[i] += c

    def graft(self, prefix: str, held: dict[str, list[int]]) -> None:
        """Merges a container that another trie has at ``prefix``: as a whole where the subtrees match, else by entry."""
        node, rest = self._reach(prefix)
        if node.kids is not None:  # this trie has burst there
            for suffix, counts in held.items():
                self.add(prefix + suffix, counts)
            return
        own = node.held
        self._last = ("", self.root)
        if not own and not self.limit < len(held):
            node.label += rest
            node.held = dict(held)
            self.entries += len(held)
            self.chars += sum(map(len, held))
            return
        for suffix, counts in held.items():
            old = own.get(rest + suffix)
            if old is None:
                own[rest + suffix] = counts
                self.entries += 1
                self.chars += len(rest) + len(suffix)
            else:
                for i, c in enumerate(counts):
                    old[i] += c
        if len(own) > self.limit:
            self._burst(node)

    def _burst(self, node: _Node) -> None:
        """Moves what all entries share to the label and the rest to a container for each next character, and so on."""
        todo = [node]
        while todo:
            node = todo.pop()
            held = node.held
            shared = commonprefix((min(held), max(held)))
            node.label += shared
            node.kids, node.held = {}, {}
            n = len(shared)
            self.chars -= n * (len(held) - 1)
            for rest, counts in held.items():
                if len(rest) == n:
                    node.held[""] = counts
                else:
                    node.kids.setdefault(rest[n], _Node()).held[rest[n + 1 :]] = counts
            todo += [kid for kid in node.kids.values() if len(kid.held) > self.limit]

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, suffixes with counters) of each container."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            prefix += node.label
            if node.held:
                yield prefix, node.held
            todo += [(prefix + k, kid) for k, kid in (node.kids or {}).items()]


_CONTAINER = pa.schema([("field", pa.string()), ("prefix", pa.string()), ("weight", pa.int64()), ("suffixes", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_CONTAINER_SQL = "field string, prefix string, weight bigint, suffixes array<string>, counts array<bigint>"


def _weight(prefix: str, held: dict[str, list[int]]) -> int:
    return len(held) + (len(held) * len(prefix) + sum(map(len, held))) // ENTRY_CHARS


def _rows(part: list[tuple[str, str, dict[str, list[int]]]]) -> pa.RecordBatch:
    fields, prefixes, held = zip(*part)
    columns = [fields, prefixes, [_weight(p, h) for p, h in zip(prefixes, held)], [list(h) for h in held], [[c for x in h.values() for c in x] for h in held]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CONTAINER)], schema=_CONTAINER)


def _emit(tries: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
    part: list = []
    size = 0
    for field, trie in tries.items():
        for prefix, held in trie.containers():
            part.append((field, prefix, held))
            size += len(prefix) + sum(map(len, held)) + 64 * len(held)
            if size >= EMIT_CHARS:
                yield _rows(part)
                part, size = [], 0
    if part:
        yield _rows(part)


def _count_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a worker's rows (field, item, and four counters) to one trie per field; emits the containers.

    Tries that have grown too large are emitted and begun anew, so a task's memory doesn't grow with its items.
    """
    tries: dict[str, BurstTrie] = {}
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def add() -> None:
        t = pa.Table.from_batches(held).group_by(["field", "item"]).aggregate([(f"c{i}", "sum") for i in range(_COUNTERS)]).sort_by([("field", "ascending"), ("item", "ascending")])
        counts = np.column_stack([t[f"c{i}_sum"].to_numpy() for i in range(_COUNTERS)]).tolist()
        for field, item, c in zip(t["field"].to_pylist(), t["item"].to_pylist(), counts):
            if field not in tries:
                tries[field] = BurstTrie()
            tries[field].add(item, c)
        held.clear()

    for b in batches:
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows >= GATHER or size >= GATHER_BYTES:
            add()
            rows = size = 0
            if sum(t.entries for t in tries.values()) > HELD or sum(t.chars for t in tries.values()) > HELD_CHARS:
                yield from _emit(tries)
                tries.clear()
    if held:
        add()
    yield from _emit(tries)


def _heavy_prefixes(containers: DataFrame) -> frozenset[tuple[str, str]]:
    """Prefixes with too many entries below them for one task; at most ``ROUTES`` of each length come to the driver."""
    total = containers.agg(F.sum("weight")).first()[0] or 0
    most = max(ROUTE_ENTRIES, total // ROUTES)
    if total <= most:
        return frozenset()
    lengths = F.sequence(F.lit(0), F.least(F.length("prefix"), F.lit(PREFIX_CHARS)))
    below = containers.select("field", "weight", F.explode(F.transform(lengths, lambda n: F.substring("prefix", F.lit(1), n))).alias("p"))
    return frozenset((r["field"], r["p"]) for r in below.groupBy("field", "p").agg(F.sum("weight").alias("n")).where(F.col("n") > most).collect())


_ROUTED = pa.schema([("field", pa.string()), ("route", pa.string()), ("part", pa.int64()), *list(_CONTAINER)[1:]])
_ROUTED_SQL = "field string, route string, part bigint, prefix string, weight bigint, suffixes array<string>, counts array<bigint>"


def _pieces(route_of):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Divides each container among the (route, part) that ``route_of(row)`` gives for it, or for each of its suffixes."""
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                whole, each = route_of(row)
                if whole is not None:
                    out.append((row["field"], *whole, row["prefix"], row["weight"], row["suffixes"], row["counts"]))
                    continue
                groups: dict[tuple[str, int], list[int]] = {}
                for i, s in enumerate(row["suffixes"]):
                    groups.setdefault(each(s), []).append(i)
                for to, at in groups.items():
                    held = {row["suffixes"][i]: row["counts"][_COUNTERS * i : _COUNTERS * (i + 1)] for i in at}
                    out.append((row["field"], *to, row["prefix"], _weight(row["prefix"], held), list(held), [c for x in held.values() for c in x]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_ROUTED), _ROUTED)], schema=_ROUTED)

    return split


def _router(heavy: frozenset[tuple[str, str]]):
    """Gives each item the shortest of its prefixes that isn't heavy."""

    def route_of(row: dict):
        field, prefix = row["field"], row["prefix"]
        light = lambda text, start: next((text[:n] for n in range(start, min(len(text), PREFIX_CHARS) + 1) if (field, text[:n]) not in heavy), None)
        r = light(prefix, 0)
        if r is None and len(prefix) >= PREFIX_CHARS:
            r = prefix[:PREFIX_CHARS]
        if r is not None:
            return (r, 0), None
        return None, lambda s: ((light(prefix + s[:PREFIX_CHARS], len(prefix)) or (prefix + s)[:PREFIX_CHARS]), 0)

    return _pieces(route_of)


def _splitter():
    """Divides what is on a route that is too heavy (``parts`` above 1) by a hash of the items."""

    def route_of(row: dict):
        prefix, parts = row["prefix"], row["parts"]
        if parts <= 1:
            return (row["route"], 0), None
        start = zlib.crc32(prefix.encode())
        return None, lambda s: (row["route"], zlib.crc32(s.encode(), start) % parts)

    return _pieces(route_of)


def _merge(t: pa.Table) -> pa.Table:
    """Merges the containers on one route, of all workers, into one trie."""
    trie = BurstTrie()
    for prefix, suffixes, counts in zip(t["prefix"].to_pylist(), t["suffixes"].to_pylist(), t["counts"].to_pylist()):
        trie.graft(prefix, {s: counts[_COUNTERS * i : _COUNTERS * (i + 1)] for i, s in enumerate(suffixes)})
    items, counts = [], []
    for prefix, held in trie.containers():
        items += [prefix + s for s in held]
        counts += held.values()
    found = np.array(counts, np.int64).reshape(-1, _COUNTERS)
    return pa.table({"field": pa.array([t["field"][0].as_py()] * len(items), pa.string()), "item": pa.array(items, pa.string())} | {f"c{i}": found[:, i] for i in range(_COUNTERS)})


def clean_value(c: str) -> Column:
    """A text without outer white space, inner runs of it made one space, in lower case; null if nothing is left."""
    s = F.lower(F.trim(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"(?U)\s+", " ")))
    return F.when(s != "", s)


def count_terms(df: DataFrame, fields: Sequence[str], record: str) -> DataFrame:
    """``field_name, kind, item, occurrences, records`` of every value and every space-separated word of ``fields``.

    A record is a distinct value of ``record``; an item occurs in it if any of its rows holds it. Rows with a
    null record add occurrences but no record. A word that stands twice in a value occurs twice, a repeated row
    counts again. Null and blank values are no items; an empty table has none; values may have any length. Other
    columns are ignored, whatever their names.

    Each row's items are first counted by record and item, before and after one shuffle, so neither a hot record
    nor a hot item meets in one task. Workers then count items in burst tries; the containers of all workers are
    routed by prefixes that are lengthened where there are many entries, and merged below each prefix into one
    trie. A route that holds too many entries still is split by a hash, so that none outgrows a task.
    """
    items = []
    for f in fields:
        v = clean_value(f)
        words = F.split(v, " ")
        one = F.size(words) == 1
        cell = lambda item, value, term, f=f: F.struct(F.lit(f).alias("field"), item.alias("item"), F.lit(value).alias("v"), F.lit(term).alias("t"))
        items.append(F.when(v.isNull(), F.array()).when(one, F.array(cell(v, 1, 1))).otherwise(F.concat(F.array(cell(v, 1, 0)), F.transform(words, lambda w: cell(w, 0, 1)))))
    rows = df.select(F.col(f"`{record}`").alias("record"), F.inline(F.concat(*items) if len(items) > 1 else items[0]))
    per_record = rows.groupBy("record", "field", "item").agg(F.sum("v").alias("v"), F.sum("t").alias("t"))
    known = F.col("record").isNotNull()
    counted = per_record.select("field", "item", F.col("v").alias("c0"), (known & (F.col("v") > 0)).cast("bigint").alias("c1"), F.col("t").alias("c2"), (known & (F.col("t") > 0)).cast("bigint").alias("c3"))
    containers = cut(counted.mapInArrow(_count_locally, _CONTAINER_SQL))
    if heavy := _heavy_prefixes(containers):
        routed = cut(containers.mapInArrow(_router(heavy), _ROUTED_SQL))
        parts = routed.groupBy("field", "route").agg(F.ceil(F.sum("weight") / ROUTE_ENTRIES).alias("parts")).where("parts > 1")
        routed = routed.join(parts, ["field", "route"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).mapInArrow(_splitter(), _ROUTED_SQL)
    else:
        routed = containers.select("field", F.lit("").alias("route"), F.lit(0).cast("bigint").alias("part"), "prefix", "weight", "suffixes", "counts")
    merged = routed.groupBy("field", "route", "part").applyInArrow(_merge, "field string, item string, c0 bigint, c1 bigint, c2 bigint, c3 bigint")
    kinds = F.array(
        F.when(F.col("c0") > 0, F.struct(F.lit("value").alias("kind"), F.col("c0").alias("occurrences"), F.col("c1").alias("records"))),
        F.when(F.col("c2") > 0, F.struct(F.lit("term").alias("kind"), F.col("c2").alias("occurrences"), F.col("c3").alias("records"))),
    )
    return merged.select(F.col("field").alias("field_name"), "item", F.inline(F.array_compact(kinds))).select("field_name", "kind", "item", "occurrences", "records")


def mark_terms(counts: DataFrame, n_records: int, rare: int = 2, common_share: float = 0.04) -> DataFrame:
    """``counts`` with ``mark``: rare (in 1 to ``rare`` records), common (in more than that share of all), else null."""
    r = F.col("records")
    return counts.withColumn("mark", F.when(r.between(1, rare), "rare").when(r > common_share * n_records, "common"))
