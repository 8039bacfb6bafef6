"""Byte-pair encoding by a public rank file, as a two-tier lookup.

Tier 1 resolves a whole pre-token by a minimal perfect hash of the vocabulary. Tier 2, for pre-tokens that
aren't in it, merges linked bytes by a heap of pair ranks. The hash and the pair table are built once on the
driver from the vocabulary (a fixed file of some 50,000 entries) and shipped with the task.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from dataclasses import dataclass

import numpy as np
import regex
import xxhash

#: Rank file used unless another is given; the folder of public vocabularies is a setting.
DEFAULT_VOCABULARY = os.path.join(os.environ.get("PREPLINE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")

# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of the memo of a worker and longest text it keeps; it is emptied when full, so memory is bounded and
#: results don't depend on it.
MEMO, MEMO_CHARS = 1 << 17, 64

_SHIFT = 17  # ids are below 2 ** 17 in every vocabulary this reads


@dataclass(frozen=True)
class PerfectHash:
    """A minimal perfect hash by hash and displace: n keys have the slots 0 .. n - 1.

    ``shift[b]`` is the displacement of bucket b if it is 0 or more, else the complement of the only slot of
    that bucket.
    """

    seed: int
    shift: np.ndarray
    n: int

    @staticmethod
    def build(keys: list[bytes], per_bucket: int = 2) -> PerfectHash:
        n = len(keys)
        for seed in range(64):
            found = PerfectHash._try(keys, n, max(1, -(-n // per_bucket)), seed)
            if found is not None:
                return PerfectHash(seed, found, n)
        raise ValueError("no perfect hash found: are the keys distinct?")

    @staticmethod
    def _try(keys: list[bytes], n: int, n_buckets: int, seed: int) -> np.ndarray | None:
        buckets: list[list[int]] = [[] for _ in range(n_buckets)]
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k, seed)
            buckets[h % n_buckets].append(h)
        shift, taken = np.zeros(n_buckets, dtype=np.int64), bytearray(n)
        order = sorted(range(n_buckets), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            hs = buckets[b]
            if len(hs) > 1:
                for d in range(200_000):
                    slots = {((h >> 32) + d * ((h >> 16) & 0xFFFF | 1)) % n for h in hs}
                    if len(slots) == len(hs) and not any(taken[s] for s in slots):
                        break
                else:
                    return None
                for s in slots:
                    taken[s] = 1
                shift[b] = d
            elif hs:
                if free is None:  # buckets of one key come last and take what is left
                    free = iter([s for s in range(n) if not taken[s]])
                shift[b] = ~next(free)
        return shift


@dataclass(frozen=True)
class Vocabulary:
    """What a worker needs of a rank file: tokens and ids in hash order, and the ranks of mergeable pairs."""

    hash: PerfectHash
    tokens: list[bytes]
    ids: np.ndarray
    byte_ids: list[int]
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    pattern: str


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    """Reads a rank file (a token in base64 and its rank on each line) on the driver."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing or max(ranks.values()) >= 1 << _SHIFT:
        raise ValueError(f"{path} is no byte-level vocabulary of less than {1 << _SHIFT} ids")
    keys = list(ranks)
    h = PerfectHash.build(keys)
    tokens: list[bytes] = [b""] * len(keys)
    for k in keys:
        tokens[_slot(h.seed, h.shift, h.n, k)] = k
    pair_keys, pair_ids = [], []
    for t, i in ranks.items():
        for at in range(1, len(t)):
            left, right = ranks.get(t[:at]), ranks.get(t[at:])
            if left is not None and right is not None:
                pair_keys.append(left << _SHIFT | right)
                pair_ids.append(i)
    return Vocabulary(h, tokens, np.array([ranks[t] for t in tokens], dtype=np.int32), [ranks[bytes([b])] for b in range(256)], np.array(pair_keys, dtype=np.int64), np.array(pair_ids, dtype=np.int32), pattern)


def _slot(seed: int, shift, n: int, key: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(key, seed)
    d = int(shift[h % len(shift)])
    return ~d if d < 0 else ((h >> 32) + d * ((h >> 16) & 0xFFFF | 1)) % n


def merge_bytes(data: bytes, byte_ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank is merged first, of equal ones the leftmost."""
    ids = [byte_ids[b] for b in data]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << _SHIFT | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or pairs.get(ids[i] << _SHIFT | ids[j]) != rank:
            continue  # one of the two was merged meanwhile
        ids[i], ids[j] = rank, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := pairs.get(rank << _SHIFT | ids[k])) is not None:
                heapq.heappush(heap, (r, i))
        if (k := before[i]) >= 0 and (r := pairs.get(ids[k] << _SHIFT | rank)) is not None:
            heapq.heappush(heap, (r, k))
    return [i for i in ids if i >= 0]


class _Memo(dict):
    """Key to result, computed on first use; emptied at ``MEMO`` entries."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts in a worker.

    A single space between two other characters always starts a pre-token, so a text whose white space is all
    single is cut there first and whole words are looked up in the memo; other texts are split by the pattern.
    """

    def __init__(self, v: Vocabulary):
        self.seed, self.shift, self.n = v.hash.seed, v.hash.shift.tolist(), v.hash.n
        self.tokens, self.ids = v.tokens, v.ids.tolist()
        self.byte_ids, self.pairs = v.byte_ids, dict(zip(v.pair_keys.tolist(), v.pair_ids.tolist()))
        self.split = regex.compile(v.pattern).findall
        self.wide = regex.compile(r"\s\s|^\s|\s$").search
        self.pre_tokens: _Memo = _Memo(self._pre_token)
        self.words: _Memo = _Memo(self._word)
        self.counts: _Memo = _Memo(lambda w: len(self._word(w)) // 4)

    def _pre_token(self, text: str) -> bytes:
        data = text.encode("utf-8")
        s = _slot(self.seed, self.shift, self.n, data)
        ids = [self.ids[s]] if self.tokens[s] == data else merge_bytes(data, self.byte_ids, self.pairs)
        return np.array(ids, dtype="<i4").tobytes()

    def _word(self, text: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.split(text)))

    def _parts(self, text: str) -> list[str]:
        if self.wide(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self._parts(text)))

    def count(self, text: str) -> int:
        """The number of ids of ``text``."""
        return sum(map(self.counts.__getitem__, self._parts(text)))
