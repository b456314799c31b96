"""Encoding texts with a public byte-level BPE vocabulary, in two tiers.

Tier 1: a minimal perfect hash over the vocabulary resolves every pre-token that is a token as a whole. It is looked up
for all different pre-tokens of a batch at once; the token's bytes are compared, so that no other string passes.
Tier 2: what is left is merged from its bytes: a heap holds the adjacent pairs by (rank, position) over a doubly linked
list, so that a pre-token of n bytes takes n log n steps, however long it is.

The vocabulary has a fixed size; its file is read on the driver and sent to the executors once. Texts of any length are
encoded whole. Defined cases: null and empty texts give the empty list; strings that look like special tokens are
ordinary text; white space is kept by the pattern; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.plans.common import received, shipped

#: Pre-token pattern of the byte_bpe vocabularies (fixed value; the same text as PATTERN of the tokenizers' folder).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MIX, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_MEMO = 100_000


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * _MIX & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK
    return (x >> 32) % n


class MinimalPerfectHash:
    """n keys to n slots. Keys share a bucket by hash; a bucket's displacement puts all its keys into free slots."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(max(1, n))]
        for i, h in enumerate(hashes):
            buckets[h % n].append(i)
        self.displace = np.zeros(max(1, n), np.int64)  # below 0: the slot itself, minus one
        self.slot_key = np.full(max(1, n), -1, np.int32)
        free_at = 0
        for b in sorted(range(n), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) > 1:
                d = 1
                while True:
                    slots = [_slot(hashes[i], d, n) for i in own]
                    if len(set(slots)) == len(slots) and all(self.slot_key[s] < 0 for s in slots):
                        break
                    d += 1
                self.displace[b] = d
                for s, i in zip(slots, own):
                    self.slot_key[s] = i
            elif own:
                while self.slot_key[free_at] >= 0:
                    free_at += 1
                self.displace[b], self.slot_key[free_at] = -free_at - 1, own[0]

    def find(self, key: bytes) -> int:
        """The index that key has if it is a key at all."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.n]
        return int(self.slot_key[-d - 1 if d < 0 else _slot(h, int(d), self.n)])

    def find_all(self, keys: list[bytes]) -> np.ndarray:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        d = self.displace[(h % np.uint64(self.n)).astype(np.int64)]
        with np.errstate(over="ignore"):
            x = (h ^ (d.astype(np.uint64) * np.uint64(_MIX))) * np.uint64(0xBF58476D1CE4E5B9)
        slots = np.where(d < 0, -d - 1, ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64))
        return self.slot_key[slots]


class Vocabulary:
    """Tokens with their ids, which are also the merge ranks."""

    def __init__(self, path: str):
        pairs = [line.split() for line in open(path, "rb") if line.strip()]
        self.tokens = [base64.b64decode(a) for a, _ in pairs]
        self.ids = [int(b) for _, b in pairs]
        self.hash = MinimalPerfectHash(self.tokens)
        self.memo: dict[str, tuple[int, ...]] = {}

    def rank(self, token: bytes) -> int:
        """The token's id, or -1."""
        i = self.hash.find(token)
        return self.ids[i] if i >= 0 and self.tokens[i] == token else -1

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tier 2."""
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that starts at i; 0 when it has been merged away
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.rank(piece[i : i + 2])) >= 0]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i]
            if not end[i] or j >= n or end[j] != stop or end[i] != j:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.rank(piece[i : end[after[i]]])) >= 0:
                    heappush(heap, (r, i, end[after[i]]))
            if (b := before[i]) >= 0 and (r := self.rank(piece[b:stop])) >= 0:
                heappush(heap, (r, b, stop))
        return tuple(self.rank(piece[i : end[i]]) for i in range(n) if end[i])

    def resolve(self, pieces: set[str]) -> None:
        """Puts the ids of all pieces into the memo."""
        new = [p for p in pieces if p not in self.memo]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        found = self.hash.find_all(raw) if raw else ()
        for p, r, i in zip(new, raw, found):
            self.memo[p] = (self.ids[i],) if i >= 0 and self.tokens[i] == r else self.merge(r)


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row. vocabulary: path of a .tiktoken file of ranks."""
    shared = shipped(df.sparkSession, Vocabulary(vocabulary))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = received(shared)
        split = regex.compile(PATTERN).findall
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                texts = [split(t) if t else () for t in part.column(1).to_pylist()]
                pieces = set().union(*texts)
                if len(v.memo) + len(pieces) > _MEMO:
                    v.memo.clear()
                v.resolve(pieces)
                get, flat, ends = v.memo.__getitem__, [], [0]
                for t in texts:
                    for ids in map(get, t):
                        flat += ids
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")
