"""Evaluation texts inside training texts: suffix arrays over shards of the corpus.

Texts and items are read as words: markup, entities, case, punctuation and white space don't count. Each task cuts its
documents into shards of about SHARD words and sorts all suffixes of the shard's stretches of item words (no other stretch
can match) to their full depth, with the lengths of the common prefixes of neighbours. Every suffix of every item is looked
up by binary search at full depth; its neighbours there give the longest verbatim match, and the suffixes around it that
share at least SEED words give all places with the length of each match. Matches that a longer one covers are left out.

A leaked passage may have exchanged words: the words around each verbatim match are compared on the same diagonal, and runs
of at least min_words with at most one word in `replaced` exchanged are kept. Such a run always holds SEED equal words in a
row: with k <= L / 8 exchanged words, the longest of its k + 1 equal stretches has (L - k) / (k + 1) words, which is above 5
for every L >= 22 up to 8 * k + 7, k >= 2.

The items are the stated query set; they are sent to all tasks in blocks of at most ITEMS items or ITEM_WORDS words, so what
is sent has a bound. A document longer than a shard is read in parts, each with the words of the next part up to the length
of the longest item, so that no run is lost between them.

Defined cases: null, empty and blank texts leak nothing; an item shorter than min_words leaks nowhere; a run begins and
ends with an equal word; repeated rows and several runs give one row per (document, item).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.plans.common import received, shipped

SEED = 6
SHARD = 300_000
ITEMS, ITEM_WORDS = 2_000, 2_000_000
#: Words compared at a time on the diagonals.
CELLS = 4_000_000
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ids in order (a suffix that ends sooner comes first), by doubling the compared length."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n:
        second = np.zeros(n, np.int64)
        if k < n:
            second[: n - k] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([1], 1 + np.cumsum(np.diff(key[order]) > 0)))
        rank, k = new, 2 * k
    return order


def common_prefix(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of places, how many values of a from i and of b from j are equal. Both end in a value of their own."""
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        live = live[a[i[live] + out[live]] == b[j[live] + out[live]]]
        out[live] += 1
    return out


def places(text: np.ndarray, order: np.ndarray, items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each suffix of items (by its start in at), how many suffixes of text are smaller: binary search at full depth.
    text ends in a value that items lack, items in one that text lacks."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        p, q = order[mid], at[open_]
        n = common_prefix(text, p, items, q)
        less = text[p + n] < items[q + n]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    return lo


class Items:
    """The query set as word ids: 0 is a separator, any other id a word of some item."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int, replaced: int):
        self.min_words, self.replaced = min_words, replaced
        self.vocabulary: dict[str, int] = {}
        self.keys, texts = [], []
        for key, text in rows:
            w = words(text)
            if len(w) >= min_words:
                self.keys.append(key)
                texts.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        self.longest = max(map(len, texts), default=0)
        self.matrix = np.full((len(texts), self.longest + 1), -1, np.int64)
        for i, t in enumerate(texts):
            self.matrix[i, : len(t)] = t
        # all items one after the other, each closed by -2, which no shard has inside a stretch
        self.flat = np.array([x for t in texts for x in (*t, -2)] or [-2], np.int64)
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length + 1) - length - 1
        n = np.maximum(length - SEED + 1, 0)
        self.item = np.repeat(np.arange(len(texts)), n)
        self.at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.starts = (begin[self.item] if len(texts) else np.zeros(0, np.int64)) + self.at

    def search(self, ids: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(owner, item, longest run, its exchanged words, longest verbatim match, its word in ids and in the item) over the
        words ids; owner is the document of each word."""
        n = len(ids)
        known = ids > 0
        # starts of SEED known words in a row; a suffix elsewhere can't match
        c = np.concatenate(([0], np.cumsum(known)))
        starts = np.zeros(n, bool)
        if n >= SEED:
            starts[: n - SEED + 1] = (c[SEED:] - c[:-SEED]) == SEED
        if not starts.any() or not len(self.starts):
            return
        inside = np.convolve(starts.astype(np.int64), np.ones(SEED, np.int64))[:n] > 0
        gap = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        place = np.flatnonzero(inside)
        # stretches one after the other, each closed by 0, which no item has
        at = np.arange(len(place)) + np.searchsorted(gap, place, "right") - 1
        text = np.zeros(len(place) + len(gap), np.int64)
        origin = np.zeros(len(text), np.int64)
        text[at], origin[at] = ids[place], place
        order = suffix_array(text)
        # the longest match of an item suffix is with a neighbour of its place; all matches of SEED words stand around it
        where = places(text, order, self.flat, self.starts)
        group = np.concatenate(([0], np.cumsum(self._shared(text, order) < SEED)))
        sizes = np.bincount(group)
        first = np.cumsum(sizes) - sizes
        found = []
        for near in (where - 1, where):
            q = np.flatnonzero((near >= 0) & (near < len(order)))
            q = q[common_prefix(text, order[near[q]], self.flat, self.starts[q]) >= SEED]
            found.append((q, group[near[q]]))
        q, g = (np.concatenate(x) for x in zip(*found))
        if not len(q):
            return
        q, g = np.unique(np.stack([q, g], 1), axis=0).T
        chunk = np.cumsum(sizes[g]) // CELLS  # so many matches are looked at together
        match: dict[tuple[int, int], tuple[int, int, int]] = {}
        diagonals = []
        for c in np.unique(chunk):
            part, hits = q[chunk == c], sizes[g[chunk == c]]
            which = np.repeat(part, hits)
            spot = order[np.repeat(first[g[chunk == c]], hits) + np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)]
            # a match that goes on to the left is part of a longer one
            left = (spot > 0) & (self.at[which] > 0) & (text[spot - 1] == self.flat[self.starts[which] - 1])
            which, spot = which[~left], spot[~left]
            length = common_prefix(text, spot, self.flat, self.starts[which])
            for i, p, a, m in zip(self.item[which].tolist(), origin[spot].tolist(), self.at[which].tolist(), length.tolist()):
                k = (int(owner[p]), i)
                if m > match.get(k, (0, 0, 0))[0]:
                    match[k] = (m, p, a)
            diagonals.append(np.unique(np.stack([self.item[which], origin[spot] - self.at[which]], 1), axis=0))
        diagonal = np.unique(np.concatenate(diagonals), axis=0)
        step = max(1, CELLS // (self.longest + 1))
        for part in range(0, len(diagonal), step):
            for o, i, best, lost in self._runs(ids, owner, diagonal[part : part + step]):
                yield o, i, best, lost, *match.get((o, i), (0, 0, 0))

    @staticmethod
    def _shared(text: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The common prefixes of neighbouring suffixes, as far as SEED words."""
        out = np.zeros(max(0, len(order) - 1), np.int64)
        a, b = order[:-1], order[1:]
        live = np.arange(len(out))
        for k in range(SEED):
            live = live[(a[live] + k < len(text)) & (b[live] + k < len(text))]
            live = live[(text[a[live] + k] == text[b[live] + k]) & (text[a[live] + k] > 0)]
            out[live] += 1
        return out

    def _runs(self, ids: np.ndarray, owner: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Runs on each diagonal (item, start of the item in ids)."""
        n, m, least, r = len(ids), self.longest, self.min_words, self.replaced
        item, start = diagonal[:, 0], diagonal[:, 1]
        at = start[:, None] + np.arange(m)
        want = self.matrix[item, :m]
        there = (at >= 0) & (at < n) & (want > 0)
        got = np.where(there, ids[np.clip(at, 0, n - 1)], 0)
        equal = there & (got == want)
        # separators (-2) and the ends of texts break a run: they count as more exchanged words than any run may have
        cost = np.where(equal, 0, np.where(there & (got != -2), 1, m + 1))
        f = np.arange(m + 1) - r * np.concatenate([np.zeros((len(item), 1), np.int64), np.cumsum(cost, 1)], 1)
        big = np.iinfo(np.int64).max // 4
        low = np.minimum.accumulate(np.where(equal, f[:, :m], big), 1)  # the best start up to here
        reach = np.where(equal[:, least - 1 :], f[:, least:] - low[:, : m - least + 1], -1)
        good = np.flatnonzero((reach >= 0).any(1))
        for g in good:
            ends = np.flatnonzero(reach[g] >= 0)
            best, lost, place = 0, 0, 0
            for e in ends[::-1]:
                t = e + least
                ok = np.flatnonzero(equal[g, : e + 1] & (f[g, : e + 1] <= f[g, t]))
                if len(ok) and t - ok[0] > best:
                    best, place = int(t - ok[0]), int(at[g, ok[0]])
                    lost = int(cost[g, ok[0] : t].sum())
            yield int(owner[place]), int(item[g]), best, lost


def blocks_of(rows: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """rows in blocks of bounded size; an item of more words than that is a block by itself."""
    block: list[tuple[int, str]] = []
    n = 0
    for r in rows:
        size = len(r[1]) // 2 + 1
        if block and (len(block) >= ITEMS or n + size > ITEM_WORDS):
            yield block
            block, n = [], 0
        block.append(r)
        n += size
    yield block


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 22, replaced: int = 8, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_words, n_replaced, n_verbatim, doc_word, item_word): each document with each item it leaks: the
    longest run, and the longest verbatim match with the words of document and item at which it begins."""
    rows = [(r[0], r[1]) for r in items.select(item, "text").where("text is not null").distinct().orderBy(item, "text").toLocalIterator()]
    schema = "doc_id long, item_id long, n_words int, n_replaced int, n_verbatim int, doc_word long, item_word int"
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(block: Items):
        shared = shipped(documents.sparkSession, block)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q: Items = received(shared)
            get = q.vocabulary.get
            parts: list[np.ndarray] = []
            owners: list[tuple[int, int]] = []
            size = 0

            def flush() -> pd.DataFrame:
                found: dict[tuple[int, int], tuple] = {}
                if parts:
                    ids = np.concatenate(parts)
                    lengths = np.array([len(p) for p in parts])
                    begin = np.cumsum(lengths) - lengths
                    owner = np.repeat(np.arange(len(parts)), lengths)
                    for o, i, length, lost, verbatim, p, a in q.search(ids, owner):
                        k = (owners[o][0], q.keys[i])
                        if found.get(k, (0, 0))[0] < length:
                            found[k] = (length, lost, verbatim, owners[o][1] + p - int(begin[o]), a)
                return pd.DataFrame([(*k, *v) for k, v in found.items()], columns=names)

            for f in frames:
                for doc, t in zip(f["k"], f["t"]):
                    w = np.fromiter((get(x, -1) for x in words(t)), np.int64)
                    if len(w) < q.min_words:
                        continue
                    for a in range(0, len(w), SHARD):
                        piece = w[a : a + SHARD + q.longest]
                        if size and size + len(piece) > SHARD:
                            yield flush()
                            parts.clear()
                            owners.clear()
                            size = 0
                        parts.append(np.append(piece, -2))
                        owners.append((doc, a))
                        size += len(piece) + 1
            yield flush()

        return documents.select(documents[key].cast("long").alias("k"), documents[text].cast("string").alias("t")).where("t is not null and k is not null").mapInPandas(run, schema)

    out = None
    for block in blocks_of(rows):
        one = scan(Items(block, min_words, replaced))
        out = one if out is None else out.unionByName(one)
    longest = F.max(F.struct("n_words", (-F.col("n_replaced")).alias("kept"), "n_verbatim", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    return out.groupBy("doc_id", "item_id").agg(longest.alias("run")).select("doc_id", "item_id", "run.n_words", (-F.col("run.kept")).alias("n_replaced"), "run.n_verbatim", (-F.col("run.d")).alias("doc_word"), (-F.col("run.i")).alias("item_word"))


def clean(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """documents without those that leak an item."""
    return documents.join(found.select(found["doc_id"].alias(key)).distinct(), key, "left_anti")
