"""Test passages inside a corpus: a stored positional inverted index of the training text.

``build_index`` turns the corpus into segments of documents. A segment holds,
for each of its words, the sorted list of positions where it stands (postings;
gaps between positions, compressed), and where its documents begin. Segments
are made in the tasks that read the documents, so postings never cross the
network, and are stored: new test items search the index, not the texts.

``search_index`` intersects the lists of neighbouring item words, adjusted by
the offset, looks up each window of ``run`` words of an item by its rarest pair
in the segment, intersects that list with those of the words beside it, and
extends what is left to the exact runs. With ``slop`` runs that follow each other closely count together
(proximity), else each stands for itself (exact phrases). The test items
(checked to be small; in several rounds if they are not) go to all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.llm.latex import Overgrown, words, write_out_macros
from phytoscape.session import materialise

#: Bytes of item texts that go to the tasks at once.
ITEM_BYTES = 16 << 20
SEGMENT_WORDS = 1_500_000
_CANDIDATES = 4_000_000  # positions compared at once
_INDEX = "keys binary, starts binary, terms binary, counts binary, gaps binary, n long"


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _hashes(known) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in known), np.uint64, len(known))


def _segment(keys: list[int], texts: list[np.ndarray], numbers: _Numbers) -> tuple:
    """Postings of a segment: terms (hashes, sorted), how often each stands, and the gaps between its positions."""
    starts = np.cumsum([0] + [len(t) for t in texts]).astype(np.int32)
    w = np.concatenate(texts)
    terms = _hashes(numbers)
    order = np.argsort(terms, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    w = place[w]
    at = np.argsort(w, kind="stable").astype(np.int32)  # positions by term, ascending within each
    counts = np.bincount(w, minlength=len(terms)).astype(np.int32)
    gaps = np.diff(at, prepend=np.int32(0))
    first = np.cumsum(counts) - counts
    gaps[first] = at[first]
    squeeze = lambda a: zlib.compress(a.tobytes(), 1)
    planes = gaps.view(np.uint8).reshape(-1, 4).T  # most high bytes are 0
    return np.array(keys, np.int64).tobytes(), starts.tobytes(), terms[order].tobytes(), squeeze(counts), squeeze(np.ascontiguousarray(planes)), len(w)


def build_index(docs: DataFrame, key: str, text: str, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the positional index of (key, text). Rows without key, missing and empty texts have no postings; repeated documents have theirs each."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, keys, rows, numbers = [], [], 0, _Numbers()

        def row() -> pd.DataFrame:
            return pd.DataFrame([_segment(keys, held, numbers)], columns=["keys", "starts", "terms", "counts", "gaps", "n"])

        for b in batches:
            for k, t in zip(b["key"], b["text"]):
                ws = words(t)
                if ws:
                    held.append(np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws)))
                    keys.append(k)
                    rows += len(ws)
                if rows >= segment_words:
                    yield row()
                    held, keys, rows, numbers = [], [], 0, _Numbers()
        if held:
            yield row()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").mapInPandas(build, _INDEX)


class Segment:
    """A stored segment, read for the terms of some items: ``word`` has the number (from 1) of the item word at each place, 0 at others and between documents."""

    def __init__(self, row: tuple, wanted: np.ndarray, pad: int):
        keys, starts, terms, counts, gaps, n = row
        self.keys, self.starts = np.frombuffer(keys, np.int64), np.frombuffer(starts, np.int32)
        terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(zlib.decompress(counts), np.int32)
        gaps = np.ascontiguousarray(np.frombuffer(zlib.decompress(gaps), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        slot = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
        known = terms[slot] == wanted
        first, has = np.cumsum(counts) - counts, np.flatnonzero(known)
        sums = np.cumsum(gaps, dtype=np.int64)
        own = slot[has]
        m = counts[own]
        at = np.repeat(first[own] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
        place = sums[at] - np.repeat(np.where(first[own] > 0, sums[first[own] - 1], 0), m)
        border = np.zeros(n, np.int64)
        border[self.starts[1:-1]] = 1
        self.word = np.zeros(int(n + len(self.starts) + 2 * pad), np.int32)
        self.word[place + np.cumsum(border)[place] + pad] = np.repeat(has + 1, m)
        self.first = self.starts[:-1] + np.arange(len(self.starts) - 1) + pad

    def document(self, at: int) -> int:
        return int(np.searchsorted(self.first, at, "right")) - 1


class ItemIndex:
    """The items' words as numbers, one after another with zeros between."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run, vocabulary = run, _Numbers()
        self.ids, seqs = [], []
        for i, text in items:
            w = words(text)
            if len(w) >= run:
                self.ids.append(i), seqs.append(np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)) + 1)
        self.seqs, self.terms, self.pad = seqs, _hashes(vocabulary), run + 2
        self.sizes = np.array([len(x) for x in seqs], np.int64)
        self.first = np.cumsum([self.pad] + [len(x) + 1 for x in seqs])[:-1] if seqs else np.zeros(0, np.int64)
        self.all = np.zeros(int(sum(len(x) + 1 for x in seqs)) + 2 * self.pad, np.int32)
        for at, x in zip(self.first, seqs):
            self.all[at:at + len(x)] = x
        self.base = len(vocabulary) + 1
        real = (self.all[:-1] > 0) & (self.all[1:] > 0)
        self.pairs, inverse = np.unique(self._pair(self.all)[real], return_inverse=True)
        self.pair_at = np.full(len(real), -1)
        self.pair_at[real] = inverse
        # starts of all windows of run words, that is run - 1 pairs
        ok = np.cumsum(np.r_[0, real])
        starts = np.arange(len(real) - (run - 1) + 1)
        self.windows = starts[ok[starts + run - 1] - ok[starts] == run - 1]

    def _pair(self, w: np.ndarray) -> np.ndarray:
        return w[:-1].astype(np.int64) * self.base + w[1:]

    def search(self, row: tuple, share: float) -> list[tuple[int, int, int, int, int, int]]:
        """(key, document, item, shift, from, to): the runs of ``run`` or more words of an item in a segment, as positions of the item, where they may cover ``share`` of it."""
        if not len(self.windows):
            return []
        seg = Segment(row, self.terms, self.pad)
        w = seg.word
        at = np.flatnonzero((w[:-1] > 0) & (w[1:] > 0))
        slot = np.minimum(np.searchsorted(self.pairs, code := self._pair(w)[at]), len(self.pairs) - 1)
        known = self.pairs[slot] == code
        at, slot = at[known], slot[known]
        at = at[np.argsort(slot, kind="stable")]  # the intersected lists: places by pair
        count = np.bincount(slot, minlength=len(self.pairs))
        start = np.cumsum(count) - count
        # the rarest pair of each window; a window with a pair that never occurs has no run
        rare = np.where(self.pair_at >= 0, count[self.pair_at], 0)
        view = np.lib.stride_tricks.sliding_window_view(rare, self.run - 1)[self.windows]
        lead = np.unique((self.windows + view.argmin(1))[view.min(1) > 0])
        found, lo, load = [], 0, np.cumsum(rare[lead])
        while lo < len(lead):
            hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + _CANDIDATES, "right")))
            own = self.pair_at[lead[lo:hi]]
            n = count[own]
            found.append(self._aligned(w, at[np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], np.repeat(lead[lo:hi], n)))
            lo = hi
        item, shift, i, j = np.unique(np.concatenate(found), axis=0).T if found else np.zeros((4, 0), np.int64)
        doc = np.searchsorted(seg.first, shift + i, "right") - 1
        # runs of an item in a document are looked at one by one only if they could cover enough of it together
        _, pair = np.unique(np.stack([doc, item], 1), axis=0, return_inverse=True)
        go = (np.bincount(pair, weights=j - i)[pair] >= share * self.sizes[item]) if len(pair) else np.zeros(0, bool)
        return list(zip(seg.keys[doc[go]].tolist(), doc[go].tolist(), item[go].tolist(), shift[go].tolist(), i[go].tolist(), j[go].tolist()))

    def _aligned(self, w: np.ndarray, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        """(item, shift, from, to) of the runs of ``run`` or more words around pairs of places (p in the segment, g in the items)."""
        # lists of the words beside, adjusted by their offsets, are intersected: two of the next words must agree, as far as a run needs them
        same = lambda k: w[p + k] == self.all[g + k]
        right, left = same(2), same(-1)
        go = right | left
        p, g, right, left = p[go], g[go], right[go], left[go]
        if self.run > 3:
            go = (right & left) | (right & same(3)) | (left & same(-2))
            p, g = p[go], g[go]
        ends = np.stack([g, g + 2])
        for side, step in ((1, 1), (0, -1)):  # ends of the run: as far as words agree
            alive, k = np.arange(len(p)), 2 if step > 0 else -1
            while len(alive):
                alive = alive[(w[p[alive] + k] == self.all[g[alive] + k]) & (self.all[g[alive] + k] > 0)]
                ends[side, alive] += step
                k += step
        go = ends[1] - ends[0] >= self.run
        p, g, ends = p[go], g[go], ends[:, go]
        item = np.searchsorted(self.first, g, "right") - 1
        return np.stack([item, p - (g - self.first[item]), ends[0] - self.first[item], ends[1] - self.first[item]], 1)


def _cover(runs: list[tuple[int, int, int]], slop: int | None) -> int:
    """Words of an item covered by runs (shift, from, to): by all of them, or with ``slop`` by the best chain of runs close to each other in item and document."""
    chains: list[tuple[list, set]] = []
    for shift, i, j in sorted(runs, key=lambda r: (r[1], r[2], r[0])):
        if slop is None:
            chains = chains or [([], set())]
            chains[0][1].update(range(i, j))
            continue
        near = next((c for c in chains if any(abs(shift - d) <= slop and i - e <= slop for d, e in c[0])), None)
        if near is None:
            near = ([], set())
            chains.append(near)
        near[0].append((shift, j)), near[1].update(range(i, j))
    return max((len(c) for _, c in chains), default=0)


def search_index(index: DataFrame, items: DataFrame, item_key: str, item_text: str, run: int = 12, share: float = 0.5, slop: int | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(key, item, covered, words): documents of an index in which at least ``share`` of an item's words stand in runs of ``run`` (three at least) or more.

    Without ``slop`` all exact runs of an item count together, wherever they
    stand in the document. With it only runs count that follow each other within
    ``slop`` words, in the item as in the document (a passage with words put in,
    left out or changed). Items of fewer than ``run`` words are never found,
    items without id are left out; of repeated documents the greatest cover
    comes out once.
    """
    if run < 3:
        raise ValueError("runs of fewer than three words are no passages")
    items = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, -(-total * 2 // item_bytes))
    out = []
    for r in range(rounds):
        part = [(x["item"], x["text"]) for x in items.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r).collect()]
        shared = index.sparkSession.sparkContext.broadcast(part)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = ItemIndex(shared.value, run)
            for b in batches:
                for row in b[["keys", "starts", "terms", "counts", "gaps", "n"]].itertuples(index=False, name=None):
                    hits: dict[tuple[int, int, int], list] = {}
                    for key, doc, k, shift, i, j in known.search(row, share):
                        hits.setdefault((key, doc, k), []).append((shift, i, j))
                    cover = [(key, known.ids[k], _cover(runs, slop), len(known.seqs[k])) for (key, _, k), runs in hits.items()]
                    yield pd.DataFrame([c for c in cover if c[2] >= share * c[3]], columns=["key", "item", "covered", "words"])

        out.append(index.mapInPandas(find, "key long, item long, covered int, words int"))
    return reduce(DataFrame.union, out).groupBy("key", "item").agg(F.max("covered").alias("covered"), F.max("words").alias("words"))


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, share: float = 0.5, slop: int | None = None, item_bytes: int = ITEM_BYTES, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """``search_index`` over the stored index of some documents."""
    return search_index(materialise(build_index(docs, key, text, segment_words)), items, item_key, item_text, run, share, slop, item_bytes)


def overgrown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key): documents whose own macros grow without any bound worth reading; their text is indexed as it stands."""
    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = []
            for k, t in zip(b["key"], b["text"]):
                try:
                    write_out_macros(t)
                except Overgrown:
                    bad.append(k)
            yield pd.DataFrame({"key": bad}, dtype=np.int64)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.col("text").contains("\\")).mapInPandas(test, "key long")
