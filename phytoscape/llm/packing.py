"""Filling fixed-capacity sequences with articles: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.llm.tokens import TokenCounter


def token_sizes(docs: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, size) in tokens of every row; missing and empty texts have size 0. Whole texts are read."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(vocabulary)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "size": [counter.count(t) for t in b["text"]]})

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(count, "key long, size long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item (sizes at most capacity), longest first, each in the first bin with room.

    The tree holds in each inner node the greatest free room of the bins below
    it, so the first bin with room is found on one way down.
    """
    n = len(sizes)
    leaves = 1 << max(0, int(np.ceil(np.log2(max(1, n)))))
    room, out = [capacity] * (2 * leaves), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        out[i] = at - leaves
        room[at] -= size
        at >>= 1
        while at:
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
            at >>= 1
    return out


def pack(sizes: DataFrame, capacity: int, group_rows: int = 20_000, seed: int = 5, rows: int | None = None) -> DataFrame:
    """(key, piece, tokens, sequence_id, start): the place of each article, or of its pieces if it is longer than a sequence.

    Longer articles fill whole sequences and their rest is packed with the
    others; no other article is cut. Articles of size 0 take no room but have a
    sequence. Repeated keys are articles of their own; rows without key are
    left out; an empty table gives no rows. Sequence ids are unique over all
    groups, not consecutive. ``rows`` tells the number of articles where it is
    known, as counting would measure every text once more.
    """
    sizes = sizes.where("key is not null")
    groups = max(1, -(-(sizes.count() if rows is None else rows) // group_rows))
    return pack_groups(sizes.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(groups))), capacity)


def pack_groups(sizes: DataFrame, capacity: int) -> DataFrame:
    """``pack`` for rows (key, size, grp) whose groups are given."""

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "size"])
        key, size, grp = part["key"].to_numpy(), part["size"].to_numpy(), int(part["grp"].iloc[0])
        full = np.where(size > capacity, size // capacity, 0)
        rest = size - full * capacity
        packed = (rest > 0) | (full == 0)
        bins = np.full(len(part), -1)
        bins[packed] = first_fit_decreasing(rest[packed], capacity)
        used = int(bins.max()) + 1
        first = used + np.r_[0, np.cumsum(full)[:-1]]
        n = full + packed
        row = np.repeat(np.arange(len(part)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        whole = piece < full[row]
        seq = np.where(whole, first[row] + piece, bins[row])
        out = pd.DataFrame({"key": key[row], "piece": piece, "tokens": np.where(whole, capacity, rest[row]), "sequence_id": grp * (1 << 32) + seq})
        out["start"] = out.groupby("sequence_id")["tokens"].cumsum() - out["tokens"]
        return out

    return sizes.groupBy("grp").applyInPandas(fill, "key long, piece int, tokens long, sequence_id long, start long")
