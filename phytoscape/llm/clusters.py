"""Similarity clusters by bisecting k-means, made exact across the borders of its leaves.

The tree splits the node of largest dispersion in two again and again: two
centres are fitted (2-means) and the node is cut between them along the signs
of their difference. Its leaves are compact: all members lie within half the
limit of one of them, the pivot, so each leaf is one class of alike records.

Classes are linked through their pivots. The projection on signs changes by at
most the Manhattan distance of two records, so a class that reaches within half
the limit of a cut is also handed to the other side as a guest, and every pair
of classes with alike members meets in some part. Pivots at most the limit
apart are a link; pivots farther apart than the limit and both radii are none;
the members of classes in between are compared themselves, in the same way.
Links are joined into clusters by distributed connected components.

The top of the tree is fitted on a bounded sample (it only sets the layout). A
cut is kept only if it parts a node at little doubling; a part that cannot be
cut and is too large for one task is compared in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.operators.graph import components
from phytoscape.session import materialise, tasks_for

SMALL = 512  # rows up to which a node is compared directly
_BLOCK = 256
MOST_COPIES = 1.5  # rows of both sides of a cut over the rows of the node


def _two_means(x: np.ndarray, reach: np.ndarray | float = 0.0, rounds: int = 4) -> tuple[np.ndarray, float] | None:
    """Signs and threshold of the cut of a node, None if it cannot be cut.

    The threshold lies between the centres where fewest rows (each reaching
    ``reach`` to either side) fall on both sides, but keeps a fifth of the rows
    on each.
    """
    if len(x) < 2:
        return None
    a = x[np.abs(x - x.mean(0)).sum(1).argmax()]
    c = np.stack([a, x[np.abs(x - a).sum(1).argmax()]]).astype(float)
    for _ in range(rounds):
        side = ((x - c.mean(0)) @ (c[1] - c[0])) > 0
        if side.all() or not side.any():
            break
        c = np.stack([x[~side].mean(0), x[side].mean(0)])
    sign = np.sign(np.round(c[1] - c[0], 6))
    p = x @ sign
    low, high = np.quantile(p, [0.2, 0.8])
    mid = float((c @ sign).mean())
    at = np.unique(np.r_[np.clip(mid, low, high), np.linspace(low, high, 33)])
    at = at[(at >= p.min()) & (at < p.max())]
    if not len(at):
        at = np.array([(p.min() + p.max()) / 2])
        if not p.min() < p.max():
            return None
    first, last = np.sort(p - reach), np.sort(p + reach)
    both = np.searchsorted(first, at, "right") - np.searchsorted(last, at, "left")
    share = np.searchsorted(np.sort(p), at, "right") / len(p)
    return sign, float(at[(both / len(p) + 0.3 * (share - 0.5) ** 2).argmin()])


def _cut(x: np.ndarray, radius: np.ndarray, half: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray] | None:
    """(signs, threshold, rows of the left side, of the right side), None where a cut would double too many rows."""
    cut = _two_means(x, half + radius)
    if cut is None:
        return None
    p = x @ cut[0] - cut[1]
    left, right = np.flatnonzero(p <= half + radius), np.flatnonzero(p > -half - radius)
    if len(left) + len(right) > MOST_COPIES * len(x) or max(len(left), len(right)) > 0.9 * len(x):
        return None
    return *cut, left, right


def fit_top(x: np.ndarray, leaf_rows: int, radius: np.ndarray | float = 0.0, half: float = 0.0) -> list[tuple[np.ndarray, float, int, int]]:
    """Splits (signs, threshold, left, right) of the top of the tree; a negative child −1−i is leaf i. The node of largest dispersion is split first."""
    nodes: list = []
    spread = lambda rows: -float(((x[rows] - x[rows].mean(0)) ** 2).sum()) if len(rows) else 0.0
    radius = np.broadcast_to(radius, len(x))
    todo, count, done = [(spread(np.arange(len(x))), 0, np.arange(len(x)), None)], 0, 0
    while todo:
        _, _, own, place = heappop(todo)
        cut = _cut(x[own], radius[own], half) if len(own) > leaf_rows else None
        if cut is None:
            if place:
                nodes[place[0]][2 + place[1]] = -1 - done
                done += 1
            continue
        at = len(nodes)
        nodes.append([cut[0], cut[1], None, None])
        if place:
            nodes[place[0]][2 + place[1]] = at
        for s in (0, 1):
            count += 1
            part = own[cut[2 + s]]
            heappush(todo, (spread(part), count, part, (at, s)))
    return [tuple(n) for n in nodes]


def route(nodes: list, x: np.ndarray, reach: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for all leaves a record belongs to or, reaching that far across a cut, visits as a guest; ``reach`` 0 gives one leaf each."""
    if not nodes:
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    reach = np.broadcast_to(reach, len(x))
    rows, leaf, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        if at < 0:
            rows.append(own), leaf.append(np.full(len(own), -1 - at))
            continue
        sign, cut, left, right = nodes[at]
        p, r = x[own] @ sign - cut, reach[own]
        for child, part in ((left, own[p <= r]), (right, own[p > -r] if r.any() else own[p > 0])):
            if len(part):
                todo.append((child, part))
    return np.concatenate(rows), np.concatenate(leaf)


def compact_leaves(x: np.ndarray, radius: float) -> np.ndarray:
    """Pivot (row) of each row: bisects the node of largest dispersion until all lie within ``radius`` (Manhattan) of a pivot, nodes of few rows by nearest pivots in order."""
    pivot = np.arange(len(x))
    spread = lambda rows: -float(((x[rows] - x[rows].mean(0)) ** 2).sum())
    todo, count = [(0.0, 0, np.arange(len(x)))], 0
    while todo:
        _, _, own = heappop(todo)
        if len(own) < 2:
            continue
        v = x[own]
        gap = np.abs(v - v.mean(0)).sum(1)
        near = int(gap.argmin())
        if np.abs(v - v[near]).sum(1).max() <= radius:
            pivot[own] = own[near]
            continue
        cut = _two_means(v) if len(own) > _BLOCK else None
        if cut is not None:
            side = v @ cut[0] > cut[1]
            if side.any() and not side.all():
                for part in (own[~side], own[side]):
                    count += 1
                    heappush(todo, (spread(part), count, part))
                continue
        for lo in range(0, len(own), _BLOCK):
            part = own[lo:lo + _BLOCK]
            near = np.abs(x[part][:, None] - x[part][None]).sum(-1) <= radius
            open_ = np.ones(len(part), bool)
            for i in np.argsort(-near.sum(1), kind="stable"):
                if open_[i]:
                    own_ = near[i] & open_
                    pivot[part[own_]] = part[i]
                    open_ &= ~own_
    return pivot


class _Sets:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _close(x: np.ndarray, radius: np.ndarray, a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of all pairs at most the limit and both radii apart. The Euclidean distance is never greater, so products of matrices rule out most pairs."""
    u, v = x[a].astype(np.float64), x[b].astype(np.float64)
    far = limit + radius[a].max() + radius[b].max()
    square = (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T
    i, j = np.nonzero(square <= far * far * (1 + 1e-9) + 1e-6)
    i, j = a[i], b[j]
    keep = i != j
    i, j = i[keep], j[keep]
    d = np.concatenate([np.abs(x[i[c:c + 65_536]] - x[j[c:c + 65_536]]).sum(1) for c in range(0, len(i), 65_536)]) if len(i) else np.zeros(0)
    ok = d <= limit + radius[i] + radius[j]
    return i[ok], j[ok], d[ok]


def link_leaf(x: np.ndarray, limit: float, radius: np.ndarray | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set label, unsure): smallest row index of the rows linked by distances of at most ``limit``; rows with a neighbour of another set that their radii leave open.

    ``first`` marks the rows of one of two blocks, of which only pairs across are compared.
    """
    radius = np.zeros(len(x), np.float32) if radius is None else radius
    sets, label, half = _Sets(len(x)), np.arange(len(x)), limit / 2
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [np.arange(len(x))] if first is None else []
    blocks = [] if first is None else [(np.flatnonzero(first)[p:p + SMALL], np.flatnonzero(~first)[q:q + SMALL]) for p in range(0, int(first.sum()), SMALL) for q in range(0, int((~first).sum()), SMALL)]
    while todo or blocks:
        if blocks:
            a, b = blocks.pop()
            i, j, d = _close(x, radius, a, b, limit)
            sure = d <= limit
            if not sure.all():
                open_.append((i[~sure], j[~sure]))
            i, j = i[sure], j[sure]
            while len(i):  # smallest label of all neighbours, until none changes
                low = np.minimum(label[i], label[j])
                if (low == label[i]).all() and (low == label[j]).all():
                    break
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
            for r in np.unique(np.r_[i, j]):
                sets.join(int(r), int(label[r]))
                label[r] = r
            continue
        own = todo.pop()
        if len(own) < 2:
            continue
        cut = _cut(x[own], radius[own], half) if len(own) > SMALL else None
        if cut is not None:
            todo += [own[cut[2]], own[cut[3]]]
        else:
            blocks = [(own[p:p + SMALL], own[q:q + SMALL]) for p in range(0, len(own), SMALL) for q in range(p, len(own), SMALL)]
    top = np.array([sets.top(i) for i in range(len(x))], np.int64)
    unsure = np.zeros(len(x), bool)
    for i, j in open_:
        apart = top[i] != top[j]
        unsure[i[apart]] = unsure[j[apart]] = True
    return top, unsure


def _matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


_ROW = "cls long, raw binary, radius float"


def _packed(classes: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "raw": [np.asarray(v, np.float32).tobytes() for v in b["vec"]], "radius": np.float32(0)})

    return classes.mapInPandas(pack, _ROW)


def _sample(rows: DataFrame, most: int, total: int) -> pd.DataFrame:
    """About ``most`` rows by the least hashes of their ids."""
    share = min(1.0, 1.1 * most / max(1, total))
    return rows.where(F.pmod(F.xxhash64("cls"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).orderBy(F.xxhash64("cls")).limit(most).toPandas()


def _routed(rows: DataFrame, tree: list, half: float | None) -> DataFrame:
    """Rows with the leaf of the tree they are in (``half`` None) or, as guests too, in all they reach."""
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at, leaf = route(tree, _matrix(b["raw"]), 0.0 if half is None else half + b["radius"].to_numpy())
                yield b[["cls", "raw", "radius"]].iloc[at].assign(leaf=leaf)

    return rows.mapInPandas(go, f"{_ROW}, leaf long")


def _links(rows: DataFrame, limit: float, leaf_rows: int, sample_rows: int, task_rows: int) -> DataFrame:
    """(a, b, unsure): links between rows (b NULL marks a row with neighbours that its radius leaves open), each row in every part it reaches."""
    n, half = rows.count(), limit / 2
    few = _sample(rows, sample_rows, n)
    tree = fit_top(_matrix(few["raw"]), max(SMALL // 4, int(leaf_rows * len(few) / max(1, n))), few["radius"].to_numpy(), half) if len(few) else []
    placed = materialise(_routed(rows, tree, half))
    # a part beyond task_rows could not be cut: pairs of blocks, as many as it takes
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") * 2 / task_rows).cast("int").alias("blocks"))
    parts = parts.withColumn("blocks", F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(1))
    placed = placed.join(F.broadcast(parts), "leaf")  # one row per leaf of a tree that was fitted on a bounded sample
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("leaf", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "cls", "raw", "radius")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls")
        p, q = int(part["p"].iloc[0]), int(part["q"].iloc[0])
        cls = part["cls"].to_numpy()
        top, unsure = link_leaf(_matrix(part["raw"]), limit, part["radius"].to_numpy(), None if p == q else part["own"].to_numpy() == p)
        other = top != np.arange(len(top))
        return pd.DataFrame({"a": np.r_[cls[other], cls[unsure]], "b": np.r_[cls[top[other]], cls[unsure]], "unsure": np.r_[np.zeros(int(other.sum()), bool), np.ones(int(unsure.sum()), bool)]})

    return materialise(placed.groupBy("leaf", "p", "q").applyInPandas(link, "a long, b long, unsure boolean"))


def leaves(packed: DataFrame, n: int, limit: float, leaf_rows: int = 4_000, sample_rows: int = 40_000) -> DataFrame:
    """(cls, raw, pivot, gap): every record with the pivot of its compact leaf, at most half the limit (gap) away."""
    few = _sample(packed, sample_rows, n)
    tree = fit_top(_matrix(few["raw"]), max(SMALL // 4, int(leaf_rows * len(few) / max(1, n)))) if len(few) else []
    chunks = F.pmod(F.xxhash64("cls"), F.lit(1 << 20))
    placed = _routed(packed, tree, None)

    def shrink(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls")
        x, cls = _matrix(part["raw"]), part["cls"].to_numpy()
        pivot = compact_leaves(x, limit / 2)
        return pd.DataFrame({"cls": cls, "raw": part["raw"].to_numpy(object), "pivot": cls[pivot], "gap": np.abs(x - x[pivot]).sum(1).astype(np.float32)})

    # leaves that hold more than expected (the sample may miss a dense spot) are taken in several pieces
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (4 * leaf_rows)).cast("int").alias("pieces"))
    placed = materialise(placed)
    placed = placed.join(F.broadcast(sizes), "leaf").withColumn("piece", F.pmod(chunks, F.col("pieces"))).drop("pieces")
    return placed.groupBy("leaf", "piece").applyInPandas(shrink, "cls long, raw binary, pivot long, gap float")


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Usable (id, vec, hash h), its different vectors (cls is the smallest id), and how many."""
    usable = vectors.where("id is not null and vec is not null").select("id", F.col("vec").cast("array<float>").alias("vec"))
    usable = materialise(usable.select("id", "vec", F.xxhash64("vec").alias("h")))  # sorted by the hash, vectors are compared only where it is equal
    classes = materialise(usable.groupBy("h", "vec").agg(F.min("id").alias("cls")))
    return usable, classes, classes.count()


def similarity_clusters(vectors: DataFrame, limit: float, least: int = 3, leaf_rows: int = 4_000, sample_rows: int = 40_000, task_rows: int = 60_000) -> DataFrame:
    """(id, cluster_id): records (id, vec of numbers) of all sets of ``least`` or more records connected by Manhattan distances of at most ``limit``.

    Equal vectors are alike and compared once. Records without id or vector
    are left out; an empty table gives no rows. Ties do not matter: the
    clusters are exact, whatever the tree. ``sample_rows`` bounds the sample
    that sets the top of the tree; a part of more than ``task_rows`` that no
    cut divides is compared in pairs of blocks.
    """
    spark = vectors.sparkSession
    usable, classes, n = _classes(vectors)
    if n == 0:
        return spark.createDataFrame([], "id long, cluster_id long")
    packed = _packed(classes.repartition(tasks_for(spark, n * 400)))
    placed = materialise(leaves(packed, n, limit, leaf_rows, sample_rows))
    spans = placed.groupBy("pivot").agg(F.max("gap").alias("radius"))
    pivots = placed.where("cls = pivot").join(spans, "pivot").select("cls", "raw", "radius")
    links = _links(pivots, limit, 2 * leaf_rows, sample_rows, task_rows)
    edges = links.where("not unsure").select("a", "b")
    unsure = links.where("unsure").select(F.col("a").alias("pivot")).distinct()
    of = placed.select("cls", "pivot")
    members = materialise(placed.join(unsure, "pivot", "left_semi").select("cls", "raw", F.lit(0.0).cast("float").alias("radius")))
    if not members.isEmpty():  # classes that their radii leave open: member by member
        more = _links(members, limit, 2 * leaf_rows, sample_rows, task_rows).where("not unsure").select("a", "b")
        edges = edges.union(more.join(of.toDF("a", "pa"), "a").join(of.toDF("b", "pb"), "b").select("pa", "pb"))
    joined = components(edges).toDF("pivot", "root")
    # members of each class, then whole clusters
    rooted = of.join(joined, "pivot", "left").select("cls", F.coalesce("root", "pivot").alias("root"))
    member = usable.join(classes, ["h", "vec"]).select("id", "cls").join(rooted, "cls").select("id", "root").distinct()
    sizes = member.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("cluster_id")).where(F.col("size") >= least)
    return member.join(sizes, "root").select("id", "cluster_id").distinct()


def bisecting_leaves(vectors: DataFrame, limit: float, least: int = 2, leaf_rows: int = 4_000, sample_rows: int = 40_000) -> DataFrame:
    """(leaf_id, size, radius, typical): the compact leaves of the tree themselves, with their pivot, the number of records and the three nearest to the pivot (ties: smaller id).

    Leaves of fewer than ``least`` records are left out; equal vectors are
    counted with all their records, but named once.
    """
    usable, classes, n = _classes(vectors)
    if n == 0:
        return vectors.sparkSession.createDataFrame([], "leaf_id long, size long, radius double, typical string")
    placed = materialise(leaves(_packed(classes.repartition(tasks_for(vectors.sparkSession, n * 400))), n, limit, leaf_rows, sample_rows))
    copies = usable.join(classes, ["h", "vec"]).groupBy("cls").agg(F.countDistinct("id").alias("copies"))
    rows = placed.drop("raw").join(copies, "cls")
    sizes = rows.groupBy("pivot").agg(F.sum("copies").alias("size"), F.max("gap").cast("double").alias("radius")).where(F.col("size") >= least)
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("pivot").orderBy("gap", "cls"))).where("r <= 3")
    names = top.groupBy("pivot").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("r", "cls"))), lambda m: m["cls"].cast("string"))).alias("typical"))
    return sizes.join(names, "pivot").select(F.col("pivot").alias("leaf_id"), "size", "radius", "typical")


def describe_clusters(vectors: DataFrame, clusters: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each cluster's size and its members nearest to its centre (ties: smaller id)."""
    width = vectors.select(F.max(F.size("vec"))).first()[0] or 0
    rows = clusters.join(vectors.dropDuplicates(["id"]), "id")
    centre = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array(*[F.avg(F.element_at("vec", i + 1)) for i in range(width)]).alias("centre"))
    gap = F.aggregate(F.zip_with("vec", "centre", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, x: t + x)
    near = rows.join(centre, "cluster_id").select("cluster_id", "size", F.struct(F.round(gap, 9).alias("gap"), "id").alias("m"))
    best = F.slice(F.array_sort(F.collect_list("m")), 1, typical)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("m"))).where(F.col("r") <= typical)
    return top.groupBy("cluster_id", "size").agg(F.concat_ws(",", F.transform(best, lambda m: m["id"].cast("string"))).alias("typical"))
