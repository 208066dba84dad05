"""Trees (agglomerative linkage) of all sites of a packed community, each in one task that makes the distances it needs: the square matrix is never held.

Nearest-neighbour chains: all four methods are reducible, so that merging
mutual neighbours in any order gives the tree of merging the nearest first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from phytoscape.operators import sitepairs as B
from phytoscape.operators.ordination import MOST_SITES

METHODS = ("single", "complete", "average", "ward")
#: Rows of distances that a chain keeps; those of the smallest clusters are dropped first and made again when asked for.
HELD_BYTES = 128 << 20


def _site_row(p: B.Packed, metric: str):
    """A function that gives the distances of a site to all."""
    n = p.n
    if metric != "bray_curtis":
        return lambda i: B.gaps(p, slice(i, i + 1), slice(0, len(n)), metric)[0]
    wide = np.ascontiguousarray(p.x.T)
    narrow = np.minimum(wide, 65_535).astype(np.uint16) if p.whole else None  # a site of fewer individuals shares no more with any
    tmp = {k: np.empty(len(n), k) for k in (np.uint16, np.float64)}

    def row(i: int) -> np.ndarray:
        kind = np.uint16 if p.whole and n[i] < 1 << 16 else np.float64
        t, out, acc = narrow if kind == np.uint16 else wide, tmp[kind], np.zeros(len(n), kind)
        for u in t:
            if u[i]:
                np.minimum(u, u[i], out=out)
                acc += out
        return 1 - 2.0 * acc / (n[i] + n)

    return row


def _ordered(found: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Merges (left, right, height, size) by rising height of merges (a site of one side, a site of the other, height)."""
    up, ident, size, out = list(range(n)), list(range(n)), [1] * n, np.empty((len(found), 4))

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for step, k in enumerate(np.argsort([h for *_, h in found], kind="stable")):
        a, b, h = found[k]
        a, b = top(a), top(b)
        out[step] = min(ident[a], ident[b]), max(ident[a], ident[b]), h, size[a] + size[b]
        if size[a] < size[b]:
            a, b = b, a
        up[b], ident[a] = a, n + step
        size[a] += size[b]
    return out


def chain(p: B.Packed, method: str, metric: str = "bray_curtis", held_bytes: int | None = None) -> np.ndarray:
    """Merges (left, right, height, size) of all sites, numbered by their names: the tree of ``linkage``, where distances tie one of its trees."""
    n, one, ward = len(p.n), _site_row(p, metric), method == "ward"
    size, within, alive, slot = np.ones(n), np.zeros(n), np.ones(n, bool), np.arange(n)
    member = [np.array([i]) for i in range(n)]

    def room(m: int) -> int:
        return max(4, min(m, (held_bytes or HELD_BYTES) // (8 * max(1, m))))

    held, owner, at = np.empty((room(n), n)), np.full(room(n), -1), {}

    def make(c: int) -> np.ndarray:
        """Distances of a cluster to all (ward: squared)."""
        d = None
        for i in member[c]:
            e = one(i)
            if ward:
                e = e * e
            d = e if d is None else np.minimum(d, e) if method == "single" else np.maximum(d, e) if method == "complete" else d + e
        if method in ("single", "complete"):
            out = np.full(len(size), np.inf if method == "single" else -np.inf)
            (np.minimum if method == "single" else np.maximum).at(out, slot, d)
        else:
            out = np.bincount(slot, d, len(size)) / (size[c] * size)
            if ward:
                out = 2 * size[c] * size / (size[c] + size) * (out - within[c] / size[c] ** 2 - within / size**2)
        out[~alive] = np.inf
        out[c] = np.inf
        return out

    def row(c: int, keep: int) -> np.ndarray:
        if c not in at:
            free = np.flatnonzero(owner < 0)
            if len(free):
                k = int(free[0])
            else:
                k = int(np.where(owner == keep, np.inf, size[owner]).argmin())
                del at[int(owner[k])]
            held[k], owner[k], at[c] = make(c), c, k
        return held[at[c]]

    def joined(x, y, a, b, other, h):
        if method == "single":
            return np.minimum(x, y)
        if method == "complete":
            return np.maximum(x, y)
        if ward:
            return ((a + other) * x + (b + other) * y - other * h) / (a + b + other)
        return (a * x + b * y) / (a + b)

    found, way, low, start = [], [], [], 0
    for left in range(n, 1, -1):
        if left > 2 and 2 * left <= len(size):  # columns of the merged are dropped, so more rows can be kept
            keep, new = np.flatnonzero(alive), np.cumsum(alive) - 1
            used = np.flatnonzero(owner >= 0)
            more = np.empty((room(left), left))
            for k, u in enumerate(used):
                more[k] = held[u, keep]
            mine = new[owner[used]]
            held, owner, at = more, np.full(len(more), -1), {int(c): k for k, c in enumerate(mine)}
            owner[:len(mine)] = mine
            size, within, alive, slot, member = size[keep], within[keep], alive[keep], new[slot], [member[c] for c in keep]
            way, start = [int(new[c]) for c in way], 0
        while True:
            if not way:
                while not alive[start]:
                    start += 1
                way, low = [start], [np.inf]
            r = row(way[-1], way[-2] if len(way) > 1 else -1)
            c = int(r.argmin())
            if len(way) > 1 and not r[c] < low[-1] - 1e-12 * abs(low[-1]):  # what rounding tells apart is a tie
                break
            way.append(c)
            low.append(float(r[c]))
        b, a, h = way.pop(), way.pop(), low.pop()
        low.pop()
        x, y = row(a, b), row(b, a)
        if size[a] < size[b]:
            a, b, x, y = b, a, y, x
        new = joined(x, y, size[a], size[b], size, h)
        new[a] = new[b] = np.inf
        ka, kb = at[a], at.pop(b)
        owner[kb] = -1
        rest = np.flatnonzero((owner >= 0) & (owner != a))
        held[rest, a] = joined(held[rest, a], held[rest, b], size[a], size[b], size[owner[rest]], h)
        held[rest, b] = np.inf
        held[ka] = new
        if ward:
            s = size[a] * size[b] * (h * (size[a] + size[b]) / (2 * size[a] * size[b]) + within[a] / size[a] ** 2 + within[b] / size[b] ** 2)
            within[a] += within[b] + s
        alive[b] = False
        slot[member[b]] = a
        found.append((int(p.name_rank[member[a][0]]), int(p.name_rank[member[b][0]]), float(np.sqrt(max(h, 0))) if ward else h))
        member[a], member[b] = np.concatenate([member[a], member[b]]), None
        size[a] += size[b]
    return _ordered(found, n)


def trees(spark, p: B.Packed, methods: tuple[str, ...], metric: str = "bray_curtis") -> dict[str, np.ndarray]:
    """Merges (left, right, height, size) of all sites by each method, in a task each; leaves are numbered by the sites' names."""
    for m in methods:
        if m not in METHODS:
            raise ValueError(f"Unknown linkage: {m}")
    shared, most = spark.sparkContext.broadcast(p), MOST_SITES

    def grow(batches):
        from phytoscape.operators.clustering import linkage

        p = shared.value
        for ids in batches:
            for q in ids["id"]:
                if len(p.n) > most:
                    t = chain(p, methods[int(q)], metric)
                else:
                    o, every = np.argsort(p.name_rank), slice(0, len(p.n))
                    t = np.array(linkage(B.gaps(p, every, every, metric)[np.ix_(o, o)], methods[int(q)])).reshape(-1, 4)
                yield pd.DataFrame({"q": int(q), "step": np.arange(len(t)), "a": t[:, 0], "b": t[:, 1], "h": t[:, 2], "size": t[:, 3]})

    t = spark.range(0, len(methods), 1, len(methods)).mapInPandas(grow, "q long, step long, a double, b double, h double, size double").toPandas().sort_values(["q", "step"])
    return {m: t.loc[t["q"] == k, ["a", "b", "h", "size"]].to_numpy() for k, m in enumerate(methods)}


def leaves(merges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaves in an order that keeps clusters together, the height at which each meets the next): two leaves meet at the greatest height between them."""
    head, tail, after, gap = list(range(n)), list(range(n)), [-1] * n, np.zeros(n)
    for a, b, h, _ in merges:
        a, b = int(a), int(b)
        after[tail[a]], gap[tail[a]] = head[b], h
        head.append(head[a])
        tail.append(tail[b])
    order, k = [], head[-1] if n else -1
    while k >= 0:
        order.append(k)
        k = after[k]
    order = np.array(order, int)
    return order, gap[order]


def _met(g: np.ndarray, r: slice, c: slice) -> np.ndarray:
    """Heights at which the leaves of two blocks of a row of leaves meet; below the diagonal of one block 0."""
    if r == c:
        return np.maximum.accumulate(np.triu(np.broadcast_to(np.concatenate([[0.0], g[r][:-1]]), (r.stop - r.start,) * 2), 1), 1)
    first = np.maximum.accumulate(g[r][::-1])[::-1]
    second = np.maximum.accumulate(np.concatenate([[g[r.stop:c.start].max(initial=0.0)], g[c][:-1]]))
    return np.maximum(first[:, None], second[None])


def cophenetic_correlations(spark, p: B.Packed, methods: tuple[str, ...], metric: str = "bray_curtis") -> dict[str, float]:
    """Correlations over all pairs of the distances with the heights of each method's tree; no spread gives 0."""
    grown = trees(spark, p, methods, metric)
    n, by_name = len(p.n), np.argsort(p.name_rank)
    whole = B.value_sums(spark, p, [], metric)
    m = max(1.0, whole[0, 0])
    mean = whole[0, 1] / m
    order = [leaves(t, n) for t in grown.values()]
    shared = spark.sparkContext.broadcast((p, mean, [(by_name[o], g) for o, g in order]))

    def sums(batches):
        p, mean, order = shared.value
        todo = [B.block_pair(int(q)) for ids in batches for q in ids["id"]]
        t = np.zeros((len(order), 2))
        for k, (o, g) in enumerate(order):
            moved = p.reordered(o)
            for b1, b2 in todo:
                use = B.pairs_of(moved, b1, b2)
                d = B.between(moved, b1, b2, metric)[use] - mean
                t[k] += d @ _met(g, moved.rows(b1), moved.rows(b2))[use], d @ d
        yield pd.DataFrame({"k": range(t.size), "t": t.ravel()})

    t = B.over_blocks(spark, p, few=True).mapInPandas(sums, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).orderBy("k").toPandas()
    out = {}
    for (name, tree), (xy, xx) in zip(grown.items(), t["t"].to_numpy().reshape(-1, 2)):
        size = np.concatenate([np.ones(n), tree[:, 3]])
        w = size[tree[:, 0].astype(int)] * size[tree[:, 1].astype(int)] if len(tree) else np.zeros(0)
        mid = w @ tree[:, 2] / m
        yy = w @ (tree[:, 2] - mid) ** 2
        out[name] = float(xy / np.sqrt(xx * yy)) if xx / m > 1e-24 and yy / m > 1e-24 else 0.0
    return out
