"""Sums and tables over all pairs of sites. The abundances of all sites go to every task as one matrix, so pairs are made where they are used and blocks never travel.

Only for communities whose matrix fits ``PACKED_BYTES``; ``packed`` is None otherwise.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.session import parallelism

C = F.col
PACKED_BYTES = 256 << 20
BLOCK = 512
METRICS = ("bray_curtis", "jaccard", "sorensen", "euclidean", "manhattan", "canberra", "chord", "hellinger")


class Packed:
    """Sites in order of their totals, so that blocks of small sites add in small types; ``name_rank`` is a site's place by name."""

    def __init__(self, site: np.ndarray, x: np.ndarray, species: list | None = None):
        self.species = species
        self.n = x.sum(1)
        o = np.argsort(self.n, kind="stable")
        self.site, self.x, self.n = site[o], x[o], self.n[o]
        self.name_rank = np.empty(len(o), np.int64)
        self.name_rank[np.argsort(self.site)] = np.arange(len(o))
        self.whole = bool(x.size) and bool((x == np.rint(x)).all())
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.block = BLOCK
        self.blocks = max(1, -(-len(o) // BLOCK))

    def rows(self, b: int) -> slice:
        return slice(b * self.block, min(len(self.n), (b + 1) * self.block))

    def reordered(self, o: np.ndarray) -> "Packed":
        """The same sites in another order, not that of their totals."""
        q = copy(self)
        q.site, q.x, q.n, q.name_rank = self.site[o], self.x[o], self.n[o], self.name_rank[o]
        return q


def packed(com: DataFrame) -> Packed | None:
    from phytoscape.operators.distances import _few_species

    names = _few_species(com)
    if names is None or com.select("site").distinct().count() * len(names) * 8 > PACKED_BYTES:
        return None
    kind = com.schema["species"].dataType.simpleString()
    at = F.broadcast(com.sparkSession.createDataFrame([(s, k) for k, s in enumerate(names)], f"species {kind}, k int"))
    t = com.join(at, "species").groupBy("site").agg(F.collect_list(F.struct("k", C("abundance").cast("double").alias("x"))).alias("e")).toArrow().combine_chunks()
    site = np.array(t["site"].to_pylist(), object)
    if not len(site):
        return Packed(site, np.zeros((0, len(names))), names)
    e = t["e"].combine_chunks()
    row, flat = np.repeat(np.arange(len(site)), np.diff(e.offsets.to_numpy())), e.flatten()
    x = np.zeros((len(site), len(names)))
    x[row, flat.field("k").to_numpy()] = flat.field("x").to_numpy()
    return Packed(site, x, names)


def shared_min(a: np.ndarray, b: np.ndarray, whole: bool) -> np.ndarray:
    """Sums of the lesser abundances; whole numbers add in the least type that holds them."""
    top = max(a.sum(1).max(initial=0), b.sum(1).max(initial=0))
    kind = np.uint16 if whole and top < 1 << 16 else np.uint32 if whole and top < 1 << 32 else np.float64
    a, b = np.ascontiguousarray(a.T, kind), np.ascontiguousarray(b.T, kind)
    out = np.zeros((a.shape[1], b.shape[1]), kind)
    tmp = np.empty_like(out)
    for u, v in zip(a, b):
        np.minimum(u[:, None], v[None], out=tmp)
        out += tmp
    return out


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; small ones, of which products would leave nothing, are summed from differences."""
    qa, qb = (a * a).sum(1), (b * b).sum(1)
    top = qa[:, None] + qb[None]
    q = top - 2 * (a @ b.T)
    i, j = np.nonzero(q < 1e-3 * top)
    for k in range(0, len(i), 65_536):
        s = slice(k, k + 65_536)
        q[i[s], j[s]] = ((a[i[s]] - b[j[s]]) ** 2).sum(1)
    return np.sqrt(np.maximum(q, 0))


def between(p: Packed, b1: int, b2: int, metric: str) -> np.ndarray:
    """Distances of the sites of two blocks."""
    return gaps(p, p.rows(b1), p.rows(b2), metric)


def gaps(p: Packed, r: slice, c: slice, metric: str) -> np.ndarray:
    """Distances of two runs of sites."""
    a, b, na, nb = p.x[r], p.x[c], p.n[r][:, None], p.n[c][None]
    if metric == "bray_curtis":
        return 1 - 2.0 * shared_min(a, b, p.whole) / (na + nb)
    if metric == "manhattan":
        return na + nb - 2.0 * shared_min(a, b, p.whole)
    if metric in ("jaccard", "sorensen"):
        u, v = (a > 0).astype(np.float32), (b > 0).astype(np.float32)
        both, s = (u @ v.T).astype(float), u.sum(1, dtype=float)[:, None] + v.sum(1, dtype=float)[None]
        return 1 - both / (s - both) if metric == "jaccard" else 1 - 2 * both / s
    if metric == "canberra":
        out = np.zeros((len(a), len(b)))
        for u, v in zip(a.T, b.T):
            s = u[:, None] + v[None]
            out += np.divide(np.abs(u[:, None] - v[None]), s, out=np.zeros_like(s), where=s > 0)
        return out
    if metric == "chord":
        a, b = a / np.sqrt((a * a).sum(1))[:, None], b / np.sqrt((b * b).sum(1))[:, None]
    elif metric == "hellinger":
        a, b = np.sqrt(a / na), np.sqrt(b / nb.T)
    elif not p.whole:
        a, b = a - p.mean, b - p.mean
    return _gap(a, b)


def block_pair(q: int) -> tuple[int, int]:
    """The q-th pair of blocks b1 <= b2."""
    b2 = int((np.sqrt(8 * q + 1) - 1) / 2)
    while b2 * (b2 + 1) // 2 > q:
        b2 -= 1
    while (b2 + 1) * (b2 + 2) // 2 <= q:
        b2 += 1
    return q - b2 * (b2 + 1) // 2, b2


def pairs_of(p: Packed, b1: int, b2: int) -> np.ndarray:
    """Which cells of a pair of blocks are pairs: all, or those above the diagonal."""
    r, c = p.rows(b1), p.rows(b2)
    shape = (r.stop - r.start, c.stop - c.start)
    return np.triu(np.ones(shape, bool), 1) if b1 == b2 else np.ones(shape, bool)


def over_blocks(spark, p: Packed, few: bool = False) -> DataFrame:
    """(id) of all pairs of blocks, spread over the tasks; ``few`` tasks where each returns a vector."""
    from phytoscape.operators.distances import spread

    every = p.blocks * (p.blocks + 1) // 2
    tasks = min(every, spread(spark, p.blocks))
    return spark.range(0, every, 1, max(1, min(tasks, 8 * parallelism(spark)) if few else tasks))


def distance_table(com: DataFrame, p: Packed, metric: str) -> DataFrame:
    """(i, j, d) of all pairs i < j by name."""
    spark, shared = com.sparkSession, com.sparkSession.sparkContext.broadcast(p)
    kind = com.schema["site"].dataType.simpleString()

    def make(batches):
        p = shared.value
        names = None
        for ids in batches:
            for q in ids.column(0).to_pylist():
                if names is None:
                    names = pa.array(p.site.tolist(), ids_type)
                b1, b2 = block_pair(q)
                d = between(p, b1, b2, metric)
                i, j = np.nonzero(pairs_of(p, b1, b2))
                gi, gj = i + b1 * BLOCK, j + b2 * BLOCK
                swap = p.name_rank[gi] > p.name_rank[gj]
                lo, hi = np.where(swap, gj, gi), np.where(swap, gi, gj)
                v = d[i, j]
                for k in range(0, len(v), 65_536):
                    s = slice(k, k + 65_536)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(lo[s])), names.take(pa.array(hi[s])), pa.array(v[s])], ["i", "j", "d"])

    from pyspark.sql.pandas.types import to_arrow_type

    ids_type = to_arrow_type(com.schema["site"].dataType)
    return over_blocks(spark, p).mapInArrow(make, f"i {kind}, j {kind}, d double")


def row_means(spark, p: Packed, metric: str, of) -> np.ndarray:
    """Means over all sites (itself included, with ``of`` its distance 0) of ``of(distances)``."""
    shared = spark.sparkContext.broadcast(p)

    def sums(batches):
        p = shared.value
        t = np.zeros(len(p.n))
        for ids in batches:
            for q in ids["id"]:
                b1, b2 = block_pair(int(q))
                e = of(between(p, b1, b2, metric))
                if b1 == b2:
                    np.fill_diagonal(e, of(np.zeros(1))[0])
                else:
                    t[p.rows(b2)] += e.sum(0)
                t[p.rows(b1)] += e.sum(1)
        yield pd.DataFrame({"k": np.arange(len(t)), "t": t})

    t = over_blocks(spark, p, few=True).mapInPandas(sums, "k long, t double").groupBy("k").agg(F.sum("t").alias("t")).orderBy("k").toPandas()
    return t["t"].to_numpy() / max(1, len(t))


def gower_table(com: DataFrame, p: Packed, metric: str) -> DataFrame:
    """(i, j, b): double-centred -d²/2 of all ordered pairs."""
    spark = com.sparkSession
    mean = row_means(spark, p, metric, lambda d: -0.5 * d * d)
    shared = spark.sparkContext.broadcast((p, mean, float(mean.mean()) if len(mean) else 0.0))
    kind = com.schema["site"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    ids_type = to_arrow_type(com.schema["site"].dataType)

    def make(batches):
        p, r, g = shared.value
        names = pa.array(p.site.tolist(), ids_type)
        for ids in batches:
            for q in ids.column(0).to_pylist():
                b1, b2 = block_pair(q)
                d = between(p, b1, b2, metric)
                if b1 == b2:
                    np.fill_diagonal(d, 0.0)
                b = -0.5 * d * d - r[p.rows(b1)][:, None] - r[p.rows(b2)][None] + g
                i, j = np.indices(b.shape).reshape(2, -1)
                i, j, b = i + b1 * BLOCK, j + b2 * BLOCK, b.ravel()
                for x, y in ((i, j),) if b1 == b2 else ((i, j), (j, i)):
                    for k in range(0, len(b), 65_536):
                        s = slice(k, k + 65_536)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(x[s])), names.take(pa.array(y[s])), pa.array(b[s])], ["i", "j", "b"])

    return over_blocks(spark, p).mapInArrow(make, f"i {kind}, j {kind}, b double")


def value_sums(spark, p: Packed, values: list[np.ndarray], metric: str = "bray_curtis") -> np.ndarray:
    """Sums over pairs of all products of 1, the distance, and the differences |v_i - v_j| of each of ``values``."""
    shared = spark.sparkContext.broadcast((p, values))
    wide = 2 + len(values)

    def sums(batches):
        p, values = shared.value
        t = np.zeros((wide, wide))
        for ids in batches:
            for q in ids["id"]:
                b1, b2 = block_pair(int(q))
                use = pairs_of(p, b1, b2)
                v = np.stack([np.ones(int(use.sum())), between(p, b1, b2, metric)[use], *[np.abs(x[p.rows(b1)][:, None] - x[p.rows(b2)][None])[use] for x in values]])
                t += v @ v.T
        yield pd.DataFrame({"k": range(wide * wide), "t": t.ravel()})

    t = over_blocks(spark, p).mapInPandas(sums, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).orderBy("k").toPandas()
    return t["t"].to_numpy().reshape(wide, wide)


def permuted_products(spark, p: Packed, values: list[np.ndarray], mean: float, draws: list[int], seed: int, metric: str = "bray_curtis", kind=np.float64, at_once: int = 200) -> np.ndarray:
    """(draws, values): sums over pairs of the distance less ``mean`` and |v_i - v_j|, the sites permuted as ``np.random.default_rng([seed, q])`` orders their names, q of ``draws``.

    |a - b| is 2 max(a, b) - a - b, of which the last two need row sums only.
    Sums of 65,536 products are taken in ``kind``, their totals in doubles.
    """
    shared = spark.sparkContext.broadcast((p, values))
    every = p.blocks * (p.blocks + 1) // 2

    def sums(batches):
        p, values = shared.value
        todo = [int(q) for ids in batches for q in ids["id"]]
        total = np.zeros((len(draws), len(values)))
        rank = p.name_rank
        by_name = []
        for x in values:
            y = np.empty(len(x))
            y[rank] = x - x.mean()
            by_name.append(y)
        tmp = np.empty((128, p.block), kind)
        for lo in range(0, len(draws), at_once):
            hi = min(len(draws), lo + at_once)
            moved = np.empty((len(values), hi - lo, len(rank)), kind)
            for k in range(lo, hi):
                o = np.random.default_rng([seed, draws[k]]).permutation(len(rank))
                for v, y in enumerate(by_name):
                    z = np.empty(len(o), kind)
                    z[o] = y
                    moved[v, k - lo] = z[rank]
            for q in todo:
                b1, b2 = block_pair(q)
                whole = np.where(pairs_of(p, b1, b2), between(p, b1, b2, metric) - mean, 0.0)
                for v in range(len(values)):  # row sums of all draws at once
                    total[lo:hi, v] -= moved[v, :, p.rows(b1)].astype(float) @ whole.sum(1) + moved[v, :, p.rows(b2)].astype(float) @ whole.sum(0)
                for r in range(0, len(whole), 128):
                    d = np.ascontiguousarray(whole[r:r + 128], kind)
                    first, second = slice(b1 * p.block + r, b1 * p.block + r + len(d)), p.rows(b2)
                    flat, out = d.ravel(), tmp.reshape(-1)[:d.size].reshape(d.shape)
                    line = out.reshape(-1)
                    for v in range(len(values)):
                        for k in range(hi - lo):
                            np.maximum(moved[v, k, first][:, None], moved[v, k, second][None], out=out)
                            total[lo + k, v] += 2 * float(np.dot(flat, line))
        yield pd.DataFrame({"k": range(total.size), "t": total.ravel()})

    # every task draws all permutations, so there are no more tasks than keep the cores busy
    t = spark.range(0, every, 1, max(1, min(every, 2 * parallelism(spark)))).mapInPandas(sums, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).orderBy("k").toPandas()
    return t["t"].to_numpy().reshape(len(draws), len(values))


def label_sums(spark, p: Packed, labels: np.ndarray, weight: np.ndarray, metric: str = "bray_curtis") -> np.ndarray:
    """(2, permutations): sums over pairs of equal labels (site, permutation) of the squared distance, and of the distance times the label's ``weight``.

    With z a label's sites, z'Dz is half from every pair of blocks: one product of matrices for all permutations.
    """
    shared = spark.sparkContext.broadcast((p, labels, weight))
    every, groups = p.blocks * (p.blocks + 1) // 2, len(weight)

    def sums(batches):
        p, labels, weight = shared.value
        todo = sorted(block_pair(int(q)) for ids in batches for q in ids["id"])
        total = np.zeros((2, labels.shape[1]))
        for lo in range(0, labels.shape[1], 250):
            part = labels[:, lo:lo + 250]
            hold, first = None, None
            for b1, b2 in todo:
                if hold != b1:
                    hold, first = b1, [(part[p.rows(b1)] == g).astype(float) for g in range(groups)]
                d = np.where(pairs_of(p, b1, b2), between(p, b1, b2, metric), 0.0)
                sq = d * d
                for g in range(groups):
                    z = (part[p.rows(b2)] == g).astype(float)
                    total[0, lo:lo + 250] += np.einsum("ij,ij->j", first[g], sq @ z)
                    total[1, lo:lo + 250] += weight[g] * np.einsum("ij,ij->j", first[g], d @ z)
        yield pd.DataFrame({"k": range(total.size), "t": total.ravel()})

    t = spark.range(0, every, 1, max(1, min(every, 2 * parallelism(spark)))).mapInPandas(sums, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).orderBy("k").toPandas()
    return t["t"].to_numpy().reshape(2, labels.shape[1])


#: Distances are ranked as whole numbers of 1e-12, sorted by ranges of so many pairs; ranges are made of steps of 2**STEP.
RANGE_PAIRS, STEP = 1 << 25, 24


def _rank_sum(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """(sum of the average-tie ranks of the keys marked by their last bit, all keys) of (keys, counts)."""
    key, count = _merged(held)
    v, at = np.unique(key >> 1, return_inverse=True)
    every, marked = np.bincount(at, count), np.bincount(at, count * (key & 1))
    return float((marked * (np.cumsum(every) - (every - 1) / 2)).sum()), float(marked.sum())


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.int64)
    if held and all(c is None for _, c in held):
        u, c = np.unique(key, return_counts=True)
        return u, c.astype(float)
    count = np.concatenate([np.ones(len(k)) if c is None else c for k, c in held]) if held else np.zeros(0)
    u, at = np.unique(key, return_inverse=True)
    return u, np.bincount(at, count, len(u))


def group_sums(spark, p: Packed, code: np.ndarray, metric: str = "bray_curtis") -> dict:
    """Over pairs of distances rounded to 12 digits: their number ``m``, squares ``sq``; per group pairs, sums and squares within; the sum of ranks within and how many ``inside``.

    A first pass counts the distances by steps; ranges of them are then sorted
    each in a task that makes all pairs again and keeps those of its range.
    """
    groups = int(code.max()) + 1 if len(code) else 0
    shared = spark.sparkContext.broadcast((p, code))

    def keys(p, code, q):
        b1, b2 = block_pair(int(q))
        use = pairs_of(p, b1, b2)
        k = np.rint(between(p, b1, b2, metric)[use] * 1e12).astype(np.int64)
        a = np.broadcast_to(code[p.rows(b1)][:, None], use.shape)[use]
        return k, a, a == np.broadcast_to(code[p.rows(b2)][None], use.shape)[use]

    def first(batches):
        p, code = shared.value
        t, steps = np.zeros(2 + 3 * groups), {}
        for ids in batches:
            for q in ids["id"]:
                k, a, same = keys(p, code, q)
                d = k / 1e12
                t[:2] += len(k), d @ d
                w, d = a[same], d[same]
                t[2:] += np.concatenate([np.bincount(w, minlength=groups), np.bincount(w, d, groups), np.bincount(w, d * d, groups)])
                s = np.bincount(k >> STEP)
                for b in np.flatnonzero(s):
                    steps[b] = steps.get(b, 0) + int(s[b])
        yield pd.DataFrame({"k": [*range(-len(t), 0), *steps], "t": [*t, *map(float, steps.values())]})

    t = over_blocks(spark, p, few=True).mapInPandas(first, "k long, t double").groupBy("k").agg(F.sum("t").alias("t")).orderBy("k").toPandas()
    k, v = t["k"].to_numpy(), t["t"].to_numpy()
    head, step, count = v[k < 0], k[k >= 0], v[k >= 0]
    ranges, lo, held = [], 0, 0.0
    for s, c in zip(step, count):
        if held and held + c > RANGE_PAIRS:
            ranges.append((lo, int(s) << STEP, held))
            lo, held = int(s) << STEP, 0.0
        held += c
    ranges.append((lo, 1 << 62, held))
    before = np.concatenate([[0.0], np.cumsum([r[2] for r in ranges])])

    def second(batches):
        p, code = shared.value
        every = p.blocks * (p.blocks + 1) // 2
        for ids in batches:
            for r in ids["id"]:
                lo, hi, _ = ranges[int(r)]
                held, loose = [], 0
                for q in range(every):
                    k, _, same = keys(p, code, q)
                    use = (k >= lo) & (k < hi)
                    held.append((k[use] * 2 + same[use], None))
                    loose += len(held[-1][0])
                    if loose > RANGE_PAIRS:  # many equal distances
                        held, loose = [_merged(held)], 0
                s, n = _rank_sum(held)
                yield pd.DataFrame({"s": [s + n * before[int(r)]], "n": [n]})

    r = spark.range(0, len(ranges), 1, len(ranges)).mapInPandas(second, "s double, n double").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    w = head[2:].reshape(3, groups)
    return {"m": head[0], "sq": head[1], "pairs": w[0], "sums": w[1], "squares": w[2], "ranks": r["s"] or 0.0, "inside": r["n"] or 0.0}


#: Different differences of values that are listed on the driver and go to every task.
MOST_LEVELS = 1 << 21


def value_levels(v: np.ndarray, digits: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Different |v_i - v_j| over pairs, rounded to ``digits`` as whole numbers, with the average-tie rank and the number of each; None if there are more than ``MOST_LEVELS``."""
    u, c = np.unique(v, return_counts=True)
    c = c.astype(float)
    held, loose = [(np.zeros(1, np.int64), np.array([(c * (c - 1) / 2).sum()]))], 0
    for i in range(len(u) - 1):
        held.append((np.rint((u[i + 1:] - u[i]) * 10.0**digits).astype(np.int64), c[i] * c[i + 1:]))
        loose += len(u) - 1 - i
        if loose > 1 << 21 or i == len(u) - 2:
            held, loose = [_merged(held)], 0
            if len(held[0][0]) > MOST_LEVELS:
                return None
    key, n = held[0]
    key, n = key[n > 0], n[n > 0]
    return key, np.cumsum(n) - (n - 1) / 2, n


def rank_products(spark, p: Packed, v: np.ndarray, level: np.ndarray, rank: np.ndarray) -> tuple[float, float]:
    """Over pairs: sums of the products of centred ranks and of the squares of the centred ranks of Bray-Curtis distances rounded to 12 digits; ``rank`` is that of the differences of ``v``, of ``value_levels``.

    Ranges of distances are sorted each in a task that makes all pairs again.
    """
    shared = spark.sparkContext.broadcast((p, v, level, rank))
    bits = int(len(level)).bit_length()

    def keys(p, q):
        b1, b2 = block_pair(int(q))
        return b1, b2, np.rint(between(p, b1, b2, "bray_curtis") * 1e12).astype(np.int64)

    def first(batches):
        p, *_ = shared.value
        steps = {}
        for ids in batches:
            for q in ids["id"]:
                b1, b2, k = keys(p, q)
                s = np.bincount((k[pairs_of(p, b1, b2)] if b1 == b2 else k.ravel()) >> STEP)
                for b in np.flatnonzero(s):
                    steps[b] = steps.get(b, 0) + int(s[b])
        yield pd.DataFrame({"k": [*steps], "t": [*map(float, steps.values())]})

    t = over_blocks(spark, p, few=True).mapInPandas(first, "k long, t double").groupBy("k").agg(F.sum("t").alias("t")).orderBy("k").toPandas()
    ranges, lo, held = [], 0, 0.0
    for s, c in zip(t["k"], t["t"]):
        if held and held + c > RANGE_PAIRS // 2:
            ranges.append((lo, int(s) << STEP, held))
            lo, held = int(s) << STEP, 0.0
        held += c
    ranges.append((lo, 1 << 62, held))
    before = np.concatenate([[0.0], np.cumsum([r[2] for r in ranges])])
    middle = (before[-1] + 1) / 2

    def second(batches):
        p, v, level, rank = shared.value
        every = p.blocks * (p.blocks + 1) // 2
        centred = rank - middle
        for ids in batches:
            for r in ids["id"]:
                lo, hi, _ = ranges[int(r)]
                held, loose = [], 0
                for q in range(every):
                    b1, b2, k = keys(p, q)
                    use = k >= lo
                    use &= k < hi
                    if b1 == b2:
                        use &= pairs_of(p, b1, b2)
                    i, j = np.nonzero(use)
                    if not len(i):
                        continue
                    y = np.searchsorted(level, np.rint(np.abs(v[p.rows(b1)][i] - v[p.rows(b2)][j]) * 1e9).astype(np.int64))
                    held.append((k[i, j] - lo << bits | y, None))
                    loose += len(i)
                    if loose > RANGE_PAIRS:  # many equal distances
                        held, loose = [_merged(held)], 0
                if any(c is not None for _, c in held):
                    key, count = _merged(held)
                else:
                    key, count = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.int64), None
                    held.clear()
                    key.sort()
                y = centred[key & (1 << bits) - 1]
                key >>= bits
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                n = np.add.reduceat(count, start) if count is not None and len(key) else np.diff(np.append(start, len(key))).astype(float)
                x = before[int(r)] + np.cumsum(n) - (n - 1) / 2 - middle
                s = np.add.reduceat(y if count is None else y * count, start) if len(key) else np.zeros(0)
                yield pd.DataFrame({"a": [float(x @ s)], "b": [float((n * x) @ x)]})

    r = spark.range(0, len(ranges), 1, len(ranges)).mapInPandas(second, "a double, b double").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return r["a"] or 0.0, r["b"] or 0.0


def apart(p: Packed, b1: int, b2: int, eps: float, metric: str) -> bool:
    """Whether the totals alone tell that no sites of two blocks b1 <= b2 are within ``eps``: shared abundance is the lesser total at most."""
    if metric != "bray_curtis":
        return False
    a, b = p.n[p.rows(b1).stop - 1], p.n[p.rows(b2).start]
    return bool(b > a and 1 - 2 * a / (a + b) > eps + 1e-9)


def _roots(up: np.ndarray, at: np.ndarray) -> np.ndarray:
    r = up[at]
    while True:
        s = up[r]
        if (s == r).all():
            up[at] = r
            return r
        r = s


def _join(up: np.ndarray, nodes: np.ndarray) -> None:
    r = np.unique(_roots(up, nodes))
    up[r] = r[0]


def near_clusters(spark, p: Packed, eps: float, least: int, metric: str = "bray_curtis") -> tuple[np.ndarray, np.ndarray]:
    """DBSCAN without a list of near pairs: (cluster of each site as the place by name of its smallest core site, -1 for noise; which are core).

    Neighbouring blocks settle first which sites have enough neighbours, and
    which belong together; only blocks that hold open sites are compared further.
    Tasks return degrees of open sites, new links of components and the core
    neighbours of border sites, which are fewer than ``least`` each.
    """
    every, size = p.blocks * (p.blocks + 1) // 2, len(p.n)
    close = spark.range(0, p.blocks, 1, max(1, min(p.blocks, 2 * parallelism(spark))))
    wide = spark.range(0, every, 1, max(1, min(every, 16 * parallelism(spark))))

    def pairs(p, ids, local):
        for b in ids["id"]:
            for b1, b2 in ([(int(b), c) for c in range(int(b), min(p.blocks, int(b) + 2))] if local else [block_pair(int(b))]):
                if not apart(p, b1, b2, eps, metric):
                    yield b1, b2

    def near(p, b1, b2):
        w = between(p, b1, b2, metric) <= eps
        if b1 == b2:
            np.fill_diagonal(w, False)
        return w

    def degrees(over, local, known):
        shared = spark.sparkContext.broadcast((p, known))

        def count(batches):
            p, known = shared.value
            n = np.zeros(len(p.n), np.int64)
            for ids in batches:
                for b1, b2 in pairs(p, ids, local):
                    r, c = p.rows(b1), p.rows(b2)
                    if known[r].all() and known[c].all():
                        continue
                    w = near(p, b1, b2)
                    n[r] += w.sum(1)
                    if b1 != b2:
                        n[c] += w.sum(0)
            k = np.flatnonzero((n > 0) & ~known)
            yield pd.DataFrame({"k": k, "n": n[k]})

        t = over.mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(size, np.int64)
        n[t["k"].to_numpy(int)] = t["n"].to_numpy(int)
        return n

    core = degrees(close, True, np.zeros(size, bool)) + 1 >= least
    n = degrees(wide, False, core) if not core.all() else np.zeros(size, np.int64)
    border = ~core & (n > 0) & (n + 1 < least)
    core |= n + 1 >= least
    up = np.arange(size)

    def link(over, local):
        shared = spark.sparkContext.broadcast((p, core, border, up.copy()))

        def links(batches):
            p, core, border, up = shared.value
            up, was, out = up.copy(), up, []
            for ids in batches:
                for b1, b2 in pairs(p, ids, local):
                    r, c = np.arange(len(p.n))[p.rows(b1)], np.arange(len(p.n))[p.rows(b2)]
                    cr, cc = core[r], core[c]
                    held = np.concatenate([_roots(up, r[cr]), _roots(up, c[cc])])
                    rest = not local and (border[r].any() or border[c].any())
                    if not rest and not (len(held) and (held != held[0]).any() and cr.any() and cc.any()):
                        continue
                    w = near(p, b1, b2)
                    if rest:
                        for a, b, e in ((r, c, w),) if b1 == b2 else ((r, c, w), (c, r, w.T)):
                            i, j = np.nonzero(e & border[a][:, None] & core[b][None])
                            out.append(np.stack([a[i], b[j], np.ones(len(i), int)]))
                    w &= cr[:, None] & cc[None]
                    w &= _roots(up, r)[:, None] != _roots(up, c)[None]
                    for i in np.flatnonzero(w.any(1)):
                        _join(up, np.append(c[w[i]], r[i]))
            k = np.flatnonzero(up != was)
            out.append(np.stack([k, up[k], np.zeros(len(k), int)]))
            yield pd.DataFrame(np.concatenate(out, 1).T, columns=["a", "b", "border"])

        return over.mapInPandas(links, "a long, b long, border long").toPandas().to_numpy()

    def unite(e):
        for a, b in e[:, :2]:
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            up[max(a, b)] = min(a, b)
        _roots(up, np.arange(size))

    unite(link(close, True))
    e = link(wide, False)
    unite(e[e[:, 2] == 0])
    low = np.full(size, size)
    np.minimum.at(low, up[core], p.name_rank[core])
    cluster = np.where(core, low[up], size)
    b = e[e[:, 2] == 1]
    np.minimum.at(cluster, b[:, 0], low[up[b[:, 1]]])
    return np.where(cluster == size, -1, cluster), core


def simper_sums(spark, p: Packed, code: np.ndarray, within: bool) -> pd.DataFrame:
    """(a, b, k, t, pairs): sums over pairs of sites of groups a <= b of |x - y| / (all individuals of both) by species; pairs within a group only if asked for."""
    groups, shared = int(code.max()) + 1 if len(code) else 0, spark.sparkContext.broadcast((p, code))

    def sums(batches):
        p, code = shared.value
        t = np.zeros((groups, groups, p.x.shape[1] + 1))
        for ids in batches:
            for q in ids["id"]:
                b1, b2 = block_pair(int(q))
                r, c = np.arange(len(p.n))[p.rows(b1)], np.arange(len(p.n))[p.rows(b2)]
                for g in np.unique(code[r]):
                    for h in np.unique(code[c]):
                        if g == h and not within or b1 == b2 and g > h:
                            continue
                        i, j = r[code[r] == g], c[code[c] == h]
                        w = 1 / np.maximum(p.n[i][:, None] + p.n[j][None], 1e-300)
                        if b1 == b2 and g == h:
                            w = np.triu(w, 1)
                        out = t[min(g, h), max(g, h)]
                        out[-1] += w.size if not (b1 == b2 and g == h) else len(i) * (len(i) - 1) // 2
                        # |x - y| is x + y - 2 min(x, y)
                        out[:-1] += w.sum(1) @ p.x[i] + w.sum(0) @ p.x[j]
                        x, y, flat, tmp = np.ascontiguousarray(p.x[i].T), np.ascontiguousarray(p.x[j].T), w.ravel(), np.empty_like(w)
                        for k in range(len(x)):
                            np.minimum(x[k][:, None], y[k][None], out=tmp)
                            out[k] -= 2 * np.dot(flat, tmp.ravel())
        a, b, k = np.indices(t[:, :, :-1].shape).reshape(3, -1)
        yield pd.DataFrame({"a": a, "b": b, "k": k, "t": t[:, :, :-1].ravel(), "pairs": t[a, b, -1]})

    return over_blocks(spark, p).mapInPandas(sums, "a int, b int, k int, t double, pairs double").groupBy("a", "b", "k").agg(F.sum("t").alias("t"), F.sum("pairs").alias("pairs")).where("pairs > 0").toPandas()
