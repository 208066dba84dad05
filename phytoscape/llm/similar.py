"""Most similar vectors by cross-polytope hashing.

Unit vectors, centred on the mean of all of them, are turned by fast
pseudo-rotations (three rounds of random signs and a Hadamard transform); the
nearest signed axis of each of several rotations gives one bucket per table.
The number of buckets grows with the collection (the last rotation may keep
some of its axes only), so a bucket holds about as many vectors at every size,
and a query looks into its ``probes`` best buckets of every table. All
candidates are ranked by their exact cosine.

Equal vectors are one class: they are hashed once and expanded at the end, so
copies cannot fill a bucket. Vectors and queries meet by the leading axes of
their buckets; a task compares each query with the vectors of its own buckets
alone and keeps the best, so candidates never become rows. Crowded groups of
buckets are cut into chunks to which their queries are copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.session import materialise, parallelism, tasks_for

#: Crowded groups of buckets at most: their list (16 bytes each) goes to all tasks, chunks grow beyond it.
MOST_CROWDED = 100_000
#: Rows of queries or results up to which they are broadcast to a join; more are joined by shuffle.
BROADCAST_ROWS = 200_000
_PAIRS = 1_000_000  # candidates compared at once


@dataclass(frozen=True)
class Index:
    """``tables`` tables of about n / ``bucket_rows`` buckets for n vectors; ``probe_factor`` · n ** ``probe_power`` buckets of each are searched per query."""

    tables: int = 10
    bucket_rows: float = 2.0
    probe_factor: float = 32.0
    probe_power: float = 0.2
    chunk_rows: int = 16_384
    seed: int = 11

    def axes(self, n: int, dim: int) -> list[int]:
        """Axes (each with either sign) that every rotation of a table keeps."""
        most, kept = n / self.bucket_rows, [dim]
        while (2 * dim) ** len(kept) < most:
            kept.append(dim)
        while kept[-1] > 1 and (2 * dim) ** (len(kept) - 1) * kept[-1] >= most:
            kept[-1] //= 2
        return kept

    def probes(self, n: int) -> int:
        return int(np.ceil(self.probe_factor * max(1, n) ** self.probe_power))


def _hadamard(a: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, h = a.shape[1], 1
    while h < n:
        a = a.reshape(len(a), n // (2 * h), 2, h)
        a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], 2).reshape(len(a), n)
        h *= 2
    return a / np.sqrt(n, dtype=a.dtype)


class Hasher:
    """The pseudo-rotations of all tables. Up to 128 dimensions each is kept as the product of its rounds, beyond it is taken by fast transforms."""

    def __init__(self, index: Index, n: int, dim: int):
        self.axes, self.tables, self.take = index.axes(n, dim), index.tables, index.probes(n)
        self.signs = [np.random.default_rng([index.seed, t]).choice(np.array([-1.0, 1.0], np.float32), (len(self.axes), 3, dim)) for t in range(index.tables)]
        self.turned = [[self._rounds(np.eye(dim, dtype=np.float32), s) for s in table] for table in self.signs] if dim <= 128 else None

    @staticmethod
    def _rounds(v: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            v = _hadamard(v * s)
        return v

    def scores(self, v: np.ndarray, table: int, rotation: int) -> np.ndarray:
        """Scores of the signed axes after one pseudo-rotation."""
        v = v @ self.turned[table][rotation] if self.turned else self._rounds(v, self.signs[table][rotation])
        v = v[:, :self.axes[rotation]]
        return np.concatenate([v, -v], 1)

    def buckets(self, v: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(v), np.int64)
        for r, a in enumerate(self.axes):
            code = code * (2 * a) + self.scores(v, table, r).argmax(1)
        return code

    def probes(self, v: np.ndarray, table: int) -> np.ndarray:
        """Codes of the ``take`` buckets of each row that lose least against its best axes."""
        cost, code = np.zeros((len(v), 1), np.float32), np.zeros((len(v), 1), np.int64)
        for r, a in enumerate(self.axes):
            s = self.scores(v, table, r)
            order = np.argsort(-s, axis=1)[:, :self.take]
            lost = (s.max(1, keepdims=True) - np.take_along_axis(s, order, 1)) ** 2
            # both lists are sorted: a pair with more than ``take`` pairs before it in either list cannot be among the best
            i, j = np.divmod(np.arange(cost.shape[1] * lost.shape[1]), lost.shape[1])
            ok = (i + 1) * (j + 1) <= self.take
            i, j = i[ok], j[ok]
            c, k = cost[:, i] + lost[:, j], min(self.take, len(i))
            best = np.argpartition(c, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(c, best, 1), axis=1), 1)
            cost, code = np.take_along_axis(c, best, 1), np.take_along_axis(code, i[best], 1) * (2 * a) + np.take_along_axis(order, j[best], 1)
        return code


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _arrays(values: pd.Series) -> np.ndarray:
    v = np.array(values.tolist(), np.float64).reshape(len(values), -1)
    return v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-30) if np.abs(v).max(initial=0) > 1e15 else v


def _prepared(v: np.ndarray, mean: np.ndarray, dim: int) -> np.ndarray:
    """Centred unit vectors padded to dim."""
    c = _unit(_unit(v).astype(np.float32) - mean)
    return np.pad(c, ((0, 0), (0, dim - c.shape[1])))


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(cls, vec) of the different vectors of (id, vec): cls is the smallest id."""
    return vectors.groupBy("vec").agg(F.min("id").alias("cls"))


def _usable(vectors: DataFrame) -> DataFrame:
    """(id, vec) without zero, NULL or non-finite vectors and NULL ids."""
    ok = F.col("id").isNotNull() & F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = "array<float>" if vectors.schema["vec"].dataType.elementType.simpleString() in ("float", "tinyint", "smallint") else "array<double>"
    return vectors.select("id", F.col("vec").cast(kind).alias("vec")).where(ok)


def _small(df: DataFrame) -> DataFrame:
    """The materialised rows, marked for a broadcast if they are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Best:
    """The best ``keep`` candidates of each query, gathered over many buckets."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.rows = keep, [], 0

    def add(self, q: np.ndarray, other: np.ndarray, s: np.ndarray) -> None:
        self.parts.append(pd.DataFrame({"cls": q, "other": other, "s": s}))
        self.rows += len(q)
        if self.rows > 2_000_000:
            self.parts = [self.rest()]
            self.rows = len(self.parts[0])

    def rest(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"cls": [], "other": [], "s": []})
        r = pd.concat(self.parts).sort_values(["cls", "s", "other"], ascending=[True, False, True]).drop_duplicates(["cls", "other"])
        return r[r.groupby("cls").cumcount() < self.keep]


def _match(own: tuple, asks: tuple, keep: int, best: _Best) -> None:
    """Compares each query with the vectors in its own buckets. own: ids, fine codes, vectors; asks: ids, vectors, number of codes, codes."""
    ids, fine, vec = own
    q_ids, q_vec, counts, codes = asks
    order = np.argsort(fine, kind="stable")
    ids, vec = ids[order], _unit(vec[order].astype(np.float64))
    known, first, size = np.unique(fine[order], return_index=True, return_counts=True)
    q_vec = _unit(q_vec.astype(np.float64))
    low, q_low = vec.astype(np.float32), q_vec.astype(np.float32)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    hit = known[at] == codes
    who, at = np.repeat(np.arange(len(q_ids)), counts)[hit], at[hit]
    n = size[at]
    done = np.cumsum(np.bincount(who, weights=n, minlength=len(q_ids))).astype(np.int64)
    edges = np.searchsorted(who, np.arange(len(q_ids) + 1))
    lo = 0
    while lo < len(q_ids):  # queries whose candidates fit into one block, one at least
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + _PAIRS, "right")))
        w, a, m = who[edges[lo]:edges[hi]] - lo, at[edges[lo]:edges[hi]], n[edges[lo]:edges[hi]]
        if len(w):
            row = np.repeat(w, m)
            col = np.repeat(first[a] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            s = np.einsum("ij,ij->i", q_low[lo + row], low[col])
            length = np.bincount(row, minlength=hi - lo)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            wide = np.full((hi - lo, int(length.max())), -2, np.float32)
            back = np.zeros(wide.shape, np.int64)
            wide[row, slot], back[row, slot] = s, col
            k = min(keep, wide.shape[1])
            top = np.argpartition(-wide, k - 1, axis=1)[:, :k] if wide.shape[1] > k else np.broadcast_to(np.arange(k), wide.shape)
            real = np.take_along_axis(wide, top, 1) > -2
            q, c = lo + np.nonzero(real)[0], np.take_along_axis(back, top, 1)[real]
            best.add(q_ids[q], ids[c], np.einsum("ij,ij->i", q_vec[q], vec[c]))
        lo = hi


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, index: Index = Index()) -> DataFrame:
    """(id, near, similarity, rank): for each id of ``queries`` the k records of most similar cosine among (id, vec) ``vectors``, itself left out.

    Ties go to the smaller id. Queries without a usable vector, and an empty
    collection, give no rows; with fewer than k others at most those come out.
    Repeated ids count once per different vector. Results are approximate:
    a neighbour is missed if none of the searched buckets holds it.
    """
    spark = vectors.sparkSession
    usable = materialise(_usable(vectors))
    classes = materialise(vector_classes(usable))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    shape = classes.agg(F.max(F.size("vec")).alias("width"), F.count("*").alias("n"), F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high"), F.bool_and(F.forall("vec", lambda x: x == F.floor(x))).alias("whole")).first()
    width, n = shape["width"], shape["n"]
    if not width:
        return spark.createDataFrame([], "id long, near long, similarity double, rank int")
    # whole numbers travel in one or two bytes each
    kind = np.dtype(np.uint8 if shape["whole"] and shape["low"] >= 0 and shape["high"] <= 255 else np.int16 if shape["whole"] and -32768 <= shape["low"] and shape["high"] <= 32767 else np.float32)
    mean = classes.withColumn("_n", norm).agg(*[F.avg(F.element_at("vec", i + 1) / F.col("_n")) for i in range(width)]).first()
    mean = np.nan_to_num(np.array(mean, np.float32))
    dim = 1 << max(1, int(np.ceil(np.log2(width))))
    named = _small(materialise(queries.select("id").where("id is not null").distinct()))
    asked = materialise(usable.join(named, "id", "left_semi").distinct())
    asked = materialise(classes.join(_small(asked), "vec").select("id", "cls", "vec"))
    wanted = asked.select("cls", "vec").distinct()

    chunk_rows = max(index.chunk_rows, -(-index.tables * n // MOST_CROWDED))
    axes = index.axes(n, dim)
    depth = next((d for d in range(len(axes)) if n / (2 * dim) ** d <= chunk_rows), len(axes) - 1)  # leading axes by which vectors and queries meet
    inner = int(np.prod([2 * a for a in axes[depth:]]))
    groups = (2 * dim) ** depth
    small = np.dtype(np.uint16 if inner <= 1 << 16 else np.uint32 if inner <= 1 << 32 else np.int64)

    def grouped(codes: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        return table * groups + codes // inner, codes % inner

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(index, n, dim)
        for b in batches:
            c = _prepared(_arrays(b["vec"]), mean, dim)
            for t in range(index.tables):
                key, m = np.unique(grouped(hasher.buckets(c, t), t)[0], return_counts=True)
                yield pd.DataFrame({"key": key, "n": m})

    spread = classes.repartition(tasks_for(spark, n * (12 + 4 * width) * index.tables))
    crowded = spread.mapInPandas(fill, "key long, n long").groupBy("key").agg(F.ceil(F.sum("n") / chunk_rows).cast("int").alias("chunks")).where("chunks > 1")
    crowded = {r["key"]: r["chunks"] for r in crowded.collect()}  # MOST_CROWDED at most, as chunk_rows grows with n
    shared = spark.sparkContext.broadcast(crowded)

    def rows_of(parts: list) -> pd.DataFrame:
        return pd.DataFrame(parts, columns=["key", "chunk", "asks", "ids", "raw", "counts", "codes"])

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, chunks = Hasher(index, n, dim), shared.value
        for b in batches:
            v, ids, out = _arrays(b["vec"]), b["cls"].to_numpy(np.int64), []
            c, raw = _prepared(v, mean, dim), v.astype(kind)
            for t in range(index.tables):
                key, fine = grouped(hasher.buckets(c, t), t)
                order = np.argsort(key, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
                for lo, hi in zip(edges[:-1], edges[1:]):
                    own, name = order[lo:hi], int(key[order[lo]])
                    part = (ids[own] * 0x9E3779B1 >> 7) % chunks[name] if name in chunks else np.zeros(len(own), int)
                    out += [(name, int(p), False, ids[x].tobytes(), raw[x].tobytes(), b"", fine[x].astype(small).tobytes()) for p in np.unique(part) for x in [own[part == p]]]
            yield rows_of(out)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, chunks = Hasher(index, n, dim), shared.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.iloc[at:at + 512]
                v, ids, out = _arrays(b["vec"]), b["cls"].to_numpy(np.int64), []
                c, raw = _prepared(v, mean, dim), v.astype(kind)
                for t in range(index.tables):
                    codes = hasher.probes(c, t)
                    key, fine = (x.ravel() for x in grouped(codes, t))
                    who = np.repeat(np.arange(len(b)), codes.shape[1])
                    order = np.lexsort((who, key))
                    edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
                    for lo, hi in zip(edges[:-1], edges[1:]):
                        own, name = order[lo:hi], int(key[order[lo]])
                        q, m = np.unique(who[own], return_counts=True)
                        row = (ids[q].tobytes(), raw[q].tobytes(), m.astype(np.int32).tobytes(), fine[own].astype(small).tobytes())
                        out += [(name, p, True, *row) for p in range(chunks.get(name, 1))]
                yield rows_of(out)

    packed = "key long, chunk int, asks boolean, ids binary, raw binary, counts binary, codes binary"
    keep = k + 4  # a few more than needed, as single precision may turn near ties around
    tasks = tasks_for(spark, n * (16 + kind.itemsize * width) * index.tables, 2 * parallelism(spark))
    both = spread.mapInPandas(put, packed).unionByName(wanted.mapInPandas(ask, packed)).repartition(tasks, "key", "chunk").sortWithinPartitions("key", "chunk", "asks")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, now, own = _Best(keep), None, []

        def view(raw: bytes, of=np.int64) -> np.ndarray:
            return np.frombuffer(raw, of)

        ready = None
        for b in batches:
            for key, chunk, asks, ids, raw, counts, codes in b.itertuples(index=False, name=None):
                if (key, chunk) != now:
                    now, own, ready = (key, chunk), [], None
                if not asks:
                    own.append((ids, codes, raw))
                elif own:
                    ready = ready or tuple(view(b"".join(x[i] for x in own), of) for i, of in ((0, np.int64), (1, small), (2, kind)))
                    _match((ready[0], ready[1], ready[2].reshape(-1, width)), (view(ids), view(raw, kind).reshape(-1, width), view(counts, np.int32), view(codes, small)), keep, best)
        yield best.rest().astype({"cls": np.int64, "other": np.int64, "s": np.float64})

    found = both.mapInPandas(match, "cls long, other long, s double").groupBy("cls", "other").agg(F.max("s").alias("s"))
    similarity = F.when(F.col("cls") == F.col("other"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), "s"))
    order = Window.partitionBy("cls").orderBy(F.desc(F.round("similarity", 12)), "other")
    near = materialise(found.select("cls", "other", similarity.alias("similarity")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"))
    # members: the k + 1 smallest ids of a class are all that can be needed
    others = materialise(classes.join(_small(materialise(near.select(F.col("other").alias("cls")).distinct())), "cls"))
    of = usable.join(_small(others), "vec").select("cls", "id").distinct()
    members = of.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("cls").alias("other"), F.col("id").alias("near"))
    pairs = asked.select("id", "cls").join(near, "cls").join(members, "other").where("id <> near")
    pairs = pairs.groupBy("id", "near").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "near"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "near", "similarity", "rank")
