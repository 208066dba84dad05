"""Clusters of sites: k-means, Gaussian mixtures, DBSCAN, fuzzy c-means, hierarchical; quality measures and elbow rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.operators.distances import distances, spread
from phytoscape.operators.graph import components
from phytoscape.operators.ordination import square
from phytoscape.operators.sitepairs import near_clusters, packed
from phytoscape.operators.sitetrees import cophenetic_correlations, trees
from phytoscape.session import materialise

C = F.col


def as_vectors(v: DataFrame, value: str = "value") -> DataFrame:
    """(site, vec) of (site, species, value); absent species are 0. The species must fit a driver list."""
    names = [r[0] for r in v.select("species").distinct().orderBy("species").limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 species")
    wide = v.groupBy("site").pivot("species", names).agg(F.first(value)).na.fill(0.0)
    return wide.select("site", F.array(*[C(f"`{n}`").cast("double") for n in names]).alias("vec"))


def kmeans(vectors: DataFrame, k: int, starts: int = 10, seed: int = 42) -> tuple[DataFrame, float]:
    """(site, cluster) of the best of several starts, and its within-cluster sum of squares. Clusters are numbered by size, then smallest site."""
    v = materialise(vectors.select("site", array_to_vector("vec").alias("features")))
    if len(v.take(k)) < k:
        raise ValueError(f"fewer than {k} sites")
    best = min((KMeans(k=k, seed=seed + i).fit(v) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    out = best.transform(v).select("site", C("prediction").alias("c"))
    from pyspark.sql import Window

    rank = out.groupBy("c").agg(F.count("*").alias("n"), F.min("site").alias("s")).withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "s")))
    return out.join(F.broadcast(rank.select("c", "cluster")), "c").select("site", "cluster"), best.summary.trainingCost


def gaussian_mixture(vectors: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, dict]:
    """(site, cluster, probability), and log-likelihood with AIC and BIC for full covariances."""
    v = materialise(vectors.select("site", array_to_vector("vec").alias("features")))
    m = GaussianMixture(k=k, seed=seed).fit(v)
    n, p = v.count(), m.gaussians[0].mean.size
    free, ll = k - 1 + k * p + k * p * (p + 1) / 2, m.summary.logLikelihood
    return m.transform(v).select("site", (C("prediction") + 1).alias("cluster"), F.array_max(vector_to_array("probability")).alias("probability")), {"log_likelihood": ll / n, "aic": 2 * free - 2 * ll, "bic": free * np.log(n) - 2 * ll}


def dbscan(d: DataFrame, sites: DataFrame, eps: float, least: int = 5) -> DataFrame:
    """(site, cluster, core) from a pair table (i, j, d): cluster is the smallest core site's; noise has NULL. A border site joins its smallest cluster."""
    near = materialise(d.where(C("d") <= eps).select("i", "j"))
    both = near.union(near.select("j", "i"))
    deg = both.groupBy(C("i").alias("site")).agg((F.count("*") + 1).alias("n"))
    core = sites.select("site").join(deg, "site", "left").where(F.coalesce("n", F.lit(1)) >= least).select("site")
    links = near.join(core.toDF("i"), "i").join(core.toDF("j"), "j").select(C("i").alias("a"), C("j").alias("b"))
    root = components(links).toDF("site", "cluster")
    own = core.join(root, "site", "left").select("site", F.coalesce("cluster", "site").alias("cluster"))
    border = both.join(own.select(C("site").alias("j"), "cluster"), "j").groupBy(C("i").alias("site")).agg(F.min("cluster").alias("b"))
    return sites.select("site").join(own, "site", "left").join(border, "site", "left").select("site", F.coalesce("cluster", "b").alias("cluster"), C("cluster").isNotNull().alias("core"))


def community_dbscan(com: DataFrame, eps: float, least: int = 5, metric: str = "bray_curtis") -> DataFrame:
    """``dbscan`` of the sites of a community, whose near pairs never become rows."""
    p = packed(com)
    if p is None:
        return dbscan(distances(com, metric), com.select("site").distinct(), eps, least)
    kind = com.schema["site"].dataType.simpleString()
    at, core = near_clusters(com.sparkSession, p, eps, least, metric)
    by_name = np.append(p.site[np.argsort(p.name_rank)], None)
    rows = pd.DataFrame({"site": p.site, "cluster": by_name[at], "core": core})
    rows["cluster"] = rows["cluster"].astype(object).where(at >= 0, None)
    return com.sparkSession.createDataFrame(rows, f"site {kind}, cluster {kind}, core boolean")


def fuzzy_cmeans(vectors: DataFrame, k: int = 3, m: float = 2.0, rounds: int = 100, tol: float = 1e-4) -> DataFrame:
    """(site, cluster, membership): the greatest membership. Starts from the k sites of least hash; every round sums weighted vectors per centre in the tasks."""
    v = materialise(vectors)
    c = np.array([r["vec"] for r in v.orderBy(F.xxhash64("site"), "site").limit(k).collect()], float)

    def share(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = np.maximum(np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1)), 1e-10)
        w = d ** (-2 / (m - 1))
        return w / w.sum(1, keepdims=True)

    for _ in range(rounds):
        def sums(batches, c=c):
            for b in batches:
                x = np.array(b["vec"].tolist(), float)
                u = share(x, c) ** m
                yield pd.DataFrame({"k": range(len(c)), "w": u.sum(0), "s": list(u.T @ x)})

        t = v.mapInPandas(sums, "k int, w double, s array<double>").groupBy("k").agg(F.sum("w").alias("w"), *[F.sum(C("s")[i]).alias(f"s{i}") for i in range(c.shape[1])]).orderBy("k").toPandas()
        new = t[[f"s{i}" for i in range(c.shape[1])]].to_numpy() / t[["w"]].to_numpy()
        moved = np.abs(new - c).max()
        c = new
        if moved < tol:
            break

    def label(batches):
        for b in batches:
            u = share(np.array(b["vec"].tolist(), float), c)
            yield pd.DataFrame({"site": b["site"], "cluster": u.argmax(1) + 1, "membership": u.max(1)})

    return v.mapInPandas(label, f"site {v.schema['site'].dataType.simpleString()}, cluster int, membership double")


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of a distance matrix by Lance-Williams updates: single, complete, average or ward."""
    n = len(d)
    work = d.astype(float).copy()
    if method == "ward":
        work = work**2
    np.fill_diagonal(work, np.inf)
    size, ident, alive, merges = np.ones(n), np.arange(n), np.ones(n, bool), []
    low, at = work.min(1) if n else np.zeros(0), work.argmin(1) if n else np.zeros(0, int)  # nearest of each row
    for step in range(n - 1):
        i = int(np.where(alive, low, np.inf).argmin())
        j = int(at[i])
        i, j = min(i, j), max(i, j)
        h = work[i, j]
        a, b = size[i], size[j]
        if method == "single":
            new = np.minimum(work[i], work[j])
        elif method == "complete":
            new = np.maximum(work[i], work[j])
        elif method == "ward":
            new = ((a + size) * work[i] + (b + size) * work[j] - size * h) / (a + b + size)
        elif method == "average":
            new = (a * work[i] + b * work[j]) / (a + b)
        else:
            raise ValueError(f"Unknown linkage: {method}")
        alive[j] = False
        new[~alive], new[i] = np.inf, np.inf
        work[i], work[:, i] = new, new
        work[j], work[:, j] = np.inf, np.inf
        merges.append((int(min(ident[i], ident[j])), int(max(ident[i], ident[j])), float(np.sqrt(max(h, 0)) if method == "ward" else h), int(a + b)))
        size[i], ident[i] = a + b, n + step
        stale = alive & ((at == i) | (at == j))
        stale[i] = True
        low[stale], at[stale] = work[stale].min(1), work[stale].argmin(1)
        closer = alive & (work[:, i] < low)
        low[closer], at[closer] = work[closer, i], i
    return merges


def cut_tree(merges: list, n: int, clusters: int) -> np.ndarray:
    """Cluster of each of ``n`` leaves, numbered from 1 by their first member."""
    cut = merges[:max(0, n - clusters)]
    top = np.arange(n + len(cut))
    for step in range(len(cut) - 1, -1, -1):
        top[[int(cut[step][0]), int(cut[step][1])]] = top[n + step]
    root = top[:n]
    _, first = np.unique(root, return_index=True)
    rank = {root[i]: k + 1 for k, i in enumerate(sorted(first))}
    return np.array([rank[r] for r in root])


def cophenetic(merges: list, n: int) -> np.ndarray:
    """Heights at which pairs of leaves meet, as a matrix."""
    out, parts = np.zeros((n, n)), {i: [i] for i in range(n)}
    for step, (a, b, h, _) in enumerate(merges):
        x, y = parts.pop(a), parts.pop(b)
        out[np.ix_(x, y)] = h
        out[np.ix_(y, x)] = h
        parts[n + step] = x + y
    return out


def cophenetic_correlation(d: DataFrame, method: str = "average") -> float:
    """Correlation of the distances of a pair table with the heights of its tree (3,000 sites at most)."""
    names, m = square(d)
    iu = np.triu_indices(len(m), 1)
    c = cophenetic(linkage(m, method), len(m))[iu]
    return float(np.corrcoef(m[iu], c)[0, 1]) if len(c) > 1 and c.std() > 0 and m[iu].std() > 0 else 0.0


def silhouette_of(d: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of a distance matrix; one cluster has 0."""
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return 0.0
    one = np.eye(len(names))[at]
    n = one.sum(0)
    mean = d @ one / np.where(one > 0, np.maximum(n - 1, 1), n)
    own = mean[np.arange(len(d)), at]
    other = np.where(one > 0, np.inf, mean).min(1)
    return float(np.where(n[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0).mean())


def hierarchical(d: DataFrame, method: str = "average", clusters: int = 3) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(merges: left, right, height, size; labels: site, cluster from 1) by Lance-Williams updates on at most 3,000 sites."""
    names, m = square(d)
    merges = linkage(m, method)
    return pd.DataFrame(merges, columns=["left", "right", "height", "size"]), pd.DataFrame({"site": names, "cluster": cut_tree(merges, len(names), max(1, clusters))})


def community_hierarchical(com: DataFrame, method: str = "average", clusters: int = 3, metric: str = "bray_curtis") -> tuple[pd.DataFrame, pd.DataFrame]:
    """``hierarchical`` of the sites of a community, whose tree is made in one task without the matrix of distances: not bounded by 3,000 sites."""
    p = packed(com)
    if p is None:
        return hierarchical(distances(com, metric), method, clusters)
    merges, names = trees(com.sparkSession, p, (method,), metric)[method], p.site[np.argsort(p.name_rank)].tolist()
    table = pd.DataFrame(merges, columns=["left", "right", "height", "size"]).astype({"left": int, "right": int, "size": int})
    return table, pd.DataFrame({"site": names, "cluster": cut_tree(merges, len(names), max(1, clusters))})


def community_cophenetic(com: DataFrame, methods: tuple[str, ...] = ("average", "single", "complete", "ward"), metric: str = "bray_curtis") -> dict[str, float]:
    """``cophenetic_correlation`` of the sites of a community by each method: a tree is a task, pairs are summed in the tasks that make them, so sites are not bounded by 3,000."""
    p = packed(com)
    if p is None:
        d = distances(com, metric)
        return {m: cophenetic_correlation(d, m) for m in methods}
    return cophenetic_correlations(com.sparkSession, p, tuple(methods), metric)


def silhouette(vectors: DataFrame, labels: DataFrame, block: int = 1_024) -> DataFrame:
    """(site, cluster, silhouette), Euclidean: sums per site and cluster over all pairs, as the measure is defined. Sites alone in a cluster have 0. Pairs are summed in blocks and never become rows."""
    v = vectors.join(labels, "site").select("site", "cluster", "vec")
    blocks = max(1, -(-v.count() // block))
    rows = v.withColumn("blk", F.pmod(F.xxhash64("site"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("site", "cluster", "vec", "blk", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2")).repartition(spread(v.sparkSession, blocks), "b1", "b2")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        same, out = part["b1"].iloc[0] == part["b2"].iloc[0], []
        first = part if same else part[part["blk"] == part["b1"]]
        second = part if same else part[part["blk"] != part["b1"]]
        for a, b in ((first, second),) if same else ((first, second), (second, first)):
            x, y = (np.array(t["vec"].tolist(), float) for t in (a, b))
            d = np.empty((len(x), len(y)))
            for i in range(0, len(x), 64):
                d[i:i + 64] = np.sqrt(((x[i:i + 64, None] - y[None]) ** 2).sum(-1))
            names, at = np.unique(b["cluster"].to_numpy(), return_inverse=True)
            one = np.eye(len(names))[at]
            total, n = d @ one, one.sum(0)[None] - (one if same else 0)
            i, k = np.nonzero(np.broadcast_to(n, total.shape) > 0)
            out.append(pd.DataFrame({"i": a["site"].to_numpy()[i], "ci": a["cluster"].to_numpy()[i], "cj": names[k], "s": total[i, k], "n": np.broadcast_to(n, total.shape)[i, k]}))
        return pd.concat(out)

    kind, own = v.schema["site"].dataType.simpleString(), v.schema["cluster"].dataType.simpleString()
    s = rows.groupBy("b1", "b2").applyInPandas(run, f"i {kind}, ci {own}, cj {own}, s double, n double").groupBy("i", "ci", "cj").agg((F.sum("s") / F.sum("n")).alias("m"))
    r = s.groupBy("i", "ci").agg(F.max(F.when(C("ci") == C("cj"), C("m"))).alias("own"), F.min(F.when(C("ci") != C("cj"), C("m"))).alias("other"))
    return r.select(C("i").alias("site"), C("ci").alias("cluster"), F.coalesce(F.try_divide(C("other") - C("own"), F.greatest("own", "other")), F.lit(0.0)).alias("silhouette"))


def dispersion(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: calinski_harabasz, within and total sums of squares."""
    e = vectors.join(labels, "site").select("site", "cluster", F.posexplode("vec"))
    g = e.groupBy("cluster", "pos").agg(F.count("*").alias("n"), F.avg("col").alias("m"), F.var_pop("col").alias("v"))
    w = g.agg(F.sum(C("n") * C("v")).alias("within"), F.countDistinct("cluster").alias("k"))
    t = e.groupBy("pos").agg(F.count("*").alias("n"), F.var_pop("col").alias("v")).agg(F.sum(C("n") * C("v")).alias("total"), F.max("n").alias("n"))
    return w.join(t).select(F.try_divide((C("total") - C("within")) / (C("k") - 1), C("within") / (C("n") - C("k"))).alias("calinski_harabasz"), "within", "total")


def davies_bouldin(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean over clusters of the greatest (spread + spread) / distance of centres; centres are as many as clusters."""
    v = vectors.join(labels, "site")
    e = v.select("site", "cluster", F.posexplode("vec"))
    centre = e.groupBy("cluster", "pos").agg(F.avg("col").alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, q: t + q))
    s = v.join(F.broadcast(centre), "cluster").groupBy("cluster").agg(F.avg(gap("vec", "c")).alias("s"), F.first("c").alias("c"))
    p = s.toDF("i", "si", "ci").join(s.toDF("j", "sj", "cj"), C("i") != C("j")).withColumn("r", F.try_divide(C("si") + C("sj"), gap("ci", "cj")))
    return p.groupBy("i").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def simplified_silhouette(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean silhouette by distances to cluster centres instead of members, at a cost linear in the sites."""
    v = vectors.join(labels, "site")
    centre = v.select("cluster", F.posexplode("vec")).groupBy("cluster", "pos").agg(F.avg("col").alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    gap = F.sqrt(F.aggregate(F.zip_with("vec", "c", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, q: t + q))
    d = v.join(F.broadcast(centre.withColumnRenamed("cluster", "k"))).select("site", "cluster", "k", gap.alias("d"))
    r = d.groupBy("site").agg(F.max(F.when(C("k") == C("cluster"), C("d"))).alias("a"), F.min(F.when(C("k") != C("cluster"), C("d"))).alias("b"))
    return r.agg(F.coalesce(F.avg(F.coalesce(F.try_divide(C("b") - C("a"), F.greatest("a", "b")), F.lit(0.0))), F.lit(0.0)).alias("silhouette"))


def total_variance(vectors: DataFrame) -> float:
    """Sum of the population variances of all coordinates."""
    return float(vectors.select(F.posexplode("vec")).groupBy("pos").agg(F.var_pop("col").alias("v")).agg(F.sum("v")).first()[0] or 0.0)


def _l_method(k: np.ndarray, y: np.ndarray) -> int | None:
    """The k at which two straight lines fit best, weighted by their points; a side without spread has no fit."""
    best, at = np.inf, None
    for s in range(2, len(k) - 1):
        r2 = []
        for a, b in ((k[:s], y[:s]), (k[s:], y[s:])):
            rest, total = ((b - np.polyval(np.polyfit(a, b, 1), a)) ** 2).sum(), ((b - b.mean()) ** 2).sum()
            r2.append(1 - rest / total if total > 0 else np.nan)
        score = -(s * r2[0] + (len(k) - s) * r2[1]) / len(k)
        if score < best:
            best, at = score, int(k[s])
    return at


def elbow_rules(k: list[int], inertia: list[float]) -> dict[str, int | None]:
    """The k each rule picks on a short list: knee, derivative, variance, jump, l_method; their consensus and its share of the votes."""
    k, y = np.asarray(k), np.asarray(inertia, float)
    out: dict = {"knee": None, "derivative": None, "variance": None, "jump": None, "l_method": None}
    if len(k) >= 3 and np.ptp(y) > 0:
        out["knee"] = int(k[((1 - (y - y.min()) / np.ptp(y)) - (k - k.min()) / np.ptp(k)).argmax()])
        out["derivative"] = int(k[np.abs(np.diff(y, 2)).argmax() + 1])
        gains = -np.diff(y) / y[0]  # of going on from each k
        low = [i for i in range(1, len(gains)) if gains[i] < 0.1]
        out["variance"] = int(k[low[0]] if low else k[-2])
        if len(k) >= 4:
            drops = -np.diff(y)
            out["jump"] = int(k[(drops[:-1] - drops[1:]).argmax() + 1])
            out["l_method"] = _l_method(k, y)
    votes = [v for v in out.values() if v is not None]
    if votes:
        counts = {v: votes.count(v) for v in votes}  # the first of the most frequent
        top = max(counts, key=lambda v: counts[v])
        out["consensus"] = int(top) if counts[top] > 1 else int(np.median(votes))
        out["confidence"] = counts[top] / len(votes)
    return out


def elbow_analysis(vectors: DataFrame, ks: range = range(1, 11), starts: int = 10, seed: int = 42) -> tuple[pd.DataFrame, dict]:
    """(table: k, inertia, silhouette, calinski_harabasz, davies_bouldin; the rules' choices with the best k by silhouette and by Calinski-Harabasz).

    k-means runs distributed for each k; k = 1 has the sum of the variances as
    its inertia. Silhouettes are the simplified ones (distances to centres).
    """
    rows, vectors = [], materialise(vectors)
    for k in ks:
        if k == 1:
            rows.append((1, total_variance(vectors), 0.0, 0.0, float("inf")))
            continue
        labels, cost = kmeans(vectors, k, starts, seed)
        labels = materialise(labels)
        ch = dispersion(vectors, labels).first()["calinski_harabasz"]
        rows.append((k, float(cost), float(simplified_silhouette(vectors, labels).first()[0]), float(ch or 0.0), float(davies_bouldin(vectors, labels).first()[0] or float("inf"))))
    t = pd.DataFrame(rows, columns=["k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin"])
    picks = elbow_rules(t["k"].tolist(), t["inertia"].tolist())
    picks["silhouette_optimal"] = int(t["k"].iloc[t["silhouette"].to_numpy().argmax()])
    picks["calinski_optimal"] = int(t["k"].iloc[t["calinski_harabasz"].to_numpy().argmax()])
    return t, picks


def gap_statistic(vectors: DataFrame, ks: range = range(1, 11), references: int = 10, starts: int = 10, seed: int = 42) -> pd.DataFrame:
    """(k, gap, error, optimal): ln of the mean inertia of uniform tables of the same ranges and size over that of the table; optimal is the first k whose gap reaches the next one less its error."""
    spark = vectors.sparkSession
    v = materialise(vectors)
    width = v.select(F.max(F.size("vec"))).first()[0]
    box = v.agg(*[f(C("vec")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("a", F.min), ("b", F.max))]).first()

    def inertia(t: DataFrame, k: int) -> float:
        return t.count() * total_variance(t) if k == 1 else kmeans(t, k, starts, seed)[1]

    seen = [inertia(v, k) for k in ks]
    null = []
    for r in range(references):
        u = lambda i: box[f"a{i}"] + (box[f"b{i}"] - box[f"a{i}"]) * (F.pmod(F.xxhash64(F.lit(seed + 1_000 * r + i), "site"), F.lit(1 << 52)) / (1 << 52))
        t = materialise(v.select("site", F.array(*[u(i) for i in range(width)]).alias("vec")))
        null.append([inertia(t, k) for k in ks])
    null = np.maximum(np.array(null), 1e-300)
    gap, err = np.log(null.mean(0)) - np.log(np.maximum(seen, 1e-300)), np.log(null).std(0) * np.sqrt(1 + 1 / references)
    best = next((k for i, k in enumerate(list(ks)[:-1]) if gap[i] >= gap[i + 1] - err[i + 1]), 1)
    return pd.DataFrame({"k": list(ks), "gap": gap, "error": err, "optimal": [k == best for k in ks]})
