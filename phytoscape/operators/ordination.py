"""Ordination. Spark sums cross-moments over sites; numpy decomposes the small species or site matrices.

Matrices of species are checked to have at most ``MOST_SPECIES`` rows, those
of sites (distance-based methods) at most ``MOST_SITES``. Axes are signed so
that the loading of largest size is positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.operators.transforms import transform

C = F.col
MOST_SPECIES, MOST_SITES = 2_000, 3_000


def _signed(vectors: np.ndarray) -> np.ndarray:
    big = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(big < 0, -1, 1)


def _names(com: DataFrame) -> list[str]:
    names = [r[0] for r in com.select("species").distinct().orderBy("species").limit(MOST_SPECIES + 1).collect()]
    if len(names) > MOST_SPECIES:
        raise ValueError(f"more than {MOST_SPECIES} species")
    return names


def _cross(com: DataFrame, names: list[str], value: str, weight: str | None = None) -> np.ndarray:
    """Sum over sites of x_j x_k (times a weight of the site)."""
    w = C(weight) if weight else F.lit(1.0)
    a = com.select("site", C("species").alias("j"), (C(value) * w).alias("x"))
    b = com.select("site", C("species").alias("k"), C(value).alias("y"))
    at = {s: i for i, s in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in a.join(b, "site").where("j <= k").groupBy("j", "k").agg(F.sum(C("x") * C("y")).alias("s")).collect():  # species squared, checked
        m[at[r["j"]], at[r["k"]]] = m[at[r["k"]], at[r["j"]]] = r["s"]
    return m


def _scores(com: DataFrame, value: str, names: list[str], loadings: np.ndarray, shift: np.ndarray, scale: str | None = None) -> DataFrame:
    """(site, axis, score): sum over species of value times loading, minus a constant per axis."""
    spark = com.sparkSession
    rows = [(s, k + 1, float(loadings[i, k])) for i, s in enumerate(names) for k in range(loadings.shape[1])]
    table = F.broadcast(spark.createDataFrame(rows, "species string, axis int, load double"))  # species times axes, checked
    less = F.broadcast(spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(shift)], "axis int, less double"))
    v = C(value) * C(scale) if scale else C(value)
    return com.join(table, "species").groupBy("site", "axis").agg(F.sum(v * C("load")).alias("s")).join(less, "axis").select("site", "axis", (C("s") - C("less")).alias("score"))


def pca(com: DataFrame, method: str = "hellinger", components: int = 2) -> tuple[DataFrame, pd.DataFrame]:
    """(site scores, species table with eigenvalues, ratios and scores). Eigenvalues over n - 1."""
    v = transform(com, method).withColumn("species", C("species").cast("string")) if method != "raw" else com.withColumn("value", C("abundance"))
    names = _names(v)
    n = com.select("site").distinct().count()
    mean = {r["species"]: r["s"] / n for r in v.groupBy("species").agg(F.sum("value").alias("s")).collect()}
    m = np.array([mean[s] for s in names])
    cov = (_cross(v, names, "value") - n * np.outer(m, m)) / max(1, n - 1)
    lam, vec = np.linalg.eigh(cov)
    order = np.argsort(-lam)[:components]
    lam_all, lam, vec = lam, np.maximum(lam[order], 0), _signed(vec[:, order])
    table = pd.DataFrame([(s, k + 1, vec[i, k] * np.sqrt(lam[k]), lam[k], lam[k] / lam_all.sum()) for i, s in enumerate(names) for k in range(len(lam))], columns=["species", "axis", "score", "eigenvalue", "ratio"])
    return _scores(v, "value", names, vec, m @ vec), table


def ca(com: DataFrame, components: int = 2) -> tuple[DataFrame, pd.DataFrame]:
    """Correspondence analysis on the residuals (X - E) / sqrt(E): site scores U S / sqrt(r), species scores V; eigenvalues not divided by the total."""
    com = com.withColumn("species", C("species").cast("string"))
    names = _names(com)
    col = {r["species"]: r["s"] for r in com.groupBy("species").agg(F.sum("abundance").alias("s")).collect()}
    c = np.array([col[s] for s in names])
    total = c.sum()
    r = com.groupBy("site").agg(F.sum("abundance").alias("r"))
    x = com.join(r, "site").withColumn("w", 1 / C("r"))
    root = np.sqrt(np.outer(c, c))
    lam, vec = np.linalg.eigh(total * _cross(x, names, "abundance", "w") / root - root)
    order = np.argsort(-lam)[:components]
    lam, vec = np.maximum(lam[order], 0), _signed(vec[:, order])
    # row of U S is row of the residuals times V; sqrt(E) times V vanishes, as sqrt(c) belongs to the eigenvalue 0
    x = x.withColumn("w", np.sqrt(total) / C("r"))
    table = pd.DataFrame([(s, k + 1, vec[i, k], lam[k]) for i, s in enumerate(names) for k in range(len(lam))], columns=["species", "axis", "score", "eigenvalue"])
    return _scores(x, "abundance", names, vec / np.sqrt(c)[:, None], np.zeros(len(lam)), "w"), table


def dca(com: DataFrame, segments: int = 26) -> pd.DataFrame:
    """(site, axis1, axis2): correspondence analysis with axis 2 centred in equal segments of axis 1; both over their population deviation."""
    s = ca(com)[0].groupBy("site").pivot("axis", [1, 2]).agg(F.first("score")).toDF("site", "axis1", "axis2")
    span = s.agg(F.min("axis1").alias("lo"), F.max("axis1").alias("hi"))
    from pyspark.sql import Window

    s = s.join(F.broadcast(span)).withColumn("bin", F.least(F.floor((C("axis1") - C("lo")) / F.greatest(C("hi") - C("lo"), F.lit(1e-300)) * segments), F.lit(segments - 1)))
    s = s.withColumn("axis2", C("axis2") - F.avg("axis2").over(Window.partitionBy("bin")))
    d = s.agg(F.stddev_pop("axis1").alias("s1"), F.stddev_pop("axis2").alias("s2"))
    one = lambda c: F.when(C(c) > 0, C(c)).otherwise(1.0)
    return s.join(F.broadcast(d)).select("site", (C("axis1") / one("s1")).alias("axis1"), (C("axis2") / one("s2")).alias("axis2"))


def constrained(com: DataFrame, env: DataFrame, names_env: list[str], method: str = "rda") -> pd.DataFrame:
    """Eigenvalues and axes of redundancy (rda) or canonical correspondence (cca) analysis on complete sites: (axis, eigenvalue, variable, kind, score)."""
    env = env.select("site", *[C(n).cast("double").alias(n) for n in names_env]).dropna("any")
    com = com.join(env.select("site"), "site", "left_semi").withColumn("species", C("species").cast("string"))
    names = _names(com)
    e = env.join(com.select("site").distinct(), "site", "left_semi")
    st = e.agg(F.count("*").alias("n"), *[F.avg(n).alias(f"m_{n}") for n in names_env], *[F.stddev_pop(n).alias(f"s_{n}") for n in names_env]).first()
    n = st["n"]
    z = e.select("site", *[((C(k) - st[f"m_{k}"]) / (st[f"s_{k}"] or 1.0)).alias(k) for k in names_env])
    zz = z.agg(*[F.sum(C(a) * C(b)).alias(f"{i}_{j}") for i, a in enumerate(names_env) for j, b in enumerate(names_env)]).first()
    q = len(names_env)
    zz = np.array([[zz[f"{i}_{j}"] for j in range(q)] for i in range(q)])
    if method == "rda":
        m = {r["species"]: (r["s"] / n, max(r["q"] / n - (r["s"] / n) ** 2, 0) ** 0.5) for r in com.groupBy("species").agg(F.sum("abundance").alias("s"), F.sum(C("abundance") ** 2).alias("q")).collect()}
        raw = com.join(z, "site").groupBy("species").agg(*[F.sum(C("abundance") * C(k)).alias(f"v{i}") for i, k in enumerate(names_env)]).collect()
        zy = {r["species"]: np.array([r[f"v{i}"] for i in range(q)]) / (m[r["species"]][1] or 1.0) for r in raw}
        zy = np.stack([zy[s] for s in names], 1)  # z is centred, so the mean of y drops out
        b = np.linalg.pinv(zz) @ zy
        lam, vec = np.linalg.eigh(zy.T @ b)
    else:
        t = com.groupBy("site").agg(F.sum("abundance").alias("r"))
        y = com.join(t, "site").join(z, "site")
        total = t.agg(F.sum("r")).first()[0]
        raw = {r["species"]: np.array([r[f"v{i}"] for i in range(q)]) for r in y.groupBy("species").agg(*[F.sum(C("abundance") * C(k) / total).alias(f"v{i}") for i, k in enumerate(names_env)]).collect()}
        zy = np.stack([raw[s] for s in names], 1)
        b = zy
        lam, vec = np.linalg.eigh(zy.T @ zy)
    order = np.argsort(-lam)[:min(q, len(names))]
    lam, vec = np.maximum(lam[order], 0), _signed(vec[:, order])
    env_scores = b @ vec
    rows = [(k + 1, lam[k], s, "species", vec[i, k]) for i, s in enumerate(names) for k in range(len(lam))] + [(k + 1, lam[k], v, "environment", env_scores[i, k]) for i, v in enumerate(names_env) for k in range(len(lam))]
    return pd.DataFrame(rows, columns=["axis", "eigenvalue", "variable", "kind", "score"])


def square(d: DataFrame) -> tuple[list, np.ndarray]:
    """Sites and full matrix of a pair table, at most ``MOST_SITES`` sites."""
    pairs = MOST_SITES * (MOST_SITES - 1) // 2
    t = d.limit(pairs + 1).toPandas()
    if len(t) > pairs:
        raise ValueError(f"more than {MOST_SITES} sites")
    names = sorted(set(t["i"]) | set(t["j"]))
    at = {s: k for k, s in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    i, j = t["i"].map(at).to_numpy(int), t["j"].map(at).to_numpy(int)
    m[i, j] = m[j, i] = t["d"].to_numpy()
    return names, m


def pcoa(d: DataFrame, components: int = 2) -> pd.DataFrame:
    """(site, axis, score, eigenvalue) of principal coordinates; eigenvalues above 1e-8 only."""
    names, m = square(d)
    h = np.eye(len(m)) - 1 / len(m)
    lam, vec = np.linalg.eigh(-0.5 * h @ (m * m) @ h)
    order = [k for k in np.argsort(-lam) if lam[k] > 1e-8][:components]
    v = _signed(vec[:, order]) * np.sqrt(lam[order])
    return pd.DataFrame([(s, k + 1, v[i, k], lam[order[k]]) for i, s in enumerate(names) for k in range(len(order))], columns=["site", "axis", "score", "eigenvalue"])


def _monotone(y: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit (pool adjacent violators)."""
    value, size = [], []
    for v in y:
        value.append(v), size.append(1)
        while len(value) > 1 and value[-2] > value[-1]:
            a, b = value.pop(), size.pop()
            value[-1] = (value[-1] * size[-1] + a * b) / (size[-1] + b)
            size[-1] += b
    return np.repeat(value, size)


def nmds(d: DataFrame, components: int = 2, rounds: int = 300, metric: bool = False, seed: int = 42) -> tuple[pd.DataFrame, float]:
    """(site coordinates, stress) by majorisation; non-metric with monotone regression unless ``metric``."""
    names, m = square(d)
    n = len(m)
    x = np.random.default_rng(seed).normal(size=(n, components)) * (m.mean() or 1)
    iu = np.triu_indices(n, 1)
    order = np.argsort(m[iu], kind="stable")
    stress = 0.0
    for _ in range(rounds):
        e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        target = m
        if not metric:
            fit = np.empty(len(order))
            fit[order] = _monotone(e[iu][order])
            fit *= np.sqrt((m[iu] ** 2).sum() / max((fit**2).sum(), 1e-300))
            target = np.zeros_like(m)
            target[iu] = fit
            target += target.T
        b = -np.divide(target, e, out=np.zeros_like(e), where=e > 0)
        b[np.arange(n), np.arange(n)] = -b.sum(1)
        x = b @ x / n
        now = float(np.sqrt(((e[iu] - target[iu]) ** 2).sum() / max((target[iu] ** 2).sum(), 1e-300)))
        if abs(stress - now) < 1e-9:
            break
        stress = now
    return pd.DataFrame(np.c_[np.array(names, object)[:, None], x], columns=["site", *[f"axis{k + 1}" for k in range(components)]]), stress


def procrustes(a: np.ndarray, b: np.ndarray) -> float:
    """Disparity of two configurations after centring, scaling and rotation."""
    a, b = a - a.mean(0), b - b.mean(0)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    s = np.linalg.svd(a.T @ b)[1].sum()
    return float(1 - s * s)
