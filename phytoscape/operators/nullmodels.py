"""Null matrices of communities and the significance of nestedness. Matrices are drawn in the tasks, one seed each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 4_000_000


def matrix(com: DataFrame) -> tuple[list, list, np.ndarray]:
    """Sites, species and the presence matrix; at most ``MOST_CELLS`` presences are taken to the driver."""
    t = com.where("abundance > 0").select("site", "species").limit(MOST_CELLS + 1).toPandas()
    if len(t) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} presences")
    sites, species = sorted(t["site"].unique()), sorted(t["species"].unique())
    m = np.zeros((len(sites), len(species)), np.int8)
    m[pd.Categorical(t["site"], sites).codes, pd.Categorical(t["species"], species).codes] = 1
    return sites, species, m


def null_matrix(m: np.ndarray, model: str, rng: np.random.Generator) -> np.ndarray:
    """equiprobable: presences anywhere; rows, columns: within their totals; proportional: weighted by both totals; fixed: swaps that keep both."""
    n, k = m.shape
    if model == "equiprobable":
        out = np.zeros(n * k, np.int8)
        out[rng.choice(n * k, int(m.sum()), replace=False)] = 1
        return out.reshape(n, k)
    if model == "rows":
        return (rng.random((n, k)).argsort(1).argsort(1) < m.sum(1)[:, None]).astype(np.int8)
    if model == "columns":
        return null_matrix(m.T, "rows", rng).T
    if model == "proportional":  # the greatest of ln(u) / weight are a weighted draw without replacement
        w = np.outer(m.sum(1), m.sum(0)) + 1e-12
        key = np.log(rng.random((n, k))) / w
        out = np.zeros(n * k, np.int8)
        out[np.argsort(-key.ravel())[: int(m.sum())]] = 1
        return out.reshape(n, k)
    if model != "fixed":
        raise ValueError(f"Unknown null model: {model}")
    out = m.copy()
    for _ in range(max(1_000, 5 * int(m.sum()))):
        i, j = rng.integers(n, size=2)
        a = np.flatnonzero(out[i] > out[j])
        b = np.flatnonzero(out[j] > out[i])
        if len(a) and len(b):
            x, y = a[rng.integers(len(a))], b[rng.integers(len(b))]
            out[[i, j], x] = 1 - out[[i, j], x]
            out[[i, j], y] = 1 - out[[i, j], y]
    return out


def nodf_of(m: np.ndarray) -> float:
    def part(x):
        t, joint = x.sum(1), x.astype(np.int64) @ x.T.astype(np.int64)
        i, j = np.triu_indices(len(x), 1)
        low, ok = np.minimum(t[i], t[j]), (t[i] != t[j]) & (np.minimum(t[i], t[j]) > 0)
        return 100.0 * joint[i, j][ok] / low[ok]
    v = np.r_[part(m), part(m.T)]
    return float(v.mean()) if len(v) else 0.0


def c_score_of(m: np.ndarray) -> float:
    t, joint = m.sum(0).astype(np.int64), m.T.astype(np.int64) @ m.astype(np.int64)
    i, j = np.triu_indices(m.shape[1], 1)
    return float(((t[i] - joint[i, j]) * (t[j] - joint[i, j])).mean()) if len(i) else 0.0


METRICS = {"nodf": nodf_of, "c_score": c_score_of}


def null_model_test(com: DataFrame, metric: str = "nodf", model: str = "fixed", draws: int = 99, seed: int = 42) -> DataFrame:
    """One row: observed value, mean and deviation of the null values, standardised effect size, p_greater, p_lesser, two-tailed p (1 at most)."""
    spark = com.sparkSession
    m = matrix(com)[2]
    shared = spark.sparkContext.broadcast(m)

    def draw(batches):
        for b in batches:
            yield pd.DataFrame({"v": [METRICS[metric](null_matrix(shared.value, model, np.random.default_rng([seed, int(i)]))) for i in b["id"]]})

    seen = METRICS[metric](m)
    t = spark.range(0, draws, 1, min(draws, spark.sparkContext.defaultParallelism)).mapInPandas(draw, "v double")
    o = F.lit(seen)
    r = t.agg(F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_sd"), ((F.count_if(F.col("v") >= o) + 1) / (draws + 1)).alias("p_greater"), ((F.count_if(F.col("v") <= o) + 1) / (draws + 1)).alias("p_lesser"))
    return r.select(o.alias("observed"), "null_mean", "null_sd", F.coalesce(F.try_divide(o - F.col("null_mean"), F.col("null_sd")), F.lit(0.0)).alias("ses"), "p_greater", "p_lesser", F.least(F.lit(1.0), 2 * F.least("p_greater", "p_lesser")).alias("p_two_tailed"))
