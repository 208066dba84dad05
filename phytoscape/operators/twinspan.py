"""Two-way indicator division of sites by pseudospecies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.operators.sitepairs import packed

C = F.col
MOST_CELLS, ROWS = 5_000_000, 16_384


def pseudospecies(com: DataFrame, cuts: tuple[float, ...] = (0, 2, 5, 10, 20)) -> DataFrame:
    """(site, pseudo): a species at each cut level it reaches; the first level is skipped."""
    return com.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(1, len(cuts))]))).where(C("abundance") >= F.element_at(F.array(*[F.lit(float(c)) for c in cuts]), C("k") + 1)).select("site", F.concat_ws("_", C("species").cast("string"), C("k").cast("string")).alias("pseudo"))


def _divide(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Side of each site and the gap between the mean scores of both sides after reciprocal averaging."""
    n = len(m)
    score, last = np.ones(n), None
    parts = [slice(k, k + ROWS) for k in range(0, n, ROWS)]  # presences are bytes, a part at a time is multiplied
    col, row = np.maximum(m.sum(0, dtype=float), 1e-12), np.maximum(m.sum(1, dtype=float), 1e-12)
    score = np.arange(n) / n if n else score
    for _ in range(20):
        sp = sum(m[k].T.astype(float) @ score[k] for k in parts) / col
        new = np.concatenate([m[k].astype(float) @ sp for k in parts]) / row
        new = (new - new.mean()) / (new.std() or 1.0)
        if last is not None and new.std() > 0 and last.std() > 0 and abs(np.corrcoef(new, last)[0, 1]) > 0.999:
            score = new
            break
        score, last = new, new
    order = np.argsort(score, kind="stable")
    s = score[order]
    k = np.arange(max(2, n // 4), min(n - 2, 3 * n // 4) + 1)
    left = np.concatenate([[0.0], np.cumsum(s)])
    best = int(k[np.abs(left[k] / k - (left[-1] - left[k]) / (n - k)).argmax()]) if len(k) else n // 2
    side = np.zeros(n, bool)
    side[order[best:]] = True
    return side, float(abs(s[:best].mean() - s[best:].mean())) if 0 < best < n else 0.0


def _presences(com: DataFrame, cuts: tuple[float, ...]) -> tuple[list, list[str], np.ndarray]:
    p = packed(com)
    if p is None:
        t = pseudospecies(com, cuts).limit(MOST_CELLS + 1).toPandas()
        if len(t) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} presences")
        sites, names = sorted(t["site"].unique()), sorted(t["pseudo"].unique())
        m = np.zeros((len(sites), len(names)), np.uint8)
        m[pd.Categorical(t["site"], sites).codes, pd.Categorical(t["pseudo"], names).codes] = 1
        return sites, names, m
    x = p.x[np.argsort(p.site)]
    column = {f"{s}_{k}": (j, cuts[k]) for j, s in enumerate(p.species) for k in range(1, len(cuts)) if (x[:, j] >= cuts[k]).any() and (x[:, j] > 0).any()}
    names = sorted(column)
    m = np.zeros((len(x), len(names)), np.uint8)
    for i, s in enumerate(names):
        j, cut = column[s]
        m[:, i] = (x[:, j] >= cut) & (x[:, j] > 0)
    some = m.any(1)
    return np.sort(p.site)[some].tolist(), names, m[some]


def twinspan(com: DataFrame, cuts: tuple[float, ...] = (0, 2, 5, 10, 20), divisions: int = 6, least: int = 5) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(sites with their group, divisions with their indicators: pseudospecies whose frequencies differ by more than 0.3, five at most).

    The matrix of sites and pseudospecies is made on the driver from that of
    the abundances, a byte a cell; where these don't fit ``packed``, from at
    most five million presences.
    """
    sites, names, m = _presences(com, cuts)
    todo, final, made = [(0.0, np.arange(len(sites)))], [], []
    while todo and len(made) < divisions:
        todo.sort(key=lambda g: g[0])
        gap, own = todo.pop()
        if len(own) < 2 * least or made and gap < 0.1:
            final.append(own)
            continue
        side, gap = _divide(m[own])
        a, b = own[~side], own[side]
        diff = m[a].mean(0, dtype=float) - m[b].mean(0, dtype=float)
        made.append((len(made) + 1, len(a), len(b), gap, ", ".join(names[i] for i in np.argsort(-np.abs(diff), kind="stable")[:5] if abs(diff[i]) > 0.3)))
        for part in (a, b):
            (todo.append((0.8 * gap, part)) if len(part) >= least else final.append(part))
    final += [own for _, own in todo]
    final.sort(key=lambda g: g.min())
    return pd.DataFrame([(sites[i], k + 1) for k, g in enumerate(final) for i in g], columns=["site", "cluster"]), pd.DataFrame(made, columns=["division", "left", "right", "gap", "indicators"])
