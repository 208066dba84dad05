"""Distances between sites, from per-site totals and sums over shared species."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.operators.sitepairs import distance_table, gower_table, packed
from phytoscape.session import parallelism

C = F.col


MOST_SPECIES = 2_000
BLOCK = 512


def _few_species(com: DataFrame) -> list | None:
    """The species in order, None if there are more than ``MOST_SPECIES``."""
    names = [r[0] for r in com.select("species").distinct().limit(MOST_SPECIES + 1).collect()]
    return sorted(names) if len(names) <= MOST_SPECIES else None


def _site_blocks(com: DataFrame) -> DataFrame:
    """(site, m, blk, b1, b2): sites with their abundances in blocks; a block meets itself and, as first or second partner, every other one."""
    blocks = max(1, -(-com.select("site").distinct().count() // BLOCK))
    rows = com.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("species", "abundance"))).alias("m")).withColumn("blk", F.pmod(F.xxhash64("site"), F.lit(blocks)).cast("int"))
    pairs = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("site", "m", "blk", F.least("blk", "p").alias("b1"), F.greatest("blk", "p").alias("b2"))
    return pairs.repartition(spread(com.sparkSession, blocks), "b1", "b2")


def spread(spark, blocks: int) -> int:
    """Tasks for all pairs of blocks, some 16 pairs each: their kernels cost more than their bytes tell."""
    return max(parallelism(spark), blocks * (blocks + 1) // 32)


def _block_matrix(part: pd.DataFrame, names: list) -> tuple:
    """(sites, abundances, rows of the first block, of the second, whether both are the same)."""
    part = part.sort_values("site")
    at = {s: k for k, s in enumerate(names)}
    x = np.zeros((len(part), len(names)))
    for r, m in enumerate(part["m"]):
        for s, v in (m.items() if isinstance(m, dict) else m):
            x[r, at[s]] = v
    same = part["b1"].iloc[0] == part["b2"].iloc[0]
    first = np.ones(len(part), bool) if same else part["blk"].to_numpy() == part["b1"].iloc[0]
    return part["site"].to_numpy(), x, first, np.ones(len(part), bool) if same else ~first, same


def pair_sums(com: DataFrame, sums: tuple[str, ...] = ("mn", "xy", "a", "cb", "hp")) -> DataFrame:
    """Every pair i < j of sites with the totals and shared sums the metrics need.

    Up to ``MOST_SPECIES`` species, sites are cut into blocks and each pair of
    blocks is one task of numpy sums, so shared cells never become rows; with
    more species the shared sums come from an equi-join on species. Either way
    the list of all pairs is the result's own size.
    """
    names = _few_species(com)
    if names is None:
        return _joined_sums(com, sums)
    kind = com.schema["site"].dataType.simpleString()
    left = _site_blocks(com)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        site, x, first, second, same = _block_matrix(part, names)
        a, b = x[first], x[second]
        na, nb = a.sum(1), b.sum(1)
        out = {k: np.zeros((len(a), len(b))) for k in sums}
        for j in range(len(names)):
            u, v = a[:, j][:, None], b[:, j][None]
            both = (u > 0) & (v > 0)
            if not both.any():
                continue
            for k in sums:
                if k == "mn":
                    out[k] += np.minimum(u, v)
                elif k == "xy":
                    out[k] += u * v
                elif k == "a":
                    out[k] += both
                elif k == "cb":
                    out[k] += np.where(both, np.abs(u - v) / np.maximum(u + v, 1e-300), 0)
                else:
                    out[k] += np.sqrt(u / na[:, None] * (v / nb[None]))
        i, j = np.triu_indices(len(a), 1) if same else (g.ravel() for g in np.indices((len(a), len(b))))
        sa, sb = site[first], site[second]
        swap = sa[i] > sb[j]
        d = {"i": np.where(swap, sb[j], sa[i]), "j": np.where(swap, sa[i], sb[j])}
        for c, f in (("n", lambda v: v.sum(1)), ("s", lambda v: (v > 0).sum(1)), ("q", lambda v: (v * v).sum(1))):
            p, q = f(a)[i], f(b)[j]
            d[f"{c}i"], d[f"{c}j"] = np.where(swap, q, p), np.where(swap, p, q)
        return pd.DataFrame({**d, **{k: out[k][i, j] for k in sums}})

    schema = f"i {kind}, j {kind}, ni double, nj double, si long, sj long, qi double, qj double, " + ", ".join(f"{k} double" for k in sums)
    return left.groupBy("b1", "b2").applyInPandas(solve, schema)


def _joined_sums(com: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    site = Window.partitionBy("site")
    d = com.withColumn("p", C("abundance") / F.sum("abundance").over(site))
    a, b = (d.select(C("site").alias(k), "species", C("abundance").alias(f"x{k}"), C("p").alias(f"p{k}")) for k in "ij")
    x, y = C("xi"), C("xj")
    every = {"mn": F.sum(F.least(x, y)), "xy": F.sum(x * y), "a": F.count("*").cast("double"), "cb": F.sum(F.abs(x - y) / (x + y)), "hp": F.sum(F.sqrt(C("pi") * C("pj")))}
    shared = a.join(b, "species").where("i < j").groupBy("i", "j").agg(*[every[k].alias(k) for k in sums])
    t = com.groupBy("site").agg(F.sum("abundance").alias("n"), F.count("*").alias("s"), F.sum(C("abundance") * C("abundance")).alias("q"))
    ti, tj = (t.select(C("site").alias(k), *[C(c).alias(f"{c}{k}") for c in "nsq"]) for k in "ij")
    return ti.join(tj, C("i") < C("j")).join(shared, ["i", "j"], "left").na.fill(0, list(sums))


#: Shared sums of each metric.
NEEDED = {"bray_curtis": ("mn",), "jaccard": ("a",), "sorensen": ("a",), "euclidean": ("xy",), "manhattan": ("mn",), "canberra": ("cb", "a"), "chord": ("xy",), "hellinger": ("hp",)}


def metric_columns() -> dict:
    n, s, q = C("ni") + C("nj"), C("si") + C("sj"), C("qi") + C("qj")
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return {
        "bray_curtis": 1 - 2 * C("mn") / n, "jaccard": 1 - C("a") / (s - C("a")), "sorensen": 1 - 2 * C("a") / s, "euclidean": root(q - 2 * C("xy")), "manhattan": n - 2 * C("mn"),
        "canberra": C("cb") + s - 2 * C("a"), "chord": root(2 - 2 * C("xy") / F.sqrt(C("qi") * C("qj"))), "hellinger": root(2 - 2 * C("hp")),
    }


def distances(com: DataFrame, metric: str = "bray_curtis") -> DataFrame:
    """(i, j, d) for all pairs of sites; an unknown metric is an error. Where the abundances fit, they go to every task and pairs are made there."""
    every = metric_columns()
    if metric not in every:
        raise ValueError(f"Unknown metric: {metric}")
    p = packed(com)
    if p is not None:
        return distance_table(com, p, metric)
    return pair_sums(com, NEEDED[metric]).select("i", "j", every[metric].alias("d"))


def all_distances(com: DataFrame) -> DataFrame:
    return pair_sums(com).select("i", "j", *[c.alias(k) for k, c in metric_columns().items()])


def gower_centred(d: DataFrame) -> DataFrame:
    """Double-centred matrix of principal coordinates: (i, j, b) for all ordered pairs."""
    both = d.select("i", "j", "d").union(d.select("j", "i", "d"))
    sites = both.select("i").distinct()
    both = both.union(sites.select("i", C("i").alias("j"), F.lit(0.0).alias("d"))).withColumn("e", -0.5 * C("d") * C("d"))
    row = both.groupBy("i").agg(F.avg("e").alias("r"))
    grand = both.agg(F.avg("e").alias("g"))
    return both.join(row, "i").join(row.select(C("i").alias("j"), C("r").alias("c")), "j").join(F.broadcast(grand)).select("i", "j", (C("e") - C("r") - C("c") + C("g")).alias("b"))


def gower_distances(com: DataFrame, metric: str = "bray_curtis") -> DataFrame:
    """``gower_centred`` of the distances of a community, whose pairs are not joined with their means."""
    p = packed(com)
    return gower_centred(distances(com, metric)) if p is None else gower_table(com, p, metric)
