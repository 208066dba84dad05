"""Co-occurrence networks of species and patterns of community assembly."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.operators.association import associations, cooccurrence_network
from phytoscape.operators.graph import components

C = F.col
MOST_NODES = 2_000


def network(com: DataFrame, method: str = "correlation", threshold: float = 0.5) -> DataFrame:
    """(i, j, weight, edge): association of all pairs of species, by correlation of abundances or Jaccard index of presences, and whether it reaches the threshold."""
    if method == "correlation":
        return cooccurrence_network(com, threshold).select("i", "j", C("r").alias("weight"), "edge")
    if method == "jaccard":
        return associations(com).select("i", "j", C("jaccard").alias("weight"), (C("jaccard") >= threshold).alias("edge"))
    raise ValueError(f"Unknown method: {method}")


def degrees(net: DataFrame) -> DataFrame:
    """(species, degree, triangles, clustering): local clustering is triangles over pairs of neighbours, 0 below two."""
    nodes = net.select(C("i").alias("species")).union(net.select("j")).distinct()
    e = net.where("edge").select("i", "j")
    both = e.union(e.select("j", "i")).toDF("a", "b")
    deg = both.groupBy(C("a").alias("species")).agg(F.count("*").alias("degree"))
    wedges = both.join(both.toDF("b", "c"), "b").where("a < c").join(e.toDF("a", "c"), ["a", "c"])  # closed at b
    tri = wedges.groupBy(C("b").alias("species")).agg(F.count("*").alias("triangles"))
    d = nodes.join(deg, "species", "left").join(tri, "species", "left").na.fill(0, ["degree", "triangles"])
    return d.withColumn("clustering", F.when(C("degree") > 1, 2.0 * C("triangles") / (C("degree") * (C("degree") - 1))).otherwise(0.0))


def properties(net: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density, mean_degree, clustering_coefficient, n_components, largest_component."""
    d = degrees(net)
    s = d.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.avg("clustering").alias("clustering_coefficient"))
    roots = d.select("species").join(components(net.where("edge").select(C("i").alias("a"), C("j").alias("b"))).toDF("species", "root"), "species", "left").select(F.coalesce("root", "species").alias("root"))
    c = roots.groupBy("root").agg(F.count("*").alias("k")).agg(F.count("*").alias("n_components"), F.max("k").alias("largest_component"))
    return s.join(c).select("n_nodes", "n_edges", F.coalesce(F.try_divide(2.0 * C("n_edges"), C("n_nodes") * (C("n_nodes") - 1)), F.lit(0.0)).alias("density"), "mean_degree", "clustering_coefficient", "n_components", "largest_component")


def _weights(net: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Species, weights and edges as matrices, of at most ``MOST_NODES`` species."""
    t = net.limit(MOST_NODES * (MOST_NODES - 1) // 2 + 1).toPandas()
    names = sorted(set(t["i"]) | set(t["j"]))
    if len(names) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} species")
    at = {s: k for k, s in enumerate(names)}
    i, j = t["i"].map(at).to_numpy(int), t["j"].map(at).to_numpy(int)
    w, e = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)), bool)
    w[i, j] = w[j, i] = t["weight"].fillna(0).to_numpy(float)
    e[i, j] = e[j, i] = t["edge"].to_numpy(bool)
    return names, w, e


def _shortest(length: np.ndarray, start: int) -> np.ndarray:
    far, todo, done = np.full(len(length), np.inf), [(0.0, start)], np.zeros(len(length), bool)
    far[start] = 0.0
    while todo:
        d, u = heapq.heappop(todo)
        if done[u]:
            continue
        done[u] = True
        new = d + length[u]
        for v in np.flatnonzero((new < far) & ~done):
            far[v] = new[v]
            heapq.heappush(todo, (new[v], v))
    return far


def centralities(net: DataFrame) -> tuple[pd.DataFrame, dict[str, float]]:
    """(species, betweenness, eigenvector; average path over all pairs weighted by 1 / |association|, and average number of edges where the network is connected, else inf). 2,000 species at most."""
    names, w, e = _weights(net)
    n = len(names)
    length = np.where(np.eye(n, dtype=bool), np.inf, 1 / (np.abs(w) + 1e-10))
    paths = np.array([_shortest(length, k) for k in range(n)])
    between, hops = np.zeros(n), np.full((n, n), np.inf)
    near = [np.flatnonzero(r) for r in e]
    for s in range(n):  # shortest paths are counted outwards and credited inwards
        dist, sigma, order, before = np.full(n, -1), np.zeros(n), [], [[] for _ in range(n)]
        dist[s], sigma[s], todo = 0, 1, [s]
        for v in todo:
            order.append(v)
            for u in near[v]:
                if dist[u] < 0:
                    dist[u] = dist[v] + 1
                    todo.append(u)
                if dist[u] == dist[v] + 1:
                    sigma[u] += sigma[v]
                    before[u].append(v)
        hops[s, dist >= 0] = dist[dist >= 0]
        credit = np.zeros(n)
        for u in reversed(order):
            for v in before[u]:
                credit[v] += sigma[v] / sigma[u] * (1 + credit[u])
            if u != s:
                between[u] += credit[u]
    x = np.full(n, 1 / np.sqrt(max(1, n)))
    a = np.where(e, np.abs(w), 0) + np.eye(n)
    for _ in range(1_000):
        y = a @ x
        y /= np.linalg.norm(y) or 1.0
        if np.abs(y - x).sum() < n * 1e-6:
            break
        x = y
    off = ~np.eye(n, dtype=bool)
    known = paths[off & np.isfinite(paths) & (paths > 0)]
    scale = (n - 1) * (n - 2)
    return pd.DataFrame({"species": names, "betweenness": between / scale if scale > 0 else between, "eigenvector": x}), {"average_path": float(known.mean()) if len(known) else float("inf"), "average_hops": float(hops[off].mean()) if n > 1 else 0.0}


def taxonomic_patterns(com: DataFrame) -> DataFrame:
    """(site, richness, evenness); richness is the site's total abundance, as the measure is defined here."""
    p = com.withColumn("n", F.sum("abundance").over(Window.partitionBy("site"))).withColumn("p", C("abundance") / C("n"))
    s = p.groupBy("site").agg(F.first("n").alias("richness"), F.count("*").alias("s"), (-F.sum(C("p") * F.log("p"))).alias("h"))
    return s.select("site", "richness", F.when(C("s") > 1, C("h") / F.log("s")).otherwise(0.0).alias("evenness"))


def trait_patterns(com: DataFrame, traits: DataFrame) -> DataFrame:
    """(site, trait, cwm, variance): weighted means and variances of long traits (species, trait, value); a missing value counts as the mean of the site's species that have it."""
    t = traits.where(C("value").isNotNull() & ~F.isnan("value"))
    kept = com.join(traits.select("species").distinct(), "species", "left_semi")
    w = kept.withColumn("w", C("abundance") / F.sum("abundance").over(Window.partitionBy("site"))).drop("abundance")
    g = w.join(traits.select("species", "trait").distinct(), "species").join(t, ["species", "trait"], "left")
    g = g.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("site", "trait"))))
    g = g.withColumn("m", F.sum(C("w") * C("value")).over(Window.partitionBy("site", "trait")))
    return g.groupBy("site", "trait").agg(F.first("m").alias("cwm"), F.sum(C("w") * (C("value") - C("m")) ** 2).alias("variance"))


def assembly(com: DataFrame, traits: DataFrame | None = None, phylo: DataFrame | None = None, draws: int = 999) -> DataFrame:
    """(pattern, value, interpretation) of richness (variation), traits (variation of community means) and phylogeny (mean net relatedness)."""
    t = taxonomic_patterns(com).agg(F.try_divide(F.stddev_samp("richness"), F.avg("richness")).alias("value"))
    out = t.select(F.lit("richness").alias("pattern"), "value", F.when(C("value") > 0.5, "High variation in species richness suggests environmental filtering").otherwise("Low variation in species richness suggests neutral assembly").alias("interpretation"))
    if traits is not None:
        c = trait_patterns(com, traits).groupBy("trait").agg(F.try_divide(F.stddev_samp("cwm"), F.avg("cwm")).alias("value"))
        out = out.union(c.select(F.concat(F.lit("trait "), "trait"), "value", F.when(C("value") > 0.3, "High variation suggests environmental filtering on this trait").otherwise("Low trait variation suggests weak environmental filtering")))
    if phylo is not None:
        from phytoscape.operators.traits import phylogenetic_nulls

        p = phylogenetic_nulls(com, phylo, draws).agg(F.avg("nri").alias("value"))
        out = out.union(p.select(F.lit("phylogeny"), "value", F.when(C("value") > 1.96, "Phylogenetic clustering suggests environmental filtering").when(C("value") < -1.96, "Phylogenetic overdispersion suggests competitive exclusion").otherwise("Random phylogenetic pattern suggests neutral assembly")))
    return out
