"""Functional and phylogenetic diversity of communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.session import parallelism

C = F.col


def weights(com: DataFrame, species: DataFrame) -> DataFrame:
    """(site, species, w): relative abundances among the species that have traits."""
    kept = com.join(species.select("species").distinct(), "species", "left_semi")
    return kept.withColumn("w", C("abundance") / F.sum("abundance").over(Window.partitionBy("site"))).drop("abundance")


def community_weighted_means(com: DataFrame, traits: DataFrame) -> DataFrame:
    """(site, trait, cwm) of long traits (species, trait, value); a missing value counts as the mean of the site's species that have it."""
    t = traits.where(C("value").isNotNull() & ~F.isnan("value"))
    w = weights(com, traits)
    grid = w.join(traits.select("species", "trait").distinct(), "species").join(t, ["species", "trait"], "left")
    return grid.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("site", "trait")))).groupBy("site", "trait").agg(F.sum(C("w") * C("value")).alias("cwm"))


def standardised(traits: DataFrame, names: list[str]) -> DataFrame:
    """Wide traits with missing values as the column's mean, then z-scores over the population deviation (0 counts as 1)."""
    ok = {n: F.when(~F.isnan(C(n).cast("double")), C(n).cast("double")) for n in names}
    traits = traits.where("species is not null")
    stats = traits.agg(*[F.avg(ok[n]).alias(f"m_{n}") for n in names])
    filled = traits.join(F.broadcast(stats)).select("species", *[F.coalesce(ok[n], C(f"m_{n}")).alias(n) for n in names])
    sd = filled.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    return filled.join(F.broadcast(sd)).select("species", *[((C(n) - C(f"m_{n}")) / F.when(C(f"s_{n}") > 0, C(f"s_{n}")).otherwise(1.0)).alias(n) for n in names])


def trait_distances(z: DataFrame, names: list[str]) -> DataFrame:
    a, b = (z.select(C("species").alias(k), *[C(n).alias(f"{k}_{n}") for n in names]) for k in "ij")
    return a.join(b, C("i") < C("j")).select("i", "j", F.sqrt(sum(((C(f"i_{n}") - C(f"j_{n}")) ** 2 for n in names), F.lit(0.0))).alias("d"))


def hull_volume(x: np.ndarray) -> float:
    """Volume (area, length) of the convex hull of points in up to three dimensions; flat sets have 0."""
    x = np.unique(np.asarray(x, float), axis=0)
    if not len(x) or x.shape[1] == 0:
        return 0.0
    if x.shape[1] == 1:
        return float(np.ptp(x))
    if x.shape[1] == 2:
        x, half = x[np.lexsort((x[:, 1], x[:, 0]))], []
        for pts in (x, x[::-1]):
            h: list = []
            for p in pts:
                while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0:
                    h.pop()
                h.append(p)
            half += h[:-1]
        r = np.array(half)
        return float(abs((r[:, 0] * np.roll(r[:, 1], -1) - r[:, 1] * np.roll(r[:, 0], -1)).sum()) / 2) if len(r) > 2 else 0.0
    x = x - x.mean(0)
    eps = 1e-10 * max(1e-300, float(np.abs(x).max())) ** 3
    a = int(x[:, 0].argmin())
    b = int(((x - x[a]) ** 2).sum(1).argmax())
    c = int((np.cross(x[b] - x[a], x - x[a]) ** 2).sum(1).argmax())
    normal = np.cross(x[b] - x[a], x[c] - x[a])
    d = int(np.abs((x - x[a]) @ normal).argmax())
    if abs((x[d] - x[a]) @ normal) <= eps:
        return 0.0
    inside = x[[a, b, c, d]].mean(0)

    def planes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(faces turned outwards, their normals, offsets)."""
        n = _cross(x[f[:, 1]] - x[f[:, 0]], x[f[:, 2]] - x[f[:, 0]])
        at = (n * x[f[:, 0]]).sum(1)
        turn = n @ inside > at
        f[turn] = f[turn][:, [0, 2, 1]]
        return f, np.where(turn[:, None], -n, n), np.where(turn, -at, at)

    faces, normals, offsets = planes(np.array([(a, b, c), (a, b, d), (a, c, d), (b, c, d)]))
    for i in range(len(x)):  # faces that see the point give way to those from their rim
        seen = normals @ x[i] - offsets > eps
        if seen.any():
            own = faces[seen]
            edges = set(map(tuple, own[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2).tolist()))
            rim = np.array([(u, v, i) for u, v in edges if (v, u) not in edges])
            f, n, o = planes(rim)
            faces, normals, offsets = np.vstack([faces[~seen], f]), np.vstack([normals[~seen], n]), np.r_[offsets[~seen], o]
    u, v, w = (x[faces[:, k]] - inside for k in range(3))
    return float(np.abs((u * _cross(v, w)).sum(1)).sum() / 6)


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack([u[:, 1] * v[:, 2] - u[:, 2] * v[:, 1], u[:, 2] * v[:, 0] - u[:, 0] * v[:, 2], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]], 1)


def _per_site(com: DataFrame, names: list, kernel, schema: str) -> DataFrame:
    """Rows of ``kernel(indices of the site's species, their abundances)`` for every site, over the species ``names``."""
    at = com.sparkSession.sparkContext.broadcast({s: k for k, s in enumerate(names)})
    kind = com.schema["site"].dataType.simpleString()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for site, m in zip(b["site"], b["m"]):
                pairs = sorted((at.value[s], v) for s, v in (m.items() if isinstance(m, dict) else m) if s in at.value)
                if pairs:
                    row = kernel(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float))
                    if row is not None:
                        out.append((site, *row))
            yield pd.DataFrame(out, columns=["site", *[c.split()[0] for c in schema.split(", ")]])

    rows = com.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("species", "abundance"))).alias("m"))
    return rows.repartition(parallelism(com.sparkSession), "site").mapInPandas(go, f"site {kind}, {schema}")  # the kernels cost more than their bytes tell


def _few(names: DataFrame, most: int = 2_000) -> list:
    """The species as a sorted list; a matrix of theirs goes to all tasks, so more than ``most`` are an error."""
    found = [r[0] for r in names.select("species").distinct().orderBy("species").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} species")
    return found


def functional_diversity(com: DataFrame, traits: DataFrame, names: list[str]) -> DataFrame:
    """(site, fdis, fdiv, raoq, feve, fric) over the species that have traits (2,000 at most, standardised over all of them).

    fdis: weighted distance to the weighted centroid; fdiv: weighted deviation
    from that mean, over it; raoq: both orders of each pair; feve: from the
    distances to the nearest species times their weights; fric: volume of the
    hull of the first three principal axes for sites of more species than
    traits, else the product of the ranges.
    """
    z = standardised(traits, names)
    here = _few(com.join(z.select("species"), "species", "left_semi"))
    table = z.join(com.select("species").distinct(), "species", "left_semi").toPandas().drop_duplicates("species").set_index("species")
    x = table.loc[here, names].to_numpy(float)
    shared = com.sparkSession.sparkContext.broadcast(x)

    def kernel(k: np.ndarray, a: np.ndarray) -> tuple:
        t, w = shared.value[k], a / a.sum()
        gap = np.sqrt(((t - w @ t) ** 2).sum(1))
        fdis = float(w @ gap)
        d = np.sqrt(np.maximum(((t[:, None] - t[None]) ** 2).sum(-1), 0))
        feve = 0.0
        if len(k) > 1:
            near = (d + np.where(np.eye(len(k), dtype=bool), np.inf, 0)).min(1) * w
            low = float((near.min() - near).sum())
            den = low + (len(k) - 1) * float(near.min())
            feve = low / den if den else 0.0
        if len(k) >= t.shape[1] + 1:
            c = t - t.mean(0)
            axes = np.linalg.svd(c, full_matrices=False)[2][:min(3, t.shape[1])] if len(k) > 3 else np.eye(t.shape[1])[:3]
            fric = hull_volume(c @ axes.T)
        else:
            fric = float(np.prod(np.ptp(t, 0)))
        return fdis, float(w @ np.abs(gap - fdis)) / fdis if fdis > 0 else 0.0, float(w @ d @ w), feve, fric

    return _per_site(com, here, kernel, "fdis double, fdiv double, raoq double, feve double, fric double")


def functional_beta(com: DataFrame, traits: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, d): Euclidean distances of all pairs of sites between their community-weighted means of standardised traits."""
    z = standardised(traits, names)
    long = z.select("species", F.explode(F.array(*[F.struct(F.lit(n).alias("trait"), C(n).alias("value")) for n in names])).alias("t")).select("species", "t.*")
    means = community_weighted_means(com, long)
    from phytoscape.operators.distances import distances

    low = means.groupBy("trait").agg(F.min("cwm").alias("low"))
    shifted = means.join(F.broadcast(low), "trait").select("site", C("trait").alias("species"), (C("cwm") - C("low") + 1.0).alias("abundance"))  # differences alone count
    return distances(shifted, "euclidean")


def functional_groups(traits: DataFrame, names: list[str], groups: int | None = None) -> pd.DataFrame:
    """(species, functional_group from 1): Ward linkage of standardised traits; without ``groups`` the number of 2 to 10 with the greatest mean silhouette. 2,000 species at most."""
    z = standardised(traits, names)
    here = _few(z)
    t = z.toPandas().drop_duplicates("species").set_index("species").loc[here, names].to_numpy(float)
    d = np.sqrt(((t[:, None] - t[None]) ** 2).sum(-1))
    from phytoscape.operators.clustering import cut_tree, linkage, silhouette_of

    merges = linkage(d, "ward")
    if groups is None:
        every = range(2, min(11, max(3, len(here) // 2)))
        groups = max(every, key=lambda k: (silhouette_of(d, cut_tree(merges, len(here), k)), -k))
    return pd.DataFrame({"species": here, "functional_group": cut_tree(merges, len(here), groups)})


def group_profiles(traits: DataFrame, names: list[str], groups: DataFrame) -> DataFrame:
    """(functional_group, trait, species, mean, deviation, range) of groups (species, functional_group)."""
    long = traits.unpivot("species", names, "trait", "value").where("value is not null and not isnan(value)").join(groups, "species")
    return long.groupBy("functional_group", "trait").agg(F.count("*").alias("species"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), (F.max("value") - F.min("value")).alias("range"))


def trade_offs(traits: DataFrame, names: list[str]) -> DataFrame:
    """(trait1, trait2, n, correlation, p_value, kind) of all pairs of traits with three common species or more."""
    from phytoscape.functions.statistics import t_two_sided

    ok = {n: F.when(~F.isnan(C(n).cast("double")), C(n).cast("double")) for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    both = lambda a, b, c: F.when(ok[a].isNotNull() & ok[b].isNotNull(), c)
    row = traits.agg(*[x for k, (a, b) in enumerate(pairs) for x in (F.corr(both(a, b, ok[a]), both(a, b, ok[b])).alias(f"r{k}"), F.count(both(a, b, F.lit(1))).alias(f"n{k}"))]).first()
    out = []
    for k, (a, b) in enumerate(pairs):
        n, r = row[f"n{k}"], row[f"r{k}"]
        if n < 3 or r is None or r != r:
            continue
        p = t_two_sided(r * np.sqrt((n - 2) / (1 - r * r)), n - 2) if abs(r) < 1 else 0.0
        kind = "No significant relationship" if p >= 0.05 else "Strong trade-off" if r < -0.3 else "Weak trade-off" if r < -0.1 else "Strong synergy" if r > 0.3 else "Weak synergy" if r > 0.1 else "No clear relationship"
        out.append((a, b, int(n), float(r), float(p), kind))
    return traits.sparkSession.createDataFrame(out, "trait1 string, trait2 string, n long, correlation double, p_value double, kind string")


# fixed values: traits by which a syndrome is known
SYNDROMES = {"acquisitive": ("leaf_area", "sla", "leaf_n", "leaf_p"), "conservative": ("leaf_thickness", "ldmc", "wood_density"), "size": ("plant_height", "leaf_area", "seed_mass"), "reproductive": ("seed_mass", "seed_number", "reproductive_height")}


def trait_syndromes(traits: DataFrame, names: list[str]) -> pd.DataFrame:
    """(axis, trait, loading, ratio, sign, interpretation): principal axes of standardised traits whose variance exceeds 1 or 5 % of all; traits loading beyond 0.6 carry the axis."""
    z = standardised(traits, names)
    row = z.agg(F.count("*").alias("n"), *[F.sum(C(a) * C(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]).first()
    m = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))]) / max(1, row["n"] - 1)
    lam, vec = np.linalg.eigh(m)
    order = np.argsort(-lam)
    lam, vec = lam[order], vec[:, order]
    vec = vec * np.where(vec[np.abs(vec).argmax(0), np.arange(len(names))] < 0, -1, 1)
    out = []
    for k in np.flatnonzero((lam > 1) | (lam / lam.sum() > 0.05)):
        strong = {n for n, v in zip(names, vec[:, k]) if v > 0.6}
        known = next((s for s, t in SYNDROMES.items() if len(strong & set(t)) >= 2), None)
        text = f"Likely represents {known} strategy" if known else "Syndrome interpretation unclear - manual interpretation needed"
        out += [(int(k) + 1, n, float(v), float(lam[k] / lam.sum()), "positive" if v > 0.6 else "negative" if v < -0.6 else "", text) for n, v in zip(names, vec[:, k])]
    return pd.DataFrame(out, columns=["axis", "trait", "loading", "ratio", "sign", "interpretation"])


def trait_environment(com: DataFrame, traits: DataFrame, names: list[str], env: DataFrame, variables: list[str]) -> DataFrame:
    """(trait, variable, n, r): correlation over sites of community-weighted means with environmental values."""
    means = community_weighted_means(com, traits.unpivot("species", names, "trait", "value").select("species", "trait", C("value").cast("double").alias("value")))
    e = env.unpivot("site", variables, "variable", "v").where("v is not null and not isnan(v)")
    return means.join(e, "site").groupBy("trait", "variable").agg(F.count("*").alias("n"), F.coalesce(F.corr("cwm", "v"), F.lit(0.0)).alias("r"))


def phylo_pairs(wide: DataFrame, species: str = "species", names: list[str] | None = None) -> DataFrame:
    """(i, j, dist) with i < j of a wide distance table; missing distances are left out, repeated species count with their mean."""
    names = names or [c for c in wide.columns if c != species]
    long = wide.select(C(species).alias("a"), *[C(f"`{n}`").cast("double").alias(n) for n in names]).unpivot("a", names, "b", "dist").where("a is not null and dist is not null and not isnan(dist) and a <> b")
    return long.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.avg("dist").alias("dist"))


def _matrix_of(phylo: DataFrame, com: DataFrame, most: int = 2_000) -> tuple[list, np.ndarray]:
    """Species of the community that have distances, and their matrix (NaN where none is known)."""
    here = com.select("species").distinct()
    p = phylo.join(here.toDF("i"), "i", "left_semi").join(here.toDF("j"), "j", "left_semi")
    names = _few(p.select(C("i").alias("species")).union(p.select("j")), most)
    at, t = {s: k for k, s in enumerate(names)}, p.select("i", "j", "dist").toPandas()
    m = np.full((len(names), len(names)), np.nan)
    i, j = t["i"].map(at).to_numpy(int), t["j"].map(at).to_numpy(int)
    m[i, j] = m[j, i] = t["dist"].to_numpy(float)
    return names, m


def _mpd_mntd(d: np.ndarray, a: np.ndarray) -> tuple[float, float] | None:
    """Abundance-weighted mean distance of pairs and mean distance to the nearest, over the pairs that are known."""
    known = ~np.isnan(d)
    np.fill_diagonal(known, False)
    if not known.any():
        return None
    w = np.where(known, np.outer(a, a), 0.0)
    near = np.where(known, np.nan_to_num(d), np.inf).min(1)
    return float((w * np.nan_to_num(d)).sum() / w.sum()), float(near[np.isfinite(near)].mean())


def mean_pair_distances(com: DataFrame, phylo: DataFrame) -> DataFrame:
    """(site, mpd, mntd): abundance-weighted mean distance of pairs, and unweighted mean distance to the nearest species. The matrix of the species (2,000 at most) goes to all tasks; sites without a known pair are left out."""
    names, m = _matrix_of(phylo, com)
    shared = com.sparkSession.sparkContext.broadcast(m)
    return _per_site(com, names, lambda k, a: _mpd_mntd(shared.value[np.ix_(k, k)], a), "mpd double, mntd double")


def _orders(size: int, draws: int, seed: int) -> np.ndarray:
    """Random orders of the pool, one a row."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(size) for _ in range(draws)]) if draws else np.zeros((0, size), int)


def _nearest(d: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Mean distance to the nearest species over the known pairs of every pick; NaN without one."""
    out = np.full(len(picks), np.nan)
    for r, k in enumerate(picks):
        x = d[np.ix_(k, k)].copy()
        np.fill_diagonal(x, np.nan)
        near = np.where(np.isnan(x), np.inf, x).min(1, initial=np.inf)
        if np.isfinite(near).any():
            out[r] = near[np.isfinite(near)].mean()
    return out


def phylogenetic_nulls(com: DataFrame, phylo: DataFrame, draws: int = 999, seed: int = 42) -> DataFrame:
    """(site, mpd, mpd_mean, mpd_sd, nri, mpd_p, mntd, mntd_mean, mntd_sd, nti, mntd_p): against ``draws`` communities of as many species of the pool, drawn at random.

    nri and nti are minus the standardised effect sizes; p is the share of draws
    (and the community itself) as low or lower. A draw is an order of the whole
    pool, the same for all sites, of which a site takes as many as it has
    species: sums over pairs of all sites of a richness are one product.
    """
    names, m = _matrix_of(phylo, com)
    order = _orders(len(m), draws, seed)
    shared = com.sparkSession.sparkContext.broadcast((m, order, {s: k for k, s in enumerate(names)}))
    schema = "mpd double, mpd_mean double, mpd_sd double, nri double, mpd_p double, mntd double, mntd_mean double, mntd_sd double, nti double, mntd_p double"
    columns = [c.split()[0] for c in schema.split(", ")]

    def effect(seen: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Columns of one measure of the sites; ``null`` has their draws as rows, NaN where a draw has no known pair."""
        known = ~np.isnan(null)
        n = known.sum(1)
        null = np.where(known, null, 0.0)
        mean = np.where(n > 0, null.sum(1) / np.maximum(n, 1), seen)
        sd = np.sqrt((np.where(known, null - mean[:, None], 0.0) ** 2).sum(1) / np.maximum(n, 1))
        low = (known & (null <= seen[:, None] + 1e-12 * np.abs(seen[:, None]))).sum(1)
        return np.stack([seen, mean, sd, np.where(sd > 1e-12 * np.abs(mean), (mean - seen) / np.where(sd > 0, sd, 1), 0.0), (low + 1) / (n + 1)], 1)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, order, at = shared.value
        near: dict = {}
        for b in batches:
            by: dict = {}
            for site, e in zip(b["site"], b["m"]):
                pairs = sorted((at[s], v) for s, v in (e.items() if isinstance(e, dict) else e) if s in at)
                if pairs:
                    k, a = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
                    seen = _mpd_mntd(d[np.ix_(k, k)], a)
                    if seen is not None:
                        by.setdefault(len(k), []).append((site, a, *seen))
            for s, rows in by.items():
                i, j = np.triu_indices(s, 1)
                if s not in near:
                    near[s] = _nearest(d, order[:, :s])
                for lo in range(0, len(rows), 512):
                    part = rows[lo:lo + 512]
                    a = np.stack([r[1] for r in part])
                    top, low = np.zeros((len(part), len(order))), np.zeros((len(part), len(order)))
                    step = max(1, 4_000_000 // max(1, len(order)))
                    for q in range(0, len(i), step):
                        u, v = i[q:q + step], j[q:q + step]
                        w, x = a[:, u] * a[:, v], d[order[:, u], order[:, v]]
                        top += w @ np.nan_to_num(x).T
                        low += w @ (~np.isnan(x)).astype(float).T
                    mpd = np.divide(top, low, out=np.full(top.shape, np.nan), where=low > 0)
                    out = np.concatenate([effect(np.array([r[2] for r in part]), mpd), effect(np.array([r[3] for r in part]), np.broadcast_to(near[s], top.shape))], 1)
                    yield pd.DataFrame({"site": [r[0] for r in part], **dict(zip(columns, out.T))})

    kind = com.schema["site"].dataType.simpleString()
    rows = com.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("species", "abundance"))).alias("m"))
    return rows.repartition(parallelism(com.sparkSession), "site").mapInPandas(go, f"site {kind}, {schema}")


def tree_length(com: DataFrame, phylo: DataFrame) -> DataFrame:
    """(site, pd): length of the minimum spanning tree over the distances of the site's species; distances of 0 are no edges.

    The species pool, not the number of sites, bounds the distance table, which
    goes to all tasks only if it has at most a million pairs.
    """
    n = phylo.count()
    if n > 1_000_000:
        raise ValueError(f"{n} pairs of species are too many for one task")
    shared = com.sparkSession.sparkContext.broadcast(phylo.select("i", "j", "dist").toPandas())

    def prim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        names = {s: k for k, s in enumerate(sorted(set(t["i"]) | set(t["j"])))}
        m = np.full((len(names), len(names)), np.inf)
        a, b = t["i"].map(names).to_numpy(int), t["j"].map(names).to_numpy(int)
        v = np.where(t["dist"].to_numpy() > 0, t["dist"].to_numpy(), np.inf)
        m[a, b] = m[b, a] = v
        for batch in batches:
            out = []
            for site, species in zip(batch["site"], batch["species"]):
                k = np.array([names[s] for s in species if s in names], int)
                total = 0.0
                if len(k):
                    best, left = m[k[0], k].copy(), np.ones(len(k), bool)
                    left[0] = False
                    while left.any():
                        j = int(np.where(left, best, np.inf).argmin())
                        if not left[j] or not np.isfinite(best[j]):
                            j = int(np.flatnonzero(left)[0])
                        else:
                            total += best[j]
                        left[j] = False
                        best = np.minimum(best, m[k[j], k])
                out.append((site, total))
            yield pd.DataFrame(out, columns=["site", "pd"])

    kind = com.schema["site"].dataType.simpleString()
    return com.groupBy("site").agg(F.sort_array(F.collect_set("species")).alias("species")).repartition(parallelism(com.sparkSession), "site").mapInPandas(prim, f"site {kind}, pd double")


def species_optima(com: DataFrame, env: DataFrame, value: str) -> DataFrame:
    """(species, optimum, tolerance): abundance-weighted mean and deviation of an environmental value."""
    j = com.join(env.select("site", C(value).alias("v")), "site").where("v is not null")
    m = j.groupBy("species").agg((F.sum(C("abundance") * C("v")) / F.sum("abundance")).alias("optimum"), (F.sum(C("abundance") * C("v") * C("v")) / F.sum("abundance")).alias("q"))
    return m.select("species", "optimum", F.sqrt(F.greatest(C("q") - C("optimum") ** 2, F.lit(0.0))).alias("tolerance"))
