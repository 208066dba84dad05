"""Nestedness, species associations, metacommunity structure and group tests on long communities and pair tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.community import dense
from phytoscape.operators import distances as D
from phytoscape.operators.distances import pair_sums
from phytoscape.operators import sitepairs as B
from phytoscape.session import materialise, parallelism, tasks_for

C = F.col


def presence(com: DataFrame, threshold: float = 0.0) -> DataFrame:
    return com.where(C("abundance") > threshold).select("site", "species")


def _pairs(pa: DataFrame, unit: str, over: str) -> DataFrame:
    """All pairs i < j of ``unit`` with occurrences ni, nj and joint occurrences a over ``over``."""
    t = pa.groupBy(unit).agg(F.count("*").alias("n"))
    all_ = t.select(C(unit).alias("i"), C("n").alias("ni")).join(t.select(C(unit).alias("j"), C("n").alias("nj")), C("i") < C("j"))
    x, y = pa.select(C(unit).alias("i"), over), pa.select(C(unit).alias("j"), over)
    joint = x.join(y, over).where("i < j").groupBy("i", "j").agg(F.count("*").alias("a"))
    return all_.join(joint, ["i", "j"], "left").na.fill(0, ["a"])


def species_pairs(com: DataFrame) -> DataFrame:
    return _pairs(presence(com), "species", "site")


def site_pairs(com: DataFrame) -> DataFrame:
    one = presence(com).withColumn("abundance", F.lit(1.0))
    return pair_sums(one, ("a",)).select("i", "j", C("si").alias("ni"), C("sj").alias("nj"), C("a").cast("bigint").alias("a"))


def _richness(com: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, sites): sites of each richness; (species, s, c): in how many of them a species occurs. All that sums over pairs of sites need."""
    rich = com.groupBy("site").agg(F.count("*").cast("double").alias("s"))
    return rich.groupBy("s").agg(F.count("*").cast("double").alias("sites")), com.join(rich, "site").groupBy("species", "s").agg(F.count("*").cast("double").alias("c"))


def _totals(com: DataFrame, rich: tuple | None = None) -> DataFrame:
    """One row of sums over all pairs of sites, on presences: shared species, lesser richness, overlap of pairs of unequal richness in percent and their number.

    Pairs of one richness or two share as many species as their counts per
    species have pairs, so no pair of sites is made.
    """
    h, t = rich or _richness(com)
    none = F.lit(0.0)
    above = lambda w: w.orderBy("s").rowsBetween(1, Window.unboundedFollowing)
    h = h.withColumn("more", F.coalesce(F.sum("sites").over(above(Window.partitionBy(F.lit(1)))), none))  # a row per richness
    t = t.withColumn("more", F.coalesce(F.sum("c").over(above(Window.partitionBy("species"))), none))
    h = h.agg(F.coalesce(F.sum(C("s") * (C("sites") * (C("sites") - 1) / 2 + C("sites") * C("more"))), none).alias("lesser"), F.coalesce(F.sum(C("sites") * C("more")), none).alias("unequal"))
    return h.join(t.agg(F.coalesce(F.sum(C("c") * (C("c") - 1) / 2 + C("c") * C("more")), none).alias("shared"), F.coalesce(F.sum(100.0 * C("c") * C("more") / C("s")), none).alias("overlap")))


def _turnover(com: DataFrame) -> DataFrame:
    """One row: mean over pairs of sites of the species in one of both over the sum of their richness."""
    h, t = _richness(com)
    pairs = lambda x, y: F.when(C("s") == C("r"), C(x) * (C(x) - 1) / 2).otherwise(C(x) * C(y))
    n = h.agg(F.sum("sites").alias("n")).select((C("n") * (C("n") - 1) / 2).alias("pairs"))
    a = t.join(t.select("species", C("s").alias("r"), C("c").alias("d")), "species").where("s <= r").agg(F.coalesce(F.sum(2 * pairs("c", "d") / (C("s") + C("r"))), F.lit(0.0)).alias("same"))
    return n.join(a).select(F.try_divide(C("pairs") - C("same"), C("pairs")).alias("mean_turnover"))


def nodf(com: DataFrame) -> DataFrame:
    """One row: nodf_rows, nodf_columns, nodf. Means over the pairs whose marginals differ; no such pair gives 0."""
    com = materialise(com)  # read once, not for each of both sides
    return _nodf(_totals(com), species_pairs(com))


def _nodf(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    v = F.when(C("ni") != C("nj"), 100.0 * C("a") / F.least("ni", "nj"))
    r = totals.select(C("overlap").alias("rt"), C("unequal").alias("rn"))
    c = pairs.agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("ct"), F.count(v).alias("cn"))
    mean = lambda t, n: F.coalesce(F.try_divide(t, n), F.lit(0.0))
    return r.join(c).select(mean(C("rt"), C("rn")).alias("nodf_rows"), mean(C("ct"), C("cn")).alias("nodf_columns"), mean(C("rt") + C("ct"), C("rn") + C("cn")).alias("nodf"))


def c_score(com: DataFrame) -> DataFrame:
    return _c_score(species_pairs(com))


def _c_score(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((C("ni") - C("a")) * (C("nj") - C("a"))).alias("c_score"))


def togetherness(com: DataFrame) -> DataFrame:
    return _togetherness(species_pairs(com))


def _togetherness(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(C("a") / (C("ni") + C("nj") - C("a"))).alias("togetherness"))


def wine(com: DataFrame) -> DataFrame:
    """Joint occurrences over the smaller marginals, summed over all pairs of sites and of species, in percent."""
    return _wine(_totals(com), species_pairs(com))


def _wine(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    c = pairs.agg(F.sum("a").alias("ca"), F.sum(F.least("ni", "nj")).alias("cl"))
    return totals.join(c).select((100.0 * (C("shared") + C("ca")) / (C("lesser") + C("cl"))).alias("wine"))


def packed(com: DataFrame) -> DataFrame:
    """(site, species, present, r, c): the grid with rows and columns ranked by totals, greatest first (ties: name)."""
    pa = com.withColumn("abundance", F.lit(1.0))
    rows = pa.groupBy("site").agg(F.count("*").alias("t")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("t"), "site"))).drop("t")
    cols = pa.groupBy("species").agg(F.count("*").alias("t")).withColumn("c", F.row_number().over(Window.orderBy(F.desc("t"), "species"))).drop("t")
    return dense(pa).join(rows, "site").join(cols, "species").select("site", "species", C("abundance").cast("int").alias("present"), "r", "c")


def temperature(com: DataFrame) -> DataFrame:
    """Share of unexpected comparisons: absences with a presence, and presences with an absence, strictly below and right of them."""
    g = packed(com)
    g = g.withColumn("z", 1 - C("present"))
    below = Window.partitionBy("c").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("r").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    for k in ("present", "z"):
        g = g.withColumn(f"_{k}", F.coalesce(F.sum(k).over(below), F.lit(0)))
    for k in ("present", "z"):
        g = g.withColumn(f"{k}_after", F.coalesce(F.sum(f"_{k}").over(right), F.lit(0)))
    size = g.agg(F.max("r").alias("m"), F.max("c").alias("k"))
    tot = g.agg(F.sum(F.when(C("z") == 1, C("present_after")).otherwise(0)).alias("up"), F.sum(F.when(C("present") == 1, C("z_after")).otherwise(0)).alias("down"))
    pairs = g.join(F.broadcast(size)).agg(F.sum((C("m") - C("r") + 1) * (C("k") - C("c") + 1) - 1).alias("total"))
    return tot.join(pairs).select(F.coalesce(F.try_divide(100.0 * (C("up") + C("down")), C("total")), F.lit(0.0)).alias("temperature"))


ROW_SPECIES = 500


def nestedness(com: DataFrame) -> DataFrame:
    """One row: nodf and its parts, temperature, c_score, togetherness and wine. The community is read once.

    Up to ``ROW_SPECIES`` species a site is one row of numbers of its species in
    order of the sites' ranks; all measures are sums over these rows.
    """
    spark = com.sparkSession
    names = sorted(r[0] for r in com.select("species").distinct().limit(ROW_SPECIES + 1).collect())
    if not 0 < len(names) <= ROW_SPECIES:
        return nodf(com).join(temperature(com)).join(c_score(com)).join(togetherness(com)).join(wine(com))
    at = spark.createDataFrame([(n, k) for k, n in enumerate(names)], f"species {com.schema['species'].dataType.simpleString()}, k smallint")
    own = presence(com).join(F.broadcast(at), "species").groupBy("site").agg(F.collect_list("k").alias("own")).withColumn("s", F.size("own"))
    rows = materialise(own.repartitionByRange(parallelism(spark), F.desc("s"), "site").sortWithinPartitions(F.desc("s"), "site").select("s", "own", F.spark_partition_id().alias("part")))
    long = rows.select("part", "s", F.explode("own").alias("k"))
    t = rows.groupBy("s").agg(F.count("*").cast("double").alias("sites")), long.groupBy(C("k").alias("species"), C("s").cast("double").alias("s")).agg(F.count("*").cast("double").alias("c"))
    totals = materialise(_totals(com, (t[0].withColumn("s", C("s").cast("double")), t[1])))
    n, both, unexpected = _row_sums(rows, long, len(names))
    pairs = [(names[i], names[j], int(n[i]), int(n[j]), int(both[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    pairs = spark.createDataFrame(pairs, f"i {at.schema['species'].dataType.simpleString()}, j {at.schema['species'].dataType.simpleString()}, ni bigint, nj bigint, a bigint")
    m, k = sum(r["sites"] for r in t[0].collect()), len(names)
    every = m * (m + 1) / 2 * k * (k + 1) / 2 - m * k
    heat = spark.createDataFrame([(100.0 * unexpected / every if every > 0 else 0.0,)], "temperature double")
    return _nodf(totals, pairs).join(heat).join(_c_score(pairs)).join(_togetherness(pairs)).join(_wine(totals, pairs))


def _row_sums(rows: DataFrame, long: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sites of each species, of each two species, unexpected comparisons of the grid) of ranked rows (s, own, part)."""
    spark, parts = rows.sparkSession, {}
    for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect():
        parts[r["part"]] = np.zeros(k + 1, np.int64)
        parts[r["part"]][k] = r["n"]
    for r in long.groupBy("part", "k").agg(F.count("*").alias("n")).collect():
        parts[r["part"]][r["k"]] = r["n"]
    held, before = np.zeros(k + 1, np.int64), {}
    for q in sorted(parts):
        before[q] = held
        held = held + parts[q]
    order = np.lexsort((np.arange(k), -held[:k]))  # columns by totals, ties by name
    shared = spark.sparkContext.broadcast((before, held, order))

    def sums(batches):
        before, every, order = shared.value
        both, up, last, seen = np.zeros((k, k)), 0, None, None
        step = max(1, 1_000_000 // k)
        for b in batches:
            for part, g in b.groupby("part", sort=False):
                if part != last:
                    last, seen = part, before[part].copy()
                for lo in range(0, len(g), step):
                    own = g["own"].iloc[lo:lo + step].to_list()
                    x = np.zeros((len(own), k), np.int64)
                    x[np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate(own)] = 1
                    both += x.astype(float).T @ x.astype(float)
                    x = x[:, order]
                    below = every[order] - seen[order] - np.cumsum(x, 0)
                    rest = (every[k] - seen[k] - 1 - np.arange(len(x)))[:, None] - below
                    after = lambda v: np.cumsum(v[:, ::-1], 1)[:, ::-1] - v
                    up += int(((1 - x) * after(below) + x * after(rest)).sum())
                    seen[order] += x.sum(0)
                    seen[k] += len(x)
        i, j = np.nonzero(both)
        yield pd.DataFrame({"i": np.r_[-1, i], "j": np.r_[-1, j], "v": np.r_[up, both[i, j].astype(np.int64)]})

    t = rows.mapInPandas(sums, "i int, j int, v long").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    both, pair = np.zeros((k, k), np.int64), t[t["i"] >= 0]
    both[pair["i"], pair["j"]] = pair["v"]
    return held[:k], both, int(t.loc[t["i"] < 0, "v"].sum())


def associations(com: DataFrame) -> DataFrame:
    """(i, j, jaccard, ochiai, dice) of species on presences."""
    a, x, y = C("a"), C("ni"), C("nj")
    return species_pairs(com).select("i", "j", (a / (x + y - a)).alias("jaccard"), (a / F.sqrt(x * y)).alias("ochiai"), (2 * a / (x + y)).alias("dice"))


def checkerboard(com: DataFrame) -> DataFrame:
    """(i, j, units, both, only_i, only_j, absent) of species."""
    n = com.agg(F.countDistinct("site").alias("sites"))
    return species_pairs(com).join(F.broadcast(n)).select("i", "j", ((C("ni") - C("a")) * (C("nj") - C("a"))).alias("units"), C("a").alias("both"), (C("ni") - C("a")).alias("only_i"), (C("nj") - C("a")).alias("only_j"), (C("sites") - C("ni") - C("nj") + C("a")).alias("absent"))


def metacommunity(com: DataFrame) -> DataFrame:
    """One row: coherence, turnover, mean_turnover, boundary_clumping and the structure they are classed as.

    Sites are ranked by richness (ties: name); absences between the first and
    the last presence of a species are embedded.
    """
    rich = com.groupBy("site").agg(F.count("*").alias("s"))
    rank = rich.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "site")))
    span = com.join(rank, "site").groupBy("species").agg((F.max("r") - F.min("r") + 1).alias("len"), F.count("*").alias("occ"))
    coh = span.agg(F.sum(C("len") - C("occ")).alias("emb"), F.sum(F.when(C("occ") > 1, C("len")).otherwise(0)).alias("possible"), F.avg(C("len") / C("occ")).alias("boundary_clumping"))
    beta = rich.agg(F.avg("s").alias("al")).join(com.agg(F.countDistinct("species").alias("ga"))).select((C("ga") / C("al") - 1).alias("turnover"))
    out = coh.join(beta).join(_turnover(com)).select(F.coalesce(1 - F.try_divide("emb", "possible"), F.lit(1.0)).alias("coherence"), "turnover", "mean_turnover", "boundary_clumping")
    coherent, far, clumped = C("coherence") > 0.5, C("turnover") > 1.5, C("boundary_clumping") < 0.5
    return out.withColumn("structure", F.when(~coherent, "random").when(~far, "nested").when(~clumped, "evenly_spaced").otherwise("clumped"))


def cooccurrence_network(com: DataFrame, threshold: float = 0.5, n_sites: int | None = None) -> DataFrame:
    """(i, j, r, edge): Pearson correlation of species over all sites (absences are zeros) and whether |r| reaches the threshold."""
    n = com.agg(F.countDistinct("site").alias("n")) if n_sites is None else com.sparkSession.range(1).select(F.lit(n_sites).alias("n"))
    t = com.groupBy("species").agg(F.sum("abundance").alias("s"), F.sum(C("abundance") * C("abundance")).alias("q"))
    x, y = (com.select("site", C("species").alias(k), C("abundance").alias(f"x{k}")) for k in "ij")
    cross = x.join(y, "site").where("i < j").groupBy("i", "j").agg(F.sum(C("xi") * C("xj")).alias("xy"))
    a, b = (t.select(C("species").alias(k), C("s").alias(f"s{k}"), C("q").alias(f"q{k}")) for k in "ij")
    p = a.join(b, C("i") < C("j")).join(cross, ["i", "j"], "left").na.fill(0, ["xy"]).join(F.broadcast(n))
    var = (C("n") * C("qi") - C("si") * C("si")) * (C("n") * C("qj") - C("sj") * C("sj"))
    r = F.when(var > 0, (C("n") * C("xy") - C("si") * C("sj")) / F.sqrt(var))
    return p.select("i", "j", r.alias("r")).withColumn("edge", F.coalesce(F.abs("r") >= threshold, F.lit(False)))


def indicator_values(com: DataFrame, groups: DataFrame) -> DataFrame:
    """(species, grp, indval): abundance share in the group times presence frequency in it, in percent; groups: (site, grp)."""
    size = groups.groupBy("grp").agg(F.count("*").alias("sites"))
    inside = com.join(groups, "site").groupBy("species", "grp").agg(F.sum("abundance").alias("x"), F.count("*").alias("k"))
    total = inside.withColumn("t", F.sum("x").over(Window.partitionBy("species")))
    return total.join(size, "grp").select("species", "grp", (100.0 * C("x") / C("t") * C("k") / C("sites")).alias("indval"))


def _packed_simper(com: DataFrame, groups: DataFrame, p, names: list, within: bool) -> DataFrame:
    g = groups.dropna().dropDuplicates(["site"]).toPandas().set_index("site")["grp"].reindex(p.site)
    keep = g.notna().to_numpy()
    if not keep.all():  # groups without a name
        p = B.Packed(p.site[keep], p.x[keep])
        g = g.reindex(p.site)
    code, grp = pd.factorize(g, sort=True)
    t = B.simper_sums(com.sparkSession, p, code, within)
    kind, gkind = com.schema["species"].dataType.simpleString(), groups.schema["grp"].dataType
    as_g = str if gkind.simpleString() == "string" else int if "int" in gkind.simpleString() else lambda v: v
    rows = [(as_g(grp[a]), as_g(grp[b]), names[k], float(v / m)) for a, b, k, v, m in t.itertuples(index=False)]
    return com.sparkSession.createDataFrame(rows, f"g1 {gkind.simpleString()}, g2 {gkind.simpleString()}, species {kind}, contribution double")


def simper(com: DataFrame, groups: DataFrame, within: bool = True) -> DataFrame:
    """(g1, g2, species, contribution): mean over pairs of sites of |a - b| / (all individuals of both), g1 <= g2 (equal: within the group).

    Pairs are summed in the tasks that hold both blocks of sites. Up to 2,000
    species (more is an error); sites without group are left out.
    """
    names = D._few_species(com)
    if names is None:
        raise ValueError(f"more than {D.MOST_SPECIES} species")
    known = com.join(groups.select("site"), "site", "left_semi")
    p = B.packed(known)
    if p is not None:
        return _packed_simper(known, groups, p, names, within)
    blocks = D._site_blocks(known).join(groups.select("site", C("grp").alias("g")), "site")
    kind, gkind = com.schema["species"].dataType.simpleString(), groups.schema["grp"].dataType.simpleString()

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("site")
        _, x, first, second, same = D._block_matrix(part, names)
        g, n = part["g"].to_numpy(), x.sum(1)
        out = []
        for p in pd.unique(g[first]):
            for q in pd.unique(g[second]):
                if same and p > q:
                    continue
                i, j = np.flatnonzero(first & (g == p)), np.flatnonzero(second & (g == q))
                w = 1 / np.maximum(n[i][:, None] + n[j][None], 1e-300)
                if same and p == q:
                    w = np.triu(w, 1)
                pairs = float((w > 0).sum())
                lo, hi = (p, q) if p <= q else (q, p)
                out += [(lo, hi, s, float((np.abs(x[i, k][:, None] - x[j, k][None]) * w).sum()), pairs) for k, s in enumerate(names)] if pairs else []
        return pd.DataFrame(out, columns=["g1", "g2", "species", "t", "pairs"])

    t = blocks.groupBy("b1", "b2").applyInPandas(solve, f"g1 {gkind}, g2 {gkind}, species {kind}, t double, pairs double")
    return t.groupBy("g1", "g2", "species").agg((F.sum("t") / F.sum("pairs")).alias("contribution"))


def simper_between(com: DataFrame, groups: DataFrame) -> DataFrame:
    """``simper`` of different groups."""
    return simper(com, groups, within=False).where("g1 < g2")


def labelled(d: DataFrame, groups: DataFrame) -> DataFrame:
    """Pair table with the groups of both sites; sites without group are left out."""
    g = groups.select("site", "grp")
    return d.join(g.toDF("i", "gi"), "i").join(g.toDF("j", "gj"), "j")


def _tests(p: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """PERMANOVA pseudo-F, ANOSIM R and MRPP delta of labelled pairs (i, j, d, rk, gi, gj), per ``by``.

    The within-group sum of squares carries the weight n_g / n, and R is scaled
    by M + 1 - mean ranks, as the measures' users expect of this library.
    """
    n = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    within = p.where("gi = gj").groupBy(*by, C("gi").alias("grp")).agg(F.sum(C("d") * C("d")).alias("ss"), F.avg("d").alias("md"))
    w = within.join(sizes.withColumnRenamed("n", "ng"), "grp").join(n).groupBy(*by).agg(F.sum(C("ng") * C("ss") / C("ng") / C("n")).alias("ssw"), F.sum(C("ng") / C("n") * C("md")).alias("delta"))
    t = p.groupBy(*by).agg(F.sum(C("d") * C("d")).alias("sq"), F.count("*").alias("m"), F.avg(F.when(C("gi") == C("gj"), C("rk"))).alias("mw"), F.avg(F.when(C("gi") != C("gj"), C("rk"))).alias("mb"))
    out = (t.join(w, by) if by else t.join(w)).join(n)
    sst = C("sq") / C("n")
    f = F.try_divide(F.try_divide(sst - C("ssw"), C("k") - 1), F.try_divide(C("ssw"), C("n") - C("k")))
    return out.select(*by, F.when((C("n") > C("k")) & (C("ssw") > 0), f).otherwise(0.0).alias("pseudo_f"), F.coalesce(F.try_divide(C("mb") - C("mw"), C("m") + 1 - C("mw") - C("mb")), F.lit(0.0)).alias("anosim_r"), C("delta").alias("mrpp_delta"))


def ranked(d: DataFrame, value: str = "d", to: str = "rk") -> DataFrame:
    """Average-tie ranks. Counts per value are sorted by ranges of the value, and each range is ranked in its own task from the counts of those before it."""
    v = d.groupBy(value).agg(F.count("*").alias("_c")).repartitionByRange(parallelism(d.sparkSession), value)
    v = materialise(v.withColumn("_p", F.spark_partition_id()))
    before = v.groupBy("_p").agg(F.sum("_c").alias("_s")).withColumn("_b", F.sum("_s").over(Window.orderBy("_p")) - C("_s"))  # one row per range
    v = v.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("_u", C("_b") + F.sum("_c").over(Window.partitionBy("_p").orderBy(value)))
    return d.join(v.select(value, "_c", "_u"), value).withColumn(to, C("_u") - (C("_c") - 1) / 2).drop("_c", "_u")


def group_tests(d: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: observed PERMANOVA pseudo-F, ANOSIM R, MRPP delta."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    return _tests(labelled(ranked(d), groups), sizes, [])


def community_group_tests(com: DataFrame, groups: DataFrame, metric: str = "bray_curtis") -> DataFrame:
    """``group_tests`` of a community by distances rounded to 12 digits, summed in the tasks that make the pairs."""
    p = B.packed(com)
    g = None if p is None else groups.select("site", "grp").toPandas().drop_duplicates("site").set_index("site")["grp"].reindex(p.site)
    if p is None or not len(g) or g.isna().any():
        return group_tests(D.distances(com, metric).withColumn("d", F.round("d", 12)), groups)
    code, _ = pd.factorize(g, sort=True)
    t = B.group_sums(com.sparkSession, p, code, metric)
    n, size, k = len(code), np.bincount(code), len(np.bincount(code))
    ssw, sst = float(t["squares"].sum()) / n, float(t["sq"]) / n
    f = (sst - ssw) / (k - 1) / (ssw / (n - k)) if n > k and k > 1 and ssw > 0 else None if n > k and ssw > 0 else 0.0
    has = t["pairs"] > 0
    delta = float((size[has] / n * t["sums"][has] / t["pairs"][has]).sum()) if has.any() else None
    m, inside = float(t["m"]), float(t["inside"])
    mw, mb = (t["ranks"] / inside if inside else None), ((m * (m + 1) / 2 - t["ranks"]) / (m - inside) if m > inside else None)
    r = 0.0 if mw is None or mb is None or m + 1 - mw - mb == 0 else (mb - mw) / (m + 1 - mw - mb)
    return com.sparkSession.createDataFrame([(f, float(r), delta)], "pseudo_f double, anosim_r double, mrpp_delta double")


#: Bytes of permuted labels (a byte per site and permutation) that go to the tasks at once.
LABEL_BYTES = 64 << 20


def _label_rounds(groups: DataFrame, permutations: int, seed: int):
    """(sites, codes of their groups, permuted codes) in rounds that fit into ``LABEL_BYTES``; the first column of the first round is as observed."""
    t = groups.select("site", "grp").dropna().dropDuplicates(["site"]).orderBy("site").toPandas()  # a row per site, of which all pairs are compared
    codes, names = pd.factorize(t["grp"], sort=True)
    if len(names) > 250:
        raise ValueError("more than 250 groups")
    rng, codes = np.random.default_rng(seed), codes.astype(np.uint8)
    step = max(1, LABEL_BYTES // max(1, len(t)))
    for lo in range(0, permutations + 1, step):
        cols = [codes if p == 0 else rng.permutation(codes) for p in range(lo, min(permutations + 1, lo + step))]
        yield t["site"].to_numpy(), codes, np.stack(cols, 1) if len(t) else np.zeros((0, len(cols)), np.uint8)


def _permuted_sums(p: DataFrame, groups: DataFrame, permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per permutation, over pairs (i, j, d, rk) within groups: sums of d², rk and d weighted by n_g over the pairs of the group; and the codes of the sites."""
    spark, out, codes = p.sparkSession, [], None
    p = materialise(p.select("i", "j", "d", "rk").repartition(parallelism(spark)))
    for sites, codes, labels in _label_rounds(groups, permutations, seed):
        n = np.bincount(codes) if len(codes) else np.zeros(1)
        weight = np.divide(n / max(1, n.sum()), n * (n - 1) / 2, out=np.zeros(len(n)), where=n > 1)
        shared = spark.sparkContext.broadcast((sites, labels, weight))

        def sums(batches, shared=shared):
            sites, labels, weight = shared.value
            total = np.zeros((3, labels.shape[1]))
            for b in batches:
                for at in range(0, len(b), 4_096):
                    c = b.iloc[at:at + 4_096]
                    i, j = np.searchsorted(sites, c["i"].to_numpy()), np.searchsorted(sites, c["j"].to_numpy())
                    a, d = labels[i], c["d"].to_numpy()
                    same = a == labels[j]
                    total[:2] += np.stack([d * d, c["rk"].to_numpy()]) @ same
                    total[2] += d @ np.where(same, weight[a], 0.0)
            yield pd.DataFrame({"k": range(3), "v": list(total)})

        t = p.mapInPandas(sums, "k int, v array<double>").groupBy("k").agg(*[F.sum(C("v")[q]).alias(f"v{q}") for q in range(labels.shape[1])]) if labels.shape[1] <= 64 else None
        if t is None:  # many columns: summed as rows
            e = p.mapInPandas(sums, "k int, v array<double>").select("k", F.posexplode("v").alias("q", "x")).groupBy("k", "q").agg(F.sum("x").alias("x")).toPandas()
            out.append(e.pivot(index="k", columns="q", values="x").sort_index().to_numpy())
        else:
            out.append(t.orderBy("k").drop("k").toPandas().to_numpy())
    return np.concatenate(out, 1), codes


def permutation_tests(d: DataFrame, groups: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """One row: the observed PERMANOVA pseudo-F, ANOSIM R and MRPP delta and their p-values (hits + 1) / (permutations + 1); MRPP counts smaller deltas.

    ``d`` has all pairs of the sites, or is a community, whose Bray-Curtis
    distances are made in the tasks and never become rows. Labels are permuted
    on the driver (a byte per site), sums over pairs are taken in the tasks for
    all permutations at once. Sites without group are left out.
    """
    known = groups.select("site", "grp").dropna().select("site")
    if "abundance" in d.columns:
        p = B.packed(d.join(known, "site", "left_semi"))
        if p is not None and len(p.site):
            return _community_permutations(d, p, groups.join(d.select("site").distinct(), "site", "left_semi"), permutations, seed)
        d = D.distances(d)
    p = ranked(d.join(known.toDF("i"), "i", "left_semi").join(known.toDF("j"), "j", "left_semi"))
    whole = p.agg(F.sum(C("d") * C("d")).alias("sq"), F.sum("rk").alias("rk"), F.count("*").alias("m")).first()
    sums, codes = _permuted_sums(p, groups, permutations, seed)
    n, size = len(codes), np.bincount(codes)
    k, inside = int((size > 0).sum()), float((size * (size - 1) / 2).sum())
    ssw, m = sums[0] / n, whole["m"]
    f = np.divide((whole["sq"] / n - ssw) / max(1, k - 1), ssw / max(1, n - k), out=np.zeros(len(ssw)), where=ssw > 0) if n > k > 1 else np.zeros(len(ssw))
    mw, mb = sums[1] / max(1.0, inside), (whole["rk"] - sums[1]) / max(1.0, m - inside)
    r = np.divide(mb - mw, m + 1 - mw - mb, out=np.zeros(len(mw)), where=m + 1 - mw - mb != 0)
    p_of = lambda hit: (int(hit.sum()) + 1) / (permutations + 1)
    row = (float(f[0]), p_of(f[1:] >= f[0] - 1e-12), float(r[0]), p_of(r[1:] >= r[0] - 1e-12), float(sums[2][0]), p_of(sums[2][1:] <= sums[2][0] + 1e-12))
    return d.sparkSession.createDataFrame([row], "pseudo_f double, permanova_p double, anosim_r double, anosim_p double, mrpp_delta double, mrpp_p double")


def _community_permutations(com: DataFrame, p: B.Packed, groups: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``permutation_tests`` of packed sites.

    The mean rank over all pairs is (m + 1) / 2, so that ANOSIM R as scaled here
    is m / (m - 2 inside) for any labels whose mean ranks within and between
    differ, by the m pairs and those inside groups alone: no ranks are made.
    Permutations keep the groups' sizes and with them R.
    """
    spark, sums, codes = com.sparkSession, [], None
    for _, codes, labels in _label_rounds(groups, permutations, seed):
        n = np.bincount(codes)
        weight = np.divide(n / n.sum(), n * (n - 1) / 2, out=np.zeros(len(n)), where=n > 1)
        sums.append(B.label_sums(spark, p, labels[p.name_rank], weight))
    s, whole = np.concatenate(sums, 1), B.value_sums(spark, p, [])
    n, size, m = len(codes), np.bincount(codes), whole[0, 0]
    k, inside = len(size), float((size * (size - 1) / 2).sum())
    ssw = s[0] / n
    f = np.divide((whole[1, 1] / n - ssw) / max(1, k - 1), ssw / max(1, n - k), out=np.zeros(len(ssw)), where=ssw > 0) if n > k > 1 else np.zeros(len(ssw))
    spread = whole[1, 1] / max(1.0, m) - (whole[0, 1] / max(1.0, m)) ** 2 > 1e-24
    r = m / (m - 2 * inside) if spread and 0 < inside < m and m != 2 * inside else 0.0
    p_of = lambda hit: (int(hit.sum()) + 1) / (permutations + 1)
    row = (float(f[0]), p_of(f[1:] >= f[0] - 1e-12), float(r), 1.0, float(s[1][0]), p_of(s[1][1:] <= s[1][0] + 1e-12))
    return spark.createDataFrame([row], "pseudo_f double, permanova_p double, anosim_r double, anosim_p double, mrpp_delta double, mrpp_p double")


def mantel_test(d1: DataFrame, d2: DataFrame, permutations: int = 999, seed: int = 42, d3: DataFrame | None = None) -> DataFrame:
    """One row: the (with ``d3``: partial) Mantel correlation and its two-sided p-value (hits + 1) / (permutations + 1), the sites of the first table permuted.

    Tables hold all pairs of at most 3,000 sites, the pairs missing in either
    are left out of all; permutations are spread over the tasks.
    """
    spark = d1.sparkSession
    p = d1.select("i", "j", C("d").alias("x")).join(d2.select("i", "j", C("d").alias("y")), ["i", "j"])
    p = p.join(d3.select("i", "j", C("d").alias("z")), ["i", "j"]) if d3 is not None else p.withColumn("z", F.lit(0.0))
    from phytoscape.operators.ordination import square

    names, x = square(p.select("i", "j", C("x").alias("d")))
    y, z = (square(p.select("i", "j", C(c).alias("d")))[1] for c in "yz")
    iu = np.triu_indices(len(names), 1)
    shared = spark.sparkContext.broadcast((x, y[iu], z[iu] if d3 is not None else None))

    def of(x: np.ndarray, y: np.ndarray, z: np.ndarray | None) -> float:
        r = lambda a, b: float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 0 and b.std() > 0 else 0.0
        if z is None:
            return r(x, y)
        den = np.sqrt((1 - r(x, z) ** 2) * (1 - r(y, z) ** 2))
        return (r(x, y) - r(x, z) * r(y, z)) / den if den > 0 else 0.0

    def draw(batches):
        x, y, z = shared.value
        iu = np.triu_indices(len(x), 1)
        for b in batches:
            v = []
            for i in b["id"]:
                o = np.random.default_rng([seed, int(i)]).permutation(len(x))
                v.append(of(x[np.ix_(o, o)][iu], y, z))
            yield pd.DataFrame({"v": v})

    seen = of(x[iu], y[iu], z[iu] if d3 is not None else None)
    t = spark.range(0, permutations, 1, parallelism(spark)).mapInPandas(draw, "v double")
    return t.agg(F.lit(seen).alias("mantel_r"), ((F.count_if(F.abs("v") >= abs(seen) - 1e-12) + 1) / (permutations + 1)).alias("p"))


def indicator_test(com: DataFrame, groups: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """(species, grp, indval, p): each species' greatest indicator value and the share of permutations of the groups that reach it, (hits + 1) / (permutations + 1).

    A block of species is a task that holds its abundances; labels of all
    sites (a byte each) go to the tasks in rounds.
    """
    best = indicator_values(com, groups).groupBy("species").agg(F.max_by(F.struct("grp", "indval"), F.struct("indval", "grp")).alias("b")).select("species", "b.grp", "b.indval")
    rows = com.join(groups.select("site"), "site", "left_semi").select("species", C("site").cast("string").alias("site"), "abundance")
    hits = None
    for sites, codes, labels in _label_rounds(groups, permutations, seed):
        shared = com.sparkSession.sparkContext.broadcast((sites.astype(str), labels, np.bincount(codes)))

        def scorer(shared):
            def score(part: pd.DataFrame) -> pd.DataFrame:
                sites, labels, size = shared.value
                order = np.argsort(sites)
                own = labels[order[np.searchsorted(sites[order], part["site"].to_numpy(str))]]
                x = part["abundance"].to_numpy()
                v = np.max([100 * ((own == g) * x[:, None]).sum(0) / x.sum() * (own == g).sum(0) / max(1, size[g]) for g in range(len(size))], 0)
                return pd.DataFrame({"species": part["species"].iloc[0], "v": [v.tolist()]})
            return score

        t = rows.groupBy("species").applyInPandas(scorer(shared), f"species {com.schema['species'].dataType.simpleString()}, v array<double>")
        t = t.join(best, "species").select("species", F.size(F.filter("v", lambda a: a >= C("indval") - 1e-9)).alias("h"))
        hits = t if hits is None else hits.union(t)
    hits = hits.groupBy("species").agg(F.sum("h").alias("h"))  # the observed labels are among them
    return best.join(hits, "species").select("species", "grp", "indval", (C("h") / (permutations + 1)).alias("p"))


MOST_KENDALL = 4_500_000


def mantel(d1: DataFrame, d2: DataFrame, method: str = "pearson") -> DataFrame:
    """One row: correlation of two pair tables (i, j, d) over their common pairs; undefined gives 0."""
    p = d1.select("i", "j", C("d").alias("x")).join(d2.select("i", "j", C("d").alias("y")), ["i", "j"])
    if method == "spearman":
        p = ranked(ranked(p, "x", "x2"), "y", "y2").select(C("x2").alias("x"), C("y2").alias("y"))
    if method == "kendall":  # by merging, on the driver: at most the pairs of 3,000 sites
        from phytoscape.functions.statistics import kendall

        t = p.select("x", "y").limit(MOST_KENDALL + 1).toPandas()
        if len(t) > MOST_KENDALL:
            raise ValueError(f"more than {MOST_KENDALL} pairs")
        return p.sparkSession.createDataFrame([(float(kendall(t["x"].to_numpy(), t["y"].to_numpy())),)], "mantel_r double")
    return p.agg(F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("mantel_r"))


def partial_mantel(d1: DataFrame, d2: DataFrame, d3: DataFrame) -> DataFrame:
    """One row: partial correlation of d1 and d2 given d3; a denominator of 0 gives 0."""
    p = d1.select("i", "j", C("d").alias("x")).join(d2.select("i", "j", C("d").alias("y")), ["i", "j"]).join(d3.select("i", "j", C("d").alias("z")), ["i", "j"])
    r = p.agg(F.corr("x", "y").alias("a"), F.corr("x", "z").alias("b"), F.corr("y", "z").alias("c"))
    den = F.sqrt((1 - C("b") * C("b")) * (1 - C("c") * C("c")))
    return r.select(F.coalesce(F.try_divide(C("a") - C("b") * C("c"), den), F.lit(0.0)).alias("partial_r"))


def _valued(com: DataFrame, values: list[DataFrame]):
    """The packed sites that have all values (site, value), the values in their order; None if they don't fit."""
    t = values[0].toDF("site", "v0")
    for k, v in enumerate(values[1:], 1):
        t = t.join(v.toDF("site", f"v{k}"), "site")
    t = t.dropna().join(com.select("site").distinct(), "site", "left_semi")
    p = B.packed(com.join(t.select("site"), "site", "left_semi"))
    if p is None:
        return None
    t = t.toPandas().set_index("site").reindex(p.site)
    return p, [t[c].to_numpy(float) for c in t.columns]


def _r(s: np.ndarray, a: int, b: int) -> float:
    """Correlation from sums of products, of which the first is a constant; no spread gives 0."""
    m = s[0, 0]
    if m < 1:
        return 0.0
    var = lambda k: s[k, k] / m - (s[0, k] / m) ** 2
    return float((s[a, b] / m - s[0, a] / m * s[0, b] / m) / np.sqrt(var(a) * var(b))) if var(a) > 0 and var(b) > 0 else 0.0


#: Draws by single precision nearer than this to the seen correlation are drawn again by doubles: above what 65,536 products may round off.
SINGLE = 3e-4


def community_spearman(com: DataFrame, values: DataFrame) -> DataFrame:
    """``mantel`` by ranks of the Bray-Curtis distances of a community, rounded to 12 digits, and of differences of values (site, value), rounded to 9.

    No pair becomes a row, unless values have more than ``MOST_LEVELS`` different differences.
    """
    spark, v = com.sparkSession, _valued(com, [values])
    levels = None if v is None else B.value_levels(v[1][0])
    if levels is None:
        one = values.toDF("site", "v").join(com.select("site").distinct(), "site", "left_semi").select("site", F.lit("v").alias("species"), (C("v") + 1000.0).alias("abundance"))
        return mantel(D.distances(com).withColumn("d", F.round("d", 12)), D.distances(one, "manhattan").withColumn("d", F.round("d", 9)), "spearman")
    p, (x,) = v
    level, rank, n = levels
    xy, xx = B.rank_products(spark, p, x, level, rank) if len(p.site) > 1 else (0.0, 0.0)
    yy = float((n * (rank - (n.sum() + 1) / 2) ** 2).sum())
    return spark.createDataFrame([(float(xy / np.sqrt(xx * yy)) if xx > 0 and yy > 0 else 0.0,)], "mantel_r double")


def community_mantel(com: DataFrame, values: list[DataFrame], metric: str = "bray_curtis", permutations: int = 0, seed: int = 42) -> DataFrame:
    """Mantel correlation (with two values: partial) of the distances of a community with differences of values (site, value), and with ``permutations`` its p-value.

    Sums are taken in the tasks that make the pairs, so no pair becomes a row and the sites are not bounded by 3,000.
    """
    spark, name = com.sparkSession, "mantel_r" if permutations or len(values) == 1 else "partial_r"
    v = _valued(com, values)
    if v is None:
        tables = [D.distances(w.select(C(w.columns[0]).alias("site"), F.lit("v").alias("species"), (C(w.columns[1]) + 1000.0).alias("abundance")), "manhattan") for w in values]
        d = D.distances(com, metric)
        if permutations:
            return mantel_test(d, tables[0], permutations, seed, tables[1] if len(tables) > 1 else None)
        return mantel(d, tables[0]) if len(values) == 1 else partial_mantel(d, *tables)
    p, x = v
    s = B.value_sums(spark, p, x, metric)
    rest = _r(s, 2, 3) if len(x) == 2 else 0.0

    def of(a, b):
        den = np.sqrt((1 - b**2) * (1 - rest**2))
        return np.where(den > 0, (a - b * rest) / np.where(den > 0, den, 1), 0.0) if len(x) == 2 else a

    seen = float(of(_r(s, 1, 2), _r(s, 1, 3) if len(x) == 2 else 0.0))
    if not permutations:
        return spark.createDataFrame([(seen,)], f"{name} double")
    m = max(1.0, s[0, 0])
    dev = lambda k: np.sqrt(max(s[k, k] / m - (s[0, k] / m) ** 2, 0.0))

    def of_draws(draws, kind):
        t = B.permuted_products(spark, p, x, s[0, 1] / m, draws, seed, metric, kind) / m
        r = [t[:, k] / (dev(1) * dev(2 + k)) if dev(1) * dev(2 + k) > 0 else np.zeros(len(t)) for k in range(len(x))]
        return of(r[0], r[1] if len(x) == 2 else 0.0)

    drawn = of_draws(list(range(permutations)), np.float32)
    open_ = np.flatnonzero(np.abs(np.abs(drawn) - abs(seen)) < SINGLE * (1 + abs(rest)) / np.sqrt(max(1 - rest**2, 1e-12)))
    if len(open_):
        drawn[open_] = of_draws(open_.tolist(), np.float64)
    return spark.createDataFrame([(seen, (int((np.abs(drawn) >= abs(seen) - 1e-12).sum()) + 1) / (permutations + 1))], "mantel_r double, p double")
