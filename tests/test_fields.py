import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phytoscape import community as K
from phytoscape import quick as Q
from phytoscape import reports as H
from phytoscape.functions import statistics as S
from phytoscape.operators import association as A
from phytoscape.operators import clustering as C
from phytoscape.operators import distances as D
from phytoscape.operators import diversity as V
from phytoscape.operators import environment as E
from phytoscape.operators import models as M
from phytoscape.operators import names as N
from phytoscape.operators import networks as W
from phytoscape.operators import spatial as P
from phytoscape.operators import temporal as T
from phytoscape.operators import traits as R
from phytoscape.operators import validation as Z


@pytest.fixture(scope="module")
def com(spark):
    rng = np.random.default_rng(4)
    m = rng.poisson(4, (14, 7)) * (rng.random((14, 7)) < 0.7)
    m[0] = [1, 0, 2, 3, 0, 0, 5]
    rows = [(f"s{i:02d}", f"t{j}", float(m[i, j])) for i in range(14) for j in range(7)]
    return m, K.community(spark.createDataFrame(rows, "site string, species string, n double"), "site", "species", "n").cache()


def xy(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")


# --- sums over pairs, permutations -------------------------------------------------
def test_sums_over_pairs_in_blocks(com, monkeypatch):
    _, c = com
    whole = [A.nodf(c).first(), A.wine(c).first(), A.metacommunity(c).first()]
    monkeypatch.setattr(D, "BLOCK", 4)
    again = [A.nodf(c).first(), A.wine(c).first(), A.metacommunity(c).first()]
    assert all(v == pytest.approx(w) if not isinstance(v, str) else v == w for a, b in zip(again, whole) for v, w in zip(a, b))
    monkeypatch.setattr(D, "MOST_SPECIES", 2)  # too many species for matrices: from rows
    assert A.nodf(c).first()[0] == pytest.approx(whole[0][0]) and A.wine(c).first()[0] == pytest.approx(whole[1][0])


def test_simper_against_brute_force(spark, com, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 5)
    m, c = com
    groups = c.select("site").distinct().withColumn("grp", F.substring("site", 2, 2).cast("int") % 2)
    got = {(r["g1"], r["g2"], r["species"]): r["contribution"] for r in A.simper(c, groups).collect()}
    live = [i for i in range(14) if m[i].sum()]
    for g, h in ((0, 0), (0, 1), (1, 1)):
        pairs = [(i, j) for i in live for j in live if i < j and sorted((i % 2, j % 2)) == [g, h]]
        for k in range(7):
            assert got[g, h, f"t{k}"] == pytest.approx(np.mean([abs(m[i, k] - m[j, k]) / (m[i].sum() + m[j].sum()) for i, j in pairs]))


def test_permutations(spark, com, monkeypatch):
    _, c = com
    d = D.distances(c)
    groups = c.select("site").distinct().withColumn("grp", F.when(F.col("site") < "s07", "a").otherwise("b"))
    seen = A.group_tests(d, groups).first()
    r = A.permutation_tests(d, groups, 99).first()
    assert (r["pseudo_f"], r["anosim_r"], r["mrpp_delta"]) == pytest.approx((seen["pseudo_f"], seen["anosim_r"], seen["mrpp_delta"]))
    monkeypatch.setattr(A, "LABEL_BYTES", 14 * 30)  # labels in several rounds
    again = A.permutation_tests(d, groups, 99).first()
    assert tuple(again) == pytest.approx(tuple(r)) and 0.01 <= r["permanova_p"] <= 1
    far = d.withColumn("d", F.when((F.col("i") < "s07") == (F.col("j") < "s07"), 0.1).otherwise(0.9))
    assert A.permutation_tests(far, groups, 199).first()["permanova_p"] <= 0.02
    t = A.mantel_test(d, d, 99).first()
    assert t["mantel_r"] == pytest.approx(1) and t["p"] == pytest.approx(0.01)
    own = {r["species"]: r for r in A.indicator_test(c, groups, 49).collect()}
    best = {r["species"]: r["indval"] for r in A.indicator_values(c, groups).groupBy("species").agg(F.max("indval").alias("indval")).collect()}
    assert {k: v["indval"] for k, v in own.items()} == pytest.approx(best) and all(1 / 50 <= v["p"] <= 1 for v in own.values())


def test_ranks_by_ranges(spark):
    v = [3.0, 1.0, 3.0, 2.0, 5.0, 3.0, 1.0]
    got = sorted((r["d"], r["rk"]) for r in A.ranked(spark.createDataFrame([(x,) for x in v], "d double")).collect())
    assert got == sorted(zip(v, pd.Series(v).rank().tolist()))


def test_kendall_with_ties():
    x, y = [1, 2, 2, 3, 4, 4, 5], [2, 1, 3, 3, 3, 5, 4]
    pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(7) for j in range(i)]
    want = sum(a * b for a, b in pairs) / math.sqrt(sum(a != 0 for a, _ in pairs) * sum(b != 0 for _, b in pairs))
    assert S.kendall(x, y) == pytest.approx(want) and S.kendall([1, 1], [2, 3]) == 0


def test_log_factorials(spark):
    r = spark.createDataFrame([(float(n),) for n in (0, 1, 2, 7, 60, 10**6)], "n double").select("n", V.log_factorial(F.col("n")).alias("l")).collect()
    assert all(x["l"] == pytest.approx(math.lgamma(x["n"] + 1), rel=1e-11, abs=1e-12) for x in r)


# --- traits ----------------------------------------------------------------------------
def test_hull_volumes():
    cube = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)], float)
    inner = np.random.default_rng(0).random((40, 3))
    assert R.hull_volume(np.vstack([cube, inner])) == pytest.approx(1) and R.hull_volume(cube[:, :2]) == pytest.approx(1)
    assert R.hull_volume(cube[:4]) == 0 and R.hull_volume(np.zeros((0, 3))) == 0 and R.hull_volume(np.array([[1.0], [4.0]])) == 3


def test_functional_diversity_by_hand(spark):
    c = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0), ("c", "none", 4.0)], "site string, species string, abundance double")
    t = spark.createDataFrame([("x", 0.0, 1.0), ("y", 2.0, None), ("z", 4.0, float("nan"))], "species string, h double, w double")
    r = {x["site"]: x for x in R.functional_diversity(c, t, ["h", "w"]).collect()}
    gap = 2 / np.std([0, 2, 4])
    assert set(r) == {"a", "b"} and r["a"]["raoq"] == pytest.approx(2 * 0.25 * 0.75 * gap) and r["a"]["fdis"] == pytest.approx(0.25 * 0.75 * gap + 0.75 * 0.25 * gap)
    near = np.array([0.25, 0.75]) * gap
    low = (near.min() - near).sum()
    assert r["a"]["feve"] == pytest.approx(low / (low + near.min())) and r["b"]["fdis"] == 0 and r["b"]["fdiv"] == 0


def test_functional_groups_and_syndromes(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i:02d}", float(10 * (i % 3) + rng.normal()), float(-10 * (i % 3) + rng.normal())) for i in range(18)]
    t = spark.createDataFrame(rows, "species string, h double, w double")
    g = R.functional_groups(t, ["h", "w"])
    assert g.groupby(g["species"].str[1:].astype(int) % 3)["functional_group"].nunique().tolist() == [1, 1, 1] and g["functional_group"].nunique() == 3
    o = R.trade_offs(t, ["h", "w"]).first()
    assert o["kind"] == "Strong trade-off" and o["n"] == 18
    s = R.trait_syndromes(t, ["h", "w"])
    assert s["axis"].max() == 1 and set(s["sign"]) == {"positive", "negative"}


def test_null_communities(spark, com):
    _, c = com
    rows = [(f"t{i}", f"t{j}", float(abs(i - j))) for i in range(7) for j in range(i + 1, 7)]
    ph = spark.createDataFrame(rows, "i string, j string, dist double")
    seen = {r["site"]: r for r in R.mean_pair_distances(c, ph).collect()}
    got = {r["site"]: r for r in R.phylogenetic_nulls(c, ph, 49).collect()}
    assert set(got) == set(seen) and all(got[k]["mpd"] == pytest.approx(seen[k]["mpd"]) and 0.02 <= got[k]["mpd_p"] <= 1 for k in got)


def test_phylogenetic_nulls_of_all_sites_from_the_same_orders(spark):
    rng = np.random.default_rng(21)
    m = rng.poisson(3, (40, 9)) * (rng.random((40, 9)) < 0.7)
    c = K.community(spark.createDataFrame([(f"s{i:02d}", f"t{j}", float(m[i, j])) for i in range(40) for j in range(9)], "site string, species string, n double"), "site", "species", "n")
    d = rng.integers(1, 60, (9, 9)).astype(float)
    d = np.triu(d, 1) + np.triu(d, 1).T
    d[2, 5] = d[5, 2] = np.nan
    ph = spark.createDataFrame([(f"t{i}", f"t{j}", float(d[i, j])) for i in range(9) for j in range(i + 1, 9) if d[i, j] == d[i, j]], "i string, j string, dist double")
    np.fill_diagonal(d, np.nan)
    got = {r["site"]: r for r in R.phylogenetic_nulls(c, ph, 99).collect()}
    orders = R._orders(9, 99, 42)
    for i in range(0, 40, 7):
        a = m[i][m[i] > 0].astype(float)
        seen, null = R._mpd_mntd(d[np.ix_(m[i] > 0, m[i] > 0)], a), [R._mpd_mntd(d[np.ix_(o[:len(a)], o[:len(a)])], a) for o in orders]
        null = np.array([v for v in null if v is not None])
        for k, (name, z) in enumerate((("mpd", "nri"), ("mntd", "nti"))):
            r, mean, sd = got[f"s{i:02d}"], null[:, k].mean(), null[:, k].std()
            assert (r[name], r[f"{name}_mean"], r[f"{name}_sd"]) == pytest.approx((seen[k], mean, sd)) and r[z] == pytest.approx((mean - seen[k]) / sd)
            assert r[f"{name}_p"] == pytest.approx(((null[:, k] <= seen[k] + 1e-9).sum() + 1) / (len(null) + 1))


# --- clusters -----------------------------------------------------------------------------
def test_linkage_cut_and_cophenetic():
    x = np.array([0.0, 1.0, 10.0, 11.0, 12.5])[:, None]
    d = np.abs(x - x.T)
    for method in ("single", "complete", "average", "ward"):
        m = C.linkage(d, method)
        assert C.cut_tree(m, 5, 2).tolist() == [1, 1, 2, 2, 2] and len(m) == 4 and C.cut_tree(m, 5, 5).tolist() == [1, 2, 3, 4, 5]
    assert C.cophenetic(C.linkage(d, "single"), 5)[0, 4] == 9 and C.silhouette_of(d, np.array([1, 1, 2, 2, 2])) > 0.8 and C.silhouette_of(d, np.ones(5)) == 0


def test_elbow_rules_of_the_survey():
    r = C.elbow_rules(list(range(1, 8)), [100, 60, 35, 30, 28, 26, 25])
    assert r["knee"] == 3 and r["derivative"] == 3 and r["variance"] == 3 and r["jump"] == 3 and r["consensus"] == 3 and r["confidence"] >= 0.8
    assert C.elbow_rules([2, 3, 4, 5], [100, 50, 20, 1])["variance"] == 4 and C.elbow_rules([1, 2], [3, 2])["knee"] is None


def test_elbow_analysis_and_gap(spark):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(c, 0.2, (25, 2)) for c in ((0, 0), (6, 6), (0, 6))])
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(m)], "site int, vec array<double>")
    t, picks = C.elbow_analysis(v, range(1, 6), 2)
    assert picks["silhouette_optimal"] == 3 and picks["calinski_optimal"] == 3 and picks["consensus"] in (2, 3) and t["inertia"].iloc[0] == pytest.approx(m.var(0).sum())
    g = C.gap_statistic(v, range(1, 5), 3, 2)
    assert g.loc[g["optimal"], "k"].tolist() == [3]


# --- environment ---------------------------------------------------------------------------
def test_smoothers(spark):
    x = np.linspace(0, 10, 400)
    y = np.sin(x) + np.random.default_rng(2).normal(0, 0.05, 400)
    df = xy(spark, x, y)
    for kind in ("spline", "gaussian_process"):
        s = E.smooth(df, "x", "y", kind)
        assert np.abs(s.predict(x) - np.sin(x)).max() < 0.12 and s.r2 > 0.98 and 4 < s.edf < 21
    assert E.smooth(df, "x", "y", "polynomial").r2 == pytest.approx(1 - ((y - np.polyval(np.polyfit(x, y, 3), x)) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)
    low = E.lowess(df, "x", "y", 0.1)
    assert np.abs(low["smooth"] - np.sin(low["x"])).mean() < 0.05 and low["rows"].sum() == 400
    line = E.lowess(xy(spark, range(20), [3 * v + 1 for v in range(20)]), "x", "y")
    assert line["smooth"].to_numpy() == pytest.approx([3 * v + 1 for v in range(20)])
    with pytest.raises(ValueError):
        E.smooth(df.limit(2), "x", "y")
    with pytest.raises(ValueError):
        E.smooth(df, "x", "y", "nobody")


def test_gam_and_regression(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random(300), rng.random(300)
    y = np.sin(5 * a) + 2 * b
    df = spark.createDataFrame([(float(p), float(q), float(r)) for p, q, r in zip(a, b, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    t, predict = E.fit_gam(df, "y", ["a", "b"])
    assert t["n"].tolist() == [300, 300] and np.corrcoef(predict(pd.DataFrame({"a": a, "b": b})), y)[0, 1] > 0.98
    m = E.multiple_regression(df, "y", ["a", "b"])
    z = np.column_stack([(a - a.mean()) / a.std(), (b - b.mean()) / b.std()])
    x = np.column_stack([np.ones(300), z, z[:, 0] * z[:, 1]])
    assert m["coefficient"].to_numpy() == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0]) and m["term"].tolist()[-1] == "a:b"
    with pytest.raises(ValueError):
        E.fit_gam(df.limit(5), "y", ["a"])


def test_response_curves(spark):
    rows = [(f"s{i}", "t", float(8 * math.exp(-((i - 20) ** 2) / 50) + 0.5)) for i in range(40)]
    c = spark.createDataFrame(rows, "site string, species string, abundance double")
    env = spark.createDataFrame([(f"s{i}", float(i)) for i in range(40)], "site string, v double")
    r = E.response_curves(c, env, "v").first()
    assert r["optimum"] == pytest.approx(20, abs=0.1) and r["tolerance"] == pytest.approx(5, abs=0.1) and r["niche_width"] == pytest.approx(2 * r["tolerance"])


def test_environmental_fit(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(50, 2))
    v = 3 * p[:, 0] - p[:, 1] + rng.normal(0, 0.3, 50)
    sc = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "site int, a double, b double")
    r = {x["axis"]: x for x in E.environmental_fit(sc, ["a", "b"], spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "site int, v double"), ["v"]).collect()}
    coef, rest = np.linalg.lstsq(np.column_stack([np.ones(50), p]), v, rcond=None)[:2]
    assert (r["a"]["coefficient"], r["b"]["coefficient"]) == pytest.approx(tuple(coef[1:])) and r["a"]["r2"] == pytest.approx(1 - rest[0] / ((v - v.mean()) ** 2).sum()) and r["a"]["p"] < 1e-6


# --- networks ---------------------------------------------------------------------------------
def test_network_measures(spark):
    pairs = [("a", "b", 0.9, True), ("b", "c", 0.8, True), ("a", "c", 0.7, True), ("c", "d", 0.6, True), ("a", "d", 0.1, False), ("b", "d", 0.1, False), ("a", "e", 0.0, False)]
    net = spark.createDataFrame(pairs, "i string, j string, weight double, edge boolean")
    d = {r["species"]: (r["degree"], r["triangles"], r["clustering"]) for r in W.degrees(net).collect()}
    assert d == {"a": (2, 1, 1.0), "b": (2, 1, 1.0), "c": (3, 1, pytest.approx(1 / 3)), "d": (1, 0, 0.0), "e": (0, 0, 0.0)}
    p = W.properties(net).first()
    assert (p["n_nodes"], p["n_edges"], p["n_components"], p["largest_component"]) == (5, 4, 2, 4) and p["density"] == pytest.approx(0.4)
    t, whole = W.centralities(net)
    b = t.set_index("species")["betweenness"]
    assert b["c"] == pytest.approx(2 * 2 / (4 * 3)) and b["a"] == 0 and t.set_index("species")["eigenvector"].idxmax() == "c" and whole["average_hops"] == math.inf
    with pytest.raises(ValueError):
        W.network(net, "nobody")


# --- validation ---------------------------------------------------------------------------------
def test_places_and_countries(spark):
    rows = [(51.4829, -0.2945, "Europe"), (39.8284, -98.5795, "Canada"), (0.0, 0.0, None), (None, 1.0, "x"), (float("nan"), 2.0, None)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, country string")
    f = Z.place_flags(F.col("latitude"), F.col("longitude"))
    got = df.select(*[c.alias(k) for k, c in f.items()], Z.country(F.col("latitude"), F.col("longitude")).alias("c")).collect()
    assert tuple(got[0]) == (True, True, True, "Europe") and tuple(got[1]) == (True, False, False, "United States") and got[2]["c"] == "Africa" and tuple(got[3]) == (False, False, False, "Unknown")
    rep = {r["check"]: r["records"] for r in Z.spatial_report(df, stated="country").collect()}
    assert rep["total"] == 5 and rep["missing"] == 2 and rep["country_mismatch"] == 1 and Z.spatial_report(df.limit(0)).count() == 10


def test_dates(spark):
    df = spark.createDataFrame([("2020-05-01", "2020-04-01", "2020-02-30")] * 4 + [("2020-05-02", None, "02/29")], "first_seen string, last_seen string, t string")
    d = df.select(F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"), "t")
    flags = Z.date_order_flags(d, ["first_seen", "last_seen"])
    assert list(flags) == ["first_seen_last_seen"] and d.where(flags["first_seen_last_seen"]).count() == 4 and d.where(Z.impossible_text(F.col("t"))).count() == 5
    assert [r["records"] for r in Z.repeated_dates(d, "first_seen").collect()] == [4] and Z.date_relation("year_a", "year_b") == ["same_year"]
    r = {x["column_name"]: x for x in Z.temporal_report(df, ["first_seen", "t"], "2020-01-01").collect()}
    assert r["first_seen"]["parsed"] == 5 and r["first_seen"]["future"] == 5 and r["t"]["parsed"] == 0


def test_resolution(spark):
    names = spark.createDataFrame([("quercus alba L.",), ("Old  name",), ("nobody",), (None,), ("quercus alba L.",)], "plant_name string")
    tax = spark.createDataFrame([("Quercus alba", None, "Fagaceae", "a", 1), ("Old name", "New name", "X", "b", 2), ("Old name", "Third name", "X", "c", 3)], "name string, accepted_name string, family string, source string, priority int")
    got = {r["original_name"]: r for r in Z.resolve_names(names, "plant_name", tax).collect()}
    assert got["quercus alba L."]["taxonomic_status"] == "Accepted" and got["Old  name"]["accepted_name"] == "New name" and got["Old  name"]["taxonomic_status"] == "Synonym" and got["nobody"]["match_score"] == 0 and len(got) == 3
    s = Z.resolution_summary(Z.resolve_names(names, "plant_name", tax)).first()
    assert (s["total_names"], s["resolved"], s["high_confidence"]) == (3, 2, 2)
    assert Z.species_column(["id", "Plant_Name"]) == "Plant_Name" and Z.species_column(["id"]) is None
    assert Z.with_resolved_names(names, tax).count() == 5


def test_names(spark):
    rows = ["Quercus alba", "quercus Alba", "Quercus", "alba", "Quercus alba L.", "Quercus × rosacea", "Acer rubrum var. trilobum", "Carex sp.", "", "  ", None, "Quercus  alba", "Abies balsamea (L.) Mill", "Acer 12"]
    got = [tuple(r) for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").select("i", N.name_type(F.col("s")).alias("t"), N.clean_name(F.col("s")).alias("c")).orderBy("i").collect()]
    assert [g[1] for g in got] == ["binomial", "malformed_binomial", "genus_only", "epithet_only", "binomial_with_author", "hybrid", "infraspecific", "placeholder", "empty", "empty", "invalid", "binomial", "binomial_with_author", "malformed_binomial"]
    assert [g[2] for g in got][:5] == ["Quercus alba", "Quercus alba", "Quercus", "alba", "Quercus alba"] and got[6][2] == "Acer rubrum var. trilobum" and got[10][2] == "" and got[12][2] == "Abies balsamea"
    t = {r["species_original"]: r for r in N.with_name_checks(spark.createDataFrame([(r,) for r in rows], "species string"), "species").collect()}
    assert t["Quercus alba"]["name_is_valid"] and t[None]["name_severity"] == "critical" and t["Quercus alba L."]["name_severity"] == "medium" and t["Acer 12"]["name_has_invalid_characters"] and t["Quercus"]["name_suggestions"].startswith("Add species epithet")
    rep = N.name_report(spark.createDataFrame([(r,) for r in rows], "species string"), "species").collect()
    totals = {r["item"]: r["names"] for r in rep if r["part"] == "summary"}
    assert totals["total_names"] == 13 and totals["valid_names"] + totals["invalid_names"] == 13 and totals["valid_names"] == sum(r["name_is_valid"] for k, r in t.items() if k is not None)


def test_equal_areas(spark):
    step, rows = 0.01, [(x, y) for y in (5.0, 40.0, 49.0) for x in (10.0, 17.0)]
    corner = lambda dx, dy: N.albers(F.col("x") + dx, F.col("y") + dy, 12.0, 45.0)
    (x0, y0), (x1, y1), (x2, y2) = corner(0.0, 0.0), corner(step, 0.0), corner(0.0, step)
    area = F.abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))
    for r in spark.createDataFrame(rows, "x double, y double").select("y", area.alias("a")).collect():
        want = 6_371_007.2**2 * math.radians(step) * (math.sin(math.radians(r["y"] + step)) - math.sin(math.radians(r["y"])))
        assert r["a"] == pytest.approx(want, rel=1e-3)


def test_standard_dataset(spark):
    df = spark.createDataFrame([("quercus Alba L.", "45°30'0\"N", "1.5", "2020/05/01", 1.0), ("Acer rubrum", "95", None, "?", None), ("x", None, None, None, 5.0)], "taxon string, lat string, lon string, sampling_date string, cover double")
    r = {x["species"]: x for x in N.standard_dataset(df).collect()}
    q = r["Quercus alba"]
    assert q["latitude"] == pytest.approx(45.5) and str(q["date"]) == "2020-05-01" and not q["abundance_filled"]
    assert r["Acer rubrum"]["latitude"] is None and r["Acer rubrum"]["abundance"] == 3.0 and r["Acer rubrum"]["abundance_filled"] and r["Acer rubrum"]["date"] is None


# --- series and grids ------------------------------------------------------------------------------
def test_decompositions(spark):
    t = np.arange(84)
    y = 0.1 * t + 3 * np.sin(2 * np.pi * t / 7) + 10
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, y)], "t int, y double")
    for model in ("additive", "multiplicative"):
        r = T.classical_decomposition(df, "t", "y", 7, model=model).where("trend is not null").toPandas()
        back = r["trend"] + r["seasonal"] + r["residual"] if model == "additive" else r["trend"] * r["seasonal"] * r["residual"]
        assert back.to_numpy() == pytest.approx(r["value"].to_numpy())
    r = T.stl(df, "t", "y", 7).toPandas().sort_values("time")
    assert r["residual"].abs().max() < 0.3 and np.abs(r["trend"].to_numpy() - 0.1 * t - 10).max() < 0.3
    assert [x["lag"] for x in T.seasonality(df.withColumn("y", F.col("y") - 0.1 * F.col("t")), "t", "y", 12).where("period").collect()] == [7]
    with pytest.raises(ValueError):
        T.classical_decomposition(df, "t", "y", 7, model="x")
    even = T.classical_decomposition(df, "t", "y", 4).where("time = 10").first()
    assert even["trend"] == pytest.approx((0.5 * y[8] + y[9] + y[10] + y[11] + 0.5 * y[12]) / 4)


def test_trends_and_forms(spark):
    df = xy(spark, np.arange(1, 41), 2 * np.log(np.arange(1, 41)) + 1)
    assert T.response_forms(df, "x", "y").first()["form"] == "logarithmic"
    for m in ("linear", "mann_kendall", "spline", "lowess"):
        assert T.detect_trend(df, "x", "y", m).count() == 1
    assert T.detect_trend(df, "x", "y", "spline").first()["direction"] == "increasing"
    x = np.arange(60.0)
    s = spark.createDataFrame([("g", float(a), float(5 * math.exp(-((a - 30) ** 2) / 72) + 2)) for a in x], "g string, x double, y double")
    p = {r["parameter"]: r["value"] for r in T.phenology(s, "g", "x", "y").collect()}
    assert p["peak_time"] == pytest.approx(30, abs=0.1) and abs(p["duration"]) == pytest.approx(12, abs=0.2)


def test_interpolations(spark):
    rng = np.random.default_rng(8)
    p = rng.random((60, 2)) * 4
    pts = spark.createDataFrame([(f"s{i}", float(a), float(b), float(2 * a - b + 1)) for i, (a, b) in enumerate(p)], "site string, x double, y double, z double")
    cells = P.grid(spark, 1, 1, 3, 3, 0.5)
    for m in ("rbf", "linear"):
        got = P.interpolate(pts, cells, m).join(cells, "grid_id").where("z is not null").toPandas()
        assert len(got) >= 14 and got["z"].to_numpy() == pytest.approx((2 * got["x"] - got["y"] + 1).to_numpy(), abs=1e-6)
    assert P.interpolate(pts, P.grid(spark, 90, 90, 91, 91, 1), "linear").first()["z"] is None
    with pytest.raises(ValueError):
        P.interpolate(pts, cells, "x")


@pytest.mark.parametrize("function", ["thin_plate_spline", "linear"])
def test_radial_functions_beyond_the_direct_solve(spark, monkeypatch, function):
    rng = np.random.default_rng(13)
    xy = rng.random((400, 2)) * [4, 3]
    pts = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "z": 50 + 9 * np.sin(xy[:, 0]) + rng.normal(size=400)}))
    run = lambda: P.rbf(pts, P.grid(spark, 0, 0, 4, 3, 0.5), function).toPandas().sort_values("grid_id")["z"].to_numpy()
    want = run()
    monkeypatch.setattr(P, "RBF_POINTS", 100)
    assert run() == pytest.approx(want, rel=1e-7, abs=1e-6)


def test_linear_interpolation_beyond_3000_positions(spark):
    rng = np.random.default_rng(11)
    xy = rng.random((3_200, 2)) * 4
    pts = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "z": 2 * xy[:, 0] - xy[:, 1] + 1}))
    cells = P.grid(spark, 0.5, 0.5, 5, 3.5, 0.5)
    got = P.linear_interpolation(pts, cells).join(cells, "grid_id").toPandas()
    inside = got["x"] < 3.9
    assert got["z"].isna().equals(~inside) and got["z"][inside].to_numpy() == pytest.approx((2 * got["x"] - got["y"] + 1)[inside].to_numpy(), abs=1e-9)


def test_triangle_around_a_place_is_that_of_the_triangulation():
    rng = np.random.default_rng(12)
    for xy in (rng.random((300, 2)), np.stack(np.meshgrid(np.arange(9.0), np.arange(9.0)), -1).reshape(-1, 2)):
        corners, every = P.hull(xy), {tuple(t) for t in np.sort(P.triangulated(xy), 1).tolist()}
        for q in [*(rng.random((60, 2)) * xy.max(0)), xy[17], (xy[40] + xy[41]) / 2]:
            f = P.triangle_at(xy, corners, q)
            if f is not None:
                assert f[1] @ xy[f[0]] == pytest.approx(q, abs=1e-9) and f[1].min() >= -1e-9
                assert len(xy) == 81 and np.ptp(xy[f[0]], axis=0).max() <= 1 or tuple(sorted(f[0].tolist())) in every or f[0][0] == f[0][1]
    assert P.triangle_at(xy, corners, np.array([9.0, 4.0])) is None and P.hull(np.c_[np.arange(5.0), np.arange(5.0)]).tolist() == [0, 4]


def test_edges_against_gradients(spark):
    g = np.random.default_rng(9).integers(0, 3, (7, 6))
    cells = spark.createDataFrame([(i, j, int(g[i, j])) for i in range(7) for j in range(6)], "row int, col int, code int")
    got = {r["code"]: r for r in P.edge_metrics(cells, 2.0).collect()}
    for code in (1, 2):
        a, b = np.gradient((g == code).astype(float))
        n = int((np.hypot(a, b) > 0).sum())
        assert got[code]["edge_cells"] == n and got[code]["edge_density"] == pytest.approx(n * 2 / (42 * 4)) and got[code]["shape_index"] == pytest.approx(n * 2 / (42 * 4) / (4 * math.sqrt((g == code).sum() * 4)))


# --- prediction and reports ---------------------------------------------------------------------------
def test_models(spark):
    rng = np.random.default_rng(10)
    rows = [(i, "x" if a + b > 1 else "y", float(a), float(b) if i % 9 else None, int(a > 0.5)) for i, (a, b) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(rows, "id long, kind string, a double, b double, present int")
    fitted, score = M.classify(df, "id", "kind", ["a", "b"])
    assert score.first()["accuracy"] > 0.8
    c = M.confusion(M.predict_labels(fitted, df, "kind", ["a", "b"]), "kind").collect()
    assert {(r["actual"], r["predicted"]): r["records"] for r in c}["all", "all"] == 300
    assert M.cross_validated(df, "id", "kind", ["a", "b"], "logistic", 3).agg(F.sum("records"), F.avg("accuracy")).first()[0] == 300
    drop = {r["feature"]: r["drop"] for r in M.permutation_importance(fitted, df, "id", "kind", ["a", "b"]).collect()}
    assert drop["a"] > 0.1 and [f for f, _ in M.importances(fitted, ["a", "b"])]
    p = M.climate_projection(df, df.withColumn("a", F.col("a") + 0.4), "id", "present", ["a"]).first()
    assert p["change"] > 0.2
    best, scores = M.species_distribution(df.select("id", "present"), df.select("id", "a", "b"), ["id"], "present", ["a", "b"])
    assert scores.count() == 2 and best is not None


def test_anomalies_stand_out(spark):
    rng = np.random.default_rng(11)
    m = np.vstack([rng.normal(size=(400, 3)), rng.normal(12, 1, (8, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)] + [(999, None, float("nan"), 0.0), (None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double")
    got = M.isolation_forest(df, "id", ["a", "b", "c"], contamination=0.02)
    assert got.count() == 409 and {r["key"] for r in got.where("anomaly").collect()} >= set(range(400, 408)) and M.isolation_forest(df.limit(0), "id", ["a"]).count() == 0
    pc = M.reduce_dimensions(df.where("id < 408"), "id", ["a", "b", "c"]).toPandas()
    z = (m - m.mean(0)) / m.std(0)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(pc.sort_values("key")["pc1"]), np.abs(z @ v[0]), atol=1e-6)


def test_reports(spark, com):
    _, c = com
    t = spark.createDataFrame([("a|b", 1.0), ("<c>", None)], "name string, v double")
    assert "&lt;c&gt;" in H.report({"x": t}) and "a\\|b" in H.report({"x": t}, output="markdown") and "2 rows." in H.report({"x": t}, output="text")
    page = H.dashboard({"f": (t, "bars", "name", "v"), "g": (spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "p double, q double"), "points", "p", "q")})
    assert page.count("<rect") == 1 and page.count("<circle") == 2
    with pytest.raises(ValueError):
        H.report({}, output="pdf")
    h = H.histogram(xy(spark, [0, 1, 2, 10, None or 10], [0] * 5), "x", 5).collect()
    assert sum(r["records"] for r in h) == 5 and H.histogram(t.limit(0), "v").count() == 0
    d = H.describe(t, ["v"]).first()
    assert (d["count"], d["mean"]) == (1, 1.0)


def test_quick_tables(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(f"s{i}", *map(int, rng.poisson(3, 6))) for i in range(20)] + [("empty", *[0] * 6)], "site string, " + ", ".join(f"t{j} int" for j in range(6)))
    with pytest.warns(UserWarning):
        t = Q.diversity_table(df, "site", indices=["shannon", "nobody"])
    assert t.count() == 21 and t.columns == ["site", "shannon"]
    for m in ("pca", "ca", "dca", "pcoa", "nmds"):
        assert Q.ordination_table(df, "site", method=m).count() > 0
    assert Q.clustering_table(df, "site", clusters=2).select("cluster").distinct().count() == 2 and Q.clustering_table(df, "site", clusters=3, method="hierarchical").count() == 20
    assert Q.nestedness_table(df, "site").count() == 1 and Q.summary_table(df, "site").first()["n_sites"] == 20 and Q.null_model_table(df, "site", draws=9, model="equiprobable").count() == 1
    assert set(Q.network_tables(df, "site")) == {"edges", "nodes", "properties"} and Q.metacommunity_table(df, "site").count() == 1
