import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phytoscape import community as K
from phytoscape.functions import statistics as S
from phytoscape.operators import association as A
from phytoscape.operators import clustering as C
from phytoscape.operators import distances as D
from phytoscape.operators import nullmodels as N
from phytoscape.operators import ordination as O
from phytoscape.operators import spatial
from phytoscape.operators.graph import components
from phytoscape.sources import tables as T


@pytest.fixture(scope="module")
def com(spark):
    rng = np.random.default_rng(4)
    m = rng.poisson(4, (12, 7)) * (rng.random((12, 7)) < 0.7)
    return m, K.community(spark.createDataFrame([(f"s{i:02d}", f"t{j}", float(m[i, j])) for i in range(12) for j in range(7)], "site string, species string, n double"), "site", "species", "n").cache()


def wide(df, axes):
    p = df.toPandas().pivot(index="site", columns="axis", values="score").sort_index()
    return p[list(axes)].to_numpy()


def test_pca_against_svd(com):
    m, c = com
    scores, table = O.pca(c, "raw", 2)
    x = m - m.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(wide(scores, (1, 2))), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    assert table.drop_duplicates("axis")["eigenvalue"].to_numpy() == pytest.approx(s[:2] ** 2 / 11)


def test_ca_against_svd(com):
    m, c = com
    m = m[m.sum(1) > 0]
    e = np.outer(m.sum(1), m.sum(0)) / m.sum()
    u, s, v = np.linalg.svd((m - e) / np.sqrt(e), full_matrices=False)
    scores, table = O.ca(c, 2)
    assert table.drop_duplicates("axis")["eigenvalue"].to_numpy() == pytest.approx(s[:2] ** 2)
    assert np.allclose(np.abs(wide(scores, (1, 2))), np.abs(u[:, :2] * s[:2] / np.sqrt(m.sum(1))[:, None]), atol=1e-8)


def test_pcoa_keeps_euclidean_distances(com):
    m, c = com
    p = O.pcoa(D.distances(c, "euclidean"), 12).pivot(index="site", columns="axis", values="score").to_numpy()
    for i, j in ((0, 1), (3, 9)):
        assert np.linalg.norm(p[i] - p[j]) == pytest.approx(np.linalg.norm(m[i] - m[j]), abs=1e-6)


def test_procrustes_of_a_turned_copy():
    a = np.random.default_rng(1).normal(size=(9, 2))
    t = np.array([[0.6, -0.8], [0.8, 0.6]])
    assert O.procrustes(a, 3 * a @ t + 5) == pytest.approx(0, abs=1e-12)


def test_monotone_fit():
    assert list(O._monotone(np.array([1.0, 3.0, 2.0, 4.0]))) == [1.0, 2.5, 2.5, 4.0]


def test_distributions():
    assert S.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert S.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert S.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert S.kendall([1, 2, 3, 4], [1, 2, 4, 3]) == pytest.approx(2 / 3)
    x = np.linspace(0, 50, 60)
    p, *_, r2, _ = S.fit_curve(lambda t, k, r, t0: k / (1 + np.exp(-r * (t - t0))), x, 10 / (1 + np.exp(-0.3 * (x - 20))), [8, 0.1, 25])
    assert p == pytest.approx([10, 0.3, 20], rel=1e-4) and r2 > 0.9999


def test_hierarchical_and_elbow(com):
    merges, labels = C.hierarchical(D.distances(com[1]), "single", 3)
    assert len(merges) == 11 and labels["cluster"].nunique() == 3 and merges["height"].is_monotonic_increasing
    got = C.elbow_rules([1, 2, 3, 4, 5, 6, 7], [100, 60, 35, 30, 28, 26, 25])
    assert got["knee"] == 3 and got["consensus"] in (2, 3, 4) and 0 < got["confidence"] <= 1


def test_dbscan_by_hand(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 2.0), ("c", "d", 1.0), ("x", "y", 1.0), ("a", "x", 9.0)], "i string, j string, d double")
    sites = spark.createDataFrame([(s,) for s in "abcdxyz"], "site string")
    ids = {s: k for k, s in enumerate("abcdxyz")}
    num = d.replace({k: str(v) for k, v in ids.items()}).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "d")
    got = {r["site"]: (r["cluster"], r["core"]) for r in C.dbscan(num, sites.replace({k: str(v) for k, v in ids.items()}).select(F.col("site").cast("long").alias("site")), 1.0, 3).collect()}
    assert got == {0: (1, False), 1: (1, True), 2: (1, True), 3: (1, False), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_components_of_random_edges(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("model", ["equiprobable", "rows", "columns", "proportional", "fixed"])
def test_null_matrices_keep_what_they_promise(model):
    m = (np.random.default_rng(5).random((8, 6)) < 0.4).astype(np.int8)
    x = N.null_matrix(m, model, np.random.default_rng(1))
    assert x.sum() == m.sum()
    if model in ("rows", "fixed"):
        assert (x.sum(1) == m.sum(1)).all()
    if model in ("columns", "fixed"):
        assert (x.sum(0) == m.sum(0)).all()


def test_idw_hits_points(spark):
    pts = spark.createDataFrame([("a", 0.5, 0.5, 3.0), ("b", 1.5, 0.5, 5.0)], "site string, x double, y double, z double")
    got = {r["grid_id"]: r["z"] for r in spatial.idw(pts, spatial.grid(spark, 0, 0, 3, 1, 1)).collect()}
    assert got[0] == 3.0 and got[1] == 5.0 and got[2] == pytest.approx((3 / 4 + 5) / 1.25)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Plot ID;Scientific Name;Cover\np1;Acer rubrum;3\n")
    df = T.read_survey(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["plot_id", "species", "abundance"]
    (tmp_path / "b.csv").write_bytes("taxon,lat,x\nAlnus \xe9,1,2\n".encode("latin-1"))
    assert [tuple(r) for r in T.read_survey(spark, str(tmp_path / "b.csv")).collect()] == [("Alnus é", 1, 2)]
    (tmp_path / "tv").mkdir()
    (tmp_path / "tv/florlist.txt").write_text("species\tcode\nAcer rubrum\t1\n")
    (tmp_path / "tv/plots.txt").write_text("releve,cover\n1,2\n")
    tv = T.read_turboveg(spark, str(tmp_path / "tv"))
    assert set(tv) == {"species_list", "releves"} and tv["releves"].columns == ["plot_id", "abundance"]
    nps = T.agency_table(spark.createDataFrame([("a", "b", 1)], "plot_code string, Taxa_Code string, pct_cover int"), "NPS")
    assert nps.columns == ["plot_id", "species_code", "abundance"]
    with pytest.raises(ValueError):
        T.read_survey(spark, str(tmp_path / "a.xyz"))
    with pytest.raises(T.NotSupportedError):
        T.read_survey(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(ValueError):
        T.agency_table(df, "nobody")
    T.write_darwin_core(df, str(tmp_path / "dwc"))
    assert spark.read.option("header", True).csv(str(tmp_path / "dwc/occurrence")).count() == 1
    assert T.export({"x": df}, str(tmp_path / "out"), "json") == [f"{tmp_path}/out_x"]


def test_darwin_core(spark):
    df = spark.createDataFrame([("Acer rubrum", "44.5", "x", "2023-05-01", "7"), ("Acer rubrum", "95", "-72", "no date", "7.5")], "Species string, lat string, lon string, date string, count string")
    out = T.to_darwin_core(df)
    assert {"scientificName", "decimalLatitude", "occurrenceID", "catalogNumber", "basisOfRecord", "kingdom", "modified"} <= set(out.columns)
    rows = out.orderBy("decimalLatitude").collect()
    assert rows[0]["decimalLongitude"] is None and rows[0]["individualCount"] == 7 and rows[1]["eventDate"] is None and str(rows[0]["eventDate"])[:10] == "2023-05-01"
    raw = df.toDF("scientificName", "decimalLatitude", "decimalLongitude", "eventDate", "individualCount")
    got = {(r["term"], r["issue"]): r["records"] for r in T.darwin_core_report(raw).collect()}
    assert got["decimalLongitude", "not of type double"] == 1 and got["individualCount", "not of type int"] == 1 and got["eventDate", "not a date"] == 1 and got["decimalLatitude, decimalLongitude", "invalid pair"] == 2 and got["kingdom", "required term is missing"] == 2
    assert T.darwin_core_report(raw.limit(0)).count() == 0


def test_stream(spark, tmp_path, data):
    from phytoscape.streaming.diversity import window_indices, windowed_counts, write_indices

    src = spark.read.parquet(f"{data}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = write_indices(stream, ["shannon", "richness"], str(tmp_path / "out"), str(tmp_path / "cp"), time="ts", site="user_id", species="event_type").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r["start"]), r["site"]): r["richness"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(str(r["start"]), r["site"]): r["richness"] for r in window_indices(windowed_counts(src, "ts", "user_id", "event_type"), ["richness"]).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_growth_fit_is_that_of_the_rows(spark):
    from phytoscape.operators.temporal import CURVES, fit_curves

    rng = np.random.default_rng(7)
    x = np.r_[np.full(400, 3.0), rng.integers(0, 20, 600)].astype(float)  # one x holds 40 % of the rows
    y = 2 * np.exp(0.1 * x) + 0.5 * np.cos(x) + rng.normal(0, 1, len(x))
    r = fit_curves(spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y})), "g", "x", "y", "exponential").first()
    p, e, r2, rmse = S.fit_curve(CURVES["exponential"][0], x, y, [1.0, 0.01])
    assert r["n"] == 1000 and r["params"] == pytest.approx(p, rel=1e-5) and r["errors"] == pytest.approx(e, rel=1e-4)
    assert (r["r2"], r["rmse"]) == pytest.approx((r2, rmse), rel=1e-9)


def test_mixture_sees_every_dimension(spark, monkeypatch):
    from phytoscape.plans import kernels

    x = np.zeros((240, 8))  # the records differ beyond the first four dimensions only
    x[:, 4:] = np.random.default_rng(3).normal(size=(240, 4))
    x[120:, 6] += 40
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "site long, vec array<double>")
    monkeypatch.setattr(kernels, "_vectors", lambda s, d: v)
    got = kernels.QUERIES["gaussian_mixture"](spark, "").toPandas()
    assert len(got) == 240 and got["cluster"].nunique() > 1


@pytest.mark.parametrize("model", ["gaussian", "exponential"])
def test_kriging_beyond_the_direct_solve(spark, monkeypatch, model):
    from phytoscape.operators import smoothing

    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 10, (300, 2))
    pts = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "z": 50 + 9 * np.sin(xy[:, 0]) + rng.normal(size=300)}))
    run = lambda: smoothing.simple_kriging(pts, spatial.grid(spark, 0, 0, 10, 10, 1), model).toPandas().sort_values("grid_id")["z"].to_numpy()
    want = run()
    monkeypatch.setattr(smoothing, "MOST_POINTS", 100)
    assert run() == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_gaussian_kriging_needs_no_pairs_of_points(spark, monkeypatch):
    from phytoscape.operators import smoothing

    rng = np.random.default_rng(9)
    xy = np.r_[rng.uniform(0, 10, (400, 2)), rng.normal(4, 0.2, (100, 2))]  # some close together
    z = 600 + 90 * np.sin(xy[:, 0]) + 200 * rng.normal(size=500)
    pts = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "z": z}))
    run = lambda: smoothing.simple_kriging(pts, spatial.grid(spark, 0, 0, 10, 10, 1)).toPandas().sort_values("grid_id")["z"].to_numpy()
    want = run()
    monkeypatch.setattr(smoothing, "MOST_POINTS", 100)

    def none(*_):
        raise AssertionError("rows of all pairs")

    monkeypatch.setattr(smoothing, "_by_rows", none)
    assert run() == pytest.approx(want, rel=1e-6, abs=1e-4)
    assert smoothing._farthest(xy) == np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)).max()


def test_kriging_of_all_sites(spark, data):
    from phytoscape.operators.smoothing import simple_kriging
    from phytoscape.plans import kernels, series

    got = kernels.QUERIES["kriging"](spark, data).toPandas().set_index("grid_id")["z"]
    want = simple_kriging(series._points(spark, data), spatial.grid(spark, -80.0, 40.0, -65.0, 50.0, 0.5)).toPandas().set_index("grid_id")["z"]
    assert got.sort_index().to_numpy() == pytest.approx(want.sort_index().to_numpy(), abs=1e-4)


@pytest.mark.parametrize("module, name, of", [(N, "null_model_test", "draws"), (A, "permutation_tests", "permutations")])
def test_queries_take_999_draws(spark, data, monkeypatch, module, name, of):
    import inspect

    import __spark_entry__

    f, seen = getattr(module, name), {}
    monkeypatch.setattr(module, name, lambda *a, **k: seen.update(inspect.signature(f).bind(*a, **k).arguments) or spark.range(1))
    __spark_entry__.queries()[name](spark, data)
    assert seen[of] == 999


def _sites(spark, n=30, s=5, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.poisson(3, (n, s)) + np.eye(n, s)
    m[n - 1] = m[0]  # equal sites, equal distances
    com = K.community(spark.createDataFrame([(f"s{i:02d}", f"t{j}", float(m[i, j])) for i in range(n) for j in range(s)], "site string, species string, n double"), "site", "species", "n")
    return m, com


def _bray(m):
    return np.abs(m[:, None] - m[None]).sum(-1) / (m.sum(1)[:, None] + m.sum(1)[None])


def test_packed_sites_never_travel_in_blocks(spark):
    _, com = _sites(spark)
    plan = D.distances(com, "jaccard")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Exchange" not in plan.split("Physical Plan")[-1].split("Range")[0]


@pytest.mark.parametrize("metric", ["bray_curtis", "jaccard", "hellinger", "euclidean"])
def test_distances_of_equal_sites_are_zero(spark, metric):
    _, com = _sites(spark)
    t = D.distances(com, metric).where("i = 's00' and j = 's29'").first()
    assert t["d"] == 0.0


def test_hellinger_of_proportional_sites_is_zero(spark):
    com = K.community(spark.createDataFrame([(s, f"t{k}", float(v * f)) for s, f in (("a", 1), ("b", 3), ("c", 7)) for k, v in enumerate((1, 5, 13, 2, 4))], "site string, species string, n double"), "site", "species", "n")
    assert max(r["d"] for r in D.distances(com, "hellinger").collect()) < 1e-12


def test_pair_sums_over_any_blocks(spark):
    from phytoscape.operators import sitepairs as B

    m, com = _sites(spark, 40)
    p = B.packed(com)
    assert sorted(B.block_pair(q) for q in range(10)) == [(a, b) for a in range(4) for b in range(a, 4)]
    whole = np.concatenate([B.between(p, 0, 0, "bray_curtis")[np.triu_indices(40, 1)]])
    o = np.argsort(p.site)
    assert np.allclose(B.between(p, 0, 0, "bray_curtis")[np.ix_(o, o)], _bray(m))
    assert np.allclose(np.sort(whole), np.sort(_bray(m)[np.triu_indices(40, 1)]))


def test_community_mantel_is_that_of_the_tables_also_beyond_3000_sites(spark, monkeypatch):
    m, com = _sites(spark)
    v, w = np.random.default_rng(2).normal(size=(2, 30))
    values = [spark.createDataFrame([(f"s{i:02d}", float(x[i])) for i in range(30)], "site string, value double") for x in (v, w)]
    gap = lambda x: spark.createDataFrame([(f"s{i:02d}", f"s{j:02d}", float(abs(x[i] - x[j]))) for i in range(30) for j in range(i + 1, 30)], "i string, j string, d double")
    d = D.distances(com)
    assert A.community_mantel(com, values[:1]).first()[0] == pytest.approx(A.mantel(d, gap(v)).first()[0])
    assert A.community_mantel(com, values).first()[0] == pytest.approx(A.partial_mantel(d, gap(v), gap(w)).first()[0])
    old, older = A.mantel_test(d, gap(v), 99).first(), A.mantel_test(d, gap(v), 99, d3=gap(w)).first()
    monkeypatch.setattr(O, "MOST_SITES", 10)  # a bound of the tables alone
    new, newer = A.community_mantel(com, values[:1], permutations=99).first(), A.community_mantel(com, values, permutations=99).first()
    assert (new["mantel_r"], new["p"]) == (pytest.approx(old["mantel_r"]), old["p"])
    assert (newer["mantel_r"], newer["p"]) == (pytest.approx(older["mantel_r"]), older["p"])


def test_community_group_tests_in_ranges(spark, monkeypatch):
    from phytoscape.operators import sitepairs as B

    _, com = _sites(spark)
    groups = spark.createDataFrame([(f"s{i:02d}", i % 3) for i in range(30)], "site string, grp long")
    monkeypatch.setattr(B, "RANGE_PAIRS", 50)
    assert tuple(A.community_group_tests(com, groups).first()) == pytest.approx(tuple(A.group_tests(D.distances(com).withColumn("d", F.round("d", 12)), groups).first()))


def test_nestedness_without_pairs_of_sites(spark):
    m, com = _sites(spark, 12, 6)
    m = (m > 0).astype(int)
    n = m.sum(1)
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12)]
    t = A._totals(com).first()
    assert t["shared"] == sum(int(m[i] @ m[j]) for i, j in pairs) and t["lesser"] == sum(min(n[i], n[j]) for i, j in pairs)
    assert t["overlap"] == pytest.approx(sum(100 * (m[i] @ m[j]) / min(n[i], n[j]) for i, j in pairs if n[i] != n[j]))
    assert A._turnover(com).first()[0] == pytest.approx(np.mean([(n[i] + n[j] - 2 * (m[i] @ m[j])) / (n[i] + n[j]) for i, j in pairs]))
    assert "FlatMapGroups" not in A.nodf(com)._jdf.queryExecution().toString()


def test_twinspan_beyond_the_bound_of_presences(spark, monkeypatch):
    from phytoscape.operators import twinspan as W

    _, com = _sites(spark, 40, 6)
    before = W.twinspan(com)
    monkeypatch.setattr(W, "MOST_CELLS", 10)
    monkeypatch.setattr(W, "ROWS", 7)
    after = W.twinspan(com)
    pd.testing.assert_frame_equal(after[0], before[0])
    pd.testing.assert_frame_equal(after[1], before[1])


def test_curves_of_more_than_100000_different_x(spark):
    from phytoscape.operators import temporal

    t = spark.range(100_001).select(F.lit("g").alias("g"), (F.col("id") / 100_001.0).alias("x")).withColumn("y", 2 * F.exp(0.5 * F.col("x")))
    r = temporal.fit_curves(t, "g", "x", "y", "exponential").first()
    assert r["n"] == 100_001 and r["params"] == pytest.approx([2.0, 0.5], rel=1e-4)


def test_exponential_rates_over_large_x(spark):
    from phytoscape.operators import temporal

    t = spark.range(200).select(F.lit("g").alias("g"), (F.col("id") * 1000).alias("x")).withColumn("y", 2 * F.exp(1e-5 * F.col("x")))
    r = temporal.fit_curves(t, "g", "x", "y", "exponential").first()
    assert r["params"] == pytest.approx([2.0, 1e-5], rel=1e-4) and r["r2"] > 0.9999


def test_nestedness_reads_the_community_once(spark, monkeypatch):
    _, com = _sites(spark, 40, 7)
    want = A.nodf(com).join(A.temperature(com)).join(A.c_score(com)).join(A.togetherness(com)).join(A.wine(com)).first().asDict()
    with monkeypatch.context() as m:
        m.setattr(A, "species_pairs", None)
        m.setattr(A, "temperature", None)
        assert A.nestedness(com).first().asDict() == pytest.approx(want)
    monkeypatch.setattr(A, "ROW_SPECIES", 3)
    assert A.nestedness(com).first().asDict() == pytest.approx(want)


def _no_pair_tables(monkeypatch):
    """Tables of pairs are an error."""
    def refuse(*a, **k):
        raise AssertionError("pairs as rows")
    for module, name in ((D, "distance_table"), (D, "pair_sums"), (A, "ranked"), (O, "square")):
        monkeypatch.setattr(module, name, refuse)


def test_community_spearman_makes_no_rows_of_pairs(spark, monkeypatch):
    from phytoscape.operators import sitepairs as B

    m, com = _sites(spark)
    v = np.random.default_rng(2).integers(0, 12, 30) / 3
    values = spark.createDataFrame([(f"s{i:02d}", float(v[i])) for i in range(30)], "site string, value double")
    i, j = np.triu_indices(30, 1)
    rank = lambda x: pd.Series(x).rank().to_numpy()
    want = np.corrcoef(rank(np.round(_bray(m)[i, j], 12)), rank(np.round(np.abs(v[i] - v[j]), 9)))[0, 1]
    with monkeypatch.context() as here:
        here.setattr(B, "BLOCK", 8)
        _no_pair_tables(here)
        assert A.community_spearman(com, values).first()[0] == pytest.approx(want, abs=1e-12)
        here.setattr(B, "RANGE_PAIRS", 60)  # ranges, and merges of equal distances within them
        here.setattr(B, "STEP", 36)
        assert A.community_spearman(com, values).first()[0] == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(B, "MOST_LEVELS", 3)  # tables beyond it
    assert A.community_spearman(com, values).first()[0] == pytest.approx(want, abs=1e-12)


def test_permutation_tests_of_a_community_make_no_rows_of_pairs(spark, monkeypatch):
    from fractions import Fraction

    from phytoscape.operators import sitepairs as B

    m, com = _sites(spark)
    groups = spark.createDataFrame([(f"s{i:02d}", "abc"[i % 3] if i != 7 else None) for i in range(30)] + [("none", "a")], "site string, grp string")
    known = groups.where("site <> 'none' and grp is not null")
    old = A.permutation_tests(D.distances(com), known, 99).first()
    monkeypatch.setattr(B, "BLOCK", 8)
    _no_pair_tables(monkeypatch)
    new = A.permutation_tests(com, groups, 99).first()
    assert [v for k, v in new.asDict().items() if k != "anosim_p"] == pytest.approx([v for k, v in old.asDict().items() if k != "anosim_p"])
    assert new["anosim_p"] == 1 == pytest.approx(old["anosim_p"], abs=0.05)  # tables round R off by more than 1e-12
    # R as scaled here, by exact ranks: the same for all labels of equal sizes
    keep = [i for i in range(30) if i != 7]
    i, j = np.triu_indices(29, 1)
    rank = [Fraction(x) for x in pd.Series(np.round(_bray(m)[np.ix_(keep, keep)][i, j], 12)).rank()]
    for q in range(5):
        g = np.random.default_rng(q).permutation([k % 3 for k in keep])
        w = g[i] == g[j]
        mw, mb = (sum(r for r, k in zip(rank, w) if k == side) / int((w == side).sum()) for side in (True, False))
        assert (mb - mw) / (len(rank) + 1 - mw - mb) == Fraction(len(rank), len(rank) - 2 * int(w.sum())) == pytest.approx(new["anosim_r"])


def test_draws_of_mantel_by_singles_are_settled_by_doubles(spark, monkeypatch):
    from phytoscape.operators import sitepairs as B

    _, com = _sites(spark)
    v = np.random.default_rng(2).normal(size=30)
    values = [spark.createDataFrame([(f"s{i:02d}", float(v[i])) for i in range(30)], "site string, value double")]
    p, x = A._valued(com, values)
    one, two = (B.permuted_products(spark, p, x, 0.5, [*range(20)], 42, kind=k) for k in (np.float32, np.float64))
    assert one == pytest.approx(two, rel=1e-4, abs=1e-3) and (one != two).any()
    seen = []
    monkeypatch.setattr(B, "permuted_products", lambda *a, f=B.permuted_products: seen.append((len(a[4]), a[7])) or f(*a))
    want = A.community_mantel(com, values, permutations=99).first()
    assert seen[0] == (99, np.float32)
    monkeypatch.setattr(A, "SINGLE", 9.0)  # all are drawn again
    assert tuple(A.community_mantel(com, values, permutations=99).first()) == tuple(want) and seen[-1] == (99, np.float64)


@pytest.mark.parametrize("eps, least", [(0.1, 3), (0.18, 4), (0.22, 9), (0.9, 4), (0.0, 2)])
def test_community_dbscan_makes_no_rows_of_pairs(spark, monkeypatch, eps, least):
    from phytoscape.operators import sitepairs as B

    rng = np.random.default_rng(5)
    m = np.concatenate([rng.poisson(c, (14, 5)) for c in ([9, 1, 1, 4, 0], [1, 9, 3, 0, 2], [40, 5, 5, 20, 1], [4, 4, 4, 4, 4])]) + 1
    m[3] = m[40]
    names = [f"s{k:02d}" for k in rng.permutation(len(m))]
    com = spark.createDataFrame([(names[i], f"t{j}", float(m[i, j])) for i in range(len(m)) for j in range(5)], "site string, species string, abundance double")
    want = {r["site"]: (r["cluster"], r["core"]) for r in C.dbscan(D.distances(com), com.select("site").distinct(), eps, least).collect()}
    monkeypatch.setattr(B, "BLOCK", 4)
    _no_pair_tables(monkeypatch)
    assert {r["site"]: (r["cluster"], r["core"]) for r in C.community_dbscan(com, eps, least).collect()} == want


def test_draws_of_partial_mantel_near_the_seen_one_are_settled_by_doubles(spark, monkeypatch):
    from phytoscape.operators import sitepairs as B

    _, com = _sites(spark)
    v = np.random.default_rng(3).normal(size=30)
    values = [spark.createDataFrame([(f"s{i:02d}", float(x[i])) for i in range(30)], "site string, value double") for x in (v, v + np.random.default_rng(4).normal(size=30) / 50)]
    seen = []
    monkeypatch.setattr(B, "permuted_products", lambda *a, f=B.permuted_products: seen.append((len(a[4]), a[7])) or f(*a))
    got = A.community_mantel(com, values, permutations=199).first()
    # the values are nearly alike, so that their own correlation widens what singles leave open
    assert seen[0] == (199, np.float32) and seen[1][1] is np.float64 and 0 < seen[1][0] <= 199
    monkeypatch.setattr(A, "SINGLE", 9.0)
    assert tuple(A.community_mantel(com, values, permutations=199).first()) == tuple(got) and seen[-1] == (199, np.float64)


def test_tree_of_a_community_beyond_3000_sites_is_that_of_its_distances(spark, monkeypatch):
    from phytoscape.operators import sitepairs as B
    from phytoscape.operators import sitetrees

    rng = np.random.default_rng(8)
    x = rng.gamma(0.7, 20, (90, 6)) + 0.1
    com = K.community(spark.createDataFrame([(f"s{i:02d}", f"t{j}", float(x[i, j])) for i in range(90) for j in range(6)], "site string, species string, n double"), "site", "species", "n")
    d = D.distances(com)
    merges, labels = C.hierarchical(d, "average", 4)
    monkeypatch.setattr(O, "MOST_SITES", 10)
    monkeypatch.setattr(sitetrees, "MOST_SITES", 10)
    got, own = C.community_hierarchical(com, "average", 4)
    assert np.allclose(got, merges) and own.equals(labels)
    p = B.packed(com)
    for m in sitetrees.METHODS:  # rows are dropped and made again
        assert np.allclose(sitetrees.chain(p, m, held_bytes=1), sitetrees.chain(p, m))


def test_cophenetic_of_a_community_beyond_3000_sites_is_that_of_its_distances(spark, monkeypatch):
    from phytoscape.operators import sitepairs as B
    from phytoscape.operators import sitetrees

    rng = np.random.default_rng(9)
    x = rng.gamma(0.7, 20, (70, 6)) + 0.1
    com = K.community(spark.createDataFrame([(f"s{i:02d}", f"t{j}", float(x[i, j])) for i in range(70) for j in range(6)], "site string, species string, n double"), "site", "species", "n")
    d = D.distances(com)
    want = {m: C.cophenetic_correlation(d, m) for m in ("average", "single", "complete", "ward")}
    monkeypatch.setattr(O, "MOST_SITES", 10)
    monkeypatch.setattr(sitetrees, "MOST_SITES", 10)
    monkeypatch.setattr(B, "BLOCK", 16)  # several blocks, whose leaves meet across them
    assert C.community_cophenetic(com) == pytest.approx(want)


def test_shared_abundances_above_half_of_16_bits_do_not_wrap(spark):
    com = K.community(spark.createDataFrame([("a", "t", 40_000.0), ("b", "t", 40_000.0), ("b", "u", 8_000.0)], "site string, species string, n double"), "site", "species", "n")
    assert D.distances(com).first()["d"] == pytest.approx(1 - 80_000 / 88_000)
