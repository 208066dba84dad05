import math

import pytest

from phytoscape import community as K
from phytoscape.operators import association as A
from phytoscape.operators import distances as D
from phytoscape.operators import diversity as V
from phytoscape.operators.transforms import METHODS, transform

ROWS = {"A": [10, 5, 0, 8, 0], "B": [5, 10, 15, 2, 0], "C": [0, 5, 5, 0, 20], "D": [2, 0, 10, 5, 5], "E": [0, 0, 0, 15, 10]}


@pytest.fixture(scope="module")
def com(spark):
    return K.community(spark.createDataFrame([(s, f"sp{i}", float(x)) for s, v in ROWS.items() for i, x in enumerate(v)], "site string, species string, abundance double"), "site", "species", "abundance").cache()


def test_indices_by_hand(com):
    got = {r["site"]: r for r in V.indices(com).collect()}
    for s, v in ROWS.items():
        n, x = sum(v), [a for a in v if a]
        h = -sum(a / n * math.log(a / n) for a in x)
        assert got[s]["shannon"] == pytest.approx(h)
        assert got[s]["simpson"] == pytest.approx(sum((a / n) ** 2 for a in x))
        assert got[s]["richness"] == len(x)
        assert got[s]["evenness"] == pytest.approx(h / math.log(len(x)))
        assert got[s]["chao1"] >= len(x)
        assert got[s]["brillouin"] == pytest.approx((math.lgamma(n + 1) - sum(math.lgamma(a + 1) for a in x)) / n)
        alpha = got[s]["fisher_alpha"]
        assert abs(len(x) / math.log(1 + n / alpha) - alpha) < 1e-5


def test_empty_sites_and_dirty_rows(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "x", 3.0), ("a", None, 1.0), (None, "x", 1.0), ("b", "x", None), ("b", "y", float("nan")), ("b", "z", -4.0)], "site string, species string, n double")
    com = K.community(df, "site", "species", "n")
    assert [tuple(r) for r in com.collect()] == [("a", "x", 5.0)]
    got = {r["site"]: r for r in V.indices(com, sites=K.sites_of(df, "site")).collect()}
    assert got["b"]["shannon"] == 0 and got["b"]["richness"] == 0 and got["b"]["simpson_inverse"] is None
    none = com.limit(0)
    assert V.indices(none).count() == 0 and D.distances(none).count() == 0 and V.rarefaction(none).count() == 0


def test_unknown_names(com):
    with pytest.raises(ValueError, match="Unknown diversity index"):
        V.indices(com, ["nope"])
    with pytest.raises(ValueError):
        D.distances(com, "nope")
    with pytest.raises(ValueError):
        transform(com, "nope")


def test_hill_decreases(com):
    rows = V.hill_numbers(com, (0, 1, 2)).collect()
    for s in ROWS:
        h = [r["hill"] for r in sorted((r for r in rows if r["site"] == s), key=lambda r: r["q"])]
        assert h[0] >= h[1] >= h[2] > 0


def test_rarefaction_reaches_richness(com):
    rows = [r for r in V.rarefaction(com, 1000).collect() if r["site"] == "E"]
    assert max(r["sample_size"] for r in rows) == 25
    assert max(rows, key=lambda r: r["sample_size"])["expected_species"] == pytest.approx(2, abs=1e-6)
    assert min(rows, key=lambda r: r["sample_size"])["expected_species"] == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("metric", ["bray_curtis", "jaccard", "sorensen", "euclidean", "manhattan", "canberra", "chord", "hellinger"])
def test_distances_by_hand(com, metric):
    def by_hand(x, y):
        n, m = sum(x), sum(y)
        both, any_ = sum(a > 0 and b > 0 for a, b in zip(x, y)), sum(a > 0 or b > 0 for a, b in zip(x, y))
        l2 = lambda u, v: math.sqrt(sum((a - b) ** 2 for a, b in zip(u, v)))
        return {
            "bray_curtis": sum(abs(a - b) for a, b in zip(x, y)) / (n + m), "jaccard": 1 - both / any_, "sorensen": 1 - 2 * both / (sum(a > 0 for a in x) + sum(b > 0 for b in y)), "euclidean": l2(x, y),
            "manhattan": sum(abs(a - b) for a, b in zip(x, y)), "canberra": sum(abs(a - b) / (a + b) for a, b in zip(x, y) if a + b),
            "chord": l2([a / l2(x, [0] * 5) for a in x], [b / l2(y, [0] * 5) for b in y]), "hellinger": l2([math.sqrt(a / n) for a in x], [math.sqrt(b / m) for b in y]),
        }[metric]
    rows = D.distances(com, metric).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["d"] == pytest.approx(by_hand(ROWS[r["i"]], ROWS[r["j"]]), abs=1e-9)


@pytest.mark.parametrize("method", list(METHODS))
def test_transforms_are_finite(com, method):
    assert all(math.isfinite(r["value"]) for r in transform(com, method).collect())


def test_partitions_do_not_matter(com):
    a = {tuple(r) for r in D.distances(com.repartition(3)).collect()}
    assert {(i, j, round(d, 9)) for i, j, d in a} == {(r[0], r[1], round(r[2], 9)) for r in D.distances(com.coalesce(1)).collect()}


def test_permutations(com, spark):
    groups = spark.createDataFrame([(s, i % 2) for i, s in enumerate(ROWS)], "site string, grp long")
    r = A.permutation_tests(D.distances(com), groups, 19).first()
    o = A.group_tests(D.distances(com), groups).first()
    assert r["pseudo_f"] == pytest.approx(o["pseudo_f"]) and 0 < r["permanova_p"] <= 1 and 0 < r["mrpp_p"] <= 1


def test_block_sums_equal_joined_sums(com, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 2)
    cols = sorted(D.pair_sums(com).columns)
    a = sorted(tuple(round(float(v), 9) if not isinstance(v, str) else v for v in r) for r in D.pair_sums(com).select(*cols).collect())
    b = sorted(tuple(round(float(v), 9) if not isinstance(v, str) else v for v in r) for r in D._joined_sums(com, ("mn", "xy", "a", "cb", "hp")).select(*cols).collect())
    assert a == b and len(a) == 10
