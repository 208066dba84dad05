import math
import random

import pytest

from phytoscape.operators import geometry as G
from phytoscape.operators.hotdeck import Field, HotDeck, filled_table, hot_deck
from phytoscape.operators.nearby import keys_in_regions, near_keys, near_or_inside, positions
from phytoscape.operators.profile import Limits, control_limits, load_findings, merge_states, profile_metrics, profile_states, value_states


def haversine(a, b):
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def even_odd(text, x, y):
    n = 0
    for part in G.parse_wkt(text):
        for ring in part:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


STAR = "POLYGON ((0 0, 4 1, 8 0, 7 4, 8 8, 4 7, 0 8, 1 4, 0 0), (3 3, 5 3, 5 5, 3 5, 3 3))"


def test_ear_clipping_covers_the_ring():
    for part in G.parse_wkt(STAR):
        for ring in part:
            area = abs(sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring)))) / 2
            got = sum(((t[2] - t[0]) * (t[5] - t[1]) - (t[3] - t[1]) * (t[4] - t[0])) / 2 for t in G.ear_clip(ring))
            assert got == pytest.approx(area)


@pytest.mark.parametrize("text", [None, "", "POINT (1 2)", "POLYGON EMPTY", "POLYGON ((0 0, 1 1))", "POLYGON ((0 0, 1"])
def test_bad_boundaries(text):
    assert G.triangulate(text) == []


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_regions_match_even_odd(spark, limit):
    rnd = random.Random(1)
    pts = [(f"s{i % 40}", rnd.uniform(-1, 9), rnd.uniform(-1, 9)) for i in range(400)]
    regions = spark.createDataFrame([("star", STAR), ("two", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((5 5, 9 5, 9 9, 5 5)))"), ("none", None)], "area string, wkt string")
    df = positions(spark.createDataFrame(pts, "site string, lat double, lon double"), "site", "lat", "lon")
    got = {tuple(r) for r in keys_in_regions(df, regions, "area", "wkt", broadcast_bytes=limit, tile_triangles=4, chunk_rows=50).collect()}
    want = {(a, s) for a, w in regions.collect() for s, y, x in pts if w and even_odd(w, x, y)}
    assert got == want


def test_borders_belong_to_regions_and_holes_do_not(spark):
    df = positions(spark.createDataFrame([("corner", 0.0, 0.0), ("hole", 4.0, 4.0), ("rim", 3.0, 4.0), ("in", 2.0, 2.0), ("diagonal", 1.0, 4.0)], "site string, lat double, lon double"), "site", "lat", "lon")
    got = {r["k"] for r in keys_in_regions(df, spark.createDataFrame([("a", STAR)], "area string, wkt string"), "area", "wkt").collect()}
    assert got == {"corner", "rim", "in", "diagonal"}


def test_near_keys_against_brute_force(spark):
    rnd = random.Random(2)
    pts = []
    for i in range(120):
        y, x = 45 + rnd.uniform(0, 0.01), -70 + rnd.uniform(0, 0.015)
        pts += [(f"s{i:03d}", y + rnd.gauss(0, 5e-5), x + rnd.gauss(0, 5e-5)) for _ in range(rnd.choice([1, 2, 6]))]
    pts += [("hot", 45.005 + rnd.gauss(0, 4e-5), -69.99 + rnd.gauss(0, 4e-5)) for _ in range(300)]
    pts += [("east", 10.0, 179.9999), ("west", 10.0, -179.9999), ("nan", float("nan"), 1.0), ("null", None, 1.0), (None, 45.0, -70.0)]
    got = {tuple(r) for r in near_keys(positions(spark.createDataFrame(pts, "site string, lat double, lon double"), "site", "lat", "lon"), 100.0).collect()}
    good = [p for p in pts if p[0] and p[1] is not None and not math.isnan(p[1])]
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and haversine(a[1:], b[1:]) <= 100}
    assert got == want and ("east", "west") in got


def test_near_keys_at_the_poles_and_in_crowded_cells(spark, monkeypatch):
    from phytoscape.operators import nearby

    monkeypatch.setattr(nearby, "MOST_PAIRS", 50)
    rnd = random.Random(3)
    pts = [(f"p{i}", 90 - rnd.uniform(0, 0.004), rnd.uniform(-180, 180)) for i in range(40)] + [(f"q{i}", rnd.choice([88.999, 89.0, 89.001]) + rnd.gauss(0, 1e-3), rnd.uniform(-0.1, 0.1)) for i in range(40)]
    pts += [(f"h{i % 2}", 45 + i % 2 * 0.0008993 + rnd.gauss(0, 1e-6), 7 + rnd.gauss(0, 1e-6)) for i in range(120)]
    got = {tuple(r) for r in near_keys(positions(spark.createDataFrame(pts, "site string, lat double, lon double"), "site", "lat", "lon"), 100.0).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and haversine(a[1:], b[1:]) <= 100}
    assert got == want and len({p for p in got if p[0][0] == "p"}) > 20


def test_empty_points(spark):
    none = spark.createDataFrame([], "site string, lat double, lon double")
    regions = spark.createDataFrame([("a", STAR)], "area string, wkt string")
    assert near_or_inside(positions(none, "site", "lat", "lon"), regions, "area", "wkt").count() == 0


DECK = HotDeck("id", "site", "day", "arrived", (Field("ph", 2, 11), Field("kind", values=("fen", "heath"))), numeric=(("height", 500.0),), categorical=("use",), band=("height", 250.0), donors=2, chunk_rows=4)


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, site string, day string, arrived long, ph double, kind string, height double, use string, near string, field string").withColumn("day", __import__("pyspark.sql.functions", fromlist=["x"]).to_date("day"))


def test_hot_deck(spark):
    rows = [(i, "a", f"2020-01-{i + 1:02d}", 1, 5.0 + i, " Fen ", 10.0, "u", "x", "y") for i in range(10)]
    rows += [(20, "a", "2020-01-06", 1, None, "?", 10.0, "u", "x", "y"), (20, "a", "2020-01-06", 2, 99.0, None, 10.0, "u", "x", "y"), (21, "b", None, 1, float("nan"), "heath", None, None, None, None), (22, None, "2020-02-01", 1, None, None, 10.0, "u", None, None), (None, "a", "2020-01-01", 1, 7.0, "fen", 1.0, "u", None, None)]
    got = {(r["key"], r["field"]): r for r in hot_deck(table(spark, rows), DECK).collect()}
    assert set(got) == {(20, "ph"), (20, "kind"), (21, "ph"), (22, "ph"), (22, "kind"), *((i, "ph") for i in range(7, 10))}
    assert got[20, "ph"]["block"] == "group" and got[20, "ph"]["num"] in (9.0, 10.0, 11.0) and got[20, "kind"]["cat"] == "fen" and len(got[20, "ph"]["donors"]) <= 3
    assert got[21, "ph"]["block"] != "group" and got[22, "kind"]["block"] == "season_features"
    full = {r["id"]: r for r in filled_table(table(spark, rows), DECK).collect()}
    assert full[20]["ph_filled"] and not full[0]["ph_filled"] and len(full) == 13
    assert hot_deck(table(spark, rows).limit(0), DECK, only="group").count() == 0


@pytest.mark.parametrize("chunk", [1_000, 6])
def test_hot_deck_values_by_hand(spark, chunk):
    """Values, donors and all against a plain search; with small chunks every cell still gets donors of both sides."""
    import datetime

    rnd = random.Random(5)
    rows = []
    for i in range(90):
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=rnd.randrange(300))
        rows.append((i, rnd.choice("ab"), str(day), 1, rnd.choice([None, None, round(rnd.uniform(3, 8), 2)]), rnd.choice([None, "fen", "heath"]), rnd.choice([None, rnd.uniform(0, 900)]), rnd.choice(["u", "v", None]), "x", "y"))
    deck = HotDeck("id", "site", "day", "arrived", (Field("ph", 2, 11), Field("kind", values=("fen", "heath"))), numeric=(("height", 500.0),), categorical=("use",), band=("height", 250.0), donors=2, chunk_rows=chunk)
    got = {(r["key"], r["field"]): r for r in hot_deck(table(spark, rows), deck, only="group").collect()}
    want = 0
    for name, at in (("ph", 4), ("kind", 5)):
        for r in rows:
            if r[at] is not None:
                continue
            own = sorted((o for o in rows if o[1] == r[1] and o[at] is not None), key=lambda o: (o[2], o[0]))
            if not own:
                continue
            want += 1
            before = [o for o in own if (o[2], o[0]) < (r[2], r[0])][-2:]
            after = [o for o in own if (o[2], o[0]) > (r[2], r[0])][:2]

            def gap(o):
                days = abs((datetime.date.fromisoformat(o[2]) - datetime.date.fromisoformat(r[2])).days)
                parts = [min(1.0, days / 365.0)]
                if o[6] is not None and r[6] is not None:
                    parts.append(min(1.0, abs(o[6] - r[6]) / 500.0))
                if o[7] is not None and r[7] is not None:
                    parts.append(0.0 if o[7] == r[7] else 1.0)
                return sum(parts) / len(parts)

            near = sorted(before + after, key=lambda o: (gap(o), o[0]))[:3]
            if chunk == 6:
                assert got[r[0], name]["donors"]
                continue
            assert list(got[r[0], name]["donors"]) == [o[0] for o in near]
            w = [round(1 / (0.05 + gap(o)), 9) for o in near]
            if name == "ph":
                total, upto = sum(w), 0.0
                for o, x in sorted(zip(near, w), key=lambda p: (p[0][4], p[0][0])):
                    upto += x
                    if upto >= total / 2:
                        break
                assert got[r[0], name]["num"] == o[4]
            else:
                votes = {}
                for o, x in zip(near, w):
                    votes[o[5]] = votes.get(o[5], 0) + x
                assert got[r[0], name]["cat"] == max(votes, key=lambda k: (round(votes[k], 6), k))
    assert len(got) == want


def test_findings(spark):
    rows = [("s", 1, float(40 + i % 10), "V2020-000001") for i in range(50)] + [("s", 2, 49.0 if i % 2 else None, "bad" if i < 5 else "V2020-000001\n" if i == 6 else "V2020-000001") for i in range(50)] + [("s", 4, 60.0, None), (None, 1, 41.0, "V"), ("s", None, 41.0, "V")]
    got = {tuple(r) for r in load_findings(spark.createDataFrame(rows, "series string, no int, lat double, code string"), "series", "no", [Limits("lat", 40, 50, 0.01)], ("code", r"V[0-9]{4}-[0-9]{6}")).collect()}
    assert got == {("s", 2, "lat", "missing"), ("s", 2, "lat", "shift"), ("s", 2, "lat", "distinct"), ("s", 2, "code", "pattern"), ("s", 4, "lat", "range")}


def test_profile_states_merge(spark):
    df = spark.createDataFrame([("a", i % 2, float(i), f"x{i % 3}", None) for i in range(100)] + [("a", 0, float("nan"), None, None)], "load string, part int, v double, t string, n string")
    whole = {r["column_name"]: r for r in profile_metrics(profile_states(df, ["load"], ["v", "t", "n"], {"t": "x[0-1]"}), ["load"]).collect()}
    parts = profile_states(df, ["load", "part"], ["v", "t", "n"], {"t": "x[0-1]"})
    merged = {r["column_name"]: r for r in profile_metrics(merge_states(parts, ["load"]), ["load"]).collect()}
    for c in ("v", "t", "n"):
        assert whole[c]["n"] == merged[c]["n"] == 101 and whole[c]["missing_share"] == merged[c]["missing_share"] and whole[c]["distinct_values"] == merged[c]["distinct_values"] and whole[c]["lowest"] == merged[c]["lowest"]
    assert whole["v"]["distinct_values"] == 100 and whole["n"]["missing_share"] == 1 and whole["t"]["off_form_share"] == pytest.approx(33 / 100)


def test_stored_states_add_up(spark):
    rows = [("s", i % 3 + 1, float(40 + i % (3 + i % 5)), "V2020-000001" if i % 9 else "?", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "series string, no int, lat double, code string, part int")
    limits, form = [Limits("lat", 40, 50, 0.01)], ("code", r"V[0-9]{4}-[0-9]{6}")
    stored = value_states(df.where("part = 0"), "series", "no", limits, form)
    whole = {tuple(r) for r in load_findings(df, "series", "no", limits, form).collect()}
    assert whole and {tuple(r) for r in load_findings(df.where("part = 1"), "series", "no", limits, form, stored=stored).collect()} == whole


def test_control_limits_of_short_histories(spark):
    m = spark.createDataFrame([("s", 1, "c", 10, 1.0), ("s", 2, "c", 30, 1.1), ("t", 1, "c", 5, None)], "series string, no int, column_name string, n long, mean double")
    assert [(r["no"], r["metric"]) for r in control_limits(m, "series", "no").collect()] == [(2, "n")]


def test_control_limits(spark):
    m = spark.createDataFrame([("s", i, "c", 0.1 + 0.001 * (i % 2), 5, 1.0, 1.0) for i in range(6)] + [("s", 6, "c", 0.9, 5, 1.0, 1.0)], "series string, no int, column_name string, missing_share double, distinct_values long, mean double, median double")
    assert [(r["no"], r["metric"]) for r in control_limits(m, "series", "no").collect()] == [(6, "missing_share")]
