"""Points near other points, and points inside regions.

``near_keys`` finds the pairs of keys (sites) of which any two positions lie
within a distance. Positions are summarised to small boxes per key before any
join, so a key that holds a large share of the rows costs as many boxes as it
covers ground; bounds on the distance between boxes settle almost all pairs,
the rest is settled on finer boxes and finally on positions.

``keys_in_regions`` triangulates region boundaries by ear clipping and tests
positions against the triangles through a bounding-volume hierarchy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phytoscape.operators.geometry import TriangleTree, triangulate
from phytoscape.session import materialise, parallelism

EARTH_RADIUS_M = 6_371_000.0
#: Bytes of triangles up to which the hierarchy is sent to every task; beyond it, triangles and points are distributed by tiles.
BROADCAST_BYTES = 32 << 20
#: Boxes (key and cell, some 60 bytes each) up to which the open ones are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Pairs of positions that may be compared in the end; while there are more, boxes are cut finer, down to a millimetre.
MOST_PAIRS = 20_000_000
_TRIANGLE_BYTES = 6 * 8 + 8 + 2 + 40


def positions(df: DataFrame, key: str, lat: str, lon: str, lat_range=(-90.0, 90.0), lon_range=(-180.0, 180.0)) -> DataFrame:
    """Different usable positions as (k, y, x). Rows with a missing key, a missing or NaN coordinate or one out of range are left out."""
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    return (
        df.select(F.col(key).alias("k"), y.alias("y"), x.alias("x"))
        .where(F.col("k").isNotNull() & F.col("y").between(*map(float, lat_range)) & F.col("x").between(*map(float, lon_range)) & ~F.isnan("y") & ~F.isnan("x"))
    )


def haversine_m(y1, x1, y2, x2) -> Column:
    """Great-circle distance in metres of positions in degrees."""
    y1, x1, y2, x2 = (F.col(c) if isinstance(c, str) else c for c in (y1, x1, y2, x2))
    h = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _box_bounds(radius_m: float) -> tuple[Column, Column]:
    """Whether two boxes (a_y0, a_y1, a_x0, a_x1 and b_...) lie wholly within the radius, and whether they may reach it.

    The haversine grows with both differences and with the cosines, so the
    extreme values of each bound it.
    """
    c = F.col
    dy_near = F.greatest(F.lit(0.0), c("a_y0") - c("b_y1"), c("b_y0") - c("a_y1"))
    dy_far = F.greatest(c("a_y1") - c("b_y0"), c("b_y1") - c("a_y0"))
    mid = F.abs((c("a_x0") + c("a_x1")) / 2 - (c("b_x0") + c("b_x1")) / 2)
    mid = F.least(mid, 360 - mid)
    half = (c("a_x1") - c("a_x0") + c("b_x1") - c("b_x0")) / 2
    dx_near, dx_far = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(180.0), mid + half)

    def cosines(far: bool) -> Column:
        def of(s: str) -> Column:
            big = F.greatest(F.abs(c(f"{s}_y0")), F.abs(c(f"{s}_y1")))
            small = F.when(c(f"{s}_y0") * c(f"{s}_y1") <= 0, F.lit(0.0)).otherwise(F.least(F.abs(c(f"{s}_y0")), F.abs(c(f"{s}_y1"))))
            return F.cos(F.radians(small if far else big))
        return of("a") * of("b")

    def metres(dy: Column, dx: Column, cos: Column) -> Column:
        h = F.pow(F.sin(F.radians(dy) / 2), 2) + cos * F.pow(F.sin(F.radians(dx) / 2), 2)
        return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

    slack = 1e-6  # metres, above the rounding of the formulas
    return metres(dy_far, dx_far, cosines(True)) <= radius_m - slack, metres(dy_near, dx_near, cosines(False)) <= radius_m + slack


def _boxes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def _side(df: DataFrame, s: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{s}_{c}") for c in [*keep, "y0", "y1", "x0", "x1"]])


def near_keys(points: DataFrame, radius_m: float) -> DataFrame:
    """Distinct pairs (key_a < key_b) of which any two positions lie at most ``radius_m`` apart.

    points: (k, y, x) of ``positions``. An empty table gives no pair; equal
    positions of one key are one position; a key is never paired with itself.
    The radius must be below a quarter of the way around the earth.
    """
    if not 0 < radius_m < 9_000_000:
        raise ValueError("the radius must lie between 0 and 9,000 km")
    fine = radius_m / 8
    step = 180.0 / np.pi / EARTH_RADIUS_M
    # the width in longitude of a cell is set by the band of one degree it lies in
    cos = F.cos(F.radians(F.least(F.lit(89.5), F.abs(F.floor("y") + 0.5))))
    cell = lambda size: (F.floor(F.col("y") / (size * step)), F.floor(F.col("x") * cos / (size * step)))
    # a box is known by a hash of its cell: were two cells to share one, their box would only be larger
    cells = points.select(
        "*", F.xxhash64(F.floor("y"), *cell(fine)).alias("c1"),
        F.col("y").alias("y0"), F.col("y").alias("y1"), F.col("x").alias("x0"), F.col("x").alias("x1"),
    )
    one = ["k", "c1"]
    boxes1 = _boxes(cells, one)

    # a box lives in the coarse cell of its lower corner and is looked for in all cells where a near box's corner can be
    high = 4 * radius_m * step  # wide enough that few boxes are looked for in several cells
    near = radius_m * step * 1.000001
    row = lambda y: F.floor(y / high)

    def width(r: Column) -> Column:
        """Width of the columns of a row of cells; a row that reaches beyond 89 degrees is one column."""
        top = F.greatest(F.abs(r), F.abs(r + 1)) * high
        return F.when(top >= 89, F.lit(360.0)).otherwise(F.least(F.lit(360.0), high / F.cos(F.radians(top))))

    home = boxes1.withColumn("r", row(F.col("y0"))).withColumn("c", F.pmod(F.floor((F.col("x0") + 180) / width(F.col("r"))), F.ceil(360.0 / width(F.col("r")))))
    pad = near + fine * step * 2
    probe = (
        boxes1.withColumn("r", F.explode(F.sequence(row(F.col("y0") - pad), row(F.col("y1") + near))))
        .withColumn("w", width(F.col("r")))
        .withColumn("top", F.greatest(F.abs("y0"), F.abs("y1")) + high * 2)
        .withColumn("reach", F.when(F.col("top") >= 89, F.lit(180.0)).otherwise(F.least(F.lit(180.0), (radius_m * 1.000001 + 2 * fine) * step / F.cos(F.radians("top")))))
        .withColumn("c", F.explode(F.sequence(F.floor((F.col("x0") - F.col("reach") + 180) / F.col("w")), F.floor((F.col("x1") + F.col("reach") + 180) / F.col("w")))))
        .withColumn("c", F.pmod(F.col("c"), F.ceil(360.0 / F.col("w"))))
        .drop("w", "reach", "top")
    )
    sure, maybe = _box_bounds(radius_m)
    pairs = (
        _side(home, "a", [*one, "r", "c"])
        .join(_side(probe, "b", [*one, "r", "c"]), (F.col("a_r") == F.col("b_r")) & (F.col("a_c") == F.col("b_c")) & (F.col("a_k") < F.col("b_k")))
        .where(maybe)
        .withColumn("sure", sure)
    )
    on = lambda s, cols: [f"{s}_{c}" for c in cols]
    pairs = materialise(pairs.select("a_k", "a_c1", "b_k", "b_c1", "sure"))
    known = pairs.where("sure").select("a_k", "b_k").distinct()
    open_ = pairs.where("not sure").select("a_k", "a_c1", "b_k", "b_c1").distinct().join(known, ["a_k", "b_k"], "left_anti")
    # what is open is settled on ever finer boxes of its own positions alone, and at last on the positions
    spots, size = cells.select(*one, "y", "x", "y0", "y1", "x0", "x1"), radius_m
    while True:
        open_ = materialise(open_)
        need = materialise(open_.select(F.col("a_k").alias("k"), F.col("a_c1").alias("c1")).union(open_.select("b_k", "b_c1")).distinct())
        few = need.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        spots = spots.join(F.broadcast(need) if few else need, one, "left_semi").distinct()
        held = spots.groupBy(*one).agg(F.count("*").alias("n"))
        named = lambda df, s, cols: df.select(*[F.col(c).alias(f"{s}_{c}") for c in cols])
        work = open_.join(named(held, "a", [*one, "n"]), on("a", one)).join(named(held, "b", [*one, "n"]), on("b", one)).agg(F.sum(F.col("a_n").cast("double") * F.col("b_n"))).first()[0] or 0
        if size < radius_m and (work <= MOST_PAIRS or size < 0.001):
            break
        size /= 128 if size == radius_m else 16
        spots = materialise(spots.withColumn("c2", F.xxhash64("c1", F.floor("y"), *cell(size))))
        boxes2 = _boxes(spots, [*one, "c2"])
        finer = (
            open_.join(_side(boxes2, "a", [*one, "c2"]), on("a", one)).join(_side(boxes2, "b", [*one, "c2"]), on("b", one))
            .where(maybe).withColumn("sure", sure)
        )
        finer = materialise(finer.select("a_k", F.col("a_c2").alias("a_c1"), "b_k", F.col("b_c2").alias("b_c1"), "sure"))
        found = finer.where("sure").select("a_k", "b_k").distinct()
        known = known.union(found)
        open_ = finer.where("not sure").select("a_k", "a_c1", "b_k", "b_c1").distinct().join(found, ["a_k", "b_k"], "left_anti")
        spots = spots.select("k", F.col("c2").alias("c1"), "y", "x", "y0", "y1", "x0", "x1")
    exact = (
        open_.join(named(spots, "a", [*one, "y", "x"]), on("a", one)).join(named(spots, "b", [*one, "y", "x"]), on("b", one))
        .where(haversine_m("a_y", "a_x", "b_y", "b_x") <= radius_m).select("a_k", "b_k")
    )
    return known.union(exact).distinct().select(F.col("a_k").alias("key_a"), F.col("b_k").alias("key_b"))


_TRIANGLES = "region string, part int, hole boolean, ax double, ay double, bx double, by double, cx double, cy double, edges int"


def region_triangles(regions: DataFrame, name: str, wkt: str) -> DataFrame:
    """Triangles of all boundaries, by ear clipping. Missing or malformed boundaries give none."""

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, h, *t) for r, w in zip(b["region"], b["wkt"]) if r is not None for p, h, t in triangulate(w)]
            yield pd.DataFrame(rows, columns=["region", "part", "hole", "ax", "ay", "bx", "by", "cx", "cy", "edges"])

    return regions.select(F.col(name).cast("string").alias("region"), F.col(wkt).alias("wkt")).mapInPandas(clip, _TRIANGLES)


def _tree(t: pd.DataFrame) -> tuple[TriangleTree, np.ndarray]:
    part = t.groupby(["region", "part"], sort=False).ngroup().to_numpy()
    first = np.unique(part, return_index=True)[1]
    tree = TriangleTree(t[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy(), part, t["hole"].to_numpy(bool), t["edges"].to_numpy())
    return tree, t["region"].to_numpy(object)[first]


def _hits(tree: TriangleTree, names: np.ndarray, p: pd.DataFrame) -> pd.DataFrame:
    at, owner = tree.hits(p["x"].to_numpy(float), p["y"].to_numpy(float))
    pairs = dict.fromkeys(zip(names[owner].tolist(), p["k"].to_numpy(object)[at].tolist())) if len(owner) else {}
    return pd.DataFrame({"region": pd.Series([r for r, _ in pairs], dtype=object), "k": pd.Series([k for _, k in pairs], dtype=object)})


def keys_in_regions(points: DataFrame, regions: DataFrame, name: str, wkt: str, broadcast_bytes: int = BROADCAST_BYTES, tile_triangles: int = 20_000, chunk_rows: int = 200_000) -> DataFrame:
    """Distinct (region, k): regions that contain a position of the key, borders included.

    The hierarchy goes to every task while the triangles fit into
    ``broadcast_bytes``; otherwise the plane is cut into tiles of about
    ``tile_triangles`` triangles, triangles are copied to the tiles they touch,
    points go to theirs (crowded tiles in several chunks), and each tile builds
    its own hierarchy.
    """
    spark = points.sparkSession
    triangles = materialise(region_triangles(regions.repartition(parallelism(spark)), name, wkt))
    n = triangles.count()
    if n == 0:
        return points.select(F.lit(None).cast("string").alias("region"), F.col("k").cast("string")).limit(0)
    schema = "region string, k string"
    points = points.withColumn("k", F.col("k").cast("string"))
    if n * _TRIANGLE_BYTES <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(triangles.toPandas())

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, names = _tree(shared.value)
            held, rows = [], 0
            for b in batches:
                held.append(b)
                rows += len(b)
                if rows >= chunk_rows:
                    yield _hits(tree, names, pd.concat(held))
                    held, rows = [], 0
            if held:
                yield _hits(tree, names, pd.concat(held))

        return points.mapInPandas(search, schema).distinct()

    # tiles: medians of a bounded sample of centres; they only set the layout, all triangles and points are used
    share = min(1.0, 100_000 / n)
    centres = triangles.sample(share, seed=7).select(((F.col("ax") + F.col("bx") + F.col("cx")) / 3).alias("x"), ((F.col("ay") + F.col("by") + F.col("cy")) / 3).alias("y")).limit(200_000).toPandas().to_numpy()
    depth = max(1, int(np.ceil(np.log2(n / tile_triangles))))
    cuts: dict[int, tuple[int, float]] = {}

    def cut(node: int, c: np.ndarray, level: int) -> None:
        if level < depth and len(c) > 1:
            axis = int(np.ptp(c[:, 1]) > np.ptp(c[:, 0]))
            at = float(np.median(c[:, axis]))
            cuts[node] = (axis, at)
            cut(2 * node, c[c[:, axis] <= at], level + 1)
            cut(2 * node + 1, c[c[:, axis] > at], level + 1)

    cut(1, centres, 0)

    def tiles(x0, y0, x1, y1) -> list[int]:
        found, todo = [], [1]
        while todo:
            node = todo.pop()
            if node not in cuts:
                found.append(node)
                continue
            axis, at = cuts[node]
            if (y0 if axis else x0) <= at:
                todo.append(2 * node)
            if (y1 if axis else x1) > at:
                todo.append(2 * node + 1)
        return found

    def tri_tiles(batches):
        for b in batches:
            xs, ys = b[["ax", "bx", "cx"]].to_numpy(), b[["ay", "by", "cy"]].to_numpy()
            own = [tiles(*v) for v in zip(xs.min(1), ys.min(1), xs.max(1), ys.max(1))]
            yield b.loc[b.index.repeat([len(o) for o in own])].assign(tile=[t for o in own for t in o])

    def point_tiles(batches):
        for b in batches:
            node = np.ones(len(b), np.int64)
            xy = b[["x", "y"]].to_numpy(float)
            for _ in range(depth):
                for v in np.unique(node):
                    if v in cuts:
                        axis, at = cuts[v]
                        own = node == v
                        node[own] = 2 * v + (xy[own, axis] > at)
            yield b.assign(tile=node)

    placed = points.mapInPandas(point_tiles, "k string, y double, x double, tile long")
    chunks = placed.groupBy("tile").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    left = placed.join(chunks, "tile").select("k", "y", "x", (F.col("tile") + 0).alias("tile"), F.pmod(F.xxhash64("k", "y", "x"), F.col("chunks")).cast("int").alias("chunk"))
    parts = chunks.select((F.col("tile") + 0).alias("tile"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = triangles.mapInPandas(tri_tiles, _TRIANGLES + ", tile long").join(parts, "tile")

    def local(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(t):
            return pd.DataFrame({"region": [], "k": []}, dtype=object)
        return _hits(*_tree(t), p)

    return left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInPandas(local, schema).distinct()


def near_or_inside(points: DataFrame, regions: DataFrame, name: str, wkt: str, radius_m: float = 100.0) -> DataFrame:
    """Both lists: near pairs of keys, and (region, key) pairs, as (key_a, key_b)."""
    inside = keys_in_regions(points, regions, name, wkt)
    return near_keys(points, radius_m).union(inside.select(F.col("region").alias("key_a"), F.col("k").alias("key_b"))).distinct()
