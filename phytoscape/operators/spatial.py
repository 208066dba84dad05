"""Interpolation, spatial autocorrelation and landscape metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.operators.distances import spread
from phytoscape.session import parallelism

C = F.col
GRID_CELLS = 1_000_000


def grid(spark, x0: float, y0: float, x1: float, y1: float, size: float) -> DataFrame:
    """(grid_id, x, y) cell centres, x fastest; at most a million cells."""
    nx, ny = max(0, int(np.ceil((x1 - x0) / size - 0.5))), max(0, int(np.ceil((y1 - y0) / size - 0.5)))
    if nx * ny > GRID_CELLS:
        raise ValueError(f"{nx * ny} cells are more than {GRID_CELLS}")
    i = C("id")
    return spark.range(nx * ny).select(i.alias("grid_id"), (x0 + size / 2 + size * (i % max(nx, 1))).alias("x"), (y0 + size / 2 + size * F.floor(i / max(nx, 1))).alias("y"))


_WIDE = 2_000_000  # distances held at once by a kernel


def _per_cell(points: DataFrame, cells: DataFrame, kernel, schema: str) -> DataFrame:
    """Rows of ``kernel(points x, y, z, cells x, y)`` per cell from every part of the points: cells (bounded by ``GRID_CELLS``) go to all tasks, pairs are summed where they are made."""
    t = cells.select("grid_id", "x", "y").limit(GRID_CELLS + 1).toPandas()
    if len(t) > GRID_CELLS:
        raise ValueError(f"more than {GRID_CELLS} cells")
    shared = points.sparkSession.sparkContext.broadcast((t["grid_id"].to_numpy(), t["x"].to_numpy(float), t["y"].to_numpy(float)))
    p = points.where("x is not null and y is not null and z is not null").select(C("x").cast("double").alias("x"), C("y").cast("double").alias("y"), C("z").cast("double").alias("z"))

    def go(batches):
        ids, gx, gy = shared.value
        for b in batches:
            x, y, z = (b[c].to_numpy() for c in "xyz")
            step = max(1, _WIDE // max(1, len(b)))
            for lo in range(0, len(ids), step):
                yield pd.DataFrame({"grid_id": ids[lo:lo + step], **kernel(x, y, z, gx[lo:lo + step], gy[lo:lo + step])})

    return p.mapInPandas(go, f"grid_id long, {schema}")


def idw(points: DataFrame, cells: DataFrame, power: float = 2.0) -> DataFrame:
    """(grid_id, z): inverse-distance weighting; a point on the centre gives its value (several: the smallest)."""
    def kernel(x, y, z, gx, gy):
        d2 = (gx[:, None] - x[None]) ** 2 + (gy[:, None] - y[None]) ** 2
        on = d2 == 0
        w = np.where(on, 0.0, np.where(on, 1.0, d2) ** (-power / 2))
        return {"w": w.sum(1), "s": w @ z, "on": np.where(on, z[None], np.inf).min(1)}

    t = _per_cell(points, cells, kernel, "w double, s double, on double").groupBy("grid_id").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.min("on").alias("on"))
    return t.select("grid_id", F.when(C("on") < float("inf"), C("on")).otherwise(F.try_divide("s", "w")).alias("z"))


def nearest(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(grid_id, z): value of the nearest point (ties: smallest position)."""
    def kernel(x, y, z, gx, gy):
        o = np.lexsort((z, y, x))
        x, y, z = x[o], y[o], z[o]
        d2 = (gx[:, None] - x[None]) ** 2 + (gy[:, None] - y[None]) ** 2
        k = d2.argmin(1)
        return {"d2": d2[np.arange(len(gx)), k], "px": x[k], "py": y[k], "z": z[k]}

    t = _per_cell(points, cells, kernel, "d2 double, px double, py double, z double")
    return t.groupBy("grid_id").agg(F.min_by("z", F.struct("d2", "px", "py", "z")).alias("z"))


BLOCK = 1_024


def _pair_blocks(points: DataFrame, kernel, schema: str) -> DataFrame:
    """Rows of ``kernel(first block, second block, whether both are the same)`` of points (site, x, y, z) in blocks, for every pair of blocks: pairs of points are summed in the tasks and never become rows."""
    p = points.where("site is not null and x is not null and y is not null and z is not null").select("site", *[C(c).cast("double").alias(c) for c in "xyz"])
    blocks = max(1, -(-p.count() // BLOCK))
    rows = p.withColumn("blk", F.pmod(F.xxhash64("site"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("site", "x", "y", "z", "blk", F.least("blk", "q").alias("b1"), F.greatest("blk", "q").alias("b2")).repartition(spread(points.sparkSession, blocks), "b1", "b2")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        same = part["b1"].iloc[0] == part["b2"].iloc[0]
        first = part if same else part[part["blk"] == part["b1"]]
        second = part if same else part[part["blk"] != part["b1"]]
        return kernel(first, second, same)

    return rows.groupBy("b1", "b2").applyInPandas(run, schema)


def _gaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(distances, differences of values) of all points of both blocks."""
    g = lambda c: a[c].to_numpy()[:, None] - b[c].to_numpy()[None]
    return np.sqrt(g("x") ** 2 + g("y") ** 2), g("z")


def _half(d: np.ndarray, same: bool) -> np.ndarray:
    return np.triu(np.ones(d.shape, bool), 1) if same else np.ones(d.shape, bool)


def _by_site(first, second, same, of) -> pd.DataFrame:
    """``of(distances, differences, own values, other values)`` summed per site of either block."""
    out = []
    for a, b in ((first, second),) if same else ((first, second), (second, first)):
        d, dz = _gaps(a, b)
        if same:
            np.fill_diagonal(d, np.nan)  # a point is no pair with itself
        out.append(pd.DataFrame({"i": a["site"].to_numpy(), "zi": a["z"].to_numpy(), **of(d, dz, a["z"].to_numpy()[:, None], b["z"].to_numpy()[None])}))
    return pd.concat(out)


def loo_rmse(points: DataFrame, power: float = 2.0) -> DataFrame:
    """One row: leave-one-out error of inverse-distance weighting over (site, x, y, z)."""
    def of(d, dz, zi, zj):
        w = np.where(d > 0, np.where(d > 0, d, 1.0) ** -power, 0.0)
        return {"w": w.sum(1), "s": (w * zj).sum(1)}

    kind = points.schema["site"].dataType.simpleString()
    t = _pair_blocks(points, lambda a, b, same: _by_site(a, b, same, of), f"i {kind}, zi double, w double, s double").groupBy("i", "zi").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    return t.where("w > 0").agg(F.sqrt(F.avg((C("s") / C("w") - C("zi")) ** 2)).alias("rmse"))


def autocorrelation(points: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: morans_i (row-standardised weights), expected, z, gearys_c (binary weights). Neighbours lie within the threshold, default the mean distance above 0."""
    stats = points.agg(F.avg("z").alias("m"), F.var_pop("z").alias("v"), F.count("*").alias("n")).first()
    if threshold is None:
        def mean(a, b, same):
            d = _gaps(a, b)[0]
            d = d[_half(d, same) & (d > 0)]
            return pd.DataFrame({"s": [float(d.sum())], "k": [float(len(d))]})

        threshold = _pair_blocks(points, mean, "s double, k double").agg(F.try_divide(F.sum("s"), F.sum("k"))).first()[0] or 0.0
    m, cut = float(stats["m"] or 0.0), float(threshold)

    def of(d, dz, zi, zj):
        near = (d > 0) & (d <= cut)
        return {"lag": (near * ((zi - m) * (zj - m))).sum(1), "sq": np.where(near, dz * dz, 0).sum(1), "w": near.sum(1).astype(float)}

    kind = points.schema["site"].dataType.simpleString()
    r = _pair_blocks(points, lambda a, b, same: _by_site(a, b, same, of), f"i {kind}, zi double, lag double, sq double, w double").groupBy("i").agg(F.sum("lag").alias("lag"), F.sum("sq").alias("sq"), F.sum("w").alias("w")).where("w > 0")
    t = r.agg(F.sum(C("lag") / C("w")).alias("l"), F.sum("sq").alias("sq"), F.sum("w").alias("w"))
    n, v = F.lit(stats["n"]), F.lit(float(stats["v"] or 0.0))
    i, e = F.coalesce(F.try_divide("l", n * v), F.lit(0.0)), F.try_divide(F.lit(-1.0), n - 1)
    return t.select(i.alias("morans_i"), e.alias("expected"), ((i - e) / F.sqrt(1.0 / n)).alias("z"), F.coalesce(F.try_divide(C("sq"), 2 * C("w") * v), F.lit(1.0)).alias("gearys_c"))


def variogram(points: DataFrame, lags: int = 20) -> DataFrame:
    """(bin, lag, semivariance, pairs): equal half-open lags up to the greatest distance."""
    def far(a, b, same):
        d = _gaps(a, b)[0][_half(_gaps(a, b)[0], same)]
        return pd.DataFrame({"d": [float(d.max()) if len(d) else 0.0]})

    top = _pair_blocks(points, far, "d double").agg(F.max("d")).first()[0] or 0.0

    def bins(a, b, same):
        d, dz = _gaps(a, b)
        use = _half(d, same)
        k = np.floor(d[use] / (top / lags)).astype(int) if top > 0 else np.zeros(int(use.sum()), int)
        ok = k < lags
        n = np.bincount(k[ok], minlength=lags)
        return pd.DataFrame({"bin": np.arange(lags), "s": np.bincount(k[ok], weights=dz[use][ok] ** 2, minlength=lags), "n": n})[n > 0]

    t = _pair_blocks(points, bins, "bin long, s double, n long").groupBy("bin").agg(F.sum("s").alias("s"), F.sum("n").alias("pairs"))
    return t.select("bin", ((C("bin") + 0.5) * F.lit(float(top)) / lags).alias("lag"), (C("s") / C("pairs") / 2).alias("semivariance"), "pairs")


def landscape_level(cells: DataFrame) -> DataFrame:
    """One row of (row, col, code): shannon, simpson and evenness over all codes, background included."""
    n = cells.groupBy("code").agg(F.count("*").alias("k")).withColumn("p", C("k") / F.sum("k").over(Window.partitionBy()))
    r = n.agg((-F.sum(C("p") * F.log(C("p") + 1e-10))).alias("shannon"), (1 - F.sum(C("p") * C("p"))).alias("simpson"), F.count("*").alias("types"))
    return r.select("shannon", "simpson", F.when(C("types") > 1, C("shannon") / F.log("types")).otherwise(1.0).alias("evenness"))


def patches(cells: DataFrame) -> DataFrame:
    """(row, col, code, patch): 4-neighbour components of equal non-zero codes; patch is the smallest cell number."""
    from phytoscape.operators.graph import components

    c = cells.where("code <> 0").withColumn("cell", C("row").cast("bigint") * 1_000_003 + C("col"))
    edges = None
    for dr, dc in ((0, 1), (1, 0)):
        o = c.select((C("row") - dr).alias("row"), (C("col") - dc).alias("col"), "code", C("cell").alias("b"))
        e = c.join(o, ["row", "col", "code"]).select(C("cell").alias("a"), "b")
        edges = e if edges is None else edges.union(e)
    root = components(edges)
    return c.join(root.withColumnRenamed("node", "cell"), "cell", "left").select("row", "col", "code", F.coalesce("root", "cell").alias("patch"))


def patch_metrics(cells: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Per code: patches, patch density, mean patch area, its variation in percent and the largest patch index."""
    area = cells.agg((F.count("*") * cell_size**2).alias("area"))
    p = patches(cells).groupBy("code", "patch").agg((F.count("*") * cell_size**2).alias("a"))
    m = p.groupBy("code").agg(F.count("*").alias("patches"), F.avg("a").alias("mean_area"), F.stddev_pop("a").alias("sd"), F.max("a").alias("largest"))
    return m.join(F.broadcast(area)).select("code", "patches", (C("patches") / C("area") * 10_000).alias("patch_density"), "mean_area", F.when(C("patches") > 1, C("sd") / C("mean_area") * 100).otherwise(0.0).alias("area_cv"), (C("largest") / C("area") * 100).alias("largest_patch_index"))


def contagion(cells: DataFrame) -> DataFrame:
    """One row: contagion of adjacencies to the right and below (last row and column start none)."""
    top = cells.agg(F.max("row").alias("mr"), F.max("col").alias("mc"), F.countDistinct("code").alias("types"))
    c = cells.join(F.broadcast(top)).where((C("row") < C("mr")) & (C("col") < C("mc")))
    adj = None
    for dr, dc in ((0, 1), (1, 0)):
        o = cells.select((C("row") - dr).alias("row"), (C("col") - dc).alias("col"), C("code").alias("other"))
        e = c.join(o, ["row", "col"]).select("code", "other")
        adj = e if adj is None else adj.union(e)
    p = adj.groupBy("code", "other").agg(F.count("*").alias("k")).withColumn("p", C("k") / F.sum("k").over(Window.partitionBy()))
    return p.agg(F.sum(C("p") * F.log(C("p") + 1e-10)).alias("s")).join(top).select(F.when(C("types") > 1, (1 + C("s") / F.log("types")) * 100).otherwise(100.0).alias("contagion"))


def edge_metrics(cells: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Per code: edge cells (of non-zero difference to a neighbour row or column, central differences inside and one-sided at the border), edge density, and the shape index edge density / (4 √area). The landscape is a full grid of (row, col, code)."""
    box = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("all"))
    codes = cells.where("code <> 0").groupBy("code").agg((F.count("*") * cell_size**2).alias("area"))
    at = cells.join(F.broadcast(box))
    c = at.select("row", "col", "code", "all")
    for name, dr, dc in (("up", -1, 0), ("down", 1, 0), ("left", 0, -1), ("right", 0, 1)):
        c = c.join(cells.select((C("row") - dr).alias("row"), (C("col") - dc).alias("col"), C("code").alias(name)), ["row", "col"], "left")
    # a code's mask differs along an axis if exactly one of both neighbours (or, at the border, of neighbour and cell) has it
    sides = [F.array(F.coalesce("up", "code"), F.coalesce("down", "code")), F.array(F.coalesce("left", "code"), F.coalesce("right", "code"))]
    edge = c.select("all", F.explode(F.array_distinct(F.concat(*[F.when(s[0] != s[1], s).otherwise(F.slice(s, 1, 0)) for s in sides]))).alias("code"))
    e = edge.where("code <> 0").groupBy("code").agg(F.count("*").alias("edge_cells"), F.first("all").alias("all"))
    density = F.try_divide(C("edge_cells") * cell_size, C("all") * cell_size**2)
    return codes.join(e, "code", "left").select("code", F.coalesce("edge_cells", F.lit(0)).alias("edge_cells"), F.coalesce(density, F.lit(0.0)).alias("edge_density"), F.coalesce(density / (4 * F.sqrt("area")), F.lit(0.0)).alias("shape_index"))


RBF_POINTS = 3_000


def _local(u: np.ndarray, rows: np.ndarray, anchors: np.ndarray, phi, near: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights) of functions that are 1 at each of ``rows`` and 0 at its nearest points and the anchors."""
    d = ((u[rows, None] - u[None]) ** 2).sum(-1)
    d[:, anchors] = np.inf
    d[np.arange(len(rows)), rows] = -1
    at = np.argpartition(d, near, 1)[:, :near]
    at = np.c_[rows, np.where(at == rows[:, None], -1, at)]
    at = np.take_along_axis(at, np.argsort(at < 0, 1, kind="stable"), 1)[:, :near]
    own = np.searchsorted(anchors, rows)
    own = np.where(anchors[np.minimum(own, len(anchors) - 1)] == rows, own, len(anchors))
    extra = np.stack([np.delete(np.r_[anchors, -1], o) for o in own])
    extra = np.where(extra < 0, at[:, -1:], extra)
    drop = own < len(anchors)  # an anchor has its last point twice: left out below
    k = np.c_[at, extra]
    p, size = u[k], k.shape[1]
    m = np.zeros((len(rows), size + 3, size + 3))
    m[:, :size, :size] = phi(np.sqrt(((p[:, :, None] - p[:, None]) ** 2).sum(-1)))
    m[:, :size, size] = m[:, size, :size] = 1
    m[:, :size, size + 1:] = p
    m[:, size + 1:, :size] = p.transpose(0, 2, 1)
    if drop.any():
        m[drop, size - 1, :] = m[drop, :, size - 1] = 0
        m[drop, size - 1, size - 1] = 1
    b = np.zeros((len(rows), size + 3, 1))
    b[:, 0] = 1
    return k, np.linalg.solve(m, b)[:, :size, 0]


def _radial_weights(spark, u: np.ndarray, z: np.ndarray, plane: np.ndarray, phi, tol: float = 1e-10, most: int = 150) -> np.ndarray:
    """Weights of the same system as the direct solve by GMRES; products with all pairs are taken in the tasks, functions of each point's surroundings condition it."""
    from phytoscape.operators.smoothing import _by_rows

    n = len(u)
    way = np.linspace(0, 2 * np.pi, 8, endpoint=False)
    anchors = np.unique((u @ np.stack([np.cos(way), np.sin(way)])).argmax(0))
    shared = spark.sparkContext.broadcast(u)
    step = max(1, 1_000_000 // n)

    def part(batches):
        for b in batches:
            for i in b["id"]:
                k, w = _local(shared.value, np.arange(i * step, min(n, (i + 1) * step)), anchors, phi)
                yield pd.DataFrame({"id": [i], "k": [k.ravel()], "w": [w.ravel()]})

    blocks = -(-n // step)
    t = spark.range(0, blocks, 1, min(blocks, parallelism(spark))).mapInPandas(part, "id long, k array<long>, w array<double>").toPandas().sort_values("id")
    k, c = (np.concatenate(t[v].to_list()).reshape(n, -1) for v in "kw")
    q = np.linalg.qr(plane)[0]
    flat = lambda v: v - q @ (q.T @ v)
    joined = lambda y: np.bincount(k.ravel(), (c * y[:, None]).ravel(), n)
    product = lambda w: _by_rows(spark, u, lambda h: phi(h) @ w, 1_000_000)
    w, rest = np.zeros(n), flat(z)
    least = tol * max(np.linalg.norm(z), 1e-300)
    done, last = 0, np.inf
    while (beta := np.linalg.norm(rest)) > least:
        if beta > 0.5 * last and beta <= 1e3 * least:  # what rounding of the products leaves
            break
        if done >= most:
            raise ValueError("the system of radial functions could not be solved")
        last = beta
        basis, h, solved = [rest / beta], np.zeros((41, 40)), None
        for j in range(40):
            done += 1
            v = flat(product(joined(basis[j])))
            for _ in range(2):
                for i, e in enumerate(basis):
                    x = e @ v
                    h[i, j] += x
                    v = v - x * e
            h[j + 1, j] = np.linalg.norm(v)
            rhs = np.r_[beta, np.zeros(j + 1)]
            solved = np.linalg.lstsq(h[:j + 2, :j + 1], rhs, rcond=None)[0]
            if np.linalg.norm(h[:j + 2, :j + 1] @ solved - rhs) <= 0.3 * least or h[j + 1, j] <= 1e-14 * beta:
                break
            basis.append(v / h[j + 1, j])
        w = flat(w + joined(np.stack(basis[:len(solved)], 1) @ solved))
        rest = flat(z - product(w))
    return np.r_[w, np.linalg.lstsq(plane, z - product(w), rcond=None)[0]]


def rbf(points: DataFrame, cells: DataFrame, function: str = "thin_plate_spline") -> DataFrame:
    """(grid_id, z) of radial functions through all points, with a plane: thin_plate_spline or linear. Positions count with their mean value; fewer than three give inverse-distance weighting.

    Up to 3,000 positions the system is solved directly, beyond that step by
    step at a cost by the square of the positions, in the tasks.
    """
    kernels = {"thin_plate_spline": lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0), "linear": lambda r: -r}
    if function not in kernels:
        raise ValueError(f"Unknown function: {function}")
    t = points.where("x is not null and y is not null and z is not null").groupBy("x", "y").agg(F.avg("z").alias("z")).toPandas()
    if len(t) < 3:
        return idw(points, cells)
    t = t.sort_values(["x", "y"])
    xy, z, phi = t[["x", "y"]].to_numpy(float), t["z"].to_numpy(float), kernels[function]
    mid, scale = xy.mean(0), np.ptp(xy, axis=0).max() or 1.0
    u = (xy - mid) / scale
    plane = np.column_stack([np.ones(len(u)), u])
    if len(t) > RBF_POINTS:
        w = _radial_weights(points.sparkSession, u, z, plane, phi)
    else:
        a = np.block([[phi(np.sqrt(((u[:, None] - u[None]) ** 2).sum(-1))), plane], [plane.T, np.zeros((3, 3))]])
        w = np.linalg.lstsq(a, np.r_[z, np.zeros(3)], rcond=None)[0]
    shared = points.sparkSession.sparkContext.broadcast((u, w))

    def predict(batches):
        u, w = shared.value
        step = max(1, 2_000_000 // len(u))
        for b in batches:
            q = (b[["x", "y"]].to_numpy(float) - mid) / scale
            v = [phi(np.sqrt(((q[i:i + step, None] - u[None]) ** 2).sum(-1))) @ w[:-3] + np.column_stack([np.ones(len(q[i:i + step])), q[i:i + step]]) @ w[-3:] for i in range(0, len(q), step)]
            yield pd.DataFrame({"grid_id": b["grid_id"], "z": np.concatenate(v) if v else []})

    return cells.select("grid_id", "x", "y").mapInPandas(predict, "grid_id long, z double")


def triangulated(xy: np.ndarray) -> np.ndarray:
    """Triangles (rows of three indices) of a Delaunay triangulation, by adding point after point."""
    mid, span = xy.mean(0), np.ptp(xy, axis=0).max() or 1.0
    pts = np.vstack([(xy - mid) / span, [[-60, -50], [60, -50], [0, 80]]])
    n = len(xy)

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = pts[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-300:
            return 0.0, 0.0, np.inf
        ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        return ux, uy, (ux - ax) ** 2 + (uy - ay) ** 2

    tri = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in np.lexsort((pts[:n, 1], pts[:n, 0])):
        keys = list(tri)
        c = np.array([tri[k] for k in keys])
        bad = [keys[k] for k in np.flatnonzero((pts[i, 0] - c[:, 0]) ** 2 + (pts[i, 1] - c[:, 1]) ** 2 < c[:, 2] * (1 + 1e-12))]
        edges: dict = {}
        for t in bad:
            del tri[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                e = (min(e), max(e))
                edges[e] = edges.get(e, 0) + 1
        for (u, v), k in edges.items():
            if k == 1:
                tri[(u, v, int(i))] = circle((u, v, int(i)))
    return np.array([t for t in tri if max(t) < n], int).reshape(-1, 3)


def hull(xy: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull, counter-clockwise; points on a line give its two ends."""
    way = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    far = np.unique(((xy - xy.mean(0)) @ np.stack([np.cos(way), np.sin(way)])).argmax(0))
    keep = np.arange(len(xy))
    if len(far) > 2:  # most points lie well within the polygon of the farthest ones
        a = xy[far] - xy[far].mean(0)
        ring = xy[far][np.argsort(np.arctan2(a[:, 1], a[:, 0]))]
        inside = np.ones(len(xy), bool)
        for u, v in zip(ring, np.roll(ring, -1, 0)):
            inside &= (v[0] - u[0]) * (xy[:, 1] - u[1]) - (v[1] - u[1]) * (xy[:, 0] - u[0]) > 1e-9 * np.ptp(xy, axis=0).max() ** 2
        keep = keep[~inside]
    keep = keep[np.lexsort((xy[keep, 1], xy[keep, 0]))]

    def chain(order):
        out: list = []
        for i in order:
            while len(out) > 1 and (xy[out[-1], 0] - xy[out[-2], 0]) * (xy[i, 1] - xy[out[-2], 1]) - (xy[out[-1], 1] - xy[out[-2], 1]) * (xy[i, 0] - xy[out[-2], 0]) <= 0:
                out.pop()
            out.append(int(i))
        return out[:-1]

    return np.array(chain(keep) + chain(keep[::-1]), int) if len(keep) > 1 else keep


def _parts(u: np.ndarray, q: np.ndarray | float = 0.0) -> np.ndarray:
    """Barycentric coordinates of ``q`` in the triangle ``u``; NaN in a flat one."""
    (ax, ay), (bx, by), (cx, cy) = u - q
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return np.array([bx * cy - by * cx, cx * ay - cy * ax, ax * by - ay * bx]) / d if abs(d) > 1e-300 else np.full(3, np.nan)


def triangle_at(xy: np.ndarray, corners: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(points, weights) of the Delaunay triangle around ``q``, None outside the hull.

    From a triangle of the hull's corners around ``q``: the point deepest in its
    circle takes the place of the corner that leaves ``q`` inside, until the
    circle holds no point. Each step lowers the weighted square of the distances
    (a linear programme whose solution is the Delaunay triangle).
    """
    u = xy - q
    near = (u * u).sum(1)
    k = int(near.argmin())
    if near[k] == 0:
        return np.array([k, k, k]), np.array([1.0, 0.0, 0.0])
    tri = weight = None
    for b, c in zip(corners[1:], corners[2:]):
        w = _parts(u[[corners[0], b, c]])
        if w.min() >= -1e-9:
            tri, weight = np.array([corners[0], b, c]), w
            break
    if tri is None:
        return None
    seen, turn = set(), 0
    while True:
        a, m = u[tri], near[tri]
        # twice the circle's centre solves 2 c (p_i - p_0) = |p_i|^2 - |p_0|^2
        (e, f), (g, h), (s, t) = a[1] - a[0], a[2] - a[0], (m[1] - m[0], m[2] - m[0])
        d = e * h - f * g
        cx, cy = (s * h - t * f) / d, (t * e - s * g) / d
        level = m[0] - a[0, 0] * cx - a[0, 1] * cy
        power = near - u[:, 0] * cx - u[:, 1] * cy - level
        power[tri] = 0.0
        p = int(power.argmin())
        if power[p] >= -1e-12 * (abs(level) + cx * cx + cy * cy):
            return tri, weight
        key = tuple(sorted(tri.tolist()))
        if key in seen:  # on an edge: step off it
            turn += 1
            step = 1e-12 * 4.0**turn * np.sqrt(near.max()) * np.array([np.cos(turn), np.sin(turn)])
            return triangle_at(xy, corners, q + step)
        seen.add(key)
        share = _parts(a, u[p])
        ratio = np.where(share > 1e-14, np.maximum(weight, 0) / np.where(share > 1e-14, share, 1), np.inf)
        tri = np.r_[np.delete(tri, int(ratio.argmin())), p]
        weight = _parts(u[tri])


def linear_interpolation(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(grid_id, z): planes over the Delaunay triangles of all positions (their mean value each); NULL outside their hull.

    Up to 3,000 positions are triangulated; of more, only the triangle around
    each cell is sought, by its tasks among all positions.
    """
    t = points.where("x is not null and y is not null and z is not null").groupBy("x", "y").agg(F.avg("z").alias("z")).toPandas()
    t = t.sort_values(["x", "y"])
    xy, z = t[["x", "y"]].to_numpy(float), t["z"].to_numpy(float)
    if len(t) > RBF_POINTS:
        return _located(points.sparkSession, xy, z, cells)
    tri = triangulated(xy) if len(t) > 2 else np.zeros((0, 3), int)
    shared = points.sparkSession.sparkContext.broadcast((xy[tri], z[tri]))

    def predict(batches):
        p, v = shared.value
        for b in batches:
            out = []
            for x, y in b[["x", "y"]].to_numpy(float):
                if not len(p):
                    out.append(None)
                    continue
                d = (p[:, 1, 1] - p[:, 2, 1]) * (p[:, 0, 0] - p[:, 2, 0]) + (p[:, 2, 0] - p[:, 1, 0]) * (p[:, 0, 1] - p[:, 2, 1])
                d = np.where(np.abs(d) < 1e-300, np.nan, d)
                a = ((p[:, 1, 1] - p[:, 2, 1]) * (x - p[:, 2, 0]) + (p[:, 2, 0] - p[:, 1, 0]) * (y - p[:, 2, 1])) / d
                c = ((p[:, 2, 1] - p[:, 0, 1]) * (x - p[:, 2, 0]) + (p[:, 0, 0] - p[:, 2, 0]) * (y - p[:, 2, 1])) / d
                inside = np.flatnonzero(np.nan_to_num(np.minimum(np.minimum(a, c), 1 - a - c), nan=-1.0) >= -1e-9)
                out.append(float(a[inside[0]] * v[inside[0], 0] + c[inside[0]] * v[inside[0], 1] + (1 - a[inside[0]] - c[inside[0]]) * v[inside[0], 2]) if len(inside) else None)
            yield pd.DataFrame({"grid_id": b["grid_id"], "z": pd.Series(out, dtype=float)})

    return cells.select("grid_id", "x", "y").mapInPandas(predict, "grid_id long, z double").withColumn("z", F.when(~F.isnan("z"), C("z")))


def _located(spark, xy: np.ndarray, z: np.ndarray, cells: DataFrame) -> DataFrame:
    shared = spark.sparkContext.broadcast((xy, z, hull(xy)))

    def predict(batches):
        xy, z, corners = shared.value
        for b in batches:
            found = [triangle_at(xy, corners, q) for q in b[["x", "y"]].to_numpy(float)]
            yield pd.DataFrame({"grid_id": b["grid_id"], "z": pd.Series([np.nan if f is None else float(z[f[0]] @ f[1]) for f in found], dtype=float)})

    return cells.select("grid_id", "x", "y").repartition(parallelism(spark), "grid_id").mapInPandas(predict, "grid_id long, z double").withColumn("z", F.when(~F.isnan("z"), C("z")))


def interpolate(points: DataFrame, cells: DataFrame, method: str = "idw") -> DataFrame:
    """(grid_id, z) by the named method: idw, kriging, rbf, nearest or linear."""
    from phytoscape.operators.smoothing import simple_kriging

    every = {"idw": idw, "kriging": simple_kriging, "rbf": rbf, "nearest": nearest, "linear": linear_interpolation}
    if method not in every:
        raise ValueError(f"Unknown interpolation: {method}")
    return every[method](points, cells)
