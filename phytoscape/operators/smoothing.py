"""Kriging, polynomial trends, moving averages and additive models on bounded sets of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.functions.statistics import f_upper

C = F.col
MOST_POINTS = 3_000

# fixed values: variogram shapes over distance / range
_SHAPES = {
    "gaussian": lambda h: 1 - np.exp(-3 * h * h), "exponential": lambda h: 1 - np.exp(-3 * h), "spherical": lambda h: np.where(h < 1, 1.5 * h - 0.5 * h**3, 1.0),
}


def _pivots(cov, xy, top: float, stop: float, most: int) -> np.ndarray:
    """Columns L of a pivoted partial Cholesky factor, so that the covariances are nearly L L'."""
    rest, cols = np.full(len(xy), top), []
    while len(cols) < most and rest.max() > stop:
        i = int(rest.argmax())
        c = cov(np.sqrt(((xy - xy[i]) ** 2).sum(1)))
        for k in cols:
            c -= k * k[i]
        cols.append(c / np.sqrt(rest[i]))
        rest = np.maximum(rest - cols[-1] ** 2, 0)
    return np.array(cols).T


def _farthest(xy) -> float:
    """The greatest distance of two points: of two corners of their hull."""
    from phytoscape.operators.spatial import hull

    c = xy[hull(xy)]
    return max(float(np.sqrt(((c - q) ** 2).sum(1)).max()) for q in c)


def _by_rows(spark, xy, of, width: int = 2_000_000) -> np.ndarray:
    """``of(distances of some points to all points)`` for all points in blocks, spread over the tasks."""
    step = max(1, width // len(xy))
    shared, blocks = spark.sparkContext.broadcast(xy), -(-len(xy) // step)

    def part(batches):
        at = shared.value
        for b in batches:
            for i in b["id"]:
                q = at[i * step : (i + 1) * step]
                h = np.sqrt((q[:, :1] - at[:, 0]) ** 2 + (q[:, 1:] - at[:, 1]) ** 2)
                yield pd.DataFrame({"id": [i], "v": [of(h)]})

    t = spark.range(0, blocks, 1, min(blocks, spark.sparkContext.defaultParallelism)).mapInPandas(part, "id long, v array<double>").toPandas()
    shared.unpersist()
    return np.concatenate(t.sort_values("id")["v"].to_list())


NODES, CHUNK = 64, 8_192


class _Gaussian:
    """Gaussian covariances sill exp(-3 h² / reach²) of all points as products of one function for each direction, every one exact to rounding by its values at Chebyshev nodes.

    exp(-c (s - t)²) over a span of 3 reaches is a polynomial of some 40 powers
    in s and t to all digits, so a product with the matrix of all pairs costs a
    few sums over the points.
    """

    def __init__(self, xy: np.ndarray, sill: float, reach: float):
        self.sill, self.low, self.n = sill, xy.min(0), len(xy)
        self.span = np.where(np.ptp(xy, axis=0) > 0, np.ptp(xy, axis=0), 1.0)
        self.xy = xy
        k = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
        t = np.cos(np.arange(NODES)[:, None] * np.arccos(k)) * np.where(np.arange(NODES) > 0, 2, 1)[:, None] / NODES  # values at nodes to coefficients
        self.c = [t @ np.exp(-3 * (s / 2 * (k[:, None] - k)) ** 2 / reach**2) @ t.T for s in self.span]

    def chunks(self):
        """(rows, polynomials of x, of y) of the points in turn."""
        for lo in range(0, self.n, CHUNK):
            r = slice(lo, min(self.n, lo + CHUNK))
            u = np.arccos(np.clip(2 * (self.xy[r] - self.low) / self.span - 1, -1, 1))
            yield r, *(np.cos(u[:, d, None] * np.arange(NODES)) for d in (0, 1))

    def product(self, p: np.ndarray) -> np.ndarray:
        m = sum((tx * p[r, None]).T @ ty for r, tx, ty in self.chunks())
        a, out = self.sill * (self.c[0] @ m @ self.c[1].T), np.empty(self.n)
        for r, tx, ty in self.chunks():
            out[r] = ((tx @ a) * ty).sum(1)
        return out

    def conditioner(self, nugget: float):
        """The inverse of covariances plus nugget, nearly: from the directions that matter of both functions' products."""
        (lx, vx), (ly, vy) = (np.linalg.eigh((c + c.T) / 2) for c in self.c)
        l = self.sill * np.outer(lx, ly)
        i, j = np.nonzero(l > 1e-4 * nugget / self.n)
        root = np.sqrt(l[i, j])
        part = lambda tx, ty: (tx @ vx)[:, i] * (ty @ vy)[:, j] * root
        s, v = np.linalg.eigh(sum(f.T @ f for f in (part(tx, ty) for _, tx, ty in self.chunks())))

        def apply(r: np.ndarray) -> np.ndarray:
            # step by step: the product of v, its scale and v' as one matrix would lose the small directions
            g, out = v @ ((v.T @ sum(part(tx, ty).T @ r[k] for k, tx, ty in self.chunks())) / (nugget + np.maximum(s, 0))), np.empty(self.n)
            for k, tx, ty in self.chunks():
                out[k] = part(tx, ty) @ g
            return (r - out) / nugget

        return apply


def _solve(spark, xy, z, cov, sill: float, nugget: float, tol: float = 1e-10, smooth: _Gaussian | None = None) -> np.ndarray:
    """Weights of the same system as the direct solve by conjugate gradients: products with all covariances are taken in the tasks, or by ``smooth``; a low factor of them conditions."""
    n = len(xy)
    if smooth is None:
        low = _pivots(cov, xy, sill, 1e-3 * nugget / n, max(1, min(n, 500, 20_000_000 // n)))
        basis = np.linalg.qr(np.r_[low, np.sqrt(nugget) * np.eye(low.shape[1])])[0][:n]
        conditioned = lambda r: (r - basis @ (basis.T @ r)) / nugget
        product = lambda p: _by_rows(spark, xy, lambda h: cov(h) @ p)
    else:
        conditioned, product = smooth.conditioner(nugget), smooth.product
    w, r, least = np.zeros(n), z.astype(float), tol * np.linalg.norm(z)
    p, old = None, 0.0
    for _ in range(10 * n):
        if np.linalg.norm(r) <= least:
            return w
        y = conditioned(r)
        new = r @ y
        p = y if p is None else y + new / old * p
        old = new
        a = product(p) + nugget * p
        step = new / (p @ a)
        w, r = w + step * p, r - step * a
    raise ValueError("the kriging system could not be solved")


def simple_kriging(points: DataFrame, cells: DataFrame, model: str = "gaussian", nugget: float = 0.1) -> DataFrame:
    """(grid_id, z): weights from the covariance sill − γ, without a mean term. Sill is the variance, range a third of the greatest distance.

    The system has a row per point. Up to 3,000 points it is solved directly,
    beyond that by conjugate gradients: gaussian covariances at a cost linear in
    the points, the others over blocks of rows in the tasks at a cost by their
    square; cells are spread over the tasks.
    """
    spark = points.sparkSession
    p = points.where("x is not null and y is not null and z is not null").select("x", "y", "z").toPandas().sort_values(["x", "y", "z"])
    if len(p) < 3:
        raise ValueError("at least 3 points are needed")
    xy, z = p[["x", "y"]].to_numpy(float), p["z"].to_numpy(float)
    small = len(p) <= MOST_POINTS
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) if small else None
    sill, reach = float(z.var()) or 1.0, (float(d.max() if small else _farthest(xy)) or 1.0) / 3
    shape = _SHAPES[model]
    cov = lambda h: sill * (1 - shape(h / reach))
    weights = np.linalg.solve(cov(d) + nugget * np.eye(len(p)), z) if small else _solve(spark, xy, z, cov, sill, nugget, smooth=_Gaussian(xy, sill, reach) if model == "gaussian" else None)
    shared = spark.sparkContext.broadcast((xy, weights))

    def predict(batches):
        at, w = shared.value
        step = max(1, 2_000_000 // len(at))
        for b in batches:
            q = b[["x", "y"]].to_numpy()
            yield pd.DataFrame({"grid_id": b["grid_id"], "z": np.concatenate([cov(np.sqrt(((q[i : i + step, None] - at[None]) ** 2).sum(-1))) @ w for i in range(0, len(q), step)])})

    return cells.select("grid_id", "x", "y").mapInPandas(predict, "grid_id long, z double")


def polynomial_fit(s: DataFrame, x: str, y: str, degree: int = 2) -> pd.DataFrame:
    """(power, coefficient, r2) of least squares; Spark sums the powers of the centred and scaled x, numpy solves the small system."""
    ok = s.where(C(x).isNotNull() & C(y).isNotNull() & ~F.isnan(C(x).cast("double")) & ~F.isnan(C(y).cast("double"))).select(C(x).cast("double").alias("x"), C(y).cast("double").alias("y"))
    m = ok.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    if m["n"] <= degree:
        raise ValueError(f"{m['n']} points are too few for degree {degree}")
    scale = m["s"] or 1.0
    t = ok.select(((C("x") - m["m"]) / scale).alias("t"), "y")
    r = t.agg(*[F.sum(F.pow("t", F.lit(float(k)))).alias(f"p{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow("t", F.lit(float(k))) * C("y")).alias(f"q{k}") for k in range(degree + 1)], F.sum(C("y") * C("y")).alias("yy"), F.avg("y").alias("my")).first()
    a = np.array([[r[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    q = np.array([r[f"q{i}"] for i in range(degree + 1)])
    b = np.linalg.lstsq(a, q, rcond=None)[0]
    total = r["yy"] - m["n"] * r["my"] ** 2
    r2 = 1 - (r["yy"] - b @ q) / total if total > 0 else 0.0
    c = np.polynomial.polynomial.Polynomial(b, domain=[m["m"] - scale, m["m"] + scale], window=[-1, 1]).convert().coef
    return pd.DataFrame({"power": range(degree + 1), "coefficient": np.pad(c, (0, degree + 1 - len(c))), "r2": r2})


def smoothed(s: DataFrame, time: str, value: str, share: float = 0.3, n: int | None = None) -> DataFrame:
    """(time, value, smooth): centred moving average over a share of the rows, shorter at the ends."""
    n = n or s.count()
    half = max(1, int(n * share) // 2)
    return s.select(time, value, F.avg(value).over(Window.orderBy(time).rowsBetween(-half, half)).alias("smooth"))


def additive_model(df: DataFrame, response: str, predictors: list[str], degree: int = 3) -> pd.DataFrame:
    """(predictor, power, coefficient, r2, f, p): independent univariate smooths around the response's mean, as polynomials; not backfitted. 10 complete rows or more."""
    whole = df.select(response, *predictors).dropna("any")
    n = whole.count()
    if n < 10:
        raise ValueError("at least 10 complete rows are needed")
    out = []
    for p in predictors:
        t = polynomial_fit(whole, p, response, degree)
        r2 = float(t["r2"].iloc[0])
        f = (r2 / degree) / max((1 - r2) / (n - degree - 1), 1e-300)
        out.append(t.assign(predictor=p, f=f, p=f_upper(f, degree, n - degree - 1)))
    return pd.concat(out)[["predictor", "power", "coefficient", "r2", "f", "p"]]
