"""Environmental modelling: smoothers and additive models, response curves, gradients, fits of variables to ordinations.

Smoothers are fits of a bounded basis (splines, radial functions, powers): the
tasks sum its cross-products over all rows, numpy solves the small penalised
system, so no series has to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.functions.statistics import f_upper
from phytoscape.operators.ordination import constrained, dca
from phytoscape.operators.traits import species_optima

C = F.col


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    ok = df.select(*[C(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return ok.where(" and ".join(f"c{i} is not null and not isnan(c{i})" for i in range(len(columns))))


def _moments(rows: DataFrame, basis: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """(X'X, X'y, y'y, sum of y, rows) of the basis of all columns but the last, which is y; summed in the tasks."""
    def go(batches):
        xx, xy, yy, sy, n = np.zeros((width, width)), np.zeros(width), 0.0, 0.0, 0
        for b in batches:
            v = b.to_numpy(float)
            for at in range(0, len(v), 20_000):
                x, y = basis(v[at:at + 20_000, :-1]), v[at:at + 20_000, -1]
                xx += x.T @ x
                xy += x.T @ y
                yy, sy, n = yy + float(y @ y), sy + float(y.sum()), n + len(y)
        yield pd.DataFrame({"k": range(width * width + width + 3), "v": np.r_[xx.ravel(), xy, yy, sy, n]})

    t = rows.mapInPandas(go, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
    if not len(t):
        t = np.zeros(width * width + width + 3)
    return t[:width * width].reshape(width, width), t[width * width:-3], float(t[-3]), float(t[-2]), int(t[-1])


class Smooth:
    """A fitted univariate smooth: ``predict`` values, effective degrees of freedom ``edf``, in-sample ``r2``, rows ``n``."""

    def __init__(self, basis, coef: np.ndarray, edf: float, r2: float, n: int):
        self.basis, self.coef, self.edf, self.r2, self.n = basis, coef, edf, r2, n

    def predict(self, x) -> np.ndarray:
        return self.basis(np.asarray(x, float).reshape(-1, 1)) @ self.coef


def _bspline(knots: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Cubic truncated-power-free basis: cubic radial functions of the knots beside a straight line (natural enough between them)."""
    def of(v: np.ndarray) -> np.ndarray:
        x = v[:, 0]
        return np.column_stack([np.ones(len(x)), x, np.abs(x[:, None] - knots[None]) ** 3])
    return of


def smooth(df: DataFrame, x: str, y: str, kind: str = "spline", size: int = 20) -> Smooth:
    """Smooth of y on x over all complete rows.

    spline: cubic functions of ``size`` knots, their weight chosen by
    generalised cross-validation; gaussian_process: radial functions of ``size``
    inducing points, length a fifth of the range, noise by the same rule;
    polynomial: third degree; linear. Fewer than 3 rows are an error; equal x
    give the mean.
    """
    rows = _complete(df, [x, y])
    s = rows.agg(F.min("c0").alias("lo"), F.max("c0").alias("hi"), F.count("*").alias("n")).first()
    if s["n"] < 3:
        raise ValueError("at least 3 complete rows are needed")
    lo, span = s["lo"], (s["hi"] - s["lo"]) or 1.0
    at = np.linspace(0, 1, size)
    bases = {
        "spline": (_bspline(at), size + 2, np.r_[0, 0, np.ones(size)]), "gaussian_process": (lambda v: np.column_stack([np.ones(len(v)), np.exp(-0.5 * ((v - at[None]) / 0.2) ** 2)]), size + 1, np.r_[0, np.ones(size)]),
        "polynomial": (lambda v: v[:, :1] ** np.arange(4), 4, np.zeros(4)), "linear": (lambda v: v[:, :1] ** np.arange(2), 2, np.zeros(2)),
    }
    if kind not in bases:
        raise ValueError(f"Unknown smoother: {kind}")
    raw, width, pen = bases[kind]
    basis = lambda v: raw((v - lo) / span)
    xx, xy, yy, sy, n = _moments(rows, basis, width)
    total = yy - sy * sy / n
    best = None
    for lam in (10.0 ** np.arange(-8, 5) * n if pen.any() else [0.0]):
        a = xx + lam * np.diag(pen) + 1e-10 * np.trace(xx) / width * np.eye(width)
        inv = np.linalg.pinv(a, hermitian=True)
        coef = inv @ xy
        rss, edf = max(0.0, yy - 2 * coef @ xy + coef @ xx @ coef), float(np.trace(inv @ xx))
        score = n * rss / max(1e-9, n - edf) ** 2
        if best is None or score < best[0]:
            best = (score, coef, edf, 1 - rss / total if total > 0 else 0.0)
    return Smooth(basis, best[1], best[2], float(best[3]), n)


def lowess(df: DataFrame, x: str, y: str, share: float = 0.3, bins: int = 1_000) -> pd.DataFrame:
    """(x, smooth, rows): local straight lines with tricube weights over the ``share`` nearest rows. Rows are first summed in ``bins`` equal bins of x (means and counts), exactly where no two x share a bin."""
    rows = _complete(df, [x, y])
    s = rows.agg(F.min("c0").alias("lo"), F.max("c0").alias("hi")).first()
    if s["lo"] is None:
        return pd.DataFrame({"x": [], "smooth": [], "rows": []})
    width = (s["hi"] - s["lo"]) / bins or 1.0
    t = rows.groupBy(F.least(F.floor((C("c0") - s["lo"]) / width), F.lit(bins - 1)).alias("b")).agg(F.avg("c0").alias("x"), F.avg("c1").alias("y"), F.count("*").alias("k")).toPandas().sort_values("x")
    a, b, k = t["x"].to_numpy(), t["y"].to_numpy(), t["k"].to_numpy(float)
    out, need = np.zeros(len(a)), max(2.0, share * k.sum())
    for i, at in enumerate(a):
        d = np.abs(a - at)
        o = np.argsort(d, kind="stable")
        reach = d[o[min(len(o) - 1, int(np.searchsorted(np.cumsum(k[o]), need)))]] or 1.0
        w = k * np.clip(1 - (d / (reach * (1 + 1e-9))) ** 3, 0, None) ** 3
        m, my = (w @ a) / w.sum(), (w @ b) / w.sum()
        var = w @ (a - m) ** 2
        out[i] = my + ((w @ ((a - m) * (b - my))) / var * (at - m) if var > 1e-12 * max(1.0, m * m) else 0.0)
    return pd.DataFrame({"x": a, "smooth": out, "rows": k.astype(int)})


LINKS = {"gaussian": lambda v: v, "poisson": np.exp, "binomial": lambda v: 1 / (1 + np.exp(-v))}


def fit_gam(df: DataFrame, response: str, predictors: list[str], kinds: dict[str, str] | None = None, family: str = "gaussian") -> tuple[pd.DataFrame, Callable[[pd.DataFrame], np.ndarray]]:
    """(predictor, smoother, edf, r2, f, p, n; prediction of the sum of the smooths around the mean, through the family's link).

    Smooths are fitted each for itself, not backfitted. 10 complete rows or more.
    """
    rows = _complete(df, [response, *predictors]).toDF(response, *predictors)
    m = rows.agg(F.count("*").alias("n"), F.avg(response).alias("m")).first()
    if m["n"] < 10:
        raise ValueError("at least 10 complete rows are needed")
    fits, out = {}, []
    for p in predictors:
        kind = (kinds or {}).get(p, "spline")
        s = fits[p] = smooth(rows, p, response, kind)
        df1, df2 = max(1.0, s.edf - 1), max(1.0, s.n - s.edf)
        f = (s.r2 / df1) / max((1 - s.r2) / df2, 1e-300)
        out.append((p, kind, s.edf, s.r2, f, f_upper(f, df1, df2), s.n))

    def predict(t: pd.DataFrame) -> np.ndarray:
        return LINKS[family](m["m"] + sum(fits[p].predict(t[p]) - m["m"] for p in predictors))

    return pd.DataFrame(out, columns=["predictor", "smoother", "edf", "r2", "f", "p", "n"]), predict


def multiple_regression(df: DataFrame, response: str, predictors: list[str], interactions: bool = True) -> pd.DataFrame:
    """(term, coefficient, r2, n) of least squares on standardised predictors and their pairwise products; rows with a gap are left out."""
    rows = _complete(df, [*predictors, response])
    k = len(predictors)
    s = rows.agg(F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)], *[F.stddev_pop(f"c{i}").alias(f"s{i}") for i in range(k)]).first()
    if s["n"] <= k:
        raise ValueError(f"{s['n']} complete rows are too few")
    mean, sd = np.array([s[f"m{i}"] for i in range(k)]), np.array([s[f"s{i}"] or 1.0 for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)] if interactions else []

    def basis(v: np.ndarray) -> np.ndarray:
        z = (v - mean) / sd
        return np.column_stack([np.ones(len(z)), z, *[z[:, i] * z[:, j] for i, j in pairs]])

    xx, xy, yy, sy, n = _moments(rows, basis, 1 + k + len(pairs))
    coef = np.linalg.pinv(xx, hermitian=True) @ xy
    total = yy - sy * sy / n
    r2 = 1 - (yy - coef @ xy) / total if total > 0 else 0.0
    return pd.DataFrame({"term": ["intercept", *predictors, *[f"{predictors[i]}:{predictors[j]}" for i, j in pairs]], "coefficient": coef, "r2": r2, "n": n})


def response_curves(com: DataFrame, env: DataFrame, variable: str, curve: str = "gaussian", least: int = 4) -> DataFrame:
    """(species, curve, n, optimum, tolerance, niche_width, amplitude, baseline, r2, rmse) of abundances over an environmental value, at the sites where the species occurs.

    gaussian: a·exp(−(x − m)²/2s²) + d; sigmoid: amplitude, rate as tolerance and
    turning point as optimum. Species of fewer than ``least`` sites are left out.
    """
    from phytoscape.operators.temporal import fit_curves

    j = com.join(env.select("site", C(variable).cast("double").alias("v")), "site").where("v is not null and not isnan(v)")
    fit = fit_curves(j, "species", "v", "abundance", curve, least)
    p = lambda i: C("params")[i]
    cols = {"gaussian": (p(1), F.abs(p(2)), p(0), p(3)), "sigmoid": (p(2), F.abs(p(1)), p(0), p(3))}
    if curve not in cols:
        raise ValueError(f"Unknown response curve: {curve}")
    o, t, a, b = cols[curve]
    return fit.select(C("grp").alias("species"), "curve", "n", o.alias("optimum"), t.alias("tolerance"), (2 * t).alias("niche_width"), a.alias("amplitude"), b.alias("baseline"), "r2", "rmse")


def gradient_lengths(scores: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, length): four population deviations of the site scores of each axis."""
    s = scores.agg(*[(4 * F.stddev_pop(a)).alias(a) for a in axes])
    return s.unpivot([], axes, "axis", "length")


def environmental_fit(scores: DataFrame, axes: list[str], env: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, axis, coefficient, n, r2, f, p): least squares of each variable on the axes of an ordination, over sites that have it; three or more."""
    out = []
    j = scores.join(env, "site")
    for v in variables:
        rows = _complete(j, [*axes, v])
        xx, xy, yy, sy, n = _moments(rows, lambda a: np.column_stack([np.ones(len(a)), a]), len(axes) + 1)
        if n < 3:
            continue
        coef = np.linalg.pinv(xx, hermitian=True) @ xy
        total = yy - sy * sy / n
        r2 = 1 - max(0.0, yy - coef @ xy) / total if total > 0 else 0.0
        df2 = n - len(axes) - 1
        f = (r2 / len(axes)) / ((1 - r2) / df2) if df2 > 0 and r2 < 1 else float("inf")
        out += [(v, a, float(c), int(n), float(r2), float(f), float(f_upper(f, len(axes), df2)) if np.isfinite(f) else 0.0) for a, c in zip(axes, coef[1:])]
    return scores.sparkSession.createDataFrame(out, "variable string, axis string, coefficient double, n long, r2 double, f double, p double")


def shepard(d: DataFrame, scores: DataFrame, axes: list[str]) -> DataFrame:
    """(i, j, d, delta): distances of a pair table and those of the ordination's sites."""
    side = lambda s: scores.select(C("site").alias(s), *[C(a).alias(f"{s}_{a}") for a in axes])
    gap = F.sqrt(sum(((C(f"i_{a}") - C(f"j_{a}")) ** 2 for a in axes), F.lit(0.0)))
    return d.join(side("i"), "i").join(side("j"), "j").select("i", "j", "d", gap.alias("delta"))


def goodness_of_fit(d: DataFrame, scores: DataFrame, axes: list[str]) -> DataFrame:
    """One row: pairs, correlation, r2 and stress √(Σ(d − δ)² / Σδ²) of an ordination against the distances."""
    s = shepard(d, scores, axes)
    r = s.agg(F.count("*").alias("pairs"), F.coalesce(F.corr("d", "delta"), F.lit(0.0)).alias("correlation"), F.sqrt(F.try_divide(F.sum((C("d") - C("delta")) ** 2), F.sum(C("delta") ** 2))).alias("stress"))
    return r.select("pairs", "correlation", (C("correlation") ** 2).alias("r2"), "stress")


def axis_correlations(scores: DataFrame, axes: list[str], env: DataFrame, variables: list[str]) -> DataFrame:
    """(axis, variable, n, r) of site scores with environmental values over more than three common sites; no spread gives 0."""
    a = scores.unpivot("site", axes, "axis", "score")
    e = env.select("site", *[C(v).cast("double").alias(v) for v in variables]).unpivot("site", variables, "variable", "v").where("v is not null and not isnan(v)")
    return a.join(e, "site").groupBy("axis", "variable").agg(F.count("*").alias("n"), F.coalesce(F.corr("score", "v"), F.lit(0.0)).alias("r")).where("n > 3")


def gradient_analysis(com: DataFrame, env: DataFrame, variables: list[str], method: str = "cca") -> dict[str, DataFrame]:
    """Tables of a gradient analysis: cca and rda (axes, and for cca the species' optima), dca (scores, lengths, correlations with the environment), pca_env (principal axes of the environment)."""
    spark = com.sparkSession
    if method in ("cca", "rda"):
        out = {"axes": spark.createDataFrame(constrained(com, env, variables, method))}
        if method == "cca":
            parts = [species_optima(com, env, v).withColumn("variable", F.lit(v)) for v in variables]
            optima = parts[0]
            for p in parts[1:]:
                optima = optima.union(p)
            out["optima"] = optima
        return out
    if method == "dca":
        s = dca(com)
        return {"scores": s, "lengths": gradient_lengths(s, ["axis1", "axis2"]), "correlations": axis_correlations(s, ["axis1", "axis2"], env, variables)}
    if method == "pca_env":
        rows = _complete(env, variables)
        k = len(variables)
        st = rows.agg(F.count("*").alias("n"), *[F.corr(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i in range(k) for j in range(i + 1, k)]).first()
        m = np.eye(k)
        for i in range(k):
            for j in range(i + 1, k):
                m[i, j] = m[j, i] = st[f"r{i}_{j}"] or 0.0
        lam, vec = np.linalg.eigh(m)
        o = np.argsort(-lam)
        vec = vec[:, o] * np.where(vec[np.abs(vec[:, o]).argmax(0), o] < 0, -1, 1)
        return {"axes": spark.createDataFrame([(int(a) + 1, float(lam[o[a]]), float(lam[o[a]] / k), v, float(vec[i, a])) for a in range(k) for i, v in enumerate(variables)], "axis int, eigenvalue double, ratio double, variable string, loading double")}
    raise ValueError(f"Unknown method: {method}")

