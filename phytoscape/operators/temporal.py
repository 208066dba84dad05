"""Trends, lags, decomposition and curve fits of time series. Series are always ordered by their time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.functions.statistics import fit_curve, normal_cdf, t_two_sided

C = F.col


def linear_trend(s: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, r2, t, direction of the least-squares line; missing values are left out."""
    r = s.where(C(x).isNotNull() & C(y).isNotNull()).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(y, x).alias("r"))
    t = F.when(F.abs("r") < 1, C("r") * F.sqrt(F.try_divide(C("n") - 2, 1 - C("r") * C("r"))))
    return r.select("n", "slope", "intercept", "r2", t.alias("t"), F.when(C("slope") > 0, "increasing").when(C("slope") < 0, "decreasing").otherwise("stable").alias("direction"))


def trend_p_value(row) -> float:
    return t_two_sided(row["t"], row["n"] - 2) if row["t"] is not None else 0.0


def mann_kendall(s: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, s, variance (ties considered), z with continuity correction, Sen's slope. Series of periods, compared pair by pair."""
    v = s.where(C(x).isNotNull() & C(y).isNotNull()).select(C(x).alias("x"), C(y).alias("y"))
    p = v.toDF("x1", "y1").join(v.toDF("x2", "y2"), C("x1") < C("x2")).agg(F.sum(F.signum(C("y2") - C("y1"))).alias("s"), F.median((C("y2") - C("y1")) / (C("x2") - C("x1"))).alias("sen_slope"))
    ties = v.groupBy("y").agg(F.count("*").alias("k")).agg(F.sum(C("k") * (C("k") - 1) * (2 * C("k") + 5)).alias("ties"), F.sum("k").alias("n"))
    var = (C("n") * (C("n") - 1) * (2 * C("n") + 5) - C("ties")) / 18
    out = p.join(ties).select("n", "s", var.alias("variance"), "sen_slope")
    return out.withColumn("z", F.when((C("s") > 0) & (C("variance") > 0), (C("s") - 1) / F.sqrt("variance")).when((C("s") < 0) & (C("variance") > 0), (C("s") + 1) / F.sqrt("variance")).otherwise(0.0))


def mann_kendall_p(row) -> float:
    return 2 * (1 - normal_cdf(abs(row["z"])))


def lag_correlations(s: DataFrame, time: str, response: str, drivers: list[str], lags: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """(driver, lag, r): Pearson correlation of the response with each driver some rows before; fewer than 3 rows, or no spread, give 0."""
    w = Window.orderBy(time)
    d = s.select(time, response, *[(F.lag(v, k).over(w) if k else C(v)).alias(f"{v}_{k}") for v in drivers for k in lags])
    ok = lambda c: C(c).isNotNull() & C(response).isNotNull()
    r = d.agg(*[F.when(F.count_if(ok(f"{v}_{k}")) >= 3, F.coalesce(F.corr(response, f"{v}_{k}"), F.lit(0.0))).otherwise(0.0).alias(f"{v}_{k}") for v in drivers for k in lags])
    return r.select(F.explode(F.array(*[F.struct(F.lit(v).alias("driver"), F.lit(k).alias("lag"), C(f"{v}_{k}").alias("r")) for v in drivers for k in lags])).alias("x")).select("x.*")


def best_lag(correlations: DataFrame) -> DataFrame:
    return correlations.groupBy("driver").agg(F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -C("lag"))).alias("b")).select("driver", "b.*")


def rolling_mean(s: DataFrame, time: str, value: str, width: int) -> DataFrame:
    """(time, value, mean) over a centred window, NULL where the window is not full."""
    before = width // 2
    w = Window.orderBy(time).rowsBetween(-before, width - 1 - before)
    return s.select(time, value, F.when(F.count(value).over(w) == width, F.avg(value).over(w)).alias("mean"))


def decompose(s: DataFrame, time: str, value: str, period: int) -> DataFrame:
    """(time, value, trend, seasonal, residual): rolling mean over the period; seasonal is the mean of what is left by day of year modulo the period."""
    t = rolling_mean(s, time, value, period).withColumn("left", C(value) - C("mean")).withColumn("phase", F.dayofyear(time) % period)
    t = t.withColumn("seasonal", F.avg("left").over(Window.partitionBy("phase")))
    return t.select(time, value, C("mean").alias("trend"), "seasonal", (C(value) - C("mean") - C("seasonal")).alias("residual"))


def _clean(a):
    return np.where(np.isfinite(a), a, 1e9)


CURVES = {
    "logistic": (lambda t, k, r, t0: k / (1 + np.exp(-r * (t - t0))), lambda t, y: [y.max() * 1.1, 0.1, np.median(t)]),
    "gompertz": (lambda t, k, r, t0: k * np.exp(-np.exp(-r * (t - t0))), lambda t, y: [y.max() * 1.1, 0.1, np.median(t)]),
    "von_bertalanffy": (lambda t, k, r, t0: k * (1 - np.exp(-r * (t - t0))) ** 3, lambda t, y: [y.max() * 1.1, 0.1, t.min() - 1]),
    "exponential": (lambda t, n0, r: n0 * np.exp(r * t), lambda t, y: [max(y[0], 1e-3), 0.01]),
    "power": (lambda t, a, b: a * np.power(np.maximum(t, 1e-9), b), lambda t, y: [1.0, 1.0]),
    "sigmoid": (lambda x, a, b, c, d: a / (1 + np.exp(-b * (x - c))) + d, lambda x, y: [np.ptp(y), 0.1, x.mean(), y.min()]),
    "gaussian": (lambda x, a, m, s, d: a * np.exp(-((x - m) ** 2) / (2 * s * s)) + d, lambda x, y: [np.ptp(y), x[y.argmax()], max(np.ptp(x) / 4, 1e-3), y.min()]),
}


def fit_curves(s: DataFrame, group: str, x: str, y: str, curve: str = "logistic", least: int = 4) -> DataFrame:
    """(group, curve, n, params, errors, r2, rmse) of a curve fitted to each group of ``least`` rows or more.

    The fit is that of all rows. Groups are first reduced to count, mean and
    squares around the mean of the response at each different x, which is all
    that least squares need: a group is 32 bytes for each different x.
    """
    f, start = CURVES[curve]
    pts = s.where(C(x).isNotNull() & C(y).isNotNull() & ~F.isnan(C(y).cast("double"))).groupBy(C(group).cast("string").alias("grp"), C(x).cast("double").alias("x")).agg(F.avg(C(y).cast("double")).alias("y"), F.count("*").alias("k"), (F.var_pop(C(y).cast("double")) * F.count("*")).alias("within"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        a, b, k = part["x"].to_numpy(), part["y"].to_numpy(), part["k"].to_numpy()
        if k.sum() < least:
            return pd.DataFrame({"grp": [], "curve": [], "n": [], "params": [], "errors": [], "r2": [], "rmse": []})
        # a rate that overflows from its start has no slopes: it is fitted per larger unit of x
        unit = max(1.0, float(np.abs(a).max()) / 1_500) if curve == "exponential" and 0.01 * float(np.abs(a).max()) > 50 else 1.0
        p, e, r2, rmse = fit_curve(lambda t, *q: _clean(f(t, *q)), a / unit, b, start(a / unit, b), counts=k, within=part["within"].sum())
        if unit > 1:
            p[1], e[1] = p[1] / unit, e[1] / unit
        return pd.DataFrame([(part["grp"].iloc[0], curve, int(k.sum()), p.tolist(), e.tolist(), r2, rmse)], columns=["grp", "curve", "n", "params", "errors", "r2", "rmse"])

    return pts.groupBy("grp").applyInPandas(fit, "grp string, curve string, n long, params array<double>, errors array<double>, r2 double, rmse double")


def phenology(s: DataFrame, group: str, x: str, y: str, curve: str = "gaussian") -> DataFrame:
    """(grp, curve, n, parameter, value, r2, rmse) of seasonal curves: onset, amplitude, rate and baseline of a sigmoid; peak, duration and baseline of a gaussian."""
    p = lambda i: C("params")[i]
    named = {
        "sigmoid": {"onset": p(2), "amplitude": p(0), "rate": p(1), "baseline": p(3)},
        "gaussian": {"peak_time": p(1), "peak_amplitude": p(0) + p(3), "duration": 2 * p(2), "baseline": p(3)},
    }
    if curve not in named:
        raise ValueError(f"Unknown model: {curve}")
    f = fit_curves(s, group, x, y, curve)
    return f.select("grp", "curve", "n", "r2", "rmse", F.explode(F.array(*[F.struct(F.lit(k).alias("parameter"), v.alias("value")) for k, v in named[curve].items()])).alias("q")).select("grp", "curve", "n", "q.*", "r2", "rmse")


def classical_decomposition(s: DataFrame, time: str, value: str, period: int, group: str | None = None, model: str = "additive") -> DataFrame:
    """(group, time, value, trend, seasonal, residual): centred moving average over the period (twice for even ones); seasonal are the mean deviations by position in the period, centred on 0 (multiplicative: ratios, on 1). Series are windows of their ``group``."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"Unknown model: {model}")
    t = s.select(*([C(group).alias("grp")] if group else [F.lit("all").alias("grp")]), C(time).alias("t"), C(value).cast("double").alias("v"))
    w = Window.partitionBy("grp").orderBy("t")
    half = period // 2
    around = w.rowsBetween(-half, period - 1 - half) if period % 2 else w.rowsBetween(-half, half)
    if period % 2:
        mean, full = F.avg("v").over(around), F.count("v").over(around) == period
    else:
        mean, full = (F.sum("v").over(around) - 0.5 * (F.lag("v", half).over(w) + F.lead("v", half).over(w))) / period, F.count("v").over(around) == period + 1
    t = t.withColumn("trend", F.when(full, mean)).withColumn("phase", (F.row_number().over(w) - 1) % period)
    apart = (lambda a, b: a - b) if model == "additive" else (lambda a, b: F.try_divide(a, b))
    t = t.withColumn("off", apart(C("v"), C("trend")))
    per = t.groupBy("grp", "phase").agg(F.avg("off").alias("m"))
    per = per.withColumn("seasonal", apart(C("m"), F.avg("m").over(Window.partitionBy("grp")))).drop("m")
    t = t.join(per, ["grp", "phase"])
    return t.select("grp", C("t").alias("time"), C("v").alias("value"), "trend", "seasonal", apart(C("off"), C("seasonal")).alias("residual"))


def _loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Local straight lines with tricube weights over the ``span`` nearest points."""
    out, w0 = np.empty(len(at)), np.ones(len(x)) if weight is None else weight
    k = min(span, len(x))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        near = np.argpartition(d, k - 1)[:k] if k < len(x) else np.arange(len(x))
        h = max(d[near].max() * (1 + (span - k) / max(1, k)), 1e-12)
        w = w0[near] * np.clip(1 - (d[near] / (h * 1.0001)) ** 3, 0, None) ** 3
        if w.sum() <= 0:
            out[i] = y[near].mean()
            continue
        m, my = w @ x[near] / w.sum(), w @ y[near] / w.sum()
        var = w @ (x[near] - m) ** 2
        out[i] = my + (w @ ((x[near] - m) * (y[near] - my)) / var * (a - m) if var > 1e-12 else 0.0)
    return out


def stl_series(y: np.ndarray, period: int, seasonal: int = 7, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) of a series by loess: cycle-subseries smoothed and freed of their low frequencies, then the trend of what is left."""
    n, t = len(y), np.arange(len(y), dtype=float)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    trend, cycle = np.zeros(n), np.zeros(n)
    box = lambda v, k: np.convolve(v, np.ones(k) / k, "valid")
    for _ in range(rounds):
        c = np.zeros(n + 2 * period)
        for p in range(period):
            own = np.arange(p, n, period)
            q = np.arange(-1, len(own) + 1, dtype=float)
            c[p::period][:len(q)] = _loess(np.arange(len(own), dtype=float), (y - trend)[own], q, seasonal)
        low = _loess(t, box(box(box(c, period), period), 3)[:n], t, period | 1)
        cycle = c[period:period + n] - low
        trend = _loess(t, y - cycle, t, span)
    return trend, cycle


def stl(s: DataFrame, time: str, value: str, period: int, group: str | None = None) -> DataFrame:
    """(grp, time, value, trend, seasonal, residual) by ``stl_series``; a group is a series that one task holds (more than 200,000 rows, or fewer than two periods, are an error)."""
    t = s.where(C(time).isNotNull() & C(value).isNotNull()).select(*([C(group).cast("string").alias("grp")] if group else [F.lit("all").alias("grp")]), C(time).alias("time"), C(value).cast("double").alias("value"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("time")
        if not 2 * period <= len(part) <= 200_000:
            raise ValueError(f"a series of {len(part)} rows has fewer than two periods or more than 200,000 rows")
        trend, cycle = stl_series(part["value"].to_numpy(), period)
        return part.assign(trend=trend, seasonal=cycle, residual=part["value"].to_numpy() - trend - cycle)

    kind = t.schema["time"].dataType.simpleString()
    return t.groupBy("grp").applyInPandas(run, f"grp string, time {kind}, value double, trend double, seasonal double, residual double")


def seasonality(s: DataFrame, time: str, value: str, most: int = 24) -> DataFrame:
    """(lag, autocorrelation, period): correlation of a series with itself ``lag`` rows before; period marks the greatest one above 0.3 that exceeds both neighbours."""
    w = Window.orderBy(time)  # one series of periods
    d = s.select(C(value).cast("double").alias("v"), *[F.lag(C(value).cast("double"), k).over(w).alias(f"l{k}") for k in range(1, most + 1)])
    r = d.agg(*[F.coalesce(F.corr("v", f"l{k}"), F.lit(0.0)).alias(f"r{k}") for k in range(1, most + 1)]).first()
    a = [float(r[f"r{k}"]) for k in range(1, most + 1)]
    peaks = [k for k in range(1, most - 1) if a[k] > 0.3 and a[k] > a[k - 1] and a[k] > a[k + 1]]
    best = max(peaks, key=lambda k: a[k], default=None)
    return s.sparkSession.createDataFrame([(k + 1, v, k == best) for k, v in enumerate(a)], "lag int, autocorrelation double, period boolean")


def response_forms(s: DataFrame, x: str, y: str) -> DataFrame:
    """(form, slope, intercept, r2) of linear, logarithmic and exponential responses in closed form, best first by r2; the logarithm takes rows of positive x, the exponential those of positive y (its r2 is of ln y)."""
    ok = s.where(C(x).isNotNull() & C(y).isNotNull()).select(C(x).cast("double").alias("x"), C(y).cast("double").alias("y"))
    lx, ly = F.when(C("x") > 0, F.log("x")), F.when(C("y") > 0, F.log("y"))
    on = F.when(C("x") > 0, C("y"))
    r = ok.agg(*[f(b, a).alias(f"{n}_{m}") for n, (b, a) in {"linear": (C("y"), C("x")), "logarithmic": (on, lx), "exponential": (ly, F.when(C("y") > 0, C("x")))}.items() for m, f in (("s", F.regr_slope), ("i", F.regr_intercept), ("r", F.regr_r2))])
    return r.select(F.explode(F.array(*[F.struct(F.lit(n).alias("form"), C(f"{n}_s").alias("slope"), C(f"{n}_i").alias("intercept"), C(f"{n}_r").alias("r2")) for n in ("linear", "logarithmic", "exponential")])).alias("q")).select("q.*").orderBy(F.desc("r2"))


def detect_trend(s: DataFrame, x: str, y: str, method: str = "linear") -> DataFrame:
    """One row of the named trend: linear, mann_kendall, spline or lowess (mean slope of the smooth, its direction and r2)."""
    if method == "linear":
        return linear_trend(s, x, y)
    if method == "mann_kendall":
        return mann_kendall(s, x, y)
    from phytoscape.operators.environment import lowess, smooth

    if method == "spline":
        fit = smooth(s, x, y)
        lo, hi = s.agg(F.min(C(x).cast("double")), F.max(C(x).cast("double"))).first()
        v = fit.predict(np.linspace(lo, hi, 201))
        slope, r2 = float((v[-1] - v[0]) / ((hi - lo) or 1.0)), fit.r2
    elif method == "lowess":
        t = lowess(s, x, y)
        slope = float((t["smooth"].iloc[-1] - t["smooth"].iloc[0]) / ((t["x"].iloc[-1] - t["x"].iloc[0]) or 1.0)) if len(t) else 0.0
        r2 = float("nan")
    else:
        raise ValueError(f"Unknown method: {method}")
    return s.sparkSession.createDataFrame([(method, slope, None if r2 != r2 else float(r2), "increasing" if slope > 0 else "decreasing" if slope < 0 else "stable")], "method string, mean_slope double, r2 double, direction string")
