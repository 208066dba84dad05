"""Queries of time series, spatial measures and curves, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from phytoscape.functions import formulas as X
from phytoscape.operators import spatial as S
from phytoscape.operators import temporal as T
from phytoscape.operators.smoothing import polynomial_fit
from phytoscape.plans.helpers import rounded
from phytoscape.session import read_table

QUERIES, SQL = {}, {}


def _add(name, build, body=None, doubles="", others=""):
    QUERIES[name] = lambda spark, d: rounded(build(spark, d))
    if body:
        cols = ", ".join([*filter(None, (c.strip() for c in others.split(","))), *[f"round({c.strip()}::double, 9) + 0.0 as {c.strip()}" for c in doubles.split(",") if c.strip()]])
        SQL[name] = f"{_VIEWS}, result as ({body}) select {cols} from result"


_VIEWS = """with days as (select date_trunc('day', ts)::date as day, date_diff('day', date '2024-01-01', date_trunc('day', ts)::date) x, sum(value) y, count(*)::double k from events group by 1, 2),
pts as (select site_id site, avg(longitude) x, avg(latitude) y, avg(elevation) z from environmental_variables where latitude between 40 and 50 and longitude between -80 and -65 and elevation between 0 and 2500 group by 1),
cells as (select ((event_id // 20) % 20)::int "row", (event_id % 20)::int col, (sum(user_id) % 3)::bigint code from events group by 1, 2)"""


def _days(s, d):
    day = F.to_date("ts")
    return read_table(s, d, "events").groupBy(day.alias("day")).agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("k")).withColumn("x", F.datediff("day", F.lit("2024-01-01")))


def _points(s, d):
    return read_table(s, d, "environmental_variables").where("latitude between 40 and 50 and longitude between -80 and -65 and elevation between 0 and 2500").groupBy(F.col("site_id").alias("site")).agg(F.avg("longitude").alias("x"), F.avg("latitude").alias("y"), F.avg("elevation").alias("z"))


def _cells(s, d):
    return read_table(s, d, "events").groupBy((F.floor(F.col("event_id") / 20) % 20).cast("int").alias("row"), (F.col("event_id") % 20).cast("int").alias("col")).agg((F.sum("user_id") % 3).alias("code"))


_add("linear_trend", lambda s, d: T.linear_trend(_days(s, d), "x", "y"), "select *, r * sqrt((n - 2) / (1 - r * r)) t, case when slope > 0 then 'increasing' when slope < 0 then 'decreasing' else 'stable' end direction from (select count(*) n, regr_slope(y, x) slope, regr_intercept(y, x) intercept, regr_r2(y, x) r2, corr(y, x) r from days)", "slope, intercept, r2, t", "n, direction")
_add("mann_kendall", lambda s, d: T.mann_kendall(_days(s, d), "x", "y"), """
  select n, s, v variance, sen_slope, case when s > 0 then (s - 1) / sqrt(v) when s < 0 then (s + 1) / sqrt(v) else 0 end z from (select sum(sign(b.y - a.y)) s, median((b.y - a.y) / (b.x - a.x)) sen_slope from days a join days b on a.x < b.x),
  (select sum(k) n, (sum(k) * (sum(k) - 1) * (2 * sum(k) + 5) - sum(k * (k - 1) * (2 * k + 5))) / 18 v from (select y, count(*) k from days group by 1))""", "s, variance, sen_slope, z", "n::bigint n")
_add("lag_correlation", lambda s, d: T.lag_correlations(_days(s, d), "day", "y", ["k"]), "select 'k' driver, l::bigint lag, corr(y, v) r from (select y, unnest([0, 1, 2, 3]) l, unnest([k, lag(k, 1) over w, lag(k, 2) over w, lag(k, 3) over w]) v from days window w as (order by day)) where v is not null group by 1, 2", "r", "driver, lag")
_add("best_lag", lambda s, d: T.best_lag(T.lag_correlations(_days(s, d), "day", "y", ["k"])), "select 'k' driver, arg_max(lag, abs(r)) lag, arg_max(r, abs(r)) r from (select l::bigint lag, corr(y, v) r from (select y, unnest([0, 1, 2, 3]) l, unnest([k, lag(k, 1) over w, lag(k, 2) over w, lag(k, 3) over w]) v from days window w as (order by day)) where v is not null group by 1)", "r", "driver, lag")
_add("rolling_mean", lambda s, d: T.rolling_mean(_days(s, d), "day", "y", 7).select(F.col("day").cast("string").alias("day"), "mean"), "select day::varchar as day, case when count(*) over w = 7 then avg(y) over w end as mean from days window w as (order by day rows between 3 preceding and 3 following)", "mean", "day")
_add("simple_decomposition", lambda s, d: T.decompose(_days(s, d), "day", "y", 7).select(F.col("day").cast("string").alias("day"), "trend", "seasonal", "residual"), """
  select day::varchar as day, m trend, s seasonal, y - m - s residual from (select *, avg(y - m) over (partition by dayofyear(day) % 7) s from (select *, case when count(*) over w = 7 then avg(y) over w end m from days window w as (order by day rows between 3 preceding and 3 following)))""", "trend, seasonal, residual", "day")
_add("polynomial_trend", lambda s, d: s.createDataFrame(polynomial_fit(_days(s, d), "x", "y", 2)).select("power", F.round("coefficient", 5).alias("coefficient"), F.round("r2", 6).alias("r2")), """
  with c as (select x - m t, y, m from days, (select avg(x) m from days)), s as (select count(*)::double n, any_value(m) m, sum(t * t) s2, sum(t * t * t) s3, sum(t * t * t * t) s4, sum(y) t0, sum(t * y) t1, sum(t * t * y) t2, sum(y * y) yy from c),
  a as (select *, (t0 * (s2 * s4 - s3 * s3) + s2 * (t1 * s3 - s2 * t2)) / d a0, (n * (t1 * s4 - s3 * t2) + t0 * s2 * s3 - s2 * s2 * t1) / d a1, (n * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / d a2 from (select *, n * (s2 * s4 - s3 * s3) - s2 * s2 * s2 d from s)),
  r as (select *, round(1 - (yy - a0 * t0 - a1 * t1 - a2 * t2) / (yy - t0 * t0 / n), 6) r2 from a)
  select unnest([0, 1, 2])::bigint power, round(unnest([a0 - a1 * m + a2 * m * m, a1 - 2 * a2 * m, a2]), 5) coefficient, r2 from r""", "coefficient, r2", "power")
_add("growth_fit", lambda s, d: T.fit_curves(read_table(s, d, "events"), "event_type", "user_id", "value", "exponential").select("grp", "curve", "n", F.concat_ws(",", F.transform("params", lambda p: F.round(p, 6).cast("string"))).alias("params"), F.concat_ws(",", F.transform("errors", lambda p: F.round(p, 6).cast("string"))).alias("errors"), "r2", "rmse"))
_Q = "l_quantity"
_CURVES = {
    "logistic": (lambda q: X.logistic_growth(q, 10.0, 0.2, 25.0), f"10 / (1 + exp(-0.2 * ({_Q} - 25)))"), "gompertz": (lambda q: X.gompertz_growth(q, 10.0, 0.2, 25.0), f"10 * exp(-exp(-0.2 * ({_Q} - 25)))"),
    "bertalanffy": (lambda q: X.von_bertalanffy_growth(q, 10.0, 0.2, 0.5), f"10 * pow(1 - exp(-0.2 * ({_Q} - 0.5)), 3)"), "exponential": (lambda q: X.exponential_growth(q, 2.0, 0.05), f"2 * exp(0.05 * {_Q})"), "power": (lambda q: X.power_growth(q, 2.0, 0.5), f"2 * pow({_Q}, 0.5)"),
    "sigmoid": (lambda q: X.sigmoid(q, 5.0, 0.3, 20.0, 1.0), f"5 / (1 + exp(-0.3 * ({_Q} - 20))) + 1"), "gauss": (lambda q: X.gaussian(q, 5.0, 20.0, 4.0, 1.0), f"5 * exp(-(({_Q} - 20) * ({_Q} - 20)) / 32) + 1"),
    "double_sigmoid": (lambda q: X.double_sigmoid(q, 5.0, 0.3, 10.0, 4.0, 0.2, 30.0, 1.0), f"5 / (1 + exp(-0.3 * ({_Q} - 10))) - 4 / (1 + exp(-0.2 * ({_Q} - 30))) + 1"),
    "response": (lambda q: X.gaussian_response(q, 5.0, 20.0, 4.0, 1.0), f"1 + 5 * exp(-0.5 * pow(({_Q} - 20) / 4, 2))"), "threshold": (lambda q: X.threshold_response(q, 5.0, 20.0, 0.5, 1.0), f"1 + 5 / (1 + exp(-0.5 * ({_Q} - 20)))"),
    "weibull": (lambda q: X.weibull(q, 5.0, 1.5, 20.0, 1.0), f"5 * (1.5 / 20) * pow({_Q} / 20, 0.5) * exp(-pow({_Q} / 20, 1.5)) + 1"), "unimodal": (lambda q: X.unimodal_response(q, 5.0, 20.0, 10.0, 1.0), f"greatest(1, 1 + 5 * (1 - pow(({_Q} - 20) / 10, 2)))"),
    "beta": (lambda q: X.beta_curve(q, 5.0, 2.0, 3.0, 0.0, 60.0), f"case when {_Q} > 0 and {_Q} < 60 then 5 * ({_Q} / 60) * pow(1 - {_Q} / 60, 2) else 0 end"),
}
_add("curve_values", lambda s, d: read_table(s, d, "lineitem").select("l_quantity").distinct().select("l_quantity", *[c(F.col("l_quantity")).alias(k) for k, (c, _) in _CURVES.items()]), "select l_quantity, " + ", ".join(f"{q} {k}" for k, (_, q) in _CURVES.items()) + " from (select distinct l_quantity::double l_quantity from lineitem)", "l_quantity, " + ", ".join(_CURVES))
_GRID = "(select (j * 20 + i)::bigint grid_id, -80 + 0.75 / 2 + 0.75 * i gx, 40 + 0.75 / 2 + 0.75 * j gy from (select unnest(range(20)) i), (select unnest(range(13)) j))"


def _grid(s):
    return S.grid(s, -80.0, 40.0, -65.0, 50.0, 0.75)


_add("spatial_grid", lambda s, d: _grid(s), f"select grid_id, gx x, gy y from {_GRID}", "x, y", "grid_id")
_add("idw", lambda s, d: S.idw(_points(s, d), _grid(s)), f"select grid_id, sum(z / d2) / sum(1 / d2) z from (select *, pow(x - gx, 2) + pow(y - gy, 2) d2 from pts, {_GRID}) group by 1", "z", "grid_id")
_add("nearest_value", lambda s, d: S.nearest(_points(s, d), _grid(s)), f"select grid_id, arg_min(z, pow(x - gx, 2) + pow(y - gy, 2)) z from pts, {_GRID} group by 1", "z", "grid_id")
_PAIR = "(select a.site i, b.site j, a.z zi, b.z zj, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) d from pts a join pts b on a.site <> b.site)"
_add("loo_rmse", lambda s, d: S.loo_rmse(_points(s, d)), f"select sqrt(avg(pow(p - zi, 2))) rmse from (select i, zi, sum(zj / (d * d)) / sum(1 / (d * d)) p from {_PAIR} where d > 0 group by 1, 2)", "rmse")
_add("autocorrelation", lambda s, d: S.autocorrelation(_points(s, d)), f"""
  select l / (n * v) morans_i, -1.0 / (n - 1) expected, (l / (n * v) + 1.0 / (n - 1)) / sqrt(1.0 / n) z, sq / (2 * w * v) gearys_c from (select sum(lagged) l, sum(sq) sq, sum(w) w from (select i, avg((zi - m) * (zj - m)) lagged, sum(pow(zi - zj, 2)) sq, count(*) w
    from {_PAIR}, (select avg(z) m from pts), (select avg(d) t from {_PAIR} where d > 0) where d > 0 and d <= t group by 1)), (select count(*) n, var_pop(z) v from pts)""", "morans_i, expected, z, gearys_c")
_add("variogram", lambda s, d: S.variogram(_points(s, d), 20), f"select b::bigint bin, (any_value(b) + 0.5) * max(top) / 20 lag, avg(pow(zi - zj, 2)) / 2 semivariance, count(*) pairs from (select *, floor(d / (top / 20)) b from {_PAIR}, (select max(d) top from {_PAIR}) where i < j) where b < 20 group by b", "lag, semivariance", "bin, pairs")
_add("landscape_diversity", lambda s, d: S.landscape_level(_cells(s, d)), "select -sum(p * ln(p + 1e-10)) shannon, 1 - sum(p * p) simpson, -sum(p * ln(p + 1e-10)) / ln(count(*)) evenness from (select code, count(*) / sum(count(*)) over () p from cells group by 1)", "shannon, simpson, evenness")
_ADJ = "(select a.code c1, b.code c2 from cells a join cells b on (b.row = a.row and b.col = a.col + 1) or (b.row = a.row + 1 and b.col = a.col) where a.row < 19 and a.col < 19)"
_add("contagion", lambda s, d: S.contagion(_cells(s, d)), f"select (1 + sum(p * ln(p + 1e-10)) / ln((select count(distinct code) from cells))) * 100 contagion from (select c1, c2, count(*) / sum(count(*)) over () p from {_ADJ} group by 1, 2)", "contagion")
_add("patch_metrics", lambda s, d: S.patch_metrics(_cells(s, d)), """
  with recursive reach as (select "row", col, code, "row" * 100 + col root from cells where code <> 0 union select c."row", c.col, c.code, r.root from reach r join cells c on c.code = r.code and abs(c."row" - r."row") + abs(c.col - r.col) = 1),
  pt as (select code, root, count(*) a from (select "row", col, code, min(root) root from reach group by all) group by 1, 2)
  select code, count(*) patches, count(*) / (select count(*) from cells) * 10000 patch_density, avg(a) mean_area, case when count(*) > 1 then stddev_pop(a) / avg(a) * 100 else 0 end area_cv, max(a) / (select count(*) from cells) * 100 largest_patch_index from pt group by 1""", "patch_density, mean_area, area_cv, largest_patch_index", "code, patches")
