"""Queries of environmental models, networks, assembly, validation, prediction and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from phytoscape import quick as Q
from phytoscape import reports as H
from phytoscape.operators import distances as D
from phytoscape.operators import environment as E
from phytoscape.operators import models as M
from phytoscape.operators import networks as N
from phytoscape.operators import spatial as S
from phytoscape.operators import temporal as T
from phytoscape.operators import validation as V
from phytoscape.operators.diversity import rarefaction
from phytoscape.operators.names import albers, standard_dataset
from phytoscape.plans.community import _GRID, _METRIC, _DENSE, _SPECIES, _TRAITS, _TSQL, _env, _long, _phylo, _traits
from phytoscape.plans.helpers import META, observations, rounded, sql, survey
from phytoscape.plans.series import _VIEWS as _SERIES
from phytoscape.plans.series import _cells, _days, _points
from phytoscape.session import read_table

QUERIES, SQL = {}, {}


def _add(name, build, body=None, doubles="", others="", views="com"):
    QUERIES[name] = lambda spark, d: rounded(build(spark, d))
    if body and views == "com":
        SQL[name] = sql(body, doubles, others)
    elif body:
        cols = ", ".join([*filter(None, (c.strip() for c in others.split(","))), *[f"round({c.strip()}::double, 9) + 0.0 as {c.strip()}" for c in doubles.split(",") if c.strip()]])
        SQL[name] = f"{_SERIES}, result as ({body}) select {cols} from result"


def _table(f):
    return lambda spark, d: spark.createDataFrame(f(spark, d))


def _sites(s, d):
    return _points(s, d).select("site", "x", "y", F.col("z").alias("elevation"))


def _measures(s, d):
    """Mean usable measures of the sites."""
    ok = lambda c, lo, hi: F.avg(F.when((F.col(c) >= lo) & (F.col(c) <= hi) & ~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c)
    return read_table(s, d, "environmental_variables").where("site_id is not null").groupBy(F.col("site_id").alias("site")).agg(ok("elevation", -100, 2500), ok("soil_ph", 2, 11), ok("temperature", -40, 50))


# --- environmental models ---------------------------------------------------------
_add("environmental_fit", lambda s, d: E.environmental_fit(_sites(s, d).select("site", "x", "y"), ["x", "y"], _sites(s, d).select("site", "elevation"), ["elevation"]).select("variable", "axis", "n", "r2").withColumn("r2", F.round("r2", 6)), """
  select 'elevation' as variable, a as axis, count(*) n, round((pow(corr(z, x), 2) + pow(corr(z, y), 2) - 2 * corr(z, x) * corr(z, y) * corr(x, y)) / (1 - pow(corr(x, y), 2)), 6) r2 from pts, (select unnest(['x', 'y']) a) group by 2""", "r2", "variable, axis, n", "series")
_add("goodness_of_fit", lambda s, d: E.goodness_of_fit(D.distances(survey(s, d)), _sites(s, d), ["x", "y"]), f"""
  with pts as (select site_id site, avg(longitude) x, avg(latitude) y from environmental_variables where latitude between 40 and 50 and longitude between -80 and -65 and elevation between 0 and 2500 group by 1),
  q as (select b.d, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) delta from (select i, j, {_METRIC['bray_curtis']} d from {_DENSE.format(g=_GRID)} group by 1, 2) b join pts p on p.site = i join pts q on q.site = j)
  select count(*) pairs, corr(d, delta) correlation, pow(corr(d, delta), 2) r2, sqrt(sum(pow(d - delta, 2)) / sum(delta * delta)) stress from q""", "correlation, r2, stress", "pairs")
_add("axis_correlations", lambda s, d: E.axis_correlations(_sites(s, d), ["x", "y"], _sites(s, d).select("site", "elevation"), ["elevation"]), "select a as axis, 'elevation' as variable, count(*) n, corr(case when a = 'x' then x else y end, z) r from pts, (select unnest(['x', 'y']) a) group by 1", "r", "axis, variable, n", "series")
_add("gradient_lengths", lambda s, d: E.gradient_lengths(_sites(s, d), ["x", "y"]), "select a as axis, 4 * stddev_pop(case when a = 'x' then x else y end) length from pts, (select unnest(['x', 'y']) a) group by 1", "length", "axis", "series")
_add("gradient_dca", lambda s, d: E.gradient_analysis(survey(s, d), _measures(s, d), ["elevation", "soil_ph"], "dca")["correlations"])
_add("gradient_pca_env", lambda s, d: E.gradient_analysis(survey(s, d), _measures(s, d), ["elevation", "soil_ph", "temperature"], "pca_env")["axes"])
_add("gradient_cca_optima", lambda s, d: E.gradient_analysis(survey(s, d), _env(s, d), ["elevation"], "cca")["optima"], """
  select species, 'elevation' as variable, m optimum, sqrt(greatest(q - m * m, 0)) tolerance from (select species, sum(abundance * v) / sum(abundance) m, sum(abundance * v * v) / sum(abundance) q from com join (select site_id site, avg(elevation) v from environmental_variables where elevation between 0 and 2500 group by 1) using (site) group by 1)""", "optimum, tolerance", "species, variable")
_add("gam", _table(lambda s, d: E.fit_gam(_measures(s, d), "soil_ph", ["elevation", "temperature"], {"temperature": "gaussian_process"})[0]))
_add("multiple_regression", _table(lambda s, d: E.multiple_regression(_measures(s, d), "soil_ph", ["elevation", "temperature"])))
_add("regression_r2", lambda s, d: s.createDataFrame(E.multiple_regression(_sites(s, d), "elevation", ["x", "y"], interactions=False)).select("n", F.round("r2", 6).alias("r2")).distinct(), """
  select count(*) n, round((pow(corr(z, x), 2) + pow(corr(z, y), 2) - 2 * corr(z, x) * corr(z, y) * corr(x, y)) / (1 - pow(corr(x, y), 2)), 6) r2 from pts""", "r2", "n", "series")
_add("response_curves", lambda s, d: E.response_curves(survey(s, d), _env(s, d), "elevation"))
_add("lowess", _table(lambda s, d: E.lowess(_days(s, d), "x", "y")))
_add("spline_trend", lambda s, d: T.detect_trend(_days(s, d), "x", "y", "spline"))

# --- networks and assembly ----------------------------------------------------------
_J = f"(select i, j, a / (ni + nj - a) w from {_SPECIES})"
_add("jaccard_network", lambda s, d: N.network(survey(s, d), "jaccard", 0.35), f"select i, j, w weight, w >= 0.35 edge from {_J}", "weight", "i, j, edge")
_add("network_degrees", lambda s, d: N.degrees(N.network(survey(s, d), "jaccard", 0.35)), f"""
  with e as (select i, j from {_J} where w >= 0.35), b as (select i a, j b from e union all select j, i from e), deg as (select a species, count(*) k from b group by 1),
  tri as (select x.b species, count(*) t from b x join b y on x.b = y.a and x.a < y.b join e on e.i = x.a and e.j = y.b group by 1)
  select n.species, coalesce(k, 0) degree, coalesce(t, 0) triangles, case when k > 1 then 2.0 * coalesce(t, 0) / (k * (k - 1)) else 0 end clustering from (select distinct species from com) n left join deg using (species) left join tri using (species)""", "clustering", "species, degree, triangles")
_add("network_properties", lambda s, d: N.properties(N.network(survey(s, d), "jaccard", 0.35)).select("n_nodes", "n_edges", "density", "mean_degree"), f"select n n_nodes, k n_edges, 2.0 * k / (n * (n - 1)) density, 2.0 * k / n mean_degree from (select count(distinct species) n from com), (select count(*) k from {_J} where w >= 0.35)", "density, mean_degree", "n_nodes, n_edges")
_add("network_centrality", _table(lambda s, d: N.centralities(N.network(survey(s, d), "jaccard", 0.35))[0]))
_add("taxonomic_patterns", lambda s, d: N.taxonomic_patterns(survey(s, d)), "select site, sum(abundance) richness, case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) else 0 end evenness from (select site, abundance, abundance / sum(abundance) over (partition by site) p from com) group by 1", "richness, evenness", "site")
_add("trait_patterns", lambda s, d: N.trait_patterns(survey(s, d), _long(_traits(s, d))), f"""
  select site, trait, any_value(m) cwm, sum(w * pow(v - m, 2)) variance from (select *, sum(w * v) over (partition by site, trait) m from (select c.site, c.species, trait, abundance / sum(abundance) over (partition by site, trait) w, coalesce(value, avg(value) over (partition by site, trait)) v
    from com c join (from {_TSQL} unpivot include nulls (value for trait in ({', '.join(_TRAITS)}))) t using (species))) group by 1, 2""", "cwm, variance", "site, trait")
_add("assembly", lambda s, d: N.assembly(survey(s, d), _long(_traits(s, d)), _phylo(s, d), 199))

# --- positions, dates, names ----------------------------------------------------------
_veg = lambda s, d: read_table(s, d, "vegetation_survey_data")
_close = lambda places, r: "(" + " or ".join(f"pow(a - {p[0]}, 2) + pow(b - {p[1]}, 2) < pow({r or p[2]}, 2)" for p in places) + ")"
_add("place_flags", lambda s, d: _veg(s, d).agg(*[F.count_if(f).alias(k) for k, f in V.place_flags(F.col("latitude"), F.col("longitude")).items()]), f"""
  select count(*) filter (where {_close([*V.CENTROIDS.values(), *V.INSTITUTIONS.values()], 0.01)}) centroid, count(*) filter (where {_close(V.CITIES.values(), 0)}) urban, count(*) filter (where {_close(V.INSTITUTIONS.values(), 0.001)}) institution
  from (select latitude a, longitude b from vegetation_survey_data where not isnan(latitude) and not isnan(longitude))""", "", "centroid, urban, institution")
_add("equal_area", lambda s, d: (lambda xy: _veg(s, d).where("latitude between 40 and 50 and longitude between -80 and -65").agg(F.round(F.avg(xy[0]), 3).alias("x"), F.round(F.avg(xy[1]), 3).alias("y")))(albers(F.col("longitude"), F.col("latitude"), -72.0, 45.0)), """
  with k as (select n, pow(cos(radians(35)), 2) + 2 * n * sin(radians(35)) c from (select (sin(radians(35)) + sin(radians(55))) / 2 n)), p as (select 6371007.2 * sqrt(c - 2 * n * sin(radians(latitude))) / n rho, 6371007.2 * sqrt(c - 2 * n * sin(radians(45))) / n rho0, n * radians(longitude + 72) th from vegetation_survey_data, k where latitude between 40 and 50 and longitude between -80 and -65)
  select round(avg(rho * sin(th)), 3) x, round(avg(rho0 - rho * cos(th)), 3) y from p""", "x, y")
_add("standard_dataset", lambda s, d: standard_dataset(read_table(s, d, "environmental_variables").select("env_id", "soil_ph", "soil_moisture")), """
  select env_id, coalesce(a, median(a) over ()) soil_ph, coalesce(b, median(b) over ()) soil_moisture, a is null soil_ph_filled, b is null soil_moisture_filled from (select env_id, case when not isnan(soil_ph) then soil_ph end a, case when not isnan(soil_moisture) then soil_moisture end b from environmental_variables)""", "soil_ph, soil_moisture", "env_id, soil_ph_filled, soil_moisture_filled")
_add("countries", lambda s, d: _veg(s, d).groupBy(V.country(F.col("latitude"), F.col("longitude")).alias("country")).agg(F.count("*").alias("records")), "select case " + " ".join(f"when latitude between {b[0]} and {b[1]} and longitude between {b[2]} and {b[3]} then '{n}'" for n, b in V.BOXES.items()) + " else 'Unknown' end country, count(*) records from vegetation_survey_data group by 1", "", "country, records")
_add("spatial_report", lambda s, d: V.spatial_report(_veg(s, d).withColumn("country", F.lit("Canada")), stated="country"))
_add("isolation_outliers", lambda s, d: M.isolation_forest(_veg(s, d).where("latitude between 40 and 50 and longitude between -80 and -65").dropDuplicates(["record_id"]), "record_id", ["latitude", "longitude", "elevation"], contamination=0.05).groupBy("anomaly").agg(F.count("*").alias("records")))
_add("temporal_report", lambda s, d: V.temporal_report(_veg(s, d), ["date", "ingested_at"], "2024-06-30", "date").select("column_name", "records", "parsed", "percentage", "future", "very_old", "far_from_event"), """
  select c column_name, count(*) records, count(x) parsed, round(100.0 * count(x) / count(*), 2) percentage, count(*) filter (where x > date '2024-06-30' + 30) future, count(*) filter (where year(x) < 1800) very_old, count(*) filter (where c <> 'date' and abs(date_diff('day', e, x)) > 365) far_from_event
  from (select unnest(['date', 'ingested_at']) c, unnest(["date", ingested_at::date]) x, "date" e from vegetation_survey_data) group by 1""", "percentage", "column_name, records, parsed, future, very_old, far_from_event")
_add("repeated_dates", lambda s, d: V.repeated_dates(read_table(s, d, "events").withColumn("date", F.to_date("ts")), "date").withColumn("date", F.col("date").cast("string")), "select ts::date::varchar as \"date\", count(*) records from events group by 1 having count(*) > greatest(2, (select count(*) from events) * 0.1)", "", '"date", records')
_add("date_conflicts", lambda s, d: (lambda t: t.agg(*[F.count_if(f).alias(k) for k, f in V.date_order_flags(t, ["first_date", "last_date"]).items()]))(_veg(s, d).select(F.col("date").alias("last_date"), F.to_date("ingested_at").alias("first_date"))), "select count(*) filter (where ingested_at::date > \"date\") first_date_last_date from vegetation_survey_data", "", "first_date_last_date")


def _taxonomy(s, d):
    r = read_table(s, d, "species_reference")
    own = r.select(F.regexp_replace("species", "_", " ").alias("name"), F.lit(None).cast("string").alias("accepted_name"), F.split("species", "_")[0].alias("family"), F.lit("list").alias("source"), F.lit(1).alias("priority"))
    syn = r.where("synonym is not null").select(F.regexp_replace("synonym", "_", " ").alias("name"), F.regexp_replace("species", "_", " ").alias("accepted_name"), F.split("species", "_")[0].alias("family"), F.lit("synonyms").alias("source"), F.lit(2).alias("priority"))
    return own.union(syn)


_add("resolution_summary", lambda s, d: V.resolution_summary(V.resolve_names(read_table(s, d, "species_traits"), "species", _taxonomy(s, d))).select("total_names", "resolved", "unresolved", "high_confidence"), r"""
  select count(*) total_names, count(*) filter (where k) resolved, count(*) filter (where not k) unresolved, count(*) filter (where k) high_confidence from (select s, exists (select 1 from (select replace(species, '_', ' ') n from species_reference union select replace(synonym, '_', ' ') from species_reference) r where lower(r.n) = lower(replace(c, '_', ' '))) k
  from (select s, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g'), ' '), '\s+L\.$', ''), '\s+\([^)]+\)\s*[A-Z][a-z]+.*$', ''), '\s+[A-Z][a-z]+\s+\d{4}$', ''), '\s+\d{4}$', '')) c from (select distinct species s from species_traits where species is not null)))""", "", "total_names, resolved, unresolved, high_confidence")
_add("resolved_traits", lambda s, d: V.with_resolved_names(read_table(s, d, "species_traits").select("trait_id", "species"), _taxonomy(s, d)).select("trait_id", "accepted_name"), r"""
  with q as (select trait_id, lower(replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(species, '\s+', ' ', 'g'), ' '), '\s+L\.$', ''), '\s+\([^)]+\)\s*[A-Z][a-z]+.*$', ''), '\s+[A-Z][a-z]+\s+\d{4}$', ''), '\s+\d{4}$', '')), '_', ' ')) k from species_traits),
  t as (select lower(replace(n, '_', ' ')) k, arg_min(a, p) a from (select species n, replace(species, '_', ' ') a, 1 p from species_reference union all select synonym, replace(species, '_', ' '), 2 from species_reference where synonym is not null) group by 1) select trait_id, a accepted_name from q left join t using (k)""", "", "trait_id, accepted_name")
_add("resolved_trait_table", lambda s, d: V.with_resolved_names(read_table(s, d, "species_traits").select("trait_id", "species"), _taxonomy(s, d)))

# --- series and grids -------------------------------------------------------------------
_MA = "case when count(*) over w = 7 then avg(y) over w end"
_add("classical_decomposition", lambda s, d: T.classical_decomposition(_days(s, d), "day", "y", 7).select(F.col("time").cast("string").alias("day"), "trend", "seasonal", "residual"), f"""
  with t as (select *, {_MA} m, (row_number() over (order by day) - 1) % 7 ph from days window w as (order by day rows between 3 preceding and 3 following)), p as (select ph, avg(y - m) q from t group by 1), s as (select ph, q - avg(q) over () s from p)
  select day::varchar as day, m trend, s seasonal, y - m - s residual from t join s using (ph)""", "trend, seasonal, residual", "day", "series")
_add("multiplicative_decomposition", lambda s, d: T.classical_decomposition(_days(s, d), "day", "y", 7, model="multiplicative").select(F.col("time").cast("string").alias("day"), "trend", "seasonal", "residual"), f"""
  with t as (select *, {_MA} m, (row_number() over (order by day) - 1) % 7 ph from days window w as (order by day rows between 3 preceding and 3 following)), p as (select ph, avg(y / m) q from t group by 1), s as (select ph, q / avg(q) over () s from p)
  select day::varchar as day, m trend, s seasonal, y / m / s residual from t join s using (ph)""", "trend, seasonal, residual", "day", "series")
_add("stl", lambda s, d: T.stl(_days(s, d), "day", "y", 7).withColumn("time", F.col("time").cast("string")))
_add("seasonality", lambda s, d: T.seasonality(_days(s, d), "day", "y", 10).select("lag", "autocorrelation"), "select l lag, corr(y, v) autocorrelation from (select y, unnest(range(1, 11)) l, unnest([" + ", ".join(f"lag(y, {k}) over w" for k in range(1, 11)) + "]) v from days window w as (order by day)) group by 1", "autocorrelation", "lag", "series")
_add("response_forms", lambda s, d: T.response_forms(_days(s, d), "k", "y"), """
  select 'linear' form, regr_slope(y, k) slope, regr_intercept(y, k) intercept, regr_r2(y, k) r2 from days union all select 'logarithmic', regr_slope(y, ln(k)), regr_intercept(y, ln(k)), regr_r2(y, ln(k)) from days where k > 0 union all select 'exponential', regr_slope(ln(y), k), regr_intercept(ln(y), k), regr_r2(ln(y), k) from days where y > 0""", "slope, intercept, r2", "form", "series")
_add("phenology", lambda s, d: T.phenology(read_table(s, d, "vegetation_survey_data").where("date is not null and temperature between -40 and 50").withColumn("doy", F.dayofyear("date")), "land_use", "doy", "temperature"))
_NEIGH = "lag(code) over (partition by col order by \"row\") up, lead(code) over (partition by col order by \"row\") down, lag(code) over (partition by \"row\" order by col) lft, lead(code) over (partition by \"row\" order by col) rgt"
_add("edge_metrics", lambda s, d: S.edge_metrics(_cells(s, d)), f"""
  with g as (select *, {_NEIGH} from cells), k as (select unnest([1, 2]) c), e as (select k.c, count(*) n from g, k where (coalesce(up, code) = k.c) <> (coalesce(down, code) = k.c) or (coalesce(lft, code) = k.c) <> (coalesce(rgt, code) = k.c) group by 1)
  select code, n edge_cells, n / (select count(*) from cells) edge_density, n / (select count(*) from cells) / (4 * sqrt(a)) shape_index from (select code, count(*) a from cells where code <> 0 group by 1) join e on c = code""", "edge_density, shape_index", "code, edge_cells", "series")
_add("rbf", lambda s, d: S.rbf(_points(s, d), S.grid(s, -80.0, 40.0, -65.0, 50.0, 0.75)))
_add("linear_interpolation", lambda s, d: S.linear_interpolation(_points(s, d), S.grid(s, -80.0, 40.0, -65.0, 50.0, 0.75)))

# --- prediction -----------------------------------------------------------------------
_HAB = "habitat in ('broadleaf','needleleaf','mixedwood','fen','heath')"
_FEATURES = ["elevation", "soil_ph", "soil_moisture", "temperature"]


def _habitats(s, d):
    return read_table(s, d, "environmental_variables").dropDuplicates(["env_id"]).withColumn("habitat", F.lower(F.trim("habitat_type"))).where(_HAB)


def _presence(s, d):
    env = _measures(s, d)
    return env.join(survey(s, d).where("species = 'Quercus_alba'").select("site", F.lit(1).alias("present")), "site", "left").na.fill(0, ["present"])


_add("habitat_confusion", lambda s, d: M.confusion(M.predict_labels(M.classify(_habitats(s, d), "env_id", "habitat", _FEATURES)[0], _habitats(s, d), "habitat", _FEATURES), "habitat"))
_add("cross_validation", lambda s, d: M.cross_validated(_habitats(s, d), "env_id", "habitat", _FEATURES, "logistic"))
_add("feature_importance", lambda s, d: s.createDataFrame(M.importances(M.classify(_habitats(s, d), "env_id", "habitat", _FEATURES)[0], _FEATURES), "feature string, importance double"))
_add("tuned_forest", lambda s, d: M.tuned(_habitats(s, d), "env_id", "habitat", _FEATURES, (10, 20), (3, 5), 3))
_add("suitability", lambda s, d: M.suitability(_presence(s, d), "site", "present", ["elevation", "soil_ph", "temperature"])[1])
_add("regression_model", lambda s, d: M.regress(_measures(s, d), "site", "soil_ph", ["elevation", "temperature"], "ridge")[1])
_add("anomalies", lambda s, d: M.isolation_forest(_measures(s, d), "site", ["elevation", "soil_ph", "temperature"]))
_add("reduced_dimensions", lambda s, d: M.reduce_dimensions(_measures(s, d), "site", ["elevation", "soil_ph", "temperature"]))
_add("community_classes", lambda s, d: M.community_classes(survey(s, d))[1])
_add("species_distribution", lambda s, d: M.species_distribution(_presence(s, d).select("site", "present"), _measures(s, d), ["site"], "present", ["elevation", "soil_ph", "temperature"])[1])
_add("climate_projection", lambda s, d: M.climate_projection(_presence(s, d), _presence(s, d).withColumn("temperature", F.col("temperature") + 3), "site", "present", ["elevation", "soil_ph", "temperature"]))

# --- plots and reports -------------------------------------------------------------------
_add("histogram", lambda s, d: H.histogram(read_table(s, d, "orders"), "o_totalprice"), "select k bin, a + k * (b - a) / 20 low, a + (k + 1) * (b - a) / 20 high, count(*) records from (select *, least(floor((v - a) / ((b - a) / 20)), 19)::bigint k from (select o_totalprice v, min(o_totalprice) over () a, max(o_totalprice) over () b from orders)) group by 1, 2, 3", "low, high", "bin, records")
_add("relative_ranks", lambda s, d: H.relative_ranks(survey(s, d)), "select site, species, row_number() over (partition by site order by abundance desc, species) as rank, abundance / sum(abundance) over (partition by site) as share from com", "share", "site, species, rank")
_add("correlation_matrix", lambda s, d: H.correlations(_measures(s, d), ["elevation", "soil_ph", "temperature"]), """
  with e as (select avg(elevation) filter (where elevation between -100 and 2500) elevation, avg(soil_ph) filter (where soil_ph between 2 and 11 and not isnan(soil_ph)) soil_ph, avg(temperature) filter (where temperature between -40 and 50 and not isnan(temperature)) temperature from environmental_variables where site_id is not null group by site_id)
  select 'elevation' a, 'soil_ph' b, corr(elevation, soil_ph) r from e union all select 'elevation', 'temperature', corr(elevation, temperature) from e union all select 'soil_ph', 'temperature', corr(soil_ph, temperature) from e""", "r", "a, b")
_add("describe", lambda s, d: H.describe(read_table(s, d, "orders"), ["o_totalprice"]), "select 'o_totalprice' column_name, count(o_totalprice) as \"count\", avg(o_totalprice) mean, stddev_samp(o_totalprice) std, min(o_totalprice) as \"min\", quantile_cont(o_totalprice, 0.25) q1, median(o_totalprice) median, quantile_cont(o_totalprice, 0.75) q3, max(o_totalprice) as \"max\" from orders", 'mean, std, "min", q1, median, q3, "max"', 'column_name, "count"')
_add("accumulation_curve", lambda s, d: H.mean_curve(rarefaction(survey(s, d)), "sample_size", "expected_species"), """
  with r as (select site, k, sum(case when k > n - x then 1 else 1 - exp(lgamma(n - x + 1) - lgamma(n - x - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) end) e
    from (select site, abundance x, sum(abundance) over (partition by site) n from com) t, (select unnest(range(1, mx::bigint + 1, greatest(1, mx::bigint // 50))) k from (select max(n) mx from sites)) where k <= n group by 1, 2)
  select k::bigint x, avg(e) mean, avg(e) - coalesce(1.96 * stddev_samp(e) / sqrt(count(*)), 0) low, avg(e) + coalesce(1.96 * stddev_samp(e) / sqrt(count(*)), 0) high, count(*) curves from r group by 1""", "mean, low, high", "x, curves")
_add("nestedness_report", lambda s, d: Q.nestedness_table(observations(s, d).groupBy("site_id").agg(*[F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))).alias(c) for c in read_table(s, d, "species_abundance").columns if c not in META]), "site_id"))


def _report(s, d):
    com = survey(s, d)
    from phytoscape.community import summary

    pages = {k: H.report({"summary": summary(com)}, "Survey", k) for k in ("html", "markdown", "text")}
    pages["dashboard"] = H.dashboard({"Species": (com.groupBy("species").agg(F.sum("abundance").alias("total")).orderBy("species"), "bars", "species", "total"), "Sites": (_sites(s, d), "points", "x", "y")})
    return s.createDataFrame([(k, v) for k, v in sorted(pages.items())], "format string, page string")


_add("report", _report)
