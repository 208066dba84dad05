"""Queries of ordination, clustering, null models and predictive models: results without a closed SQL form, but for two."""

from __future__ import annotations

from pyspark.sql import functions as F

from phytoscape.operators import clustering as K
from phytoscape.operators import distances as D
from phytoscape.operators import models as M
from phytoscape.operators import nullmodels as N
from phytoscape.operators import ordination as O
from phytoscape.operators.transforms import transform
from phytoscape.plans.helpers import rounded, sql, survey
from phytoscape.session import read_table
from phytoscape.streaming.diversity import window_indices, windowed_counts

QUERIES, SQL = {}, {}


def _add(name, build, body=None):
    QUERIES[name] = lambda spark, d: rounded(build(spark, d))
    if body:
        SQL[name] = body


def _table(f):
    """A small pandas result as a table."""
    return lambda spark, d: spark.createDataFrame(f(spark, d))


def _env(s, d):
    ok = lambda c, lo, hi: F.avg(F.when((F.col(c) >= lo) & (F.col(c) <= hi) & ~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c)
    return read_table(s, d, "environmental_variables").where("site_id is not null").groupBy(F.col("site_id").alias("site")).agg(ok("elevation", -100, 2500), ok("soil_ph", 2, 11), ok("temperature", -40, 50))


def _vectors(s, d):
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("site"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _labels(s, d):
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("site"), F.col("label").alias("cluster"))


_add("pca", lambda s, d: O.pca(survey(s, d), components=3)[0])
_add("pca_species", _table(lambda s, d: O.pca(survey(s, d), components=3)[1]))
_add("ca", lambda s, d: O.ca(survey(s, d))[0])
_GRID = "(select s.site, t.species, coalesce(c.abundance, 0) x from (select distinct site from com) s cross join (select distinct species from com) t left join com c on c.site = s.site and c.species = t.species)"


def _total(table):
    return float(table.drop_duplicates("axis")["eigenvalue"].sum())


_add("pca_total_variance", lambda s, d: s.createDataFrame([(_total(O.pca(survey(s, d), components=29)[1]),)], "variance double"), sql(f"select sum(v) variance from (select species, var_samp(sqrt(x / n)) v from {_GRID} join (select site, n from sites) using (site) group by 1)", "variance"))
_add("ca_total_inertia", lambda s, d: s.createDataFrame([(round(_total(O.ca(survey(s, d), components=29)[1]), 5),)], "inertia double"), sql(f"select round(sum(pow(x - e, 2) / e), 5) inertia from (select x, n * t / sum(x) over () e from {_GRID} join (select site, n from sites) using (site) join (select species, sum(abundance) t from com group by 1) using (species))", "inertia"))
_add("dca", lambda s, d: O.dca(survey(s, d)))
_add("rda", _table(lambda s, d: O.constrained(survey(s, d), _env(s, d), ["elevation", "soil_ph", "temperature"], "rda")))
_add("cca", _table(lambda s, d: O.constrained(survey(s, d), _env(s, d), ["elevation", "soil_ph", "temperature"], "cca")))
_add("pcoa", _table(lambda s, d: O.pcoa(D.distances(survey(s, d)))))
_add("nmds", _table(lambda s, d: O.nmds(D.distances(survey(s, d)))[0]))
_add("kmeans", lambda s, d: K.kmeans(K.as_vectors(transform(survey(s, d))), 5)[0])
_add("gaussian_mixture", lambda s, d: K.gaussian_mixture(_vectors(s, d), 3)[0])
_add("fuzzy_cmeans", lambda s, d: K.fuzzy_cmeans(K.as_vectors(transform(survey(s, d))), 3))
_DBSCAN = sql(f"""
  with recursive near as materialized (select i, j from (select a.site i, b.site j, sum(abs(a.x - b.x)) / sum(a.x + b.x) d from {_GRID} a join {_GRID} b on a.species = b.species and a.site <> b.site group by 1, 2) where d <= 0.25),
  core as materialized (select site from (select distinct site from com) left join (select i site, count(*) + 1 k from near group by 1) using (site) where coalesce(k, 1) >= 4),
  reach as (select site, site root from core union select j, root from reach join near on i = site where j in (select site from core)), own as (select site, min(root) c from reach group by 1),
  border as (select i site, min(c) b from near join own on own.site = j group by 1)
  select s.site, coalesce(c, b) as cluster, c is not null core from (select distinct site from com) s left join own using (site) left join border using (site)""", "", "site, cluster, core")
_add("dbscan", lambda s, d: K.community_dbscan(survey(s, d), 0.25, 4), _DBSCAN)
_add("hierarchical", _table(lambda s, d: K.community_hierarchical(survey(s, d), "average", 4)[1]))
_add("silhouette", lambda s, d: K.silhouette(_vectors(s, d), _labels(s, d)).select("site", F.col("cluster").cast("bigint").alias("cluster"), F.round("silhouette", 5).alias("silhouette")), """
with v as (select vec_id site, label cluster, embedding::double[] vec from embeddings), m as (select a.site, a.cluster, b.cluster other, avg(list_distance(a.vec, b.vec)) m from v a join v b on a.site <> b.site group by 1, 2, 3)
select site, cluster::bigint as cluster, round(coalesce((o - w) / nullif(greatest(o, w), 0), 0), 5) silhouette from (select site, cluster, max(m) filter (where cluster = other) w, min(m) filter (where cluster <> other) o from m group by 1, 2)""")
_add("calinski_harabasz", lambda s, d: K.dispersion(_vectors(s, d), _labels(s, d)).select(F.round("calinski_harabasz", 5).alias("calinski_harabasz")), """
with v as (select label g, unnest(embedding)::double x, generate_subscripts(embedding, 1) p from embeddings), w as (select sum(n * v) w, count(distinct g) k from (select g, p, count(*) n, var_pop(x) v from v group by 1, 2)), t as (select sum(n * v) t, max(n) n from (select p, count(*) n, var_pop(x) v from v group by 1))
select round((t - w) / (k - 1) / (w / (n - k)), 5) calinski_harabasz from w, t""")
_add("elbow_analysis", _table(lambda s, d: K.elbow_analysis(K.as_vectors(transform(survey(s, d))), range(1, 9), 3)[0]))
_add("optimal_k", lambda s, d: s.createDataFrame([(k, float(v)) for k, v in K.elbow_analysis(K.as_vectors(transform(survey(s, d))), range(1, 9), 3)[1].items() if v is not None], "rule string, k double"))
_add("gap_statistic", _table(lambda s, d: K.gap_statistic(K.as_vectors(transform(survey(s, d))), range(1, 5), 3, 1)))
_add("cophenetic", lambda s, d: s.createDataFrame(list(K.community_cophenetic(survey(s, d)).items()), "method string, correlation double"))
_add("davies_bouldin", lambda s, d: K.davies_bouldin(_vectors(s, d), _labels(s, d)).select(F.round("davies_bouldin", 5).alias("davies_bouldin")), """
with v as (select vec_id, label g, unnest(embedding)::double x, generate_subscripts(embedding, 1) p from embeddings), c as (select g, p, avg(x) m from v group by 1, 2), s as (select g, avg(d) s from (select vec_id, g, sqrt(sum(pow(x - m, 2))) d from v join c using (g, p) group by 1, 2) group by 1),
r as (select a.g i, b.g j, sqrt(sum(pow(a.m - b.m, 2))) d from c a join c b on a.p = b.p and a.g <> b.g group by 1, 2)
select round(avg(m), 5) davies_bouldin from (select i, max((x.s + y.s) / d) m from r join s x on x.g = i join s y on y.g = j group by 1)""")
_add("simplified_silhouette", lambda s, d: K.simplified_silhouette(_vectors(s, d), _labels(s, d)).select(F.round("silhouette", 6).alias("silhouette")), """
with v as (select vec_id, label g, unnest(embedding)::double x, generate_subscripts(embedding, 1) p from embeddings), c as (select g k, p, avg(x) m from v group by 1, 2), d as (select vec_id, g, k, sqrt(sum(pow(x - m, 2))) d from v join c using (p) group by 1, 2, 3)
select round(avg((b - a) / greatest(a, b)), 6) silhouette from (select vec_id, max(d) filter (where k = g) a, min(d) filter (where k <> g) b from d group by 1)""")
_add("null_model_test", lambda s, d: N.null_model_test(survey(s, d), "c_score", "columns", 999))
_add("habitat_model", lambda s, d: M.classify(read_table(s, d, "environmental_variables").withColumn("habitat", F.lower(F.trim("habitat_type"))).where("habitat in ('broadleaf','needleleaf','mixedwood','fen','heath')"), "env_id", "habitat", ["elevation", "soil_ph", "soil_moisture", "temperature"], "rf")[1])
_add("event_window_diversity", lambda s, d: window_indices(windowed_counts(read_table(s, d, "events"), "ts", "user_id", "event_type"), ["shannon", "richness"]).select(F.col("start").cast("string").alias("start"), "site", "shannon", "richness"), """
select strftime(day, '%Y-%m-%d %H:%M:%S') as start, site, round(greatest(-sum(p * ln(p)), 0), 9) + 0.0 shannon, count(*) richness from (select day, site, k / sum(k) over (partition by day, site) p from (select date_trunc('day', ts) as day, user_id site, event_type, count(*) k from events group by 1, 2, 3)) group by 1, 2""")


def _points(s, d):
    from phytoscape.plans.series import _points as p

    return p(s, d)


def _kriged(s, d):
    from phytoscape.operators.spatial import grid
    from phytoscape.operators.smoothing import simple_kriging

    return simple_kriging(_points(s, d), grid(s, -80.0, 40.0, -65.0, 50.0, 0.5))


def _additive(s, d):
    from phytoscape.operators.smoothing import additive_model

    return additive_model(_env(s, d), "soil_ph", ["elevation", "temperature"])


def _twinspan(s, d):
    from phytoscape.operators.twinspan import twinspan

    return twinspan(survey(s, d))[0]


def _pseudo(s, d):
    from phytoscape.operators.twinspan import pseudospecies

    return pseudospecies(survey(s, d)).groupBy("pseudo").agg(F.count("*").alias("sites"))


_add("kriging", _kriged)
_add("additive_model", _table(_additive))
_add("twinspan", _table(_twinspan))
_add("pseudospecies", _pseudo, "with obs as (select * exclude (obs_id, observed_on, ingested_at) from species_abundance where site_id is not null qualify row_number() over (partition by obs_id order by ingested_at) = 1), raw as (unpivot obs on columns(* exclude (site_id)) into name species value x), com as (select site_id, species, sum(x) a from raw where x > 0 group by 1, 2) select species || '_' || k pseudo, count(*) sites from com, (values (1, 2), (2, 5), (3, 10), (4, 20)) c(k, cut) where a >= cut group by 1")
