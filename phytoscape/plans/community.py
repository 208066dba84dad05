"""Queries of community measures and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from phytoscape import community as K
from phytoscape.operators import association as A
from phytoscape.operators import distances as D
from phytoscape.operators import diversity as V
from phytoscape.operators import traits as R
from phytoscape.operators import transforms as X
from phytoscape.operators.transforms import transform
from phytoscape.plans.helpers import groups, rounded, sql, survey, trade
from phytoscape.session import read_table

QUERIES, SQL = {}, {}


def _add(name: str, build, body: str | None = None, doubles: str = "", others: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(build(spark, d))
    if body:
        SQL[name] = sql(body, doubles, others)


def _survey(f):
    return lambda spark, d: f(survey(spark, d))


def _trade(f):
    return lambda spark, d: f(trade(spark, d))


# --- alpha diversity -------------------------------------------------------
_H = "greatest(-sum(p * ln(p)), 0)"
_INDEX = {
    "shannon": f"select site, {_H} as shannon from p group by 1",
    "simpson": "select site, sum(p * p) as simpson from p group by 1",
    "simpson_inverse": "select site, 1 / sum(p * p) as simpson_inverse from p group by 1",
    "evenness": f"select site, case when count(*) > 1 then {_H} / ln(count(*)) else 0 end as evenness from p group by 1",
    "berger_parker": "select site, max(p) as berger_parker from p group by 1",
    "mcintosh": "select site, case when abs(n - sqrt(q)) < 1e-12 or n = 1 then 0 else (n - sqrt(q)) / (n - sqrt(n)) end as mcintosh from sites",
    "menhinick": "select site, s / sqrt(n) as menhinick from sites",
    "margalef": "select site, case when n = 1 then 0 else (s - 1) / ln(n) end as margalef from sites",
    "brillouin": "select site, (lgamma(sum(floor(abundance)) + 1) - sum(lgamma(floor(abundance) + 1))) / sum(floor(abundance)) as brillouin from com group by 1",
    "chao1": "select site, case when f2 = 0 then s + f1 * (f1 - 1) / 2.0 else s + f1 * f1 / (2.0 * f2) end as chao1 from (select site, count(*) s, count(*) filter (where abundance = 1) f1, count(*) filter (where abundance = 2) f2 from com group by 1)",
    "ace": "select site, case when sr = 0 then s - sr when nr = f1 then s else s - sr + sr / (1 - f1 / nr) + f1 / (1 - f1 / nr) * case when nr > 1 then greatest(0, sr / (1 - f1 / nr) * nr / (nr * (nr - 1)) - 1) else 0 end end as ace from (select site, count(*) s, count(*) filter (where abundance = 1) f1, count(*) filter (where abundance <= 10) sr, coalesce(sum(abundance) filter (where abundance <= 10), 0) nr from com group by 1)",
}
for _name, _body in _INDEX.items():
    _add(_name, _survey(lambda c, n=_name: V.indices(c, [n])), _body, _name, "site")
_add("richness", _survey(lambda c: V.indices(c, ["richness"])), "select site, s::bigint richness from sites", "", "site, richness")
_FISHER = """
  select site, case when s <= 1 then 0 else list_reduce(list_prepend(s::double, list_transform(range(100), lambda x: n)), lambda a, b: case when abs(s / ln(1 + b / a) - a) < 1e-6 then a else s / ln(1 + b / a) end) end fisher_alpha from sites"""
_add("fisher_alpha", _survey(lambda c: V.indices(c, ["fisher_alpha"])), _FISHER, "fisher_alpha", "site")
_add("hill_numbers", _survey(lambda c: V.hill_numbers(c, (0, 0.5, 1, 1.5, 2))), """
  select site, q, case when q = 0 then count(*) when q = 1 then exp(-sum(p * ln(p))) else pow(sum(pow(p, q)), 1 / (1 - q)) end hill
  from (select site, abundance / sum(abundance) over (partition by site) p from com), (select unnest([0.0, 0.5, 1.0, 1.5, 2.0])::double q) group by 1, 2""", "q, hill", "site")
_OCC = "(select count(*) so, count(*) filter (where k = 1) q1, count(*) filter (where k = 2) q2 from (select species, count(*) k from com group by 1)), (select count(distinct site) n from com)"
_add("jackknife", _survey(V.jackknife), f"select so::bigint observed, so + q1 * (n - 1) / n jackknife1, so + q1 * (2 * n - 3) / n - q2 * (n - 2) * (n - 2) / (n * (n - 1)) jackknife2 from {_OCC}", "jackknife1, jackknife2", "observed")
_add("whittaker_beta", _survey(V.whittaker), "select (select count(distinct species) from com) / avg(s) whittaker_beta from sites", "whittaker_beta")
_add("rarefaction", _survey(V.rarefaction), """
  select site, k sample_size, sum(case when k > n - x then 1 else 1 - exp(lgamma(n - x + 1) - lgamma(n - x - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) end) expected_species
  from (select site, abundance x, sum(abundance) over (partition by site) n from com) t, (select unnest(range(1, mx::bigint + 1, greatest(1, mx::bigint // 50))) k from (select max(t) mx from (select sum(abundance) t from com group by site))) where k <= n group by 1, 2""", "expected_species", "site, sample_size")
_add("filter_rare_species", _survey(lambda c: K.filter_rare(c, 3, 10.0)), "select * from com where species in (select species from com group by 1 having count(*) >= 3 and sum(abundance) >= 10)", "abundance", "site, species")
_add("summary_statistics", _survey(K.summary), "select count(*) n_sites, avg(s) mean_species, sum(n) total_abundance, avg(n) mean_abundance, (select count(distinct species) from com) n_species from sites", "mean_species, total_abundance, mean_abundance", "n_sites, n_species")
_add("rank_abundance", _survey(K.rank_abundance), "select site, species, abundance, row_number() over (partition by site order by abundance desc, species) as rank from com", "abundance", "site, species, rank")

_ALL = " join ".join(f"({b}) q_{n}" + (" using (site)" if n != "shannon" else "") for n, b in _INDEX.items())
_add("all_indices", _survey(V.indices), f"select * exclude (s), s::bigint richness from {_ALL} join (select site, s from sites) using (site) join ({_FISHER}) q_f using (site)", ", ".join([*_INDEX, "fisher_alpha"]), "site, richness")

# --- transformations -------------------------------------------------------
_GRID = "(select s.site, t.species, coalesce(c.abundance, 0) x from (select distinct site from com) s cross join (select distinct species from com) t left join com c on c.site = s.site and c.species = t.species)"
_TRANSFORM = {
    "hellinger": ("hellinger", {}, "select site, species, sqrt(p) as value from p"),
    "chord": ("chord", {}, "select site, species, abundance / sqrt(sum(abundance * abundance) over (partition by site)) as value from com"),
    "log_chord": ("log_chord", {}, "select site, species, ln(abundance + 1) / sqrt(sum(ln(abundance + 1) * ln(abundance + 1)) over (partition by site)) as value from com"),
    "wisconsin": ("wisconsin", {}, "select site, species, v / sum(v) over (partition by site) as value from (select *, abundance / max(abundance) over (partition by species) v from com)"),
    "chi_square": ("chi_square", {}, "select site, species, sqrt(abundance * (select sum(abundance) from com) / (sum(abundance) over (partition by site) * sum(abundance) over (partition by species))) as value from com"),
    "log1p": ("log", {}, "select site, species, ln(abundance + 1) as value from com"),
    "log2": ("log", {"base": "log2"}, "select site, species, log2(abundance + 1) as value from com"),
    "log10": ("log", {"base": "log10"}, "select site, species, log10(abundance + 1) as value from com"),
    "arcsine": ("arcsine", {}, "select site, species, asin(sqrt(least(abundance, 1))) as value from com"),
    "unit_vector": ("normalize", {"variant": "unit_vector"}, "select site, species, abundance / sqrt(sum(abundance * abundance) over (partition by site)) as value from com"),
    "sqrt_transform": ("sqrt", {}, "select site, species, sqrt(abundance) as value from com"),
    "zscore": ("standardize", {}, f"select site, species, (x - avg(x) over w) / case when stddev_samp(x) over w = 0 then 1 else stddev_samp(x) over w end as value from {_GRID} window w as (partition by species)"),
    "robust_z": ("standardize", {"variant": "robust"}, f"select g.site, g.species, (x - m) / case when mad = 0 then 1 else mad end as value from {_GRID} g join (select species, m, median(abs(x - m)) mad from {_GRID} join (select species, median(x) m from {_GRID} group by 1) using (species) group by 1, 2) using (species)"),
    "minmax": ("normalize", {}, f"select site, species, (x - min(x) over w) / case when max(x) over w = min(x) over w then 1 else max(x) over w - min(x) over w end as value from {_GRID} window w as (partition by species)"),
}
for _name, (_m, _o, _body) in _TRANSFORM.items():
    _add(_name, _survey(lambda c, m=_m, o=_o: transform(c, m, **o)), _body, "value", "site, species")

_add("inverse_transform", lambda s, d: (lambda t: t.select("site", "species", X.inverse(F.col("value"), "log", "log10").alias("value")))(transform(survey(s, d), "log", base="log10")), "select site, species, abundance as value from com", "value", "site, species")

# --- distances -------------------------------------------------------------
_TG = "(select s.site, t.species, coalesce(c.abundance, 0) x from (select distinct site from trade) s cross join (select distinct species from trade) t left join trade c on c.site = s.site and c.species = t.species)"
_DENSE = "(select a.site i, b.site j, a.species, a.x x, b.x y from {g} a join {g} b on a.species = b.species and a.site < b.site)"
_METRIC = {
    "bray_curtis": "sum(abs(x - y)) / sum(x + y)", "jaccard": "1 - count(*) filter (where x > 0 and y > 0) / count(*) filter (where x > 0 or y > 0)",
    "sorensen": "1 - 2.0 * count(*) filter (where x > 0 and y > 0) / (count(*) filter (where x > 0) + count(*) filter (where y > 0))",
    "euclidean": "sqrt(sum((x - y) * (x - y)))", "manhattan": "sum(abs(x - y))", "canberra": "sum(case when x + y > 0 then abs(x - y) / (x + y) else 0 end)",
    "chord_distance": "sqrt(greatest(0, 2 - 2 * sum(x * y) / sqrt(sum(x * x) * sum(y * y))))",
}
_OF = {"chord_distance": "chord"}
for _name, _e in _METRIC.items():
    _add(_name, _survey(lambda c, m=_OF.get(_name, _name): D.distances(c, m)), f"select i, j, {_e} d from {_DENSE.format(g=_GRID)} group by 1, 2", "d", "i, j")
_add("hellinger_distance", _survey(lambda c: D.distances(c, "hellinger")), f"select i, j, sqrt(sum((sqrt(x / n) - sqrt(y / m)) * (sqrt(x / n) - sqrt(y / m)))) d from {_DENSE.format(g=_GRID)} join (select site i, n from sites) using (i) join (select site j, n m from sites) using (j) group by 1, 2", "d", "i, j")
_BC = f"(select i, j, {_METRIC['bray_curtis']} d from {_DENSE.format(g=_GRID)} group by 1, 2)"
_add("pcoa_gower", _survey(D.gower_distances), f"""
  select i, j, e - avg(e) over (partition by i) - avg(e) over (partition by j) + avg(e) over () b from (with bc as materialized (select * from {_BC}) select i, j, -0.5 * d * d e from (select * from bc union all select j, i, d from bc union all select site, site, 0 from sites))""", "b", "i, j")

# --- nestedness, associations, metacommunity --------------------------------
def _counts(unit: str, over: str) -> str:
    return f"(select a.u i, b.u j, a.n ni, b.n nj, coalesce(k, 0) a from (select {unit} u, count(*) n from com group by 1) a join (select {unit} u, count(*) n from com group by 1) b on a.u < b.u left join (select x.{unit} i, y.{unit} j, count(*) k from com x join com y on x.{over} = y.{over} and x.{unit} < y.{unit} group by 1, 2) s on s.i = a.u and s.j = b.u)"


_SITES, _SPECIES = _counts("site", "species"), _counts("species", "site")
_N = "case when ni <> nj then 100.0 * a / least(ni, nj) end"
_add("nodf", _survey(A.nodf), f"select coalesce((select avg({_N}) from {_SITES}), 0) nodf_rows, coalesce((select avg({_N}) from {_SPECIES}), 0) nodf_columns, coalesce((select avg({_N}) from (select ni, nj, a from {_SITES} union all select ni, nj, a from {_SPECIES})), 0) nodf", "nodf_rows, nodf_columns, nodf")
_add("c_score", _survey(A.c_score), f"select avg((ni - a) * (nj - a)) c_score from {_SPECIES}", "c_score")
_add("togetherness", _survey(A.togetherness), f"select avg(a / (ni + nj - a)) togetherness from {_SPECIES}", "togetherness")
_add("wine", _survey(A.wine), f"select 100.0 * sum(a) / sum(least(ni, nj)) wine from (select ni, nj, a from {_SITES} union all select ni, nj, a from {_SPECIES})", "wine")
_add("species_associations", _survey(A.associations), f"select i, j, a / (ni + nj - a) jaccard, a / sqrt(ni * nj) ochiai, 2.0 * a / (ni + nj) dice from {_SPECIES}", "jaccard, ochiai, dice", "i, j")
_add("checkerboard", _survey(A.checkerboard), f"select i, j, (ni - a) * (nj - a) units, a as both, ni - a only_i, nj - a only_j, (select count(distinct site) from com) - ni - nj + a absent from {_SPECIES}", "", "i, j, units::bigint units, \"both\"::bigint \"both\", only_i::bigint only_i, only_j::bigint only_j, absent::bigint absent")
_add("nestedness_temperature", _survey(A.temperature), f"""
  select coalesce(100.0 * (sum(case when z = 1 then pa else 0 end) + sum(case when z = 0 then za else 0 end)) / (select sum((m - r + 1) * (k - c + 1) - 1) from cells, (select max(r) m, max(c) k from cells)), 0) temperature from (
    select r, c, z, coalesce(sum(pb) over (partition by r order by c desc rows between unbounded preceding and 1 preceding), 0) pa, coalesce(sum(zb) over (partition by r order by c desc rows between unbounded preceding and 1 preceding), 0) za from (
      select r, c, z, coalesce(sum(1 - z) over (partition by c order by r desc rows between unbounded preceding and 1 preceding), 0) pb, coalesce(sum(z) over (partition by c order by r desc rows between unbounded preceding and 1 preceding), 0) zb from cells))""".replace("from cells", f"from (select r, c, case when x > 0 then 0 else 1 end z from {_GRID} g join (select site, row_number() over (order by count(*) desc, site) r from com group by 1) using (site) join (select species, row_number() over (order by count(*) desc, species) c from com group by 1) using (species)) cells"), "temperature")
_RANK = "(select site, row_number() over (order by s desc, site) r from sites)"
_add("metacommunity_structure", _survey(A.metacommunity), f"""
  select *, case when coherence <= 0.5 then 'random' when turnover <= 1.5 then 'nested' when boundary_clumping < 0.5 then 'clumped' else 'evenly_spaced' end as structure from (select coalesce(1 - sum(len - occ) / nullif(sum(case when occ > 1 then len else 0 end), 0), 1) coherence, (select (select count(distinct species) from com) / avg(s) - 1 from sites) turnover,
    (select avg((ni + nj - 2 * a) / (ni + nj)) from {_SITES}) mean_turnover, avg(len / occ) boundary_clumping from (select species, max(r) - min(r) + 1 len, count(*) occ from com join {_RANK} using (site) group by 1))""", "coherence, turnover, mean_turnover, boundary_clumping", "structure")
_add("cooccurrence_network", _survey(A.cooccurrence_network), f"""
  select i, j, r, coalesce(abs(r) >= 0.5, false) edge from (select a.species i, b.species j, case when stddev_pop(a.x) > 0 and stddev_pop(b.x) > 0 then corr(a.x, b.x) end r from {_GRID} a join {_GRID} b on a.site = b.site and a.species < b.species group by 1, 2)""", "r", "i, j, edge")

# --- group tests -------------------------------------------------------------
_add("indicator_values", lambda s, d: A.indicator_values(c := survey(s, d), groups(c)), """
  select species, grp, 100.0 * x / sum(x) over (partition by species) * k / sites indval from (select species, grp, sum(abundance) x, count(*) k from com join grp using (site) group by 1, 2) join (select grp, count(*) sites from grp group by 1) using (grp)""", "indval", "species, grp")
_add("simper_between", lambda s, d: A.simper_between(c := survey(s, d), groups(c)), f"""
  select a.grp g1, b.grp g2, a.species, avg(abs(a.x - b.x) / (a.n + b.n)) contribution from (select * from {_GRID} join grp using (site) join (select site, n from sites) using (site)) a join (select * from {_GRID} join grp using (site) join (select site, n from sites) using (site)) b on a.species = b.species and a.grp < b.grp group by 1, 2, 3""", "contribution", "g1, g2, species")
_add("simper", lambda s, d: A.simper(c := survey(s, d), groups(c)), f"""
  select a.grp g1, b.grp g2, a.species, avg(abs(a.x - b.x) / (a.n + b.n)) contribution from (select * from {_GRID} join grp using (site) join (select site, n from sites) using (site)) a join (select * from {_GRID} join grp using (site) join (select site, n from sites) using (site)) b on a.species = b.species and (a.grp < b.grp or a.grp = b.grp and a.site < b.site) group by 1, 2, 3""", "contribution", "g1, g2, species")
_LAB = f"(select b.*, g.grp gi, h.grp gj, rank() over (order by d) + (count(*) over (partition by d) - 1) / 2.0 rk from (select i, j, round(d, 12) d from {_BC}) b join grp g on g.site = i join grp h on h.site = j)"
_add("group_tests_observed", _survey(lambda c: A.community_group_tests(c, groups(c))), f"""
  with l as materialized (select * from {_LAB}), sz as (select grp, count(*) ng from grp group by 1), t as (select sum(ng) n, count(*) k from sz),
  w as (select sum(ng * ss / ng / n) ssw, sum(ng / n * md) delta from (select gi grp, sum(d * d) ss, avg(d) md from l where gi = gj group by 1) join sz using (grp), t),
  a as (select sum(d * d) sq, count(*) m, avg(rk) filter (where gi = gj) mw, avg(rk) filter (where gi <> gj) mb from l)
  select ((sq / n - ssw) / (k - 1)) / (ssw / (n - k)) pseudo_f, (mb - mw) / (m + 1 - mw - mb) anosim_r, delta mrpp_delta from a, w, t""", "pseudo_f, anosim_r, mrpp_delta")
_add("permutation_tests", _survey(lambda c: A.permutation_tests(c, groups(c), 999)))
_add("indicator_test", lambda s, d: A.indicator_test(c := survey(s, d), groups(c), 999))
_ENV = "(select site_id site, avg(elevation) z, avg(temperature) filter (where temperature between -40 and 50 and not isnan(temperature)) t from environmental_variables where elevation between 0 and 2500 group by 1)"
_gap_sql = lambda v: f"(select a.site i, b.site j, abs(a.{v} - b.{v})::double d from {_ENV} a join {_ENV} b on a.site < b.site where a.{v} is not null and b.{v} is not null)"


def _value(spark, d, value: str):
    """(site, value): an environmental mean of the sites that have it."""
    ok = {"elevation": "elevation", "temperature": "case when temperature between -40 and 50 and not isnan(temperature) then temperature end"}[value]
    return read_table(spark, d, "environmental_variables").where("site_id is not null and elevation between 0 and 2500").groupBy(F.col("site_id").alias("site")).agg(F.avg(F.expr(ok)).alias("value")).where("value is not null")


_add("mantel", lambda s, d: A.community_mantel(survey(s, d), [_value(s, d, "elevation")]), f"select corr(a.d, b.d) mantel_r from {_BC} a join {_gap_sql('z')} b using (i, j)", "mantel_r")
_add("mantel_spearman", lambda s, d: A.community_spearman(survey(s, d), _value(s, d, "elevation")), f"""
  with p as (select round(a.d, 12) x, round(b.d, 9) y from {_BC} a join {_gap_sql('z')} b using (i, j)) select corr(x, y) mantel_r from (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 y from p)""", "mantel_r")
_add("mantel_test", lambda s, d: A.community_mantel(survey(s, d), [_value(s, d, "elevation")], permutations=999))
_add("partial_mantel", lambda s, d: A.community_mantel(survey(s, d), [_value(s, d, "elevation"), _value(s, d, "temperature")]), f"""
  select (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) partial_r from (select corr(x.d, y.d) a, corr(x.d, z.d) b, corr(y.d, z.d) c from {_BC} x join {_gap_sql('z')} y using (i, j) join {_gap_sql('t')} z using (i, j))""", "partial_r")
_add("partial_mantel_test", lambda s, d: A.community_mantel(survey(s, d), [_value(s, d, "elevation"), _value(s, d, "temperature")], permutations=999))

# --- traits and phylogeny ----------------------------------------------------
_TRAITS = ["max_height_m", "leaf_area_cm2", "specific_leaf_area_cm2_g", "leaf_nitrogen_percent", "leaf_phosphorus_percent", "wood_density_g_cm3", "seed_mass_mg"]


def _traits(spark, d):
    """Mean traits of the records whose name is a species of the survey."""
    t = read_table(spark, d, "species_traits").dropDuplicates(["trait_id"])
    return t.groupBy("species").agg(*[F.avg(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))).alias(n) for n in _TRAITS])


def _long(t):
    return t.unpivot("species", _TRAITS, "trait", "value")


_TSQL = "(select species, " + ", ".join(f"avg({n}::double) filter (where not isnan({n}::double)) {n}" for n in _TRAITS) + " from (select * from species_traits qualify row_number() over (partition by trait_id order by submitted_at) = 1) where species is not null group by 1)"
_add("cwm", lambda s, d: R.community_weighted_means(survey(s, d), _long(_traits(s, d))), f"""
  select site, trait, sum(w * coalesce(value, mv)) cwm from (select c.site, c.species, trait, value, abundance / sum(abundance) over (partition by site, trait) w, avg(value) over (partition by site, trait) mv
    from com c join (from {_TSQL} unpivot include nulls (value for trait in ({', '.join(_TRAITS)}))) t using (species)) group by 1, 2""", "cwm", "site, trait")
_Z = "(select species, " + ", ".join(f"({n} - avg({n}) over ()) / case when stddev_pop({n}) over () > 0 then stddev_pop({n}) over () else 1 end {n}" for n in _TRAITS) + " from (select species, " + ", ".join(f"coalesce({n}, avg({n}) over ()) {n}" for n in _TRAITS) + f" from {_TSQL}))"
_add("functional_diversity", lambda s, d: R.functional_diversity(survey(s, d), _traits(s, d), _TRAITS).drop("fric"), f"""
  with z as materialized (select * from {_Z}), w as (select site, species, abundance / sum(abundance) over (partition by site) w from com where species in (select species from z)), a as (select * from w join z using (species)),
  c as (select site, {', '.join(f'sum(w * {n}) c_{n}' for n in _TRAITS)} from a group by 1), e as (select site, w, sqrt({' + '.join(f'pow({n} - c_{n}, 2)' for n in _TRAITS)}) d from a join c using (site)), f as (select *, sum(w * d) over (partition by site) m from e),
  pr as (select x.site, x.species s, any_value(x.w) w, min(sqrt({' + '.join(f'pow(x.{n} - y.{n}, 2)' for n in _TRAITS)})) near from a x join a y on x.site = y.site and x.species <> y.species group by 1, 2),
  ev as (select site, case when sum(lo - near * w) + (count(*) - 1) * any_value(lo) <> 0 then sum(lo - near * w) / (sum(lo - near * w) + (count(*) - 1) * any_value(lo)) else 0 end feve from (select *, min(near * w) over (partition by site) lo from pr) group by 1)
  select site, sum(w * d) fdis, coalesce(sum(w * abs(d - m)) / nullif(max(m), 0), 0) fdiv, coalesce(max(rao), 0) raoq, coalesce(max(feve), 0) feve from f left join ev using (site) left join (select x.site, sum(2 * x.w * y.w * sqrt({' + '.join(f'pow(x.{n} - y.{n}, 2)' for n in _TRAITS)})) rao from a x join a y on x.site = y.site and x.species < y.species group by 1) using (site) group by 1""", "fdis, fdiv, raoq, feve", "site")
_add("functional_richness", lambda s, d: R.functional_diversity(survey(s, d), _traits(s, d), _TRAITS).select("site", "fric"))
_add("functional_beta", lambda s, d: R.functional_beta(survey(s, d), _traits(s, d), _TRAITS), f"""
  with z as materialized (select * from {_Z}), w as (select site, species, abundance / sum(abundance) over (partition by site) w from com where species in (select species from z)), c as materialized (select site, {', '.join(f'sum(w * {n}) {n}' for n in _TRAITS)} from w join z using (species) group by 1)
  select a.site i, b.site j, sqrt({' + '.join(f'pow(a.{n} - b.{n}, 2)' for n in _TRAITS)}) d from c a join c b on a.site < b.site""", "d", "i, j")
_add("functional_groups", lambda s, d: s.createDataFrame(R.functional_groups(_traits(s, d).join(survey(s, d).select("species").distinct(), "species", "left_semi"), _TRAITS)))
_add("trait_profiles", lambda s, d: R.group_profiles(_traits(s, d), _TRAITS, _traits(s, d).select("species", (F.length("species") % 3).alias("functional_group")).where("species is not null")), f"""
  select length(species) % 3 functional_group, trait, count(*) species, avg(value) mean, stddev_samp(value) deviation, max(value) - min(value) "range" from (from {_TSQL} unpivot (value for trait in ({', '.join(_TRAITS)}))) group by 1, 2""", "mean, deviation, \"range\"", "functional_group, trait, species")
_add("trait_trade_offs", lambda s, d: R.trade_offs(_traits(s, d).where("species is not null"), _TRAITS).select("trait1", "trait2", "n", "correlation"), " union all ".join(f"select '{a}' trait1, '{b}' trait2, count(*) n, corr({a}, {b}) correlation from {_TSQL} where {a} is not null and {b} is not null" for i, a in enumerate(_TRAITS) for b in _TRAITS[i + 1:]), "correlation", "trait1, trait2, n")
_add("trait_syndromes", lambda s, d: s.createDataFrame(R.trait_syndromes(_traits(s, d), _TRAITS)))
_add("trait_environment", lambda s, d: R.trait_environment(survey(s, d), _traits(s, d), _TRAITS, _env(s, d), ["elevation"]), f"""
  with w as (select site, trait, sum(w * coalesce(value, mv)) cwm from (select c.site, c.species, trait, value, abundance / sum(abundance) over (partition by site, trait) w, avg(value) over (partition by site, trait) mv
    from com c join (from {_TSQL} unpivot include nulls (value for trait in ({', '.join(_TRAITS)}))) t using (species)) group by 1, 2)
  select trait, 'elevation' as variable, count(*) n, coalesce(corr(cwm, v), 0) r from w join (select site_id site, avg(elevation) v from environmental_variables where elevation between 0 and 2500 group by 1) using (site) group by 1""", "r", "trait, variable, n")


def _phylo(spark, d):
    df = read_table(spark, d, "phylogenetic_distances").dropDuplicates(["phylo_id"])
    return R.phylo_pairs(df.drop("phylo_id"))


_PH = "(select least(a, b) i, greatest(a, b) j, avg(dist) dist from (unpivot (select * exclude (phylo_id) rename (species as a) from phylogenetic_distances where species is not null qualify row_number() over (partition by phylo_id) = 1) on columns(* exclude (a)) into name b value dist) where a <> b and not isnan(dist) group by 1, 2)"
_add("mpd_mntd", lambda s, d: R.mean_pair_distances(survey(s, d), _phylo(s, d)), f"""
  with pr as (select x.site, x.species s1, y.species s2, x.abundance * y.abundance w, dist from {_PH} join com x on x.species = i join com y on y.species = j and y.site = x.site),
  nt as (select site, avg(m) mntd from (select site, s, min(dist) m from (select site, s1 s, dist from pr union all select site, s2, dist from pr) group by 1, 2) group by 1)
  select site, sum(w * dist) / sum(w) mpd, max(mntd) mntd from pr join nt using (site) group by 1""", "mpd, mntd", "site")
_add("phylo_tree_length", lambda s, d: R.tree_length(survey(s, d), _phylo(s, d)))
_add("phylo_nulls", lambda s, d: R.phylogenetic_nulls(survey(s, d), _phylo(s, d), 999))


def _env(spark, d):
    return read_table(spark, d, "environmental_variables").where("site_id is not null and elevation between 0 and 2500").groupBy(F.col("site_id").alias("site")).agg(F.avg("elevation").alias("elevation"))


_add("species_optima", lambda s, d: R.species_optima(survey(s, d), _env(s, d), "elevation"), """
  select species, m optimum, sqrt(greatest(q - m * m, 0)) tolerance from (select species, sum(abundance * v) / sum(abundance) m, sum(abundance * v * v) / sum(abundance) q from com join (select site_id site, avg(elevation) v from environmental_variables where elevation between 0 and 2500 group by 1) using (site) group by 1)""", "optimum, tolerance", "species")
