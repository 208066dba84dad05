"""Queries of names, coordinates, dates and tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from phytoscape.functions import formulas as X
from phytoscape.operators import names as N
from phytoscape.plans.helpers import rounded
from phytoscape.session import read_table
from phytoscape.sources import tables as T

QUERIES, SQL = {}, {}
TODAY = "2024-06-30"


def _add(name, build, body=None):
    QUERIES[name] = lambda spark, d: rounded(build(spark, d))
    if body:
        SQL[name] = body


def _t(name):
    return lambda spark, d: read_table(spark, d, name)


_traits, _veg, _line = _t("species_traits"), _t("vegetation_survey_data"), _t("lineitem")
# the patterns as SQL, stated apart from those of the operators
_PH = r"\b(sp\.?|cf\.?|aff\.?|indet\.?|unknown|unidentified|undet\.?|spec\.?|species|gen\.?|genus)(\s|$)"
_AU = [r"\s+L\.(\s|$)", r"\s+\([^)]+\)\s*[A-Z][a-z]+", r"\s+[A-Z][a-z]+\s+[A-Z][a-z]+(\s+\d{4})?$", r"\s+[A-Z][a-z]+\s+\d{4}(\s|$)", r"\s+\d{4}(\s|$)", r"\s+(ex|sensu|in)\s+[A-Z][a-z]+", r"\s+emend\.?\s+[A-Z][a-z]+", r"\s+nom\.\s+(nud|inval)\.", r"\s+et\s+al\.", r"\s+&\s+[A-Z][a-z]+"]
_RK = r"var\.|variety|subsp\.|ssp\.|subspecies|f\.|form|cv\.|cultivar|subvar\.|subf\."
_NAMES = r"with n as (select trait_id, species s, trim(regexp_replace(species, '\s+$|^\s+', '', 'g')) t from species_traits), w as (select *, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') w from n)"
_author = lambda c, flags="": "(" + " or ".join(f"regexp_matches({c}, '{flags}{p}')" for p in _AU) + ")"
_add("name_types", lambda s, d: _traits(s, d).groupBy(N.name_type(F.col("species")).alias("name_type")).agg(F.count("*").alias("records")), rf"""{_NAMES}
select case when s is null then 'invalid' when regexp_matches(lower(t), '{_PH}') then 'placeholder' when contains(t, '×') or contains(t, 'x ') or contains(t, 'hybr') and (contains(t, 'hybrid') or contains(t, 'hybr.')) then 'hybrid' when regexp_matches(t, '{_RK}') then 'infraspecific'
  when len(w) = 0 then 'empty' when len(w) = 1 then case when regexp_matches(w[1], '^\p{{Lu}}') then 'genus_only' else 'epithet_only' end when len(w) = 2 then case when regexp_matches(w[1], '^\p{{Lu}}') and regexp_matches(w[2], '^\p{{Ll}}') then 'binomial' else 'malformed_binomial' end
  when {_author('t')} then 'binomial_with_author' else 'trinomial_or_complex' end name_type, count(*) records from w group by 1""")
_stripped = r"regexp_replace(regexp_replace(coalesce(species, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
for _p in _AU:
    _stripped = f"regexp_replace({_stripped}, '{_p}', '', 'g')"
_tidy = "case " + " ".join(f"when contains(t, '{m}') then trim(string_split(t, '{m}')[1]) || ' {m} ' || trim(string_split(t, '{m}')[2])" for m in N.MARKERS) + " else t end"
_marks = ", ".join(f"'{m}'" for m in N.MARKERS)
_add("clean_names", lambda s, d: _traits(s, d).select("trait_id", N.clean_name(F.col("species")).alias("cleaned")), rf"""
with c as (select trait_id, {_stripped} t from species_traits), w as (select trait_id, list_filter(string_split_regex({_tidy}, '\s+'), lambda x: x <> '') w from c)
select trait_id, case when len(w) >= 2 then array_to_string(list_transform(w, lambda x, i: case when i = 1 then upper(x[1]) || lower(x[2:]) when i = 2 or i > 3 and w[i - 1] in ({_marks}) then lower(x) else x end), ' ') else coalesce(w[1], '') end cleaned from w""")
_add("fuzzy_names", lambda s, d: N.fuzzy_match(_traits(s, d), "species", read_table(s, d, "species_reference"), "species"), """
with q as (select distinct species name, regexp_replace(species, '[^\x00-\x7F]', '?', 'g') a from species_traits where species <> ''), r as (select distinct species m from species_reference where species <> ''),
c as (select name, m, 100.0 * (1 - levenshtein(a, m) / greatest(length(a), length(m))) s from q, r where len(list_intersect(list_transform(range(1, greatest(length(a) - 1, 1) + 1), lambda i: substr(a, i, 2)), list_transform(range(1, greatest(length(m) - 1, 1) + 1), lambda i: substr(m, i, 2)))) > 0),
b as (select name, arg_min(m, (-s, m)) m, max(s) s from c group by 1)
select name, case when s >= 80 then m else name end as match, round(coalesce(s, 0), 9) + 0.0 score from q left join b using (name)""")
_add("standard_names", lambda s, d: _traits(s, d).select("trait_id", N.standard_name(F.col("species")).alias("name")), r"""
with t as (select trait_id, string_split(trim(regexp_replace(coalesce(species, ''), '\s+', ' ', 'g'), ' '), ' ') w, trim(regexp_replace(coalesce(species, ''), '\s+', ' ', 'g'), ' ') t from species_traits)
select trait_id, case when len(w) >= 2 then upper(w[1][1]) || lower(w[1][2:]) || ' ' || lower(w[2]) else t end as name from t""")
_first, _second = r"regexp_matches(w[1], '^\p{Lu}')", r"regexp_matches(w[2], '^\p{Lu}')"
_before = [rf"len(list_filter(string_split_regex(string_split(t, '{m}')[1], '\s+'), lambda x: x <> '')) < 2" for m in N.MARKERS]
_ranked = " or ".join(f"(contains(t, '{m}') and (len(string_split(t, '{m}')) <> 2 or {b} or trim(string_split(t, '{m}')[2]) = '' or regexp_matches(trim(string_split(t, '{m}')[2]), '^\\p{{Lu}}')))" for m, b in zip(N.MARKERS, _before))
_CHECKS = {
    "incomplete_binomial": f"len(w) < 2 or not {_first} or {_second}", "formatting_issues": "false",
    "author_citations": rf"{_author('t', '(?i)')} or regexp_matches(t, '\b[A-Z][a-z]+\s+\d{{4}}\b') or regexp_matches(t, '\([^)]+\)') or regexp_matches(t, '\b[A-Z]\.$')",
    "hybrid_markers": r"contains(t, '×') or contains(t, 'x ') or contains(t, 'hybrid') or contains(t, 'hybr.') or contains(lower(t), ' x ') and not regexp_matches(t, '(?i)\s+x\s+[A-Z][a-z]+')", "infraspecific_issues": _ranked,
    "placeholder_names": rf"regexp_matches(lower(t), '{_PH}') or regexp_matches(lower(t), '\b\d+\b')", "invalid_characters": r"regexp_matches(t, '\d') or regexp_matches(t, '\s{2,}') or regexp_matches(t, '[^\p{L}\p{N}_\s×.\-]') or regexp_matches(t, '[\x{2000}-\x{206F}\x{2E00}-\x{2E7F}]')",
    "missing_components": rf"s is null or len(w) = 0 or len(w) = 1 and not regexp_matches(lower(t), '{_PH}')",
    "capitalization_errors": rf"len(w) > 1 and (not {_first} or {_second} or w[1] <> upper(w[1][1]) || lower(w[1][2:]) or w[2] <> lower(w[2])) or len(list_filter(w, lambda x: regexp_matches(x[2:], '\p{{Lu}}') and regexp_matches(x[2:], '\p{{Ll}}'))) > 0",
    "spacing_errors": r"regexp_matches(t, '\s{2,}') or regexp_matches(t, '\s+[.,;:]')",
}
_flagged = ", ".join(f"(s is not null or '{k}' = 'missing_components') and coalesce({c}, false) as {k}" for k, c in _CHECKS.items())
_add("name_error_counts", lambda s, d: N.with_name_checks(_traits(s, d).select("species"), "species").agg(*[F.count_if(F.col(f"name_has_{k}")).alias(k) for k in N.CATEGORIES]), rf"""{_NAMES}, f as (select {_flagged} from (select s, coalesce(t, '') t, coalesce(w, []) w from w)) select {', '.join(f'count(*) filter (where {k}) {k}' for k in _CHECKS)} from f""")
_add("name_severity", lambda s, d: N.with_name_checks(_traits(s, d).select("species"), "species").groupBy("name_severity").agg(F.count("*").alias("records")), rf"""{_NAMES}, f as (select {_flagged} from (select s, coalesce(t, '') t, coalesce(w, []) w from w))
select case when missing_components or incomplete_binomial or placeholder_names then 'critical' when invalid_characters then 'high' when author_citations or infraspecific_issues or hybrid_markers then 'medium' when capitalization_errors or spacing_errors then 'low' else 'none' end name_severity, count(*) records from f group by 1""")
_add("name_report", lambda s, d: N.name_report(_traits(s, d), "species"))
_add("names_checked", lambda s, d: N.with_name_checks(_traits(s, d).select("trait_id", "species"), "species"))
_add("darwin_core", lambda s, d: T.darwin_core_report(T.to_darwin_core(_veg(s, d).select("record_id", "site_id", "date", "latitude", "longitude", "elevation").withColumn("species", F.lit("Quercus alba")))).where("issue <> 'in the future'"), """
select 'warning' as level, 'decimalLatitude, decimalLongitude' term, 'invalid pair' issue, count(*) records from vegetation_survey_data where coalesce(latitude between -90 and 90 and longitude between -180 and 180 and not isnan(latitude) and not isnan(longitude), false) is not true having count(*) > 0""")


def _flags():
    return N.coordinate_flags(F.col("latitude"), F.col("longitude"))



_add("coordinate_flags", lambda s, d: _veg(s, d).agg(*[F.count_if(_flags()[k]).alias(k) for k in ("missing", "zero", "out_of_range", "transposed")]), """
with t as (select case when not isnan(latitude) then latitude end a, case when not isnan(longitude) then longitude end b from vegetation_survey_data)
select count(*) filter (where a is null or b is null) missing, count(*) filter (where a = 0 and b = 0) zero, count(*) filter (where abs(a) > 90 or abs(b) > 180) out_of_range, count(*) filter (where abs(a) > 90 and abs(a) <= 180 and abs(b) <= 90) transposed from t""")
# decimals of the shortest form of a number, at most ten
_DEC = "length(rtrim(split_part(printf('%.10f', abs({c})), '.', 2), '0'))"
_add("coordinate_precision", lambda s, d: _veg(s, d).where("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)").groupBy(N.precision_m(F.col("latitude"), F.col("longitude")).alias("metres")).agg(F.count("*").alias("records")), f"""
select greatest(111000 / pow(10, least({_DEC.format(c='latitude')}, {_DEC.format(c='longitude')})), 1)::double metres, count(*) records from vegetation_survey_data where not isnan(latitude) and not isnan(longitude) group by 1""")
_add("valid_coordinates", lambda s, d: _veg(s, d).groupBy(_flags()["valid"].alias("valid")).agg(F.count("*").alias("records")), f"""
with t as (select case when not isnan(latitude) then latitude end a, case when not isnan(longitude) then longitude end b from vegetation_survey_data)
select a is not null and b is not null and not (a = 0 and b = 0) and abs(a) <= 90 and abs(b) <= 180 and {_DEC.format(c='a')} >= 2 and {_DEC.format(c='b')} >= 2 as valid, count(*) records from t group by 1""")
_add("utm_zones", lambda s, d: _veg(s, d).where("latitude between -80 and 84 and longitude between -180 and 180 and not isnan(latitude) and not isnan(longitude)").groupBy(N.utm_zone(F.col("longitude"), F.col("latitude")).alias("epsg")).agg(F.count("*").alias("records")), """
select (case when latitude >= 0 then 32600 else 32700 end + case when latitude >= 56 and latitude < 64 and longitude >= 3 and longitude < 12 then 32 when latitude >= 72 and latitude < 84 and longitude >= 0 and longitude < 42 then case when longitude < 9 then 31 when longitude < 21 then 33 when longitude < 33 then 35 else 37 end else least(floor((longitude + 180) / 6) + 1, 60) end)::bigint epsg, count(*) records
from vegetation_survey_data where latitude between -80 and 84 and longitude between -180 and 180 and not isnan(latitude) and not isnan(longitude) group by 1""")
_add("web_mercator", lambda s, d: (lambda xy: _veg(s, d).where("latitude between 40 and 50 and longitude between -80 and -65").agg(F.avg(F.round(xy[0], 4)).alias("x"), F.avg(F.round(xy[1], 4)).alias("y")).select(F.round("x", 3).alias("x"), F.round("y", 3).alias("y")))(N.web_mercator(F.col("longitude"), F.col("latitude"))), """
select round(avg(round(6378137 * radians(longitude), 4)), 3) x, round(avg(round(6378137 * ln(tan(pi() / 4 + radians(latitude) / 2)), 4)), 3) y from vegetation_survey_data where latitude between 40 and 50 and longitude between -80 and -65""")


def _dms(s, d):
    t = _veg(s, d).where("latitude between 40 and 50")
    text = F.format_string("%d°%d'%d\"N", F.floor("latitude").cast("int"), F.floor((F.col("latitude") % 1) * 60).cast("int"), F.lit(30))
    return t.select(N.to_decimal(text, 90).alias("v")).groupBy(F.round("v", 2).alias("degrees")).agg(F.count("*").alias("records"))


_add("dms_to_decimal", _dms, "select round(floor(latitude) + floor((latitude % 1) * 60) / 60 + 30 / 3600.0, 2) degrees, count(*) records from vegetation_survey_data where latitude between 40 and 50 group by 1")
_OUT = ["temperature", "soil_ph"]
_add("iqr_outliers", lambda s, d: N.outliers(_veg(s, d), _OUT).groupBy("outlier").agg(F.count("*").alias("records")), """
with q as (select quantile_cont(temperature, [0.25, 0.75]) filter (where not isnan(temperature)) a, quantile_cont(soil_ph, [0.25, 0.75]) filter (where not isnan(soil_ph)) b from vegetation_survey_data)
select coalesce(not isnan(temperature) and (temperature < a[1] - 1.5 * (a[2] - a[1]) or temperature > a[2] + 1.5 * (a[2] - a[1])), false) or coalesce(not isnan(soil_ph) and (soil_ph < b[1] - 1.5 * (b[2] - b[1]) or soil_ph > b[2] + 1.5 * (b[2] - b[1])), false) outlier, count(*) records from vegetation_survey_data, q group by 1""")
_add("zscore_outliers", lambda s, d: N.outliers(_line(s, d), ["l_extendedprice"], "zscore", 2.0).groupBy("outlier").agg(F.count("*").alias("records")), "select abs(l_extendedprice - m) > 2 * s outlier, count(*) records from lineitem, (select avg(l_extendedprice) m, stddev_pop(l_extendedprice) s from lineitem) group by 1")
def _dates():
    return N.date_flags(F.col("date"), TODAY)



_add("date_flags", lambda s, d: _veg(s, d).agg(*[F.count_if(_dates()[k]).alias(k) for k in ("missing", "future", "very_old", "default_like")]), f"""
select count(*) filter (where date is null) missing, count(*) filter (where date > date '{TODAY}' + 30) future, count(*) filter (where year(date) < 1800) very_old, count(*) filter (where day(date) in (1, 15, 31)) default_like from vegetation_survey_data""")
_add("seasonal_counts", lambda s, d: _veg(s, d).groupBy(_dates()["season"].alias("season")).agg(F.count("*").alias("records")), """
select case when month(date) in (12, 1, 2) then 'winter' when month(date) in (3, 4, 5) then 'spring' when month(date) in (6, 7, 8) then 'summer' when date is not null then 'autumn' end season, count(*) records from vegetation_survey_data group by 1""")
_add("date_components", lambda s, d: read_table(s, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in N.date_components(F.col("o_orderdate")).items()]), "select o_orderkey, year(o_orderdate) as \"year\", month(o_orderdate) as \"month\", day(o_orderdate) as \"day\", dayofyear(o_orderdate) day_of_year, weekofyear(o_orderdate) as week from orders")


def _texts(s, d):
    o = read_table(s, d, "orders")
    fmt = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    return o.select("o_orderkey", N.parse_date(fmt).cast("string").alias("parsed"))


_add("parsed_dates", _texts, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') parsed from orders")
_add("date_order_check", lambda s, d: _line(s, d).join(read_table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("l_shipdate") < F.col("o_orderdate")).alias("before"), (F.datediff("l_shipdate", "o_orderdate") > 365).alias("far")).agg(F.count("*").alias("records")), """
select l_shipdate < o_orderdate as "before", date_diff('day', o_orderdate::date, l_shipdate::date) > 365 far, count(*) records from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""")
_add("integrate_outer", lambda s, d: read_table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("c_acctbal").alias("customers")).join(read_table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum("s_acctbal").alias("suppliers")), "nation", "full_outer").select("nation", F.round("customers", 3).alias("customers"), F.round("suppliers", 3).alias("suppliers")), """
select nation, round(customers, 3) customers, round(suppliers, 3) suppliers from (select c_nationkey nation, sum(c_acctbal) customers from customer group by 1) full outer join (select s_nationkey nation, sum(s_acctbal) suppliers from supplier group by 1) using (nation)""")
_add("union_by_name", lambda s, d: read_table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).unionByName(read_table(s, d, "supplier").select(F.col("s_name").alias("name")), allowMissingColumns=True), "select c_name as name, c_mktsegment segment from customer union all select s_name, null from supplier")
_add("impute_median", lambda s, d: (lambda t: t.join(F.broadcast(t.agg(F.median(F.when(~F.isnan("soil_ph"), F.col("soil_ph"))).alias("m")))).select("env_id", F.coalesce(F.when(~F.isnan("soil_ph"), F.col("soil_ph")), "m").alias("soil_ph")))(read_table(s, d, "environmental_variables")), """
select env_id, round(coalesce(case when not isnan(soil_ph) then soil_ph end, m), 9) soil_ph from environmental_variables, (select median(soil_ph) filter (where not isnan(soil_ph)) m from environmental_variables)""")
_add("duplicate_records", lambda s, d: _veg(s, d).groupBy("record_id").agg(F.count("*").alias("copies")).where("copies > 1"), "select record_id, count(*) copies from vegetation_survey_data group by 1 having count(*) > 1")


def _bands(s, d):
    return _line(s, d).select("l_orderkey", "l_linenumber", (F.col("l_discount") * 2).alias("red"), (F.col("l_quantity") / 50).alias("nir"), F.col("l_tax").alias("blue"), (F.col("l_tax") * 3).alias("green"), (F.col("l_discount") * 3).alias("swir"))


_add("vegetation_indices", lambda s, d: _bands(s, d).select("l_orderkey", "l_linenumber", X.ndvi(F.col("red"), F.col("nir")).alias("ndvi"), X.evi(F.col("red"), F.col("nir"), F.col("blue")).alias("evi"), X.savi(F.col("red"), F.col("nir")).alias("savi"), X.msavi(F.col("red"), F.col("nir")).alias("msavi"), X.ndwi(F.col("green"), F.col("nir")).alias("ndwi"), X.nbr(F.col("nir"), F.col("swir")).alias("nbr")), """
with b as (select l_orderkey, l_linenumber, l_discount * 2 red, l_quantity / 50 nir, l_tax blue, l_tax * 3 green, l_discount * 3 swir from lineitem)
select l_orderkey, l_linenumber::bigint l_linenumber, round((nir - red) / (nir + red), 9) + 0.0 ndvi, round(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1), 9) + 0.0 evi, round((nir - red) * 1.5 / (nir + red + 0.5), 9) + 0.0 savi,
  round((2 * nir + 1 - sqrt((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red))) / 2, 9) + 0.0 msavi, round((green - nir) / (green + nir), 9) + 0.0 ndwi, round((nir - swir) / (nir + swir), 9) + 0.0 nbr from b""")
