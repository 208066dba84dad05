"""Queries p1, p3 and p4 over the survey tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phytoscape.operators.hotdeck import Field, HotDeck, filled_table, hot_deck
from phytoscape.operators.nearby import keys_in_regions, near_keys, near_or_inside, positions
from phytoscape.operators.profile import Limits, control_limits, load_findings, merge_states, profile_metrics, profile_states, value_states
from phytoscape.session import read_table

LATITUDES, LONGITUDES = (40, 50), (-80, -65)
HABITATS = ("broadleaf", "needleleaf", "mixedwood", "fen", "heath")
DECK = HotDeck(
    key="env_id", group="site_id", time="measured_on", arrived="ingested_at",
    fields=(Field("soil_ph", 2, 11), Field("soil_moisture", 0, 1), Field("habitat_type", values=HABITATS)),
    numeric=(("elevation", 500.0), ("temperature", 15.0), ("precipitation", 100.0)), categorical=("land_use",), band=("elevation", 250.0),
)
LIMITS = [Limits("latitude", 40, 50, 0.01), Limits("elevation", -100, 2500, 1.0), Limits("soil_ph", 2, 11, 0.01)]
VISIT_CODE = ("visit_code", r"V[0-9]{4}-[0-9]{6}")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return positions(read_table(spark, d, "vegetation_survey_data"), "site_id", "latitude", "longitude", LATITUDES, LONGITUDES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sites with positions at most 100 m apart, and areas with the sites of which they contain a position."""
    return near_or_inside(_positions(spark, d), read_table(spark, d, "survey_areas"), "area_id", "boundary", 100.0)


def p1_near_sites(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of sites alone, within 250 m."""
    return near_keys(_positions(spark, d), 250.0)


def p1_area_sites(spark: SparkSession, d: str) -> DataFrame:
    """Number of sites with a position in each area."""
    return keys_in_regions(_positions(spark, d), read_table(spark, d, "survey_areas"), "area_id", "boundary").groupBy(F.col("region").alias("area_id")).agg(F.count("*").alias("sites"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells filled from records of the same site."""
    return hot_deck(read_table(spark, d, "environmental_variables"), DECK, only="group").select(F.col("key").alias("env_id"), F.col("field").alias("field_name"))


def p3_filled_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every filled cell with its value, the block that gave it and its donors."""
    return hot_deck(read_table(spark, d, "environmental_variables"), DECK).select(
        F.col("key").alias("env_id"), F.col("field").alias("field_name"), F.coalesce(F.col("num").cast("string"), "cat").alias("value"), "block", F.concat_ws(",", F.transform("donors", lambda x: x.cast("string"))).alias("donors")
    )


def p3_filled_table(spark: SparkSession, d: str) -> DataFrame:
    """The measurements with their gaps filled and marked."""
    return filled_table(read_table(spark, d, "environmental_variables"), DECK)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads and columns out of order."""
    return load_findings(read_table(spark, d, "vegetation_survey_data"), "load_series", "load_no", LIMITS, VISIT_CODE)


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same findings from the stored states of the rows ingested before October 2021 and a scan of those after."""
    df = read_table(spark, d, "vegetation_survey_data")
    late = F.coalesce(F.col("ingested_at") >= "2021-10-01", F.lit(False))
    return load_findings(df.where(late), "load_series", "load_no", LIMITS, VISIT_CODE, stored=value_states(df.where(~late), "load_series", "load_no", LIMITS, VISIT_CODE))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """States per load and year of ingestion, merged into those of the loads."""
    df = read_table(spark, d, "vegetation_survey_data").withColumn("_part", F.year("ingested_at"))
    by = ["load_series", "load_no"]
    parts = profile_states(df, [*by, "_part"], [c for c in df.columns if c not in (*by, "_part")], dict([VISIT_CODE]))
    return profile_metrics(merge_states(parts, by), by)


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every column of every load."""
    return _profile(spark, d).drop("low", "high")


def p4_profile_counts(spark: SparkSession, d: str) -> DataFrame:
    """The exact parts of the profile: rows, missing share, share off form, and the range of the numbers."""
    return _profile(spark, d).select("load_series", "load_no", "column_name", "n", *[(F.round(c, 9) + 0.0).alias(c) for c in ("missing_share", "off_form_share", "low", "high")])


def p4_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Metrics outside the control limits of the loads before."""
    return control_limits(_profile(spark, d), "load_series", "load_no")


QUERIES = {f.__name__: f for f in (p1_found, p1_near_sites, p1_area_sites, p3_found, p3_filled_cells, p3_filled_table, p4_found, p4_incremental, p4_profile, p4_profile_counts, p4_anomalies)}

_CLEAN = "lower(regexp_replace(habitat_type, '^\\s+|\\s+$', '', 'g')) in ('broadleaf','needleleaf','mixedwood','fen','heath')"
_PTS = "pts as (select distinct site_id k, latitude y, longitude x from vegetation_survey_data where site_id is not null and latitude between 40 and 50 and longitude between -80 and -65 and not isnan(latitude) and not isnan(longitude))"
# cells no smaller than the radius, so that near positions lie in neighbouring cells
_NEAR = """
c as (select *, cast(floor(y / {dy}) as bigint) cy, cast(floor(x / {dx}) as bigint) cx from pts),
n as (select k, y, x, cy + dy cy, cx + dx cx from c, (select unnest([-1, 0, 1]) dy) a, (select unnest([-1, 0, 1]) dx) b),
near as (select distinct a.k key_a, b.k key_b from c a join n b on a.cy = b.cy and a.cx = b.cx and a.k < b.k
  where 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= {metres})"""
_INSIDE = """
rings as (select area_id, unnest(regexp_extract_all(boundary, '\\(([^()]+)\\)', 1)) ring from survey_areas where boundary is not null),
verts as (select area_id, ring, string_split(ring, ',') v from rings),
edges as (select area_id, unnest(generate_series(1, len(v) - 1)) i, v from verts),
e as (select area_id, cast(split_part(trim(v[i]), ' ', 1) as double) x1, cast(split_part(trim(v[i]), ' ', 2) as double) y1, cast(split_part(trim(v[i + 1]), ' ', 1) as double) x2, cast(split_part(trim(v[i + 1]), ' ', 2) as double) y2 from edges),
box as (select area_id, min(least(x1, x2)) x0, max(greatest(x1, x2)) x9, min(least(y1, y2)) y0, max(greatest(y1, y2)) y9 from e group by 1),
hit as (select b.area_id, p.k, p.y, p.x from box b join pts p on p.x between b.x0 and b.x9 and p.y between b.y0 and b.y9),
odd as (select h.area_id, h.k, h.y, h.x from hit h join e on e.area_id = h.area_id and (e.y1 > h.y) <> (e.y2 > h.y) and h.x < (e.x2 - e.x1) * (h.y - e.y1) / (e.y2 - e.y1) + e.x1 group by all having count(*) % 2 = 1)"""
_FINDINGS = """
with v as (select load_series s, load_no o, unnest(['latitude', 'elevation', 'soil_ph']) c, unnest([latitude, elevation::double, soil_ph]) v, unnest([40, -100, 2]) lo, unnest([50, 2500, 11]) hi from vegetation_survey_data),
m as (select s, o, c, count(*) n, count(*) filter (where v is not null and not isnan(v)) p, count(*) filter (where not isnan(v) and v between lo and hi) ok, count(distinct v) filter (where not isnan(v) and v between lo and hi) d,
  quantile_cont(v, [0.25, 0.5, 0.75]) filter (where not isnan(v) and v between lo and hi) q from v group by 1, 2, 3),
j as (select a.*, b.o bo, b.n bn, b.p bp, b.d bd, b.q bq from m a left join m b on a.s = b.s and a.c = b.c and b.o = a.o - 1),
f as (select load_series s, load_no o, count(visit_code) p, count(*) filter (where not regexp_full_match(visit_code, 'V[0-9]{4}-[0-9]{6}')) bad from vegetation_survey_data group by 1, 2)
select s load_series, o load_no, c column_name, 'missing' finding from j where bo is not null and (n - p) / n - (bn - bp) / bn > 0.05
union all select s, o, c, 'range' from j where p - ok > 0.02 * p
union all select s, o, c, 'shift' from j where bo is not null and abs(q[2] - bq[2]) > 0.55 * (bq[3] - bq[1])
union all select s, o, c, 'distinct' from j where bo is not null and d < 0.5 * bd
union all select s, o, 'visit_code', 'pattern' from f where bad > 0.03 * p"""
_LATEST = f"select env_id, site_id, (soil_ph between 2 and 11 and not isnan(soil_ph)) is true a, (soil_moisture between 0 and 1 and not isnan(soil_moisture)) is true b, ({_CLEAN}) is true c from environmental_variables where env_id is not null qualify row_number() over (partition by env_id order by ingested_at desc) = 1"
_TEXTS = "site_id, date, land_use, habitat_type, visit_code, ingested_at"
SQL = {
    "p1_found": f"with {_PTS},{_NEAR.format(dy=0.0009, dx=0.0015, metres=100)},{_INSIDE} select key_a, key_b from near union select area_id, k from odd",
    "p1_near_sites": f"with {_PTS},{_NEAR.format(dy=0.00226, dx=0.0036, metres=250)} select key_a, key_b from near",
    "p1_area_sites": f"with {_PTS},{_INSIDE} select area_id, count(distinct k) sites from odd group by 1",
    "p3_found": f"""
with rows as ({_LATEST}),
cells as (select env_id, site_id, unnest(['soil_ph', 'soil_moisture', 'habitat_type']) field_name, unnest([a, b, c]) ok from rows),
have as (select site_id, field_name, count(*) n from cells where ok and site_id is not null group by 1, 2)
select env_id, field_name from cells join have using (site_id, field_name) where not ok""",
    "p4_found": _FINDINGS,
    "p4_incremental": _FINDINGS,
    "p4_profile_counts": f"""
with t as (select * from vegetation_survey_data), loads as (select load_series, load_no, count(*) n from t group by 1, 2),
num as (select * from (unpivot (select load_series, load_no, columns(* exclude (load_series, load_no, {_TEXTS}))::double from t) on columns(* exclude (load_series, load_no)) into name c value v) where not isnan(v)),
txt as (unpivot (select load_series, load_no, columns(* exclude (load_series, load_no))::varchar from (select load_series, load_no, {_TEXTS} from t)) on columns(* exclude (load_series, load_no)) into name c value v),
seen as (select load_series, load_no, c, count(*) k, min(v) low, max(v) high, null::bigint off from num group by 1, 2, 3 union all select load_series, load_no, c, count(*), null, null, case when c = 'visit_code' then count(*) filter (where not regexp_full_match(v, 'V[0-9]{{4}}-[0-9]{{6}}')) end from txt group by 1, 2, 3)
select l.load_series, l.load_no, c.c column_name, l.n, round((l.n - coalesce(s.k, 0)) / l.n, 9) + 0.0 missing_share, round(s.off / s.k, 9) + 0.0 off_form_share, s.low + 0.0 low, s.high + 0.0 high
from loads l cross join (select distinct c from seen) c left join seen s on s.load_series is not distinct from l.load_series and s.load_no is not distinct from l.load_no and s.c = c.c""",
}
