"""Reports on the quality of positions and dates, and the resolution of names against a reference taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phytoscape.operators.names import coordinate_flags, parse_date

C = F.col

# fixed values: latitude and longitude of country centroids and of institutions
CENTROIDS = {"Brazil": (-14.2350, -51.9253), "United States": (39.8283, -98.5795), "Canada": (56.1304, -106.3468), "Australia": (-25.2744, 133.7751), "India": (20.5937, 78.9629), "China": (35.8617, 104.1954), "Russia": (61.5240, 105.3188)}
INSTITUTIONS = {"Smithsonian": (38.8912, -77.0253), "Harvard_Herbaria": (42.3826, -71.1162), "Kew_Gardens": (51.4829, -0.2945), "Natural_History_Museum_London": (51.4966, -0.1764), "MNHN_Paris": (48.8430, 2.3547)}
# fixed values: latitude, longitude and radius in degrees of large cities
CITIES = {"New_York": (40.7128, -74.0060, 0.5), "London": (51.5074, -0.1278, 0.3), "Tokyo": (35.6762, 139.6503, 0.4), "Paris": (48.8566, 2.3522, 0.3), "Berlin": (52.5200, 13.4050, 0.3), "Sydney": (-33.8688, 151.2093, 0.3), "San_Francisco": (37.7749, -122.4194, 0.3), "Los_Angeles": (34.0522, -118.2437, 0.5)}
# fixed values: boxes (south, north, west, east) of countries, in the order they are tried
BOXES = {"United States": (25, 49, -125, -66), "Canada": (42, 70, -141, -52), "Australia": (-44, -10, 113, 154), "India": (8, 37, 68, 97), "China": (18, 54, 73, 135), "Brazil": (-34, 5, -74, -32), "Europe": (36, 71, -9, 32), "Africa": (-35, 37, -18, 52)}


def _near(lat: Column, lon: Column, places, reach: float | None = None) -> Column:
    found = F.lit(False)
    for p in places:
        found = found | F.coalesce((lat - p[0]) ** 2 + (lon - p[1]) ** 2 < (reach if reach is not None else p[2]) ** 2, F.lit(False))
    return found


def place_flags(lat: Column, lon: Column) -> dict[str, Column]:
    """centroid, urban and institution: nearer (in degrees) to a known place than its tolerance; missing positions are near none."""
    return {"centroid": _near(lat, lon, [*CENTROIDS.values(), *INSTITUTIONS.values()], 0.01), "urban": _near(lat, lon, CITIES.values()), "institution": _near(lat, lon, INSTITUTIONS.values(), 0.001)}


def country(lat: Column, lon: Column) -> Column:
    """The first rough box that holds the position, else Unknown."""
    out = F.lit("Unknown")
    for name, (s, n, w, e) in reversed(BOXES.items()):
        out = F.when(lat.between(s, n) & lon.between(w, e), name).otherwise(out)
    return out


def spatial_report(df: DataFrame, lat: str = "latitude", lon: str = "longitude", stated: str | None = None) -> DataFrame:
    """(check, records, percentage): rows, each flag of a position, and with a ``stated`` country those that differ from the derived one where both are known."""
    y, x = C(lat).cast("double"), C(lon).cast("double")
    flags = coordinate_flags(y, x) | place_flags(F.when(~F.isnan(y), y), F.when(~F.isnan(x), x))
    if stated:
        s, d = F.coalesce(C(stated), F.lit("Unknown")), country(y, x)
        flags["country_mismatch"] = (s != d) & (s != "Unknown") & (d != "Unknown")
    t = df.agg(F.count("*").alias("all"), *[F.count_if(f).alias(k) for k, f in flags.items()])
    long = t.select("all", F.explode(F.array(F.struct(F.lit("total").alias("check"), C("all").alias("records")), *[F.struct(F.lit(k).alias("check"), C(k).alias("records")) for k in flags])).alias("r"))
    return long.select("r.check", "r.records", F.coalesce(F.round(F.try_divide(100.0 * C("r.records"), C("all")), 2), F.lit(0.0)).alias("percentage"))


# fixed values: parts of column names of which the first kind lies before the second
BEFORE = [("start", "end"), ("begin", "end"), ("first", "last"), ("birth", "death"), ("collection", "identification"), ("field", "lab"), ("observed", "recorded")]
SAME_YEAR = ("year", "annual", "season")


def date_relation(a: str, b: str) -> list[str]:
    """before, after or same_year, as the names of two date columns suggest."""
    a, b = a.lower(), b.lower()
    out = ["before" if x in a and y in b else "after" for x, y in BEFORE if (x in a and y in b) or (y in a and x in b)]
    return out + (["same_year"] if any(p in a and p in b for p in SAME_YEAR) else [])


def date_order_flags(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """A flag per pair of date columns whose names relate them: both are there and contradict the relation."""
    out = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            tests = {"before": C(a) > C(b), "after": C(a) < C(b), "same_year": F.year(a) != F.year(b)}
            bad = F.lit(False)
            for r in date_relation(a, b):
                bad = bad | F.coalesce(tests[r], F.lit(False))
            if date_relation(a, b):
                out[f"{a}_{b}"] = bad
    return out


def impossible_text(c: Column) -> Column:
    """Texts of days that months do not have, by pattern (29 February counts as such, as the check is defined)."""
    return F.coalesce(c.rlike(r"(02|2)[-/](3[01]|29)") | c.rlike(r"(04|4|06|6|09|9|11)[-/](31)"), F.lit(False))


def repeated_dates(df: DataFrame, column: str) -> DataFrame:
    """(date, records): dates on more than a tenth of the dated rows, and more than two; if ten dated rows or more lie within a week, all of them."""
    d = df.select(C(column).cast("date").alias("date")).where("date is not null")
    s = d.agg(F.count("*").alias("n"), F.datediff(F.max("date"), F.min("date")).alias("span"))
    return d.groupBy("date").agg(F.count("*").alias("records")).join(F.broadcast(s)).where((C("records") > F.greatest(F.lit(2.0), C("n") * 0.1)) | ((C("n") > 10) & (C("span") < 7))).select("date", "records")


def temporal_report(df: DataFrame, columns: list[str], today: str, event: str | None = None) -> DataFrame:
    """(column_name, records, parsed, percentage, first, last, years, future, very_old, far_from_event): of each date column; far are more than 365 days from the ``event`` column."""
    parts = []
    for c in columns:
        d = C(c).cast("date") if dict(df.dtypes)[c] in ("date", "timestamp", "timestamp_ntz") else parse_date(C(c))
        far = F.coalesce(F.abs(F.datediff(d, C(event).cast("date"))) > 365, F.lit(False)) if event and event != c else F.lit(False)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count("*").alias("records"), F.count(d).alias("parsed"), F.min(d).alias("first"), F.max(d).alias("last"), F.count_if(d > F.date_add(F.lit(today).cast("date"), 30)).alias("future"), F.count_if(F.year(d) < 1800).alias("very_old"), F.count_if(far).alias("far_from_event")))
    r = df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return r.select("column_name", "records", "parsed", F.coalesce(F.round(F.try_divide(100.0 * C("parsed"), C("records")), 2), F.lit(0.0)).alias("percentage"), "first", "last", F.round(F.datediff("last", "first") / 365.25, 2).alias("years"), "future", "very_old", "far_from_event")


# --- names against a reference taxonomy ---------------------------------------
# fixed values: author citations that are stripped before a name is looked up
_CITED = [r"\s+L\.$", r"\s+\([^)]+\)\s*[A-Z][a-z]+.*$", r"\s+[A-Z][a-z]+\s+\d{4}$", r"\s+\d{4}$"]
# fixed values: column names under which species are looked for, in order
SPECIES_COLUMNS = ("species", "species_name", "scientific_name", "scientificname", "taxon", "taxa", "binomial", "name", "plant_name", "plantname", "species_col", "sp", "organism", "accepted_name", "canonical_name")


def query_name(c: Column) -> Column:
    """The name as it is looked up: blanks squeezed, authors and years stripped; NULL gives ''."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    for p in _CITED:
        t = F.regexp_replace(t, p, "")
    return F.trim(t)


def match_score(name: Column, query: Column, contained: int = 85, other: int = 70) -> Column:
    """100 for equal names whatever their case, ``contained`` if one is part of the other, else ``other``."""
    n, q = F.lower(name), F.lower(query)
    return F.when(n == q, 100).when(n.contains(q) | q.contains(n), contained).otherwise(other)


def species_column(columns: list[str]) -> str | None:
    low = {c.lower(): c for c in reversed(columns)}
    hit = next((low[n] for n in SPECIES_COLUMNS if n in low), None)
    return hit or next((c for c in columns if any(p in c.lower() for p in ("species", "taxon", "name"))), None)


def resolve_names(names: DataFrame, column: str, taxonomy: DataFrame) -> DataFrame:
    """(original_name, cleaned_name, matched_name, accepted_name, family, taxonomic_status, match_type, match_score, source) of the different names.

    taxonomy: (name, accepted_name, family, source, priority), a source table in
    place of the services: accepted_name is NULL or the name itself for accepted
    names, else the name is its synonym; sources of lower ``priority`` come
    first and the first that knows the name wins. Names are equal whatever their
    case, underscores count as blanks. Names that none knows have score 0.
    """
    norm = lambda c: F.lower(F.regexp_replace(c, "_", " "))
    q = names.select(C(column).alias("original_name")).where("original_name is not null").distinct().withColumn("cleaned_name", query_name(C("original_name")))
    t = taxonomy.where("name is not null").withColumn("_k", norm(C("name")))
    best = t.groupBy("_k").agg(F.min_by(F.struct("name", "accepted_name", "family", "source"), F.struct("priority", "name")).alias("b"))
    r = q.withColumn("_k", norm(C("cleaned_name"))).join(best, "_k", "left")
    synonym = C("b.accepted_name").isNotNull() & (C("b.accepted_name") != C("b.name"))
    return r.select(
        "original_name", "cleaned_name", C("b.name").alias("matched_name"), F.coalesce("b.accepted_name", "b.name").alias("accepted_name"), C("b.family").alias("family"),
        F.when(C("b.name").isNull(), "Unresolved").when(synonym, "Synonym").otherwise("Accepted").alias("taxonomic_status"), F.when(C("b.name").isNull(), "None").when(synonym, "Synonym").otherwise("Exact").alias("match_type"),
        F.when(C("b.name").isNotNull(), match_score(norm(C("b.name")), norm(C("cleaned_name")))).otherwise(0).alias("match_score"), C("b.source").alias("source"),
    )


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """One row: names, resolved ones, their rate, matches of high (90 or more), medium (70) and low confidence, mean score and families."""
    s = C("match_score")
    r = resolved.agg(F.count("*").alias("total_names"), F.count_if(s > 0).alias("resolved"), F.count_if(s == 0).alias("unresolved"), F.count_if(s >= 90).alias("high_confidence"), F.count_if((s >= 70) & (s < 90)).alias("medium_confidence"), F.count_if((s > 0) & (s < 70)).alias("low_confidence"), F.round(F.avg(s), 2).alias("average_match_score"), F.count_distinct("family").alias("families_found"))
    return r.withColumn("resolution_rate", F.coalesce(F.round(F.try_divide(100.0 * C("resolved"), C("total_names")), 2), F.lit(0.0)))


def with_resolved_names(df: DataFrame, taxonomy: DataFrame, column: str | None = None) -> DataFrame:
    """The table with accepted_name, taxonomic_status and match_score beside its species column (found by its name if none is given)."""
    column = column or species_column(df.columns)
    if column is None:
        raise ValueError("no column of species names")
    r = resolve_names(df, column, taxonomy).select(C("original_name").alias("_n"), "accepted_name", "taxonomic_status", "match_score")
    clash = [c for c in ("accepted_name", "taxonomic_status", "match_score") if c in df.columns]
    return df.drop(*clash).join(r, C(column) == C("_n"), "left").drop("_n")
