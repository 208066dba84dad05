"""Quality of species names and coordinates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: patterns of author citations, in the order they are stripped
AUTHORS = [
    r"\s+L\.(?:\s|$)", r"\s+\([^)]+\)\s*[A-Z][a-z]+", r"\s+[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+\d{4})?$", r"\s+[A-Z][a-z]+\s+\d{4}(?:\s|$)", r"\s+\d{4}(?:\s|$)", r"\s+ex\s+[A-Z][a-z]+", r"\s+sensu\s+[A-Z][a-z]+",
    r"\s+in\s+[A-Z][a-z]+", r"\s+emend\.?\s+[A-Z][a-z]+", r"\s+nom\.\s+nud\.", r"\s+nom\.\s+inval\.", r"\s+et\s+al\.", r"\s+&\s+[A-Z][a-z]+",
]
# fixed values: markers of ranks below species, in the order they are looked for
MARKERS = ["var.", "variety", "subsp.", "ssp.", "subspecies", "f.", "forma", "form", "cv.", "cultivar", "subvar.", "subf."]
# fixed values: placeholders for a missing name
PLACEHOLDERS = {
    r"\bsp\.?(?:\s|$)": "species_placeholder", r"\bcf\.?(?:\s|$)": "confer_placeholder", r"\baff\.?(?:\s|$)": "affinis_placeholder", r"\bindet\.?(?:\s|$)": "indeterminate_placeholder", r"\bunknown(?:\s|$)": "unknown_placeholder",
    r"\bunidentified(?:\s|$)": "unidentified_placeholder", r"\bundet\.?(?:\s|$)": "undetermined_placeholder", r"\bspec\.?(?:\s|$)": "species_placeholder", r"\bspecies(?:\s|$)": "species_placeholder", r"\bgen\.?(?:\s|$)": "genus_placeholder", r"\bgenus(?:\s|$)": "genus_placeholder",
}
# fixed values: signs of hybrids
HYBRIDS = {"×": "multiplication_hybrid", "x ": "letter_x_hybrid", " x ": "letter_x_hybrid", "hybrid": "text_hybrid", "hybr.": "abbreviated_hybrid"}
# fixed values: characters that do not belong into names
INVALID = {r"\d+": "contains_numbers", r"[!@#$%^&*()+={}\[\]|\\:;\"`~<>?/]": "invalid_symbols", r"[ -⁯⸀-⹿\\'\"]": "unusual_unicode", r"\s{2,}": "multiple_spaces", r"^\s+|\s+$": "leading_trailing_spaces"}
# fixed values: categories of errors in the order they are reported, and the advice for each
CATEGORIES = ["incomplete_binomial", "formatting_issues", "author_citations", "hybrid_markers", "infraspecific_issues", "placeholder_names", "invalid_characters", "missing_components", "capitalization_errors", "spacing_errors"]
ADVICE = {
    "genus_only": "Add species epithet after genus name", "species_epithet_only": "Add genus name before species epithet", "format": "Use proper scientific name formatting (Genus species)", "author_citations": "Remove author citations from species name",
    "placeholder_names": "Replace placeholder terms with actual species identification", "invalid_characters": "Remove invalid characters and symbols", "hybrid_markers": "Use proper hybrid notation (× for hybrids)",
    "infraspecific_issues": "Check infraspecific rank formatting (var., subsp., etc.)", "none": "Use standardized scientific nomenclature",
}


def _has(c: Column, pattern: str, flags: str = "U") -> Column:
    return c.rlike(f"(?{flags}){pattern}")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


def _codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k in pairs]), lambda x: x.isNotNull())


def clean_name(c: Column) -> Column:
    """Blanks squeezed, author citations stripped, the part after the first marker of a rank tidied, genus capitalised and epithets in lower case; NULL gives ''."""
    t = F.regexp_replace(_trimmed(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    for p in AUTHORS:
        t = F.regexp_replace(t, f"(?U){p}", "")
    tidy = F.lit(None).cast("string")
    for m in reversed(MARKERS):
        parts = F.split(t, rf"\Q{m}\E", -1)
        tidy = F.when(t.contains(m), F.concat(_trimmed(parts[0]), F.lit(f" {m} "), _trimmed(F.get(parts, F.lit(1))))).otherwise(tidy)
    words = _words(F.coalesce(tidy, t))

    def word(w: Column, i: Column) -> Column:
        after = (i > 2) & F.coalesce(F.get(words, i - 1).isin(*MARKERS), F.lit(False))
        return F.when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))).when((i == 1) | after, F.lower(w)).otherwise(w)

    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, word), " ")).otherwise(F.array_join(words, " "))


def standard_name(c: Column) -> Column:
    """Genus and epithet of names with two words or more, other words as they are; NULL gives ''."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    w = F.split(t, " ")
    return F.when(F.size(w) >= 2, F.concat(F.upper(F.substring(w[0], 1, 1)), F.lower(F.substr(w[0], F.lit(2))), F.lit(" "), F.lower(F.get(w, F.lit(1))))).otherwise(t)


def _any(t: Column, patterns, flags: str = "U") -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | _has(t, p, flags)
    return found


def _contains(t: Column, marks) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | t.contains(m)
    return found


def name_type(c: Column) -> Column:
    """invalid (NULL), placeholder, hybrid, infraspecific, empty, genus_only, epithet_only, binomial, malformed_binomial, binomial_with_author or trinomial_or_complex."""
    t = _trimmed(c)
    w = _words(t)
    n, first, second = F.size(w), F.get(w, F.lit(0)), F.get(w, F.lit(1))
    return (
        F.when(c.isNull(), "invalid").when(_any(F.lower(t), PLACEHOLDERS), "placeholder").when(_contains(t, HYBRIDS), "hybrid").when(_contains(t, MARKERS), "infraspecific").when(n == 0, "empty")
        .when((n == 1) & first.rlike(r"^\p{Lu}"), "genus_only").when(n == 1, "epithet_only").when((n == 2) & first.rlike(r"^\p{Lu}") & second.rlike(r"^\p{Ll}"), "binomial").when(n == 2, "malformed_binomial")
        .when(_any(t, AUTHORS), "binomial_with_author").otherwise("trinomial_or_complex")
    )


def name_errors(c: Column) -> dict[str, Column]:
    """Arrays of error codes per category. NULL has missing_components alone."""
    t = _trimmed(F.coalesce(c, F.lit("")))
    w = _words(t)
    n, first, second = F.size(w), F.get(w, F.lit(0)), F.get(w, F.lit(1))
    upper = lambda x: x.rlike(r"^\p{Lu}")
    two, low = n > 1, F.lower(t)
    mixed = F.exists(w, lambda x: x.rlike(r"^.(?=.*\p{Lu})(?=.*\p{Ll})"))
    ranks = []
    for m in MARKERS:
        parts = F.split(t, rf"\Q{m}\E", -1)
        before, after = _words(parts[0]), _words(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        own, one = t.contains(m), F.size(parts) == 2
        ranks += [(own & ~one, f"malformed_infraspecific_{m.replace('.', '')}"), (own & one & (F.size(before) < 2), "incomplete_binomial_before_infraspecific"), (own & one & (F.size(after) == 0), "missing_infraspecific_epithet"), (own & one & upper(F.coalesce(F.get(after, F.lit(0)), F.lit(""))), "infraspecific_epithet_capitalized")]
    placeholder = _any(low, PLACEHOLDERS)
    every = {
        "incomplete_binomial": _codes((n == 0, "empty_name"), ((n == 1) & upper(first), "genus_only"), ((n == 1) & first.rlike(r"^\p{Ll}"), "species_epithet_only"), ((n == 1) & ~first.rlike(r"^[\p{Lu}\p{Ll}]"), "single_word_unknown_type"), (two & ~upper(first), "genus_not_capitalized"), (two & upper(second), "species_epithet_capitalized")),
        "formatting_issues": F.array().cast("array<string>"),
        "author_citations": _codes((_any(t, AUTHORS, "Uiu"), "author_citation_detected"), (_has(t, r"\b[A-Z][a-z]+\s+\d{4}\b"), "author_with_year"), (_has(t, r"\([^)]+\)"), "parenthetical_author"), (_has(t, r"\b[A-Z]\.$"), "abbreviated_author")),
        "hybrid_markers": _codes(*[(t.contains(m), f"hybrid_marker_{k}") for m, k in HYBRIDS.items()], (t.contains("×") & ~_has(t, r"×\s*[A-Z][a-z]+"), "malformed_hybrid_multiplication"), (low.contains(" x ") & ~_has(t, r"\s+x\s+[A-Z][a-z]+", "Uiu"), "malformed_hybrid_letter_x")),
        "infraspecific_issues": _codes(*ranks),
        "placeholder_names": _codes(*[(_has(low, p), k) for p, k in PLACEHOLDERS.items()], (_has(low, r"\b\d+\b"), "specimen_number_in_name")),
        "invalid_characters": _codes(*[(_has(t, p), k) for p, k in INVALID.items()], (_has(t, r"[^\w\s×.\-]"), "non_standard_characters")),
        "missing_components": _codes((n == 0, "completely_empty"), ((n == 1) & ~placeholder & upper(first), "missing_species_epithet"), ((n == 1) & ~placeholder & ~upper(first), "missing_genus")),
        "capitalization_errors": _codes((two & ~upper(first), "genus_not_capitalized"), (two & (first != F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substr(first, F.lit(2))))), "genus_improper_case"), (two & upper(second), "species_epithet_capitalized"), (two & (second != F.lower(second)), "species_epithet_improper_case"), (mixed, "mixed_case_within_word")),
        "spacing_errors": _codes((_has(t, r"\s{2,}"), "multiple_consecutive_spaces"), (_has(t, r"\s+[.,;:]"), "space_before_punctuation")),
    }
    none = F.array().cast("array<string>")
    null = {"missing_components": F.array(F.lit("empty_or_null_name"))}
    return {k: F.when(c.isNull(), null.get(k, none)).otherwise(every[k]) for k in CATEGORIES}


def with_name_checks(df: DataFrame, column: str, prefix: str = "name_") -> DataFrame:
    """The table with the cleaned name in place (the typed one in ``<column>_original``), genus, specific_epithet, and per name validity, number of errors, severity, type, a flag per category, a summary and suggestions."""
    raw, e = F.col(f"{column}_original"), {k: F.col(f"_e_{k}") for k in CATEGORIES}
    out = df.withColumnRenamed(column, f"{column}_original").select("*", clean_name(raw).alias(column), *[v.alias(f"_e_{k}") for k, v in name_errors(raw).items()])
    total, some = sum((F.size(x) for x in e.values()), F.lit(0)), {k: F.size(x) > 0 for k, x in e.items()}
    level = (
        F.when(total == 0, "none").when(some["missing_components"] | some["incomplete_binomial"] | some["placeholder_names"], "critical").when(some["invalid_characters"], "high")
        .when(some["author_citations"] | some["infraspecific_issues"] | some["hybrid_markers"], "medium").otherwise("low")
    )
    advice = _codes(
        (F.array_contains(e["incomplete_binomial"], "genus_only"), ADVICE["genus_only"]), (F.array_contains(e["incomplete_binomial"], "species_epithet_only"), ADVICE["species_epithet_only"]), (some["formatting_issues"] | some["capitalization_errors"], ADVICE["format"]),
        *[(some[k], ADVICE[k]) for k in ("author_citations", "placeholder_names", "invalid_characters", "hybrid_markers", "infraspecific_issues")],
    )
    advice = F.when(raw.isNull(), F.array(F.lit("Provide a valid species name"))).when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(ADVICE["none"])))
    w = _words(F.col(column))
    out = out.withColumns({
        "genus": F.coalesce(F.get(w, F.lit(0)), F.lit("")), "specific_epithet": F.coalesce(F.get(w, F.lit(1)), F.lit("")), f"{prefix}is_valid": total == 0, f"{prefix}error_count": total, f"{prefix}severity": level, f"{prefix}type": name_type(raw),
        **{f"{prefix}has_{k}": some[k] for k in CATEGORIES}, f"{prefix}errors_summary": F.array_join(_codes2(e), "; "), f"{prefix}suggestions": F.array_join(advice, "; "),
    })
    return out.drop(*[f"_e_{k}" for k in CATEGORIES])


def _codes2(e: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.size(x) > 0, F.concat(F.lit(f"{k}: "), F.size(x).cast("string"))) for k, x in e.items()]), lambda x: x.isNotNull())


def name_report(df: DataFrame, column: str) -> DataFrame:
    """(part, item, names, percentage) over the names that are there: summary, errors by category, severities, types, and the ten commonest combinations of errors."""
    checked = with_name_checks(df.where(F.col(column).isNotNull()).select(F.col(column).alias("name")), "name", "")
    checked = checked.groupBy("is_valid", "severity", "type", "errors_summary", *[f"has_{k}" for k in CATEGORIES]).agg(F.count("*").alias("n"))
    cells = [("summary", F.lit("total_names"), F.lit(True)), ("summary", F.lit("valid_names"), F.col("is_valid")), ("summary", F.lit("invalid_names"), ~F.col("is_valid"))]
    cells += [("errors", F.lit(k), F.col(f"has_{k}")) for k in CATEGORIES] + [("severity", F.col("severity"), F.lit(True)), ("type", F.col("type"), F.lit(True)), ("combination", F.col("errors_summary"), ~F.col("is_valid"))]
    long = checked.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), i.alias("item"), F.when(t, F.col("n")).otherwise(0).alias("n")) for p, i, t in cells])).alias("x")).groupBy("x.part", "x.item").agg(F.sum("x.n").alias("names"))
    long = long.where("names > 0 or part in ('summary', 'errors')").join(F.broadcast(checked.agg(F.sum("n").alias("all"))))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("names"), "item"))  # ten rows of one part are kept
    return long.withColumn("r", rank).where("part <> 'combination' or r <= 10").select("part", "item", "names", F.round(100 * F.col("names") / F.col("all"), 2).alias("percentage"))


def fuzzy_match(names: DataFrame, column: str, reference: DataFrame, entry: str, threshold: float = 80.0) -> DataFrame:
    """(name, match, score) of the different names: the most similar entry (100 · (1 − edits / longer length), ties: smaller entry) if it reaches the threshold, else the name itself with its best score.

    Candidates share a pair of neighbouring letters, which all entries from a
    score of 60 on do; empty and missing names are left out.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    q = names.select(F.col(column).alias("name")).where("name is not null and name <> ''").distinct()
    r = reference.select(F.col(entry).alias("match")).where("match is not null and match <> ''").distinct()
    pairs = q.select("name", F.explode(grams(F.col("name"))).alias("g")).join(r.select("match", F.explode(grams(F.col("match"))).alias("g")), "g").select("name", "match").distinct()
    score = 100.0 * (1 - F.levenshtein("name", "match") / F.greatest(F.length("name"), F.length("match")))
    best = pairs.withColumn("score", score).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("match"))).alias("b"))
    out = q.join(best, "name", "left").withColumn("score", F.coalesce(-F.col("b.s"), F.lit(0.0)))
    return out.select("name", F.when(F.col("score") >= threshold, F.col("b.match")).otherwise(F.col("name")).alias("match"), "score")


def decimals(c: Column) -> Column:
    """Decimal places of a number's shortest form."""
    s = F.regexp_replace(F.format_number(c, 10), ",", "")
    return F.length(F.regexp_replace(F.regexp_extract(s, r"\.(\d*)$", 1), "0+$", ""))


def coordinate_flags(lat: Column, lon: Column) -> dict[str, Column]:
    """Flags of a position: missing, zero, out_of_range, transposed, low_precision; valid if none is set."""
    lat = F.when(~F.isnan(lat), lat)
    lon = F.when(~F.isnan(lon), lon)
    false = lambda c: F.coalesce(c, F.lit(False))
    f = {
        "missing": lat.isNull() | lon.isNull(), "zero": false((lat == 0) & (lon == 0)), "out_of_range": false((F.abs(lat) > 90) | (F.abs(lon) > 180)),
        "transposed": false((F.abs(lat) > 90) & (F.abs(lat) <= 180) & (F.abs(lon) <= 90)), "low_precision": false((decimals(lat) < 2) | (decimals(lon) < 2)),
    }
    f["valid"] = ~(f["missing"] | f["zero"] | f["out_of_range"] | f["transposed"] | f["low_precision"])
    return f


def precision_m(lat: Column, lon: Column) -> Column:
    """Metres that the fewer decimals of both stand for: 111000 for none, a tenth for each, 1 at least; NULL where either is missing."""
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(known, F.greatest(F.lit(111_000.0) / F.pow(F.lit(10.0), F.least(decimals(lat), decimals(lon))), F.lit(1.0)))


def to_decimal(c: Column, limit: float) -> Column:
    """Degrees from decimal, degree-minute-second or degree-minute text; S and W are negative; out of range or without a number NULL."""
    t = F.upper(F.trim(c.cast("string")))
    num = r"(\d+(?:\.\d+)?)"
    dms, dm = rf"{num}\s*[°D]\s*{num}\s*['′M]\s*{num}", rf"{num}\s*[°D]\s*{num}"
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("double")
    size = F.when(t.rlike(dms), part(dms, 1) + part(dms, 2) / 60 + part(dms, 3) / 3600).when(t.rlike(dm), part(dm, 1) + part(dm, 2) / 60).otherwise(F.regexp_extract(t, num, 1).try_cast("double"))
    v = F.when(t.rlike(r"[SW]|^\s*-"), -size).otherwise(size)
    return F.when(F.abs(v) <= limit, v)


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone, with the exceptions of Norway and Svalbard."""
    z = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    north = (lat >= 72) & (lat < 84)
    z = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when(north & (lon >= 0) & (lon < 9), 31).when(north & (lon >= 9) & (lon < 21), 33).when(north & (lon >= 21) & (lon < 33), 35).when(north & (lon >= 33) & (lon < 42), 37).otherwise(z)
    return F.when(lat >= 0, 32600 + z).otherwise(32700 + z)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6_378_137.0
    return r * F.radians(lon), r * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def albers(lon: Column, lat: Column, center_lon: float, center_lat: float) -> tuple[Column, Column]:
    """Metres on the equal-area cone that touches 10 degrees on either side of the centre, on the sphere of the mean radius."""
    import math

    r = 6_371_007.2
    p1, p2, p0 = (math.radians(v) for v in (max(-89.0, center_lat - 10), min(89.0, center_lat + 10), center_lat))
    n = (math.sin(p1) + math.sin(p2)) / 2
    if abs(n) < 1e-9:  # both parallels mirror each other: the cone is a cylinder
        k = math.cos(p1)
        return r * k * F.radians(lon - center_lon), r * F.sin(F.radians(lat)) / k
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    rho0 = math.sqrt(max(0.0, c - 2 * n * math.sin(p0))) / n
    rho = F.sqrt(F.greatest(F.lit(0.0), c - 2 * n * F.sin(F.radians(lat)))) / n
    theta = n * F.radians(lon - center_lon)
    return r * rho * F.sin(theta), r * (rho0 - rho * F.cos(theta))


def standard_dataset(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """A table with columns of standard names, names cleaned, coordinates in decimal degrees, dates parsed, and missing numbers filled with the column's median (marked in ``<column>_filled``)."""
    from pyspark.sql import types as T

    from phytoscape.sources.tables import standard_columns

    out = df.withColumnsRenamed(mapping or {})
    out = out.toDF(*standard_columns(out.columns))
    if "species" in out.columns:
        out = out.withColumn("species", clean_name(F.col("species")))
    for c, limit in (("latitude", 90.0), ("longitude", 180.0)):
        if c in out.columns:
            text = isinstance(out.schema[c].dataType, T.StringType)
            v = F.col(c).cast("double")
            out = out.withColumn(c, to_decimal(F.col(c), limit) if text else F.when(v.between(-limit, limit) & ~F.isnan(v), v))
    if "date" in out.columns and isinstance(out.schema["date"].dataType, T.StringType):
        out = out.withColumn("date", parse_date(F.col("date")))
    numbers = [f.name for f in out.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in ("latitude", "longitude")]
    if not numbers:
        return out
    ok = {c: F.when(~F.isnan(c), F.col(c)) for c in numbers}
    middle = out.agg(*[F.median(ok[c]).alias(f"_m_{c}") for c in numbers])
    out = out.join(F.broadcast(middle))
    return out.select(*[F.coalesce(ok[c], F.col(f"_m_{c}")).alias(c) if c in numbers else F.col(c) for c in out.columns if not c.startswith("_m_")], *[ok[c].isNull().alias(f"{c}_filled") for c in numbers])


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Adds ``outlier``: any of the columns outside its quartiles by threshold times their range, or beyond threshold deviations (population)."""
    ok = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    if method == "iqr":
        s = df.agg(*[F.percentile(ok[c], F.array(F.lit(0.25), F.lit(0.75))).alias(f"_{c}") for c in columns])
        test = [(ok[c] < F.col(f"_{c}")[0] - threshold * (F.col(f"_{c}")[1] - F.col(f"_{c}")[0])) | (ok[c] > F.col(f"_{c}")[1] + threshold * (F.col(f"_{c}")[1] - F.col(f"_{c}")[0])) for c in columns]
    elif method == "zscore":
        s = df.agg(*[F.struct(F.avg(ok[c]).alias("m"), F.stddev_pop(ok[c]).alias("s")).alias(f"_{c}") for c in columns])
        test = [F.abs(ok[c] - F.col(f"_{c}")["m"]) > threshold * F.col(f"_{c}")["s"] for c in columns]
    else:
        raise ValueError(f"Unknown method: {method}")
    flag = F.lit(False)
    for t in test:
        flag = flag | F.coalesce(t, F.lit(False))
    return df.join(F.broadcast(s)).withColumn("outlier", flag).drop(*[f"_{c}" for c in columns])


# fixed values: date formats in the order they are tried
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "yyyyMMdd", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy"]


def parse_date(c: Column) -> Column:
    """The first of the formats that fits; impossible dates give NULL."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c.cast("string")), F.lit(f)) for f in DATE_FORMATS]).cast("date")


def date_flags(d: Column, today: str, oldest: int = 1800) -> dict[str, Column]:
    """missing, future (more than 30 days after ``today``), very_old, default_like (first, 15th, last of a month), month and season."""
    day = F.dayofmonth(d)
    m = F.month(d)
    season = F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(m.isNotNull(), "autumn")
    false = lambda c: F.coalesce(c, F.lit(False))
    return {"missing": d.isNull(), "future": false(d > F.date_add(F.lit(today).cast("date"), 30)), "very_old": false(F.year(d) < oldest), "default_like": false(day.isin(1, 15, 31)), "season": season}


def date_components(d: Column) -> dict[str, Column]:
    return {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "day_of_year": F.dayofyear(d), "week": F.weekofyear(d)}
