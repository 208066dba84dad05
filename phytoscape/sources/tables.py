"""Readers and writers: delimited text with a guessed separator, agency layouts, Darwin Core archives, named exports."""

from __future__ import annotations

import re
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phytoscape.operators.names import parse_date


class NotSupportedError(NotImplementedError):
    """The format needs a library or a network that is not there."""


# fixed values: column names that stand for one thing
ALIASES = {
    "species": ("species_name", "taxon", "scientific_name"), "abundance": ("cover", "coverage", "abundance_value", "percent_cover"), "plot_id": ("plot", "site", "site_id", "releve", "quadrat"),
    "latitude": ("lat", "y", "coord_y"), "longitude": ("lon", "lng", "long", "x", "coord_x"), "date": ("sampling_date", "survey_date", "collection_date"),
}
# fixed values: Darwin Core terms of common columns
DARWIN_CORE = {
    "species": "scientificName", "species_name": "scientificName", "scientific_name": "scientificName", "latitude": "decimalLatitude", "longitude": "decimalLongitude", "lat": "decimalLatitude", "lon": "decimalLongitude", "lng": "decimalLongitude",
    "date": "eventDate", "sampling_date": "eventDate", "collection_date": "eventDate", "collector": "recordedBy", "recorded_by": "recordedBy", "plot_id": "locationID", "site_id": "locationID",
    "elevation": "minimumElevationInMeters", "altitude": "minimumElevationInMeters", "abundance": "individualCount", "count": "individualCount", "cover": "organismQuantity", "coverage": "organismQuantity",
}
# fixed values: terms a record must have, and types of the terms that are no text
REQUIRED = ("basisOfRecord", "occurrenceID", "catalogNumber", "scientificName", "kingdom", "decimalLatitude", "decimalLongitude")
TERM_TYPES = {
    "int": ("individualCount", "startDayOfYear", "endDayOfYear", "year", "month", "day"), "timestamp": ("modified", "eventDate", "georeferencedDate", "dateIdentified"),
    "double": ("minimumElevationInMeters", "maximumElevationInMeters", "minimumDepthInMeters", "maximumDepthInMeters", "minimumDistanceAboveSurfaceInMeters", "maximumDistanceAboveSurfaceInMeters", "decimalLatitude", "decimalLongitude", "coordinateUncertaintyInMeters", "coordinatePrecision", "pointRadiusSpatialFit", "footprintSpatialFit"),
}


def standard_columns(names: list[str]) -> list[str]:
    """Names in lower case with underscores for blanks; the first variant of an alias takes the standard name if that is free."""
    out = [re.sub(r"[^a-z0-9_]", "", n.strip().lower().replace(" ", "_")) for n in names]
    for target, variants in ALIASES.items():
        if target not in out:
            hit = next((v for v in variants if v in out), None)
            if hit:
                out[out.index(hit)] = target
    return out


def guess_separator(spark: SparkSession, path: str) -> str:
    line = spark.read.text(path).limit(1).collect()
    first = line[0][0] if line else ""
    return next((s for s in ("\t", ";") if s in first), ",")


def read_survey(spark: SparkSession, path: str, schema: str | None = None, standardise: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """CSV, tab-separated or text file with a header, or Parquet, ORC and JSON, by suffix."""
    kind = Path(path.rstrip("/")).suffix.lower()
    if kind in (".parquet", ".orc", ".json"):
        df = getattr(spark.read, kind[1:])(path)
    elif kind in (".csv", ".txt", ".tab", ".tsv"):
        if encoding.upper() == "UTF-8" and not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
            encoding = "ISO-8859-1"  # bytes that are no UTF-8
        r = spark.read.option("header", True).option("sep", "\t" if kind in (".tab", ".tsv") else guess_separator(spark, path)).option("encoding", encoding)
        df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    elif kind in (".xlsx", ".xls"):
        raise NotSupportedError("spreadsheets need a reader that is not installed; export them as CSV")
    else:
        raise ValueError(f"Unsupported format: {kind or path}")
    return df.toDF(*standard_columns(df.columns)) if standardise else df


def read_turboveg(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """species_list, releves and header_data of an export folder; a missing file has no entry.

    Files are looked for through the file system of the folder, so it may lie in any store Spark reads.
    """
    # fixed values: names of the files of an export, in the order they are looked for
    files = {"species_list": ("species.txt", "taxa.txt", "florlist.txt"), "releves": ("releves.txt", "vegetation.txt", "plots.txt"), "header_data": ("header.txt", "sites.txt", "metadata.txt")}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for name, choices in files.items():
        for c in choices:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{c}")
            if path.getFileSystem(conf).exists(path):
                found[name] = read_survey(spark, path.toString())
                break
    return found


# fixed values: columns of the agencies' tables and what they are called here
AGENCIES = {
    "usfs": {"plot": "plot_id", "spcd": "species_code", "lat": "latitude", "lon": "longitude"}, "nps": {"plot_code": "plot_id", "taxa_code": "species_code", "pct_cover": "abundance"},
    "epa": {"site_id": "plot_id", "taxon": "species", "percent_cover": "abundance"}, "fia": {"plt_cn": "plot_id", "spcd": "species_code", "dia": "diameter", "ht": "height"},
}


def agency_table(df: DataFrame, agency: str) -> DataFrame:
    if agency.lower() not in AGENCIES:
        raise ValueError(f"Unknown agency: {agency}")
    df = df.toDF(*standard_columns(df.columns))
    return df.withColumnsRenamed({k: v for k, v in AGENCIES[agency.lower()].items() if k in df.columns and v not in df.columns})


def _typed(df: DataFrame, column: str) -> Column:
    """The column in the type of its term; what cannot be read becomes NULL, missing texts are empty."""
    kind = next((k for k, names in TERM_TYPES.items() if column in names), None)
    c = F.col(f"`{column}`")
    if kind == "timestamp":
        return c.cast("timestamp") if dict(df.dtypes)[column] in ("date", "timestamp") else parse_date(c).cast("timestamp")
    if kind == "int":
        return c.cast("string").try_cast("double").cast("int")
    return c.cast("string").try_cast(kind) if kind else c


def to_darwin_core(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Renames to Darwin Core terms (the first column of each term), types the terms, and adds occurrenceID, catalogNumber (hashes of the row), basisOfRecord, kingdom, modified, language and license where missing."""
    names: dict[str, str] = {}
    for c in df.columns:
        term = (mapping or {}).get(c) if mapping else DARWIN_CORE.get(c.lower())
        if term and term not in df.columns and term not in names.values():
            names[c] = term
    out = df.withColumnsRenamed(names)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns]), {"ignoreNullFields": "false"})
    extra = {"occurrenceID": F.sha2(row, 256), "catalogNumber": F.xxhash64(row).cast("string"), "basisOfRecord": F.lit("HumanObservation"), **({"kingdom": F.lit("Plantae")} if "scientificName" in out.columns else {}), "modified": F.current_timestamp(), "language": F.lit("en"), "license": F.lit("CC0")}
    out = out.withColumns({k: v for k, v in extra.items() if k not in out.columns})
    return out.select(*[_typed(out, c).alias(c) for c in out.columns])


def darwin_core_report(df: DataFrame) -> DataFrame:
    """(level, term, issue, records): required terms that are missing, values that cannot be read in the type of their term, coordinates out of range or missing, dates that are none or in the future."""
    aggs, labels = [], []
    for c in df.columns:
        kind = next((k for k, names in TERM_TYPES.items() if c in names), None)
        text = F.trim(F.col(f"`{c}`").cast("string"))
        given = text.isNotNull() & (text != "")
        if kind in ("int", "double"):
            bad = given & (text.try_cast("double").isNull() | ((text.try_cast("double") % 1 != 0) if kind == "int" else F.lit(False)))
            labels.append(("error", c, f"not of type {kind}")), aggs.append(F.count_if(bad))
        elif kind == "timestamp":
            at = _typed(df, c)
            labels.append(("warning", c, "not a date")), aggs.append(F.count_if(given & at.isNull()))
            labels.append(("warning", c, "in the future")), aggs.append(F.count_if(at > F.current_timestamp()))
    if {"decimalLatitude", "decimalLongitude"} <= set(df.columns):
        y, x = (F.col(c).cast("string").try_cast("double") for c in ("decimalLatitude", "decimalLongitude"))
        labels.append(("warning", "decimalLatitude, decimalLongitude", "invalid pair")), aggs.append(F.count_if(~F.coalesce(y.between(-90, 90) & x.between(-180, 180) & ~F.isnan(y) & ~F.isnan(x), F.lit(False))))
    n = F.count("*")
    rows = [F.struct(F.lit("error").alias("level"), F.lit(t).alias("term"), F.lit("required term is missing").alias("issue"), n.alias("records")) for t in REQUIRED if t not in df.columns]
    rows += [F.struct(F.lit(a).alias("level"), F.lit(t).alias("term"), F.lit(i).alias("issue"), g.alias("records")) for (a, t, i), g in zip(labels, aggs)]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("records > 0")


def write_darwin_core(df: DataFrame, folder: str) -> None:
    """occurrence CSV parts and meta.xml with the index of every term."""
    out = to_darwin_core(df)
    out.write.mode("overwrite").option("header", True).csv(f"{folder}/occurrence")
    fields = "\n".join(f'    <field index="{i}" term="http://rs.tdwg.org/dwc/terms/{escape(c)}"/>' for i, c in enumerate(out.columns))
    text = f'<archive xmlns="http://rs.tdwg.org/dwc/text/">\n  <core encoding="UTF-8" fieldsTerminatedBy="," ignoreHeaderLines="1" rowType="http://rs.tdwg.org/dwc/terms/Occurrence">\n{fields}\n  </core>\n</archive>\n'
    out.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def export(results: dict[str, DataFrame], path: str, kind: str = "csv") -> list[str]:
    """Writes each table below ``<path>_<name>`` as csv, json, parquet or orc."""
    if kind not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"Unsupported format: {kind}")
    for name, df in results.items():
        w = df.write.mode("overwrite")
        (w.option("header", True) if kind == "csv" else w).format(kind).save(f"{path}_{name}")
    return [f"{path}_{n}" for n in results]
