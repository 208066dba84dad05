"""Transformations of long communities. Species-wise ones that depend on absences work on the full grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phytoscape.community import dense

C = F.col


def _by(name: str):
    return Window.partitionBy(name)


def _one(c: Column) -> Column:
    """Denominators of 0 count as 1."""
    return F.when(c == 0, 1.0).otherwise(c)


def _hellinger(d, **_):
    return d.withColumn("value", F.sqrt(C("abundance") / F.sum("abundance").over(_by("site"))))


def _chord(d, **_):
    return d.withColumn("value", C("abundance") / F.sqrt(F.sum(C("abundance") * C("abundance")).over(_by("site"))))


def _log_chord(d, **_):
    return _chord(d.withColumn("abundance", F.log1p("abundance")))


def _wisconsin(d, **_):
    d = d.withColumn("v", C("abundance") / F.max("abundance").over(_by("species")))
    return d.withColumn("value", C("v") / F.sum("v").over(_by("site"))).drop("v")


def _chi_square(d, **_):
    t = d.groupBy().agg(F.sum("abundance").alias("t"))
    d = d.withColumn("r", F.sum("abundance").over(_by("site"))).withColumn("c", F.sum("abundance").over(_by("species"))).join(F.broadcast(t))  # one row
    return d.withColumn("value", F.sqrt(C("abundance") * C("t") / (C("r") * C("c")))).drop("r", "c", "t")


def _log(d, base="natural", constant=1.0, **_):
    f = {"natural": F.log, "log10": F.log10, "log2": F.log2}[base]
    return d.withColumn("value", f(F.greatest(C("abundance") + constant, F.lit(1e-10))))


def _sqrt(d, **_):
    return d.withColumn("value", F.sqrt("abundance"))


def _arcsine(d, **_):
    return d.withColumn("value", F.asin(F.sqrt(F.least(C("abundance"), F.lit(1.0)))))


def _standardize(d, variant="zscore", **_):
    d = dense(d)
    if variant == "robust":
        med = d.groupBy("species").agg(F.median("abundance").alias("m"))
        d = d.join(med, "species")
        mad = d.groupBy("species").agg(F.median(F.abs(C("abundance") - C("m"))).alias("s"))
        return d.join(mad, "species").withColumn("value", (C("abundance") - C("m")) / _one(C("s"))).drop("m", "s")
    return d.withColumn("value", (C("abundance") - F.avg("abundance").over(_by("species"))) / _one(F.coalesce(F.stddev_samp("abundance").over(_by("species")), F.lit(0.0))))


def _normalize(d, variant="minmax", **_):
    if variant == "unit_vector":
        return _chord(d)
    d = dense(d)
    low, high = F.min("abundance").over(_by("species")), F.max("abundance").over(_by("species"))
    return d.withColumn("value", (C("abundance") - low) / _one(high - low))


METHODS = {"hellinger": _hellinger, "chord": _chord, "log_chord": _log_chord, "wisconsin": _wisconsin, "chi_square": _chi_square, "log": _log, "sqrt": _sqrt, "arcsine": _arcsine, "standardize": _standardize, "normalize": _normalize}


def transform(com: DataFrame, method: str = "hellinger", **options) -> DataFrame:
    """(site, species, value). Absences are left out where they map to the method's value of 0; standardize and minmax give the full grid."""
    if method not in METHODS:
        raise ValueError(f"Unknown transformation: {method}")
    return METHODS[method](com, **options).select("site", "species", "value")


def inverse(value: Column, method: str, base: str = "natural", constant: float = 1.0) -> Column:
    """Inverse of log, sqrt and arcsine; other methods give the value back."""
    if method == "log":
        return {"natural": F.exp(value), "log10": F.pow(F.lit(10.0), value), "log2": F.pow(F.lit(2.0), value)}[base] - constant
    if method == "sqrt":
        return value * value
    return F.pow(F.sin(value), 2) if method == "arcsine" else value
