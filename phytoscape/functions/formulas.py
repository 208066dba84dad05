"""Closed-form functions as Column expressions: vegetation indices, growth, phenology and response curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 / 0 = 0 and a / 0 infinite."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a == 0, F.lit(0.0)).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))


def ndvi(red: Column, nir: Column) -> Column:
    return _ratio(nir - red, nir + red)


def evi(red: Column, nir: Column, blue: Column, g=2.5, c1=6.0, c2=7.5, l=1.0) -> Column:
    return _ratio(g * (nir - red), nir + c1 * red - c2 * blue + l)


def savi(red: Column, nir: Column, l=0.5) -> Column:
    return _ratio((nir - red) * (1 + l), nir + red + l)


def msavi(red: Column, nir: Column) -> Column:
    return (2 * nir + 1 - F.sqrt((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red))) / 2


def ndwi(green: Column, nir: Column) -> Column:
    return _ratio(green - nir, green + nir)


def nbr(nir: Column, swir: Column) -> Column:
    return _ratio(nir - swir, nir + swir)


# fixed values: band names of the two satellites
BANDS = {
    "landsat": {"blue": "B2", "green": "B3", "red": "B4", "nir": "B5", "swir": "B7"},
    "sentinel": {"blue": "B2", "green": "B3", "red": "B4", "nir": "B8", "swir": "B12"},
}


def band_index(name: str, platform: str = "landsat") -> Column:
    """An index over a table whose columns are named like the platform's bands."""
    b = {k: F.col(v) for k, v in BANDS[platform].items()}
    make = {"NDVI": lambda: ndvi(b["red"], b["nir"]), "EVI": lambda: evi(b["red"], b["nir"], b["blue"]), "SAVI": lambda: savi(b["red"], b["nir"]), "MSAVI": lambda: msavi(b["red"], b["nir"]), "NDWI": lambda: ndwi(b["green"], b["nir"]), "NBR": lambda: nbr(b["nir"], b["swir"])}
    if name.upper() not in make:
        raise ValueError(f"Unknown index: {name}")
    return make[name.upper()]()


def modis_scaled(value: Column) -> Column:
    return value * 0.0001


def sigmoid(x, a, b, c, d):
    return F.lit(a) / (1 + F.exp(-b * (x - c))) + d


def double_sigmoid(x, a1, b1, c1, a2, b2, c2, d):
    return a1 / (1 + F.exp(-b1 * (x - c1))) - a2 / (1 + F.exp(-b2 * (x - c2))) + d


def gaussian(x, a, mu, sigma, d):
    return a * F.exp(-((x - mu) * (x - mu)) / (2 * sigma * sigma)) + d


def beta_curve(x, a, alpha, beta, t1, t2):
    z = (x - t1) / (t2 - t1)
    return F.when((z > 0) & (z < 1), a * F.pow(z, alpha - 1.0) * F.pow(1 - z, beta - 1.0)).otherwise(0.0)


def weibull(x, a, k, scale, d):
    z = F.greatest(x, F.lit(0.0)) / scale
    return a * (k / scale) * F.pow(z, k - 1.0) * F.exp(-F.pow(z, F.lit(float(k)))) + d


def logistic_growth(t, k, r, t0):
    return F.lit(k) / (1 + F.exp(-r * (t - t0)))


def gompertz_growth(t, k, r, t0):
    return k * F.exp(-F.exp(-r * (t - t0)))


def von_bertalanffy_growth(t, top, k, t0):
    return top * F.pow(1 - F.exp(-k * (t - t0)), F.lit(3.0))


def exponential_growth(t, n0, r):
    return n0 * F.exp(r * t)


def power_growth(t, a, b):
    return a * F.pow(t, F.lit(float(b)))


def gaussian_response(x, amplitude, optimum, tolerance, baseline):
    return baseline + amplitude * F.exp(-0.5 * F.pow((x - optimum) / tolerance, F.lit(2.0)))


def threshold_response(x, amplitude, threshold, steepness, baseline):
    return baseline + F.lit(amplitude) / (1 + F.exp(-steepness * (x - threshold)))


def unimodal_response(x, amplitude, optimum, tolerance, baseline):
    return F.greatest(F.lit(float(baseline)), baseline + amplitude * (1 - F.pow((x - optimum) / tolerance, F.lit(2.0))))
