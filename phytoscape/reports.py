"""The data behind plots, and reports and dashboards as text: nothing is drawn by a library, bars and points are plain SVG."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Rows of a table or points of a figure that a page shows; what it leaves out is stated on the page.
PAGE_ROWS = 2_000


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, records): equal bins from the least to the greatest value; missing values are left out, equal values share bin 0."""
    v = df.select(C(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    s = v.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    w = (C("b") - C("a")) / bins
    b = v.join(F.broadcast(s)).withColumn("bin", F.when(C("b") > C("a"), F.least(F.floor((C("v") - C("a")) / w), F.lit(bins - 1))).otherwise(0))
    return b.groupBy("bin").agg((F.first("a") + C("bin") * F.first((C("b") - C("a")) / bins)).alias("low"), (F.first("a") + (C("bin") + 1) * F.first((C("b") - C("a")) / bins)).alias("high"), F.count("*").alias("records"))


def mean_curve(curves: DataFrame, x: str, y: str) -> DataFrame:
    """(x, mean, low, high, curves): mean of all curves at each x with 1.96 standard errors on either side."""
    s = curves.groupBy(C(x).alias("x")).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.count("*").alias("curves"))
    e = F.coalesce(1.96 * C("sd") / F.sqrt("curves"), F.lit(0.0))
    return s.select("x", "mean", (C("mean") - e).alias("low"), (C("mean") + e).alias("high"), "curves")


def relative_ranks(com: DataFrame) -> DataFrame:
    """(site, species, rank, share): rank-abundance curves (ties: species name)."""
    by = Window.partitionBy("site")
    return com.select("site", "species", F.row_number().over(by.orderBy(F.desc("abundance"), "species")).alias("rank"), (C("abundance") / F.sum("abundance").over(by)).alias("share"))


def biplot(scores: DataFrame, vectors: pd.DataFrame, axes: tuple[str, str], share: float = 0.8) -> pd.DataFrame:
    """(name, x, y): arrows of an ordination scaled so that the longest reaches ``share`` of the sites' range. vectors: name and both axes."""
    r = scores.agg(*[F.max(F.abs(a)).alias(a) for a in axes]).first()
    top = [max(vectors[a].abs().max(), 1e-300) for a in axes]
    k = share * min((r[a] or 0.0) / t for a, t in zip(axes, top))
    return pd.DataFrame({"name": vectors.iloc[:, 0], "x": vectors[axes[0]] * k, "y": vectors[axes[1]] * k})


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of numeric columns in one scan, pairwise complete; no spread gives NULL."""
    ok = {c: F.when(~F.isnan(C(c).cast("double")), C(c).cast("double")) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    r = df.agg(*[F.corr(ok[a], ok[b]).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return r.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, count, mean, std, min, q1, median, q3, max) of numeric columns in one scan, NaN as missing."""
    def of(c: str):
        v = F.when(~F.isnan(C(c).cast("double")), C(c).cast("double"))
        q = F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
        return F.struct(F.lit(c).alias("column_name"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(v).alias("max"))
    return df.agg(F.array(*map(of, columns)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _bars(t: pd.DataFrame, label: str, value: str) -> str:
    top = max(float(t[value].max()), 1e-300) if len(t) else 1.0
    rows = [f'<text x="0" y="{18 * i + 13}">{escape(str(a))}</text><rect x="180" y="{18 * i + 2}" width="{400 * max(0.0, float(v)) / top:.1f}" height="14"/><text x="590" y="{18 * i + 13}">{float(v):.4g}</text>' for i, (a, v) in enumerate(zip(t[label], t[value]))]
    return f'<svg width="680" height="{18 * len(t) + 6}" role="img">{"".join(rows)}</svg>'


def _points(t: pd.DataFrame, x: str, y: str) -> str:
    a, b = t[x].astype(float), t[y].astype(float)
    px, py = 20 + 440 * (a - a.min()) / ((a.max() - a.min()) or 1.0), 300 - 280 * (b - b.min()) / ((b.max() - b.min()) or 1.0)
    return f'<svg width="480" height="320" role="img">{"".join(f"<circle cx={chr(34)}{i:.1f}{chr(34)} cy={chr(34)}{j:.1f}{chr(34)} r={chr(34)}3{chr(34)}/>" for i, j in zip(px, py))}<text x="220" y="316">{escape(x)}</text><text x="0" y="12">{escape(y)}</text></svg>'


def _page(df: DataFrame) -> tuple[pd.DataFrame, str]:
    t = df.limit(PAGE_ROWS + 1).toPandas()
    return t.head(PAGE_ROWS), f"The first {PAGE_ROWS} rows." if len(t) > PAGE_ROWS else f"{len(t)} rows."


def report(results: dict[str, DataFrame], title: str = "Vegetation analysis", output: str = "html") -> str:
    """A report of named tables (at most ``PAGE_ROWS`` rows of each, which it states) as html, markdown or text."""
    parts = [(name, *_page(df)) for name, df in results.items()]
    if output == "html":
        body = "".join(f"<h2>{escape(n)}</h2><p>{m}</p>{t.to_html(index=False, na_rep='')}" for n, t, m in parts)
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>"
    if output == "markdown":
        cell = lambda v: "" if pd.isna(v) else str(v).replace("|", "\\|")
        table = lambda t: "\n".join(["| " + " | ".join(map(str, t.columns)) + " |", "|" + " --- |" * len(t.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in t.itertuples(index=False)]])
        return f"# {title}\n\n" + "\n\n".join(f"## {n}\n\n{m}\n\n{table(t)}" for n, t, m in parts) + "\n"
    if output == "text":
        return f"{title}\n\n" + "\n\n".join(f"{n}\n{m}\n{t.to_string(index=False)}" for n, t, m in parts) + "\n"
    raise ValueError(f"Unsupported format: {output}")


def dashboard(figures: dict[str, tuple[DataFrame, str, str, str]], title: str = "Dashboard") -> str:
    """A page of figures, each (table, "bars" or "points", label or x column, value or y column)."""
    body = []
    for name, (df, kind, a, b) in figures.items():
        if kind not in ("bars", "points"):
            raise ValueError(f"Unknown figure: {kind}")
        t, m = _page(df.select(a, b).where(C(a).isNotNull() & C(b).isNotNull()))
        body.append(f"<section><h2>{escape(name)}</h2><p>{m}</p>{(_bars if kind == 'bars' else _points)(t, a, b)}</section>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{''.join(body)}</body></html>"


def save(spark, page: str, folder: str) -> str:
    """Writes a page as one text part below ``folder``, in any store Spark writes to."""
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(folder)
    return folder
