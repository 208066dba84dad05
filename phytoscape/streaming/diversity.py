"""Diversity of event streams per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.operators.diversity import indices


def windowed_counts(stream: DataFrame, time: str, site: str, species: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window, site and species; rows later than the watermark are dropped. For streams and tables alike."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(site).alias("site"), F.col(species).alias("species")).agg(F.count("*").alias("abundance"))


def window_indices(counts: DataFrame, names: list[str]) -> DataFrame:
    """(start, site, indices) of windowed counts; use it on a table or inside foreachBatch."""
    com = counts.select(F.struct(F.col("w.start").alias("start"), "site").alias("site"), "species", F.col("abundance").cast("double").alias("abundance"))
    out = indices(com, names)
    return out.select(F.col("site.start").alias("start"), F.col("site.site").alias("site"), *names)


def write_indices(stream: DataFrame, names: list[str], path: str, checkpoint: str, **options):
    """Starts a query that appends the indices of closed windows to Parquet; each batch is written under its own number, so a repeated batch replaces itself."""
    def save(batch: DataFrame, number: int) -> None:
        window_indices(batch, names).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return windowed_counts(stream, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
