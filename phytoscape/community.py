"""Communities in long form: (site, species, abundance), one row per pair, absences left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def community(df: DataFrame, site: str, species: str, abundance: str) -> DataFrame:
    """Sums repeated pairs; missing, NaN and non-positive abundances are absences, rows without site or species are left out."""
    x = F.col(abundance).cast("double")
    return (
        df.select(F.col(site).alias("site"), F.col(species).alias("species"), x.alias("abundance"))
        .where(F.col("site").isNotNull() & F.col("species").isNotNull() & (F.col("abundance") > 0) & ~F.isnan("abundance"))
        .groupBy("site", "species").agg(F.sum("abundance").alias("abundance"))
    )


def numeric_columns(df: DataFrame, leave: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in leave]


def from_wide(df: DataFrame, site: str, species: list[str] | None = None) -> DataFrame:
    """Long form of a wide table; without ``species`` all numeric columns but the site count as species."""
    names = species or numeric_columns(df, (site,))
    long = df.select(F.col(site).alias("_site"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names]).unpivot("_site", names, "_species", "_x")
    return community(long, "_site", "_species", "_x")


def sites_of(df: DataFrame, site: str) -> DataFrame:
    """All sites, those without individuals too."""
    return df.select(F.col(site).alias("site")).where("site is not null").distinct()


def dense(com: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """The full site by species grid with zeros; needed wherever absences count. Grows as sites times species."""
    grid = (sites if sites is not None else com.select("site").distinct()).join(com.select("species").distinct())
    return grid.join(com, ["site", "species"], "left").withColumn("abundance", F.coalesce("abundance", F.lit(0.0)))


def filter_rare(com: DataFrame, least_sites: int = 3, least_total: float = 0.0) -> DataFrame:
    """Keeps species that occur in ``least_sites`` sites or more and sum to ``least_total`` or more."""
    kept = com.groupBy("species").agg(F.count("*").alias("n"), F.sum("abundance").alias("t")).where((F.col("n") >= least_sites) & (F.col("t") >= least_total))
    return com.join(kept.select("species"), "species", "left_semi")


def summary(com: DataFrame) -> DataFrame:
    """One row: sites, species, total abundance, mean species and mean abundance per site."""
    per = com.groupBy("site").agg(F.count("*").alias("s"), F.sum("abundance").alias("n"))
    return per.agg(F.count("*").alias("n_sites"), F.avg("s").alias("mean_species"), F.sum("n").alias("total_abundance"), F.avg("n").alias("mean_abundance")).join(com.agg(F.countDistinct("species").alias("n_species")))


def rank_abundance(com: DataFrame) -> DataFrame:
    """Rank of each species in its site, most abundant first (ties: species name)."""
    return com.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("abundance"), "species")))
