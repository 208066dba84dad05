"""Views of the tables as communities, and rounding that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phytoscape.community import community, from_wide
from phytoscape.session import read_table

DIGITS = 9
META = ("obs_id", "site_id", "observed_on", "ingested_at")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 9 digits (no negative zero), whole numbers as bigint."""
    def col(f):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(F.col(f.name).cast("double"), DIGITS) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name)
    return df.select(*[col(f) for f in df.schema.fields])


def sql(body: str, doubles: str = "", others: str = "") -> str:
    """A statement over the community views with rounded doubles."""
    cols = ", ".join([*[c.strip() for c in others.split(",") if c.strip()], *[f"round({c.strip()}::double, {DIGITS}) + 0.0 as {c.strip()}" for c in doubles.split(",") if c.strip()]])
    return f"{VIEWS}, result as ({body}) select {cols} from result"


VIEWS = """with obs as (select * exclude (obs_id, observed_on, ingested_at) from species_abundance where site_id is not null and obs_id is not null qualify row_number() over (partition by obs_id order by ingested_at) = 1),
raw as (unpivot obs on columns(* exclude (site_id)) into name species value x),
com as materialized (select site_id site, species, sum(x)::double abundance from raw where x > 0 group by 1, 2),
trade as materialized (select c_nationkey site, p_brand species, sum(l_quantity)::double abundance from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey group by 1, 2),
sites as (select site, sum(abundance) n, count(*) s, sum(abundance * abundance) q, max(abundance) m from com group by 1),
p as (select com.*, abundance / n as p, n, s from com join sites using (site)),
grp as (select site, (substr(site, 6)::int % 3)::bigint grp from sites)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "species_abundance").where("obs_id is not null and site_id is not null").dropDuplicates(["obs_id"])


def survey(spark: SparkSession, d: str) -> DataFrame:
    """Sites by species of the survey, re-delivered observations once."""
    df = observations(spark, d)
    return from_wide(df, "site_id", [c for c in df.columns if c not in META])


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Nations by brands, with quantities as abundances."""
    t = lambda n: read_table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return community(j, "c_nationkey", "p_brand", "l_quantity")


def groups(com: DataFrame) -> DataFrame:
    return com.select("site").distinct().select("site", (F.substring("site", 6, 20).cast("int") % 3).cast("bigint").alias("grp"))
