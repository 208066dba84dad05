"""Queries p2, p5, p6, p7, p8 and p9 with production parameters, and their SQL where DuckDB can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phytoscape.llm.clusters import bisecting_leaves, describe_clusters, similarity_clusters
from phytoscape.llm.leakage import leaked
from phytoscape.llm.naming import map_names
from phytoscape.llm.packing import pack, token_sizes
from phytoscape.llm.similar import nearest_vectors
from phytoscape.llm.splitting import Split, split_documents
from phytoscape.session import read_table

SEQUENCE_TOKENS = 2048


def count_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vec) of the records with individuals: missing and negative counts are 0, re-delivered records count once."""
    df = read_table(spark, d, "species_abundance")
    names = [c for c in df.columns if c not in ("obs_id", "site_id", "observed_on", "ingested_at")]
    rows = df.where("obs_id is not null").select(F.col("obs_id").alias("id"), *names).dropDuplicates(["id"])
    counts = F.array(*[F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("float") for c in names])
    return rows.select("id", counts.alias("vec")).where(F.exists("vec", lambda x: x > 0))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest records of every probe record, as unordered pairs."""
    probes = read_table(spark, d, "probe_records").select(F.col("obs_id").alias("id"))
    near = nearest_vectors(count_vectors(spark, d), probes, 5)
    return near.select(F.least("id", "near").alias("obs_a"), F.greatest("id", "near").alias("obs_b")).distinct()


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest records of every record whose obs_id is divisible by 20, with their sites."""
    v = count_vectors(spark, d)
    near = nearest_vectors(v, v.where("id % 20 = 0").select("id"), 5)
    sites = read_table(spark, d, "species_abundance").groupBy("obs_id").agg(F.max("site_id").alias("site_id"))
    near = near.join(sites.select(F.col("obs_id").alias("id"), F.col("site_id").alias("site_id")), "id", "left")
    return near.join(sites.select(F.col("obs_id").alias("near"), F.col("site_id").alias("near_site_id")), "near", "left").select(F.col("id").alias("obs_id"), "site_id", F.col("near").alias("near_obs_id"), "near_site_id", F.round("similarity", 9).alias("similarity"), "rank")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of three or more records connected by differences of at most 36 individuals."""
    return similarity_clusters(count_vectors(spark, d), 36.0).select("cluster_id", F.col("id").alias("obs_id"))


def p5_described(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical records of each cluster."""
    v = count_vectors(spark, d)
    return describe_clusters(v, similarity_clusters(v, 36.0))


def p5_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The compact leaves of the tree with three records or more: pivot, size, radius and the records nearest to the pivot."""
    return bisecting_leaves(count_vectors(spark, d), 36.0, 3)


def _names(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for table, key, time in (("species_traits", "trait_id", "submitted_at"), ("phylogenetic_distances", "phylo_id", None)):
        df = read_table(spark, d, table)
        order = F.struct(time, "species") if time else F.struct(F.col("species").isNotNull(), "species")
        parts.append(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("record_id")).agg(F.max_by("species", order).alias("species")).select(F.lit(table).alias("table_name"), "record_id", "species"))
    return parts[0].union(parts[1])


def p6_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every typed name that is not an entry itself, with the entry meant or 0."""
    return map_names(_names(spark, d), read_table(spark, d, "species_reference"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_mapped(spark, d).select("table_name", "record_id", "ref_id")


def p6_misses(spark: SparkSession, d: str) -> DataFrame:
    """Names that fit no entry, by how many records have them."""
    return p6_mapped(spark, d).where("ref_id = 0").groupBy("species").agg(F.count("*").alias("records"))


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The training sequence of every article."""
    docs = read_table(spark, d, "documents")
    return pack(token_sizes(docs, "doc_id", "text"), SEQUENCE_TOKENS, rows=docs.count()).withColumnRenamed("key", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Sequences, the share of their room that is used, and articles cut although they would fit into one."""
    p = p7_sequences(spark, d)
    per = p.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("tokens")).agg(F.count_if((F.col("parts") > 1) & (F.col("tokens") <= SEQUENCE_TOKENS)).alias("cut_short_articles"))
    return p.agg(F.countDistinct("sequence_id").alias("sequences"), F.round(F.sum("tokens") / (F.countDistinct("sequence_id") * SEQUENCE_TOKENS), 6).alias("used")).join(per)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of a test item in runs of twelve words or more."""
    return leaked(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "text").select(F.col("key").alias("doc_id"), F.col("item").cast("int").alias("item_id"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of a test item in runs of five words or more which follow each other within ten words."""
    found = leaked(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "text", run=5, slop=10)
    return found.select(F.col("key").alias("doc_id"), F.col("item").cast("int").alias("item_id"), "covered", "words")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Articles of more than 512 tokens in pieces of at most 512, 32 of them shared with the piece before."""
    return split_documents(read_table(spark, d, "documents"), "doc_id", "text", Split(512, 128, 32)).withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_nearest, p5_found, p5_described, p5_leaves, p6_found, p6_mapped, p6_misses, p7_sequences, p7_fill, p8_found, p8_near, p9_pieces)}
_VECTORS = """obs as (select obs_id id, [greatest(coalesce(x, 0), 0)::double for x in list_value(*columns(* exclude (obs_id, site_id, observed_on, ingested_at)))] v from species_abundance where obs_id is not null qualify row_number() over (partition by obs_id order by ingested_at) = 1),
rec as materialized (select id, v, list_sum(v) n from obs where list_sum(v) > 0)"""
SQL: dict[str, str] = {
    "p2_found": f"""
with {_VECTORS}, near as (select p.id a, r.id b, row_number() over (partition by p.id order by round(list_cosine_similarity(p.v, r.v), 12) desc, r.id) k from rec p join probe_records q on q.obs_id = p.id join rec r on r.id <> p.id)
select distinct least(a, b) obs_a, greatest(a, b) obs_b from near where k <= 5""",
    "p5_found": f"""
with recursive {_VECTORS}, links as materialized (select x.id a, y.id b from rec x join rec y on x.id <> y.id and abs(x.n - y.n) <= 36 and abs(x.v[1] - y.v[1]) + abs(x.v[2] - y.v[2]) + abs(x.v[3] - y.v[3]) + abs(x.v[4] - y.v[4]) + abs(x.v[5] - y.v[5]) <= 36
  where list_sum([abs(z[1] - z[2]) for z in list_zip(x.v, y.v)]) <= 36),
reach as (select id, id root from rec union select b, root from reach join links on a = id),
c as (select id, min(root) cluster_id from reach group by 1)
select cluster_id, id obs_id from c where cluster_id in (select cluster_id from c group by 1 having count(*) >= 3)""",
}
