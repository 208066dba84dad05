"""One call for a whole analysis of a wide table: a row per site, a column per species."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.community import from_wide, sites_of, summary
from phytoscape.operators import association, clustering, distances, diversity, nullmodels, ordination, traits
from phytoscape.operators.models import classify
from phytoscape.operators.networks import degrees, network, properties
from phytoscape.operators.transforms import transform


def diversity_table(df: DataFrame, site: str, species: list[str] | None = None, indices: list[str] | None = None) -> DataFrame:
    """The named indices (default shannon, simpson, richness, evenness) of every site; unknown names are warned of and left out."""
    known = diversity.index_columns()
    asked = indices or ["shannon", "simpson", "richness", "evenness"]
    for name in asked:
        if name not in known:
            warnings.warn(f"Unknown diversity index: {name}", stacklevel=2)
    return diversity.indices(from_wide(df, site, species), [n for n in asked if n in known], sites_of(df, site))


def ordination_table(df: DataFrame, site: str, species: list[str] | None = None, method: str = "pca") -> DataFrame:
    """Site scores of pca, ca, dca, pcoa or nmds."""
    com, spark = from_wide(df, site, species), df.sparkSession
    if method == "pca":
        return ordination.pca(com)[0]
    if method == "ca":
        return ordination.ca(com)[0]
    if method == "dca":
        return ordination.dca(com)
    if method == "pcoa":
        return spark.createDataFrame(ordination.pcoa(distances.distances(com)))
    if method == "nmds":
        return spark.createDataFrame(ordination.nmds(distances.distances(com))[0])
    raise ValueError(f"Unknown method: {method}")


def clustering_table(df: DataFrame, site: str, species: list[str] | None = None, clusters: int = 3, method: str = "kmeans") -> DataFrame:
    """(site, cluster) by kmeans of Hellinger values, or hierarchical (average linkage of Bray-Curtis distances)."""
    com = from_wide(df, site, species)
    if method == "kmeans":
        return clustering.kmeans(clustering.as_vectors(transform(com)), clusters)[0]
    if method == "hierarchical":
        return df.sparkSession.createDataFrame(clustering.community_hierarchical(com, "average", clusters)[1])
    raise ValueError(f"Unknown method: {method}")


def elbow_table(df: DataFrame, site: str, species: list[str] | None = None, most: int = 10) -> tuple[DataFrame, dict]:
    """The table of ``elbow_analysis`` up to ``most`` clusters, and the choices of its rules."""
    t, picks = clustering.elbow_analysis(clustering.as_vectors(transform(from_wide(df, site, species))), range(1, most + 1))
    return df.sparkSession.createDataFrame(t), picks


def summary_table(df: DataFrame, site: str, species: list[str] | None = None) -> DataFrame:
    return summary(from_wide(df, site, species))


def nestedness_table(df: DataFrame, site: str, species: list[str] | None = None) -> DataFrame:
    """One row: nodf and its parts, temperature, c_score, togetherness and wine."""
    return association.nestedness(from_wide(df, site, species))


def null_model_table(df: DataFrame, site: str, species: list[str] | None = None, metric: str = "nodf", model: str = "fixed", draws: int = 99) -> DataFrame:
    return nullmodels.null_model_test(from_wide(df, site, species), metric, model, draws)


def functional_table(df: DataFrame, site: str, trait_table: DataFrame, trait_names: list[str], species: list[str] | None = None) -> DataFrame:
    """Functional diversity of every site; ``trait_table`` has a species column."""
    return traits.functional_diversity(from_wide(df, site, species), trait_table, trait_names)


def functional_group_table(trait_table: DataFrame, trait_names: list[str], groups: int | None = None) -> DataFrame:
    return trait_table.sparkSession.createDataFrame(traits.functional_groups(trait_table, trait_names, groups))


def phylogenetic_table(df: DataFrame, site: str, phylo: DataFrame, species: list[str] | None = None) -> DataFrame:
    """(site, mpd, mntd, pd); phylo: (i, j, dist)."""
    com = from_wide(df, site, species)
    return traits.mean_pair_distances(com, phylo).join(traits.tree_length(com, phylo), "site", "full_outer")


def metacommunity_table(df: DataFrame, site: str, species: list[str] | None = None) -> DataFrame:
    return association.metacommunity(from_wide(df, site, species))


def network_tables(df: DataFrame, site: str, species: list[str] | None = None, method: str = "correlation", threshold: float = 0.5) -> dict[str, DataFrame]:
    """edges, nodes (degree and clustering) and properties of the co-occurrence network."""
    net = network(from_wide(df, site, species), method, threshold)
    return {"edges": net.where("edge"), "nodes": degrees(net), "properties": properties(net)}


def model_scores(df: DataFrame, key: str, target: str, features: list[str]) -> DataFrame:
    """(model, accuracy, f1) of the classifiers, best first."""
    out = None
    for m in ("rf", "logistic"):
        s = classify(df, key, target, features, m)[1]
        out = s if out is None else out.union(s)
    return out.orderBy(F.desc("accuracy"), "model")
