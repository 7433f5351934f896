"""Named feature sets, their combinations, and the list of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The feature names of each set.
CSF = ["Amyloid_Status"]
DEMOGRAPHIC = ["Age", "Education_level", "Gender", "Marital_status", "APOE4"]
CLINICAL = [
    "MMSE_bl", "MMSE", "MOCA_bl", "MOCA", "CDRSB_bl", "CDRSB",
    "ADAS11_bl", "ADAS11", "ADAS13_bl", "ADAS13", "ADASQ4_bl", "ADASQ4",
]
MICROSTRUCTURAL = ["mean_MD", "mean_FA", "TBSS_WMmaskFA", "LH_meanMD", "RH_meanMD"]
MORPHOMETRIC = [
    "BPV", "Left-Thalamus", "Left-Caudate", "Left-Putamen", "Left-Pallidum", "Left-Hippocampus",
    "Left-Amygdala", "Left-Accumbens-area", "sum_Hippocampus", "Right-Thalamus", "Right-Caudate",
    "Right-Putamen", "Right-Pallidum", "Right-Hippocampus", "Right-Amygdala", "Right-Accumbens-area", "CSF",
    "mean_inferiortemporal_thickness", "mean_middletemporal_thickness", "mean_temporalpole_thickness",
    "mean_superiorfrontal_thickness", "mean_superiorparietal_thickness", "mean_supramarginal_thickness",
    "mean_precuneus_thickness", "mean_superiortemporal_thickness", "mean_inferiorparietal_thickness",
    "mean_rostralmiddlefrontal_thickness",
]
GRAPH_GLOBAL = [
    "density", "modularity", "assortativity", "transitivity", "global_efficiency", "characteristic_path_length",
    "diameter", "degree_distribution_entropy", "resilience", "spectral_radius", "small_worldness",
    "avg_clustering_coefficient", "avg_degree", "avg_betweenness_centrality", "avg_edge_betweenness_centrality",
    "avg_eigenvector_centrality", "avg_closeness_centrality", "avg_node_strength", "avg_pagerank",
]
NODE_MEASURES = [
    "degree_centrality", "clustering_coefficient", "betweenness_centrality", "eigenvector_centrality",
    "closeness_centrality", "node_strength", "pagerank",
]
N_NODES = 82

# Columns dropped before modelling.
UNUSED = [
    "RID", "COLPROT", "ORIGPROT", "SITE", "Final_Status", "DX_bl", "Transition_DXbl_DX",
    "Transition_DXbl_Group", "EXAMDATE_bl", "EXAMDATE", "AGE_bl",
]
UNUSED_CLASSIFICATION = [*UNUSED, "VISCODE"]

# Sets of each combination, in column order.
COMBINATIONS = {
    "1_MO": ["csf", "morphometric"],
    "2_MS": ["csf", "microstructural"],
    "3_GT": ["csf", "graph_global", "graph_local"],
    "4_MO_MS": ["csf", "microstructural", "morphometric"],
    "5_MO_MS_GT": ["csf", "microstructural", "morphometric", "graph_global", "graph_local"],
    "6_DG_MO_MS_GT": ["csf", "demographic", "microstructural", "morphometric", "graph_global", "graph_local"],
}
BINARY = ["CN_vs_AD", "CN_vs_MCI", "MCI_vs_AD"]
THREE_LEVEL = ["CN_MCI_AD"]
SUBSETS = ["without_nan"]


def feature_sets() -> dict[str, list[str]]:
    local = [f"{m}_node_{i}" for m in NODE_MEASURES for i in range(N_NODES)]
    return {
        "csf": CSF, "demographic": DEMOGRAPHIC, "clinical": CLINICAL, "microstructural": MICROSTRUCTURAL,
        "morphometric": MORPHOMETRIC, "graph_global": GRAPH_GLOBAL, "graph_local": local,
    }


def combination(name: str) -> list[str]:
    """Feature columns of one combination."""
    sets = feature_sets()
    return [f for s in COMBINATIONS[name] for f in sets[s]]


def feature_catalog(spark: SparkSession, combos: dict[str, list[str]] | None = None) -> DataFrame:
    """(combo, ord, feature) of every combination."""
    combos = combos or {c: combination(c) for c in COMBINATIONS}
    rows = [(c, i, f) for c, fs in combos.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "combo string, ord int, feature string")


def catalog_coverage(df: DataFrame, combos: dict[str, list[str]]) -> DataFrame:
    """Catalog rows with the number of non-NULL values the table has for each feature."""
    feats = sorted({f for fs in combos.values() for f in fs})
    counts = df.agg(F.create_map(*[x for f in feats for x in (F.lit(f), F.count(F.col(f"`{f}`")))]).alias("m")).scalar()
    return feature_catalog(df.sparkSession, combos).withColumn("n_values", counts[F.col("feature")])


def task_plan(combos: DataFrame, comparisons: Column) -> DataFrame:
    """Every combination with every name of the array ``comparisons``, and the partition value written to."""
    return combos.select("combo", F.explode(comparisons).alias("comparison")).withColumn(
        "partition_value", F.regexp_replace("comparison", "vs_", "")
    )


def standard_tasks(spark: SparkSession, track: str = "classification") -> DataFrame:
    """The 24 classification or the 6 regression tasks."""
    combos = spark.createDataFrame([(c,) for c in COMBINATIONS], "combo string")
    names = [*BINARY, *THREE_LEVEL] if track == "classification" else SUBSETS
    return task_plan(combos, F.array(*[F.lit(n) for n in names]))
