"""Horizontal composites: means, deviations and confidence widths over groups of feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowstats import add_row_stats, columns_matching, row_ci, row_mean, row_std

# The column groups and the names of what is derived from them.
MODELS = "(sentence_sim|glove|w2v|fast_text)(.*)"
ACROSS_MODELS = {
    # source suffix: (mean, deviation, ci)
    "all_cosine_sentences_similarity_mean": ("all_cosine_sentences_similarity_mean", "all_cosine_sentences_similarity_mean_std", "all_cosine_ci"),
    "all_cosine_sentences_similarity_std": ("all_cosine_sentences_similarity_std", "all_cosine_sentences_similarity_std_std", "all_cosine_ci_std"),
    "consecutive_cosine_sentences_similarity_mean": ("consecutive_cosine_sentences_similarity_mean", "consecutive_cosine_sentences_similarity_mean_std", "consecutive_cosine_ci"),
    "consecutive_cosine_sentences_similarity_std": ("consecutive_cosine_sentences_similarity_std", "consecutive_cosine_sentences_similarity_std_std", "consecutive_cosine_ci_std"),
    "consecutive_wmd_sentences_similarity_mean": ("consecutive_wmd_sentences_similarity_mean", "consecutive_wmd_sentences_similarity_mean_std", "consecutive_wmd_ci"),
    "all_wmd_sentences_similarity_mean": ("all_wmd_sentences_similarity_mean", "all_wmd_sentences_similarity_mean_std", "all_wmd_ci"),
    "all_wmd_sentences_similarity_std": ("all_wmd_sentences_similarity_std", "all_wmd_sentences_similarity_std_std", "all_wmd_ci_std"),
}
GROUPS = {
    "structural_density": ["cluster_density_score_HDBSCAN", "cluster_reverse_silhouette_score_HDBSCAN", "cluster_density_score_MeanShift", "cluster_reverse_silhouette_score_MeanShift", "reduction_score_PCA_explained_variance", "reduction_score_PCA_prop_of_components"],
    "semantic_contribution": ["regression_coef_density_score_Lasso", "regression_error_score_Lasso", "reduction_score_Lasso"],
    "silhouette_based": ["cluster_reverse_silhouette_score_MeanShift", "cluster_reverse_silhouette_score_HDBSCAN"],
    "cluster_density_based": ["cluster_density_score_MeanShift", "cluster_density_score_HDBSCAN"],
    "pca_based": ["reduction_score_PCA_explained_variance", "reduction_score_PCA_prop_of_components"],
    "lasso_based": ["regression_coef_density_score_Lasso", "regression_error_score_Lasso", "reduction_score_Lasso"],
}
TOPIC_GROUPS = {  # mean and ci only
    "global_topic_structure": ["cluster_density_score_MeanShift", "cluster_reverse_silhouette_score_MeanShift"],
    "local_topic_structure": ["cluster_density_score_HDBSCAN", "cluster_reverse_silhouette_score_HDBSCAN"],
    "semantic_complexity": ["reduction_score_PCA_explained_variance", "regression_error_score_Lasso"],
}


def group_stats(columns: list[str], mean: str, std: str | None, ci: str | None, z: float = 1.96) -> dict:
    cs = [F.col(f"`{c}`") for c in columns]
    out = {mean: row_mean(cs)}
    if std:
        out[std] = row_std(cs)
    if ci:
        out[ci] = row_ci(cs, z)
    return out


def add_composites(df: DataFrame, z: float = 1.96) -> DataFrame:
    """Every composite whose source columns exist."""
    specs = []
    for suffix, names in ACROSS_MODELS.items():
        cols = columns_matching(df, MODELS + f"({suffix})")
        if cols:
            specs.append((cols, *names))
    for name, cols in GROUPS.items():
        if set(cols) <= set(df.columns):
            specs.append((cols, name, f"{name}_std", f"{name}_ci"))
    for name, cols in TOPIC_GROUPS.items():
        if set(cols) <= set(df.columns):
            specs.append((cols, name, None, f"{name}_ci"))
    return add_row_stats(df, specs, z).withColumn("narrative_speed_ci", F.lit(0))


def bands_long(df: DataFrame, keys: list[str], pairs: dict[str, str]) -> DataFrame:
    """Long form for band plots: (keys, feature, value, low, high) with low/high = value -/+ ci."""
    rows = F.array(
        *[
            F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("value"), (F.col(v) - F.col(ci)).cast("double").alias("low"), (F.col(v) + F.col(ci)).cast("double").alias("high"))
            for v, ci in pairs.items()
        ]
    )
    return df.select(*keys, F.inline(rows))
