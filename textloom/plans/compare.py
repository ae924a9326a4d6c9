"""Compare a generated corpus with an organic one and pick a diverse part of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from textloom.operators import similarity, summaries
from textloom.session import materialize
from textloom.sources.writers import selected_rows, write_csv


@dataclass
class Comparison:
    scored: DataFrame
    overall: DataFrame
    topics: DataFrame
    selected: DataFrame
    selected_diversity: DataFrame


def compare(
    synthetic: DataFrame,
    organic: DataFrame,
    topic: str = "example_type",
    text: str = "text",
    vector: str = "embedding",
    n_select: int = 500,
    method: str = "diverse",
    mmd_error: float | None = None,
    cluster_column: str | None = None,
) -> Comparison:
    """Both sides: ``id, text, embedding``; the synthetic one also has the topic column.

    ``cluster_column`` names clusters that are known already. Best similarities are computed once and kept in the shared folder. Any method
    but ``diverse`` selects nothing.
    """
    # Every metric passes over the organic vectors; what they are made from is read once.
    points = materialize(organic.select("id", vector), "organic")
    best = similarity.nearest(synthetic, points, "id", "id", vector, vector)
    scored = materialize(synthetic.join(best, "id", "left"), "scored")
    overall = similarity.distribution_metrics(scored, points, "id", "id", vector, mmd_error=mmd_error).withColumn(
        "diversity", similarity.diversity(scored, vector).scalar()
    )
    topics = similarity.topic_metrics(
        scored, points, "id", "id", topic, vector, "max_similarity", mmd_error=mmd_error
    )
    n = scored.count()
    k = min(50, n // max(1, n_select // 20)) if method == "diverse" else 0
    if cluster_column is None:
        clustered, n_clusters = similarity.cluster(scored, k, vector), min(k, n // 2)
    else:
        clustered = scored.withColumn("cluster", F.col(cluster_column))
        n_clusters = clustered.agg(F.count_distinct("cluster")).first()[0]
    picked = similarity.select_diverse(
        clustered, "id", "cluster", "max_similarity", n_select, n_clusters
    ).select("id", "in_quota")
    lookup = organic.select(F.col("id").alias("nearest_id"), F.col(text).alias("closest_organic_text"))
    selected = materialize(
        scored.join(picked, "id")
        .join(lookup, "nearest_id", "left")
        .withColumnRenamed("max_similarity", "organic_similarity"),
        "selected",
    )
    return Comparison(scored, overall, topics, selected, similarity.diversity(selected, vector))


def report_lines(
    c: Comparison, organic: DataFrame, text: str = "text", topic: str = "example_type", top: int = 10
) -> list[str]:
    """Text report from the small result tables."""
    o = c.overall.first()
    lines = [
        "ORGANIC AND SYNTHETIC DATA",
        f"organic rows: {organic.count()}",
        f"synthetic rows: {c.scored.count()}",
        f"centroid distance: {o['centroid_distance']:.4f}",
        f"kernel discrepancy: {o['mmd']:.4f}",
        f"coverage: {o['coverage']:.2%}",
        f"mean best similarity: {c.scored.agg(F.avg('max_similarity')).first()[0]:.4f}",
        f"diversity: {o['diversity']:.4f}",
        f"diversity of the selection: {c.selected_diversity.first()['diversity']:.4f}",
        "TOPICS",
    ]
    for r in c.topics.orderBy("topic").toLocalIterator():
        lines.append(
            f"{r['topic']:<20}{r['n']:<10}{r['mean_similarity']:<10.4f}{r['centroid_distance']:<10.4f}"
            f"{r['mmd']:<10.4f}{r['diversity']:.4f}"
        )
    lines.append(f"TOP {top}")
    best = summaries.top_k(c.scored, "max_similarity", "id", top)
    for rank, r in enumerate(best.select("max_similarity", F.substring(text, 1, 100).alias("t"), topic).collect(), 1):
        lines.append(f"{rank}. {r['max_similarity']:.4f} {r['t']} [{r[topic] or 'Unknown'}]")
    return lines


def save_selected(c: Comparison, path: str) -> str:
    return write_csv(selected_rows(c.selected), path)
