"""Embedding comparison: nearest neighbours, coverage, distribution distance, selection.

Means and diversity use closed forms, so they cost one pass. Neighbours and coverage
are in :mod:`textloom.operators.neighbours`, kernel sums in :mod:`textloom.operators.kernels`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.vectors import (
    as_double,
    is_nonzero,
    mean_unit,
    mean_vector,
    squared_norm,
    sum_unit,
    with_unit,
)
from textloom.operators.kernels import discrepancy_within, kernel_discrepancy
from textloom.operators.neighbours import blocks, covered_counts, nearest, raw_matrix, unit_matrix
from textloom.operators.sampling import group_sample, hash_sample
from textloom.session import materialize


def mean_similarity(
    queries: DataFrame, base: DataFrame, query_key: str, query_vector: str = "embedding",
    base_vector: str = "embedding",
) -> DataFrame:
    """``(id, mean_similarity)``: the mean of cosines is the dot product with the mean unit vector."""
    known = base.where(F.col(base_vector).isNotNull())
    center = None if known.isEmpty() else with_unit(known, base_vector).agg(mean_unit("unit")).first()[0]
    left = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("id"), as_double(query_vector).alias("v"))
    if center is None:
        return left.select("id", F.lit(None).cast("double").alias("mean_similarity"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                means = unit_matrix(rows.column("v")) @ np.asarray(center)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.array(means)], names=["id", "mean_similarity"]
                )

    return left.mapInArrow(scan, "id bigint, mean_similarity double")


# --- closed forms --------------------------------------------------------------------


def diversity(df: DataFrame, vector: str = "embedding", group: str | None = None) -> DataFrame:
    """Mean pairwise cosine distance, from the sum of the unit vectors; 0 for fewer than two rows.

    Over ordered pairs the cosines add up to ``|Σu|² − Σ|u|²``.
    """
    known = df.where(F.col(vector).isNotNull())
    if not group and known.isEmpty():
        return df.sparkSession.range(1).select(F.lit(0.0).alias("diversity"))
    rows = with_unit(known.select(*([group] if group else []), vector), vector)
    grouped = rows.groupBy(group) if group else rows.groupBy()
    sums = grouped.agg(
        F.count("*").alias("n"),
        sum_unit("unit").alias("s"),
        F.count_if(is_nonzero(vector)).cast("double").alias("q"),
    )
    n = F.col("n")
    pairs = (n * (n - 1)).cast("double")
    value = F.coalesce(1.0 - F.try_divide(squared_norm(F.col("s")) - F.col("q"), pairs), F.lit(0.0))
    return sums.select(*([group] if group else []), F.when(n < 2, 0.0).otherwise(value).alias("diversity"))


def centroid_distance(
    df: DataFrame, other: DataFrame, vector: str = "embedding", group: str | None = None
) -> DataFrame:
    """L2 distance between the mean vectors; 0 when a side is empty."""
    known = other.where(F.col(vector).isNotNull())
    mine = df.where(F.col(vector).isNotNull())
    if known.isEmpty() or mine.isEmpty():
        zero = F.lit(0.0).alias("centroid_distance")
        return df.select(group, zero).distinct() if group else df.sparkSession.range(1).select(zero)
    center = known.select(mean_vector(as_double(vector))).scalar()
    rows = mine.select(*([group] if group else []), as_double(vector).alias("v"))
    grouped = rows.groupBy(group) if group else rows.groupBy()
    means = grouped.agg(mean_vector(F.col("v")).alias("m"))
    gap = F.zip_with("m", F.col("c"), lambda x, y: x - y)
    return means.withColumn("c", center).select(
        *([group] if group else []),
        F.coalesce(F.sqrt(squared_norm(gap)), F.lit(0.0)).alias("centroid_distance"),
    )


def mmd(
    df: DataFrame, other: DataFrame, key: str, other_key: str, vector: str = "embedding",
    group: str | None = None, gamma: float = 10.0, max_samples: int = 1000, seed: int | str = 42,
) -> DataFrame:
    """Kernel discrepancy of at most ``max_samples`` rows per side (and group), biased form.

    A radicand below zero gives NaN. Both samples are bounded, so each group is
    one small numpy computation.
    """
    label = F.lit("all") if group is None else F.col(group).cast("string")
    rows = df.select(label.alias("grp"), F.col(key).alias("id"), as_double(vector).alias("v"))
    # The id breaks ties, so the same rows are drawn whatever the partitioning.
    mine = group_sample(rows, "grp", "id", max_samples, seed)
    theirs = hash_sample(
        other.select(F.col(other_key).alias("id"), as_double(vector).alias("v")), "id", max_samples, seed
    ).toArrow()
    shared = df.sparkSession.sparkContext.broadcast(raw_matrix(theirs.column("v")))

    def kernel_mean(x: np.ndarray, y: np.ndarray) -> float:
        gaps = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
        return float(np.exp(-gamma * gaps).mean())

    def work(table: pa.Table) -> pa.Table:
        x, y = raw_matrix(table.column("v")), shared.value
        value = 0.0
        if len(x) and len(y):
            with np.errstate(invalid="ignore"):
                value = float(np.sqrt(kernel_mean(x, x) + kernel_mean(y, y) - 2.0 * kernel_mean(x, y)))
        return pa.table([table.column("grp").slice(0, 1), pa.array([value])], names=["grp", "mmd"])

    return mine.groupBy("grp").applyInArrow(work, "grp string, mmd double")


def cosine_features(dimensions: int, n: int, gamma: float, seed: int | str = 42) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (n x dimensions) and phases of random cosine features of the Gaussian kernel, from MD5 so that any engine can repeat them."""

    def uniform(name: str) -> float:
        return (int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:13], 16) + 1) / (16**13 + 1)

    normal = [
        [math.sqrt(-2 * math.log(uniform(f"{j}:{d}:a"))) * math.cos(2 * math.pi * uniform(f"{j}:{d}:b")) for d in range(dimensions)]
        for j in range(n)
    ]
    return math.sqrt(2 * gamma) * np.array(normal).reshape(n, dimensions), np.array([2 * math.pi * uniform(f"{j}:p") for j in range(n)])


def mmd_all(
    df: DataFrame, other: DataFrame, vector: str = "embedding", gamma: float = 10.0, n_features: int = 64, seed: int | str = 42
) -> DataFrame:
    """One row ``mmd``: kernel discrepancy over all rows of both sides.

    The kernel is the mean product of random cosine features, so the discrepancy is the distance between two mean feature
    vectors: one pass per side, partial sums, no pairs. 0 when a side is empty.
    """
    size = df.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0]
    spark = df.sparkSession
    if size is None or other.where(F.col(vector).isNotNull()).isEmpty():
        return spark.range(1).select(F.lit(0.0).alias("mmd"))
    shared = spark.sparkContext.broadcast(cosine_features(size, n_features, gamma, seed))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies, phases = shared.value
        total, rows = np.zeros(n_features), 0
        for batch in batches:
            x = raw_matrix(pa.chunked_array([batch.column(0)]))
            if len(x):
                for block in blocks(len(x), n_features):
                    total += np.cos(x[block] @ frequencies.T + phases).sum(axis=0)
                rows += len(x)
        if rows:
            parts = [pa.array(np.arange(n_features, dtype=np.int32)), pa.array(total), pa.array(np.full(n_features, rows, np.int64))]
            yield pa.RecordBatch.from_arrays(parts, names=["j", "total", "n"])

    def mean(side: DataFrame, name: str) -> DataFrame:
        rows = side.where(F.col(vector).isNotNull()).select(as_double(vector).alias("v"))
        return rows.mapInArrow(sums, "j int, total double, n bigint").groupBy("j").agg((F.sum("total") / F.sum("n")).alias(name))

    gaps = mean(df, "a").join(mean(other, "b"), "j")
    return gaps.agg(F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2) * 2 / n_features).alias("mmd"))


def _discrepancy(df: DataFrame, other: DataFrame, vector: str, group: str | None, error: float | None) -> DataFrame:
    if error is None:
        return kernel_discrepancy(df, other, vector, group)
    return discrepancy_within(df, other, vector, group, relative_error=error).select("grp", "mmd")


def distribution_metrics(
    synthetic: DataFrame, organic: DataFrame, key: str, other_key: str, vector: str = "embedding",
    threshold: float = 0.7, mmd_error: float | None = None,
) -> DataFrame:
    """One row: centroid distance, MMD and coverage; all 0 when a side is empty.

    The MMD covers all rows: exact, or within a relative ``mmd_error`` by features, whose work grows with the rows only.
    """
    if synthetic.isEmpty() or organic.isEmpty():
        return synthetic.sparkSession.range(1).select(
            *[F.lit(0.0).alias(n) for n in ("centroid_distance", "mmd", "coverage")]
        )
    hits = covered_counts(organic, synthetic, other_key, key, None, threshold, vector, vector)
    covered = hits.select(F.coalesce(F.sum("covered"), F.lit(0))).scalar()
    total = organic.select(F.count("*")).scalar()
    distance = _discrepancy(synthetic, organic, vector, None, mmd_error).select("mmd").scalar()
    return centroid_distance(synthetic, organic, vector).select(
        "centroid_distance",
        distance.alias("mmd"),
        F.try_divide(covered.cast("double"), total).alias("coverage"),
    )


def topic_metrics(
    synthetic: DataFrame, organic: DataFrame, key: str, other_key: str, topic: str,
    vector: str = "embedding", similarity: str | None = None, min_rows: int = 5,
    threshold: float = 0.7, mmd_error: float | None = None,
) -> DataFrame:
    """Per topic with enough rows: count, mean best similarity, distances, coverage, diversity.

    All topics are computed together; each metric is one pass over the rows of topics that are large enough.
    ``similarity`` names a column that already holds the best similarity. ``mmd_error`` as in :func:`distribution_metrics`.
    """
    rows = synthetic.withColumn("grp", F.coalesce(F.col(topic).cast("string"), F.lit("Unknown")))
    if similarity is None:
        best = nearest(rows, organic, key, other_key, vector, vector)
        # Rows without a vector stay, with nulls.
        rows = rows.join(best.select(F.col("id").alias(key), "max_similarity"), key, "left")
        similarity = "max_similarity"
    counts = rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg(similarity).alias("mean_similarity"))
    counts = materialize(counts.where(F.col("n") >= min_rows), "topics")
    large = materialize(rows.select("grp", key, vector).join(counts.select("grp"), "grp", "left_semi"), "topic-rows")
    total = organic.select(F.count("*")).scalar()
    parts = [
        counts,
        centroid_distance(large, organic, vector, "grp"),
        _discrepancy(large, organic, vector, "grp", mmd_error),
        diversity(large, vector, "grp"),
        covered_counts(organic, large, other_key, key, "grp", threshold, vector, vector),
    ]
    joined = reduce(lambda a, b: a.join(b, "grp", "left"), parts)
    return joined.select(
        F.col("grp").alias("topic"), "n", "mean_similarity", "centroid_distance", "mmd",
        F.coalesce(F.try_divide(F.col("covered").cast("double"), total), F.lit(0.0)).alias("coverage"),
        "diversity",
    )


# --- selection, clustering, projection -----------------------------------------------


def cluster(
    df: DataFrame, n_clusters: int = 50, vector: str = "embedding", out: str = "cluster",
    seeds: tuple[int, ...] = (42, 43, 44),
) -> DataFrame:
    """K-means with several seeds, cheapest model kept; at most one cluster per two rows. Rows without a vector have no cluster."""
    return cluster_with_centers(df, n_clusters, vector, out, seeds)[0]


def cluster_with_centers(
    df: DataFrame, n_clusters: int = 50, vector: str = "embedding", out: str = "cluster",
    seeds: tuple[int, ...] = (42, 43, 44),
) -> tuple[DataFrame, list[np.ndarray]]:
    """:func:`cluster` and the centre of every cluster, by its number."""
    known = df.where(F.col(vector).isNotNull())
    unknown = df.where(F.col(vector).isNull()).withColumn(out, F.lit(None).cast("int"))
    k = min(n_clusters, known.count() // 2)
    if k < 1:
        return df.withColumn(out, F.lit(0)).where(F.lit(False)), []
    if k == 1:
        return known.withColumn(out, F.lit(0)).unionByName(unknown), []
    rows = known.withColumn("_f", array_to_vector(as_double(vector))).persist()
    models = [KMeans(k=k, seed=s, featuresCol="_f", predictionCol=out).fit(rows) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    return best.transform(rows).drop("_f").unionByName(unknown), best.clusterCenters()


def top_per_group(df: DataFrame, group: str, order: list[Column], key: str, k: int) -> DataFrame:
    """First k rows per group; a large k ranks within salted parts of the group first."""
    if k > 1000:  # beyond this Spark no longer trims groups before the shuffle
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
        part = W.partitionBy(group, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_r", "_salt")
    window = W.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= k).drop("_r")


def select_diverse(
    df: DataFrame, key: str, cluster_column: str, similarity: str, n_select: int = 500,
    n_clusters: int | None = None,
) -> DataFrame:
    """``(key, similarity, in_quota)`` of the selected rows.

    Per cluster the most similar rows up to an even share, then the most similar
    of the rest, cut at ``n_select``; ties go to the lower key.
    """
    rows = df.select(key, cluster_column, similarity)
    if n_clusters is None:
        n_clusters = rows.select(F.count_distinct(cluster_column)).first()[0]
    if n_clusters < 1:
        return rows.select(key, similarity, F.lit(False).alias("in_quota")).where(F.lit(False))
    order = [F.desc(similarity), F.asc(key)]
    share = max(1, n_select // n_clusters)
    quota = top_per_group(rows, cluster_column, order, key, share)
    # The best n_select rows overall hold every row the fill can need.
    fill = rows.orderBy(*order).limit(n_select)
    both = quota.select(key, similarity, F.lit(True).alias("in_quota")).unionByName(
        fill.select(key, similarity, F.lit(False).alias("in_quota"))
    )
    merged = both.groupBy(key).agg(
        F.max(similarity).alias(similarity), F.bool_or("in_quota").alias("in_quota")
    )
    return merged.orderBy(F.desc("in_quota"), *order).limit(n_select)


def reduce_dimensions(df: DataFrame, k: int = 50, vector: str = "embedding", out: str = "reduced") -> DataFrame:
    """Principal components; vectors that are short enough already stay as they are, missing ones stay missing."""
    known = df.where(F.col(vector).isNotNull())
    shortest, longest = known.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if longest is None or longest <= k:
        return df.withColumn(out, as_double(vector))
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} to {longest} numbers")
    rows = known.withColumn("_f", array_to_vector(as_double(vector)))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(rows)
    done = model.transform(rows).withColumn(out, vector_to_array("_p")).drop("_f", "_p")
    return done.unionByName(df.where(F.col(vector).isNull()).withColumn(out, F.lit(None).cast("array<double>")))


def plot_coordinates(
    synthetic: DataFrame, organic: DataFrame, key: str, other_key: str, vector: str = "embedding",
    max_points: int = 1000, seed: int | str = 42,
) -> DataFrame:
    """``(side, id, x, y)`` of at most ``max_points`` rows per side: two principal components."""
    sides = [("synthetic", synthetic, key), ("organic", organic, other_key)]
    parts = [
        hash_sample(df.select(F.col(k).alias("id"), F.col(vector).alias("v")), "id", max_points, seed)
        .withColumn("side", F.lit(name))
        for name, df, k in sides
    ]
    both = reduce(DataFrame.unionByName, parts)
    small = reduce_dimensions(reduce_dimensions(both, 50, "v", "w"), 2, "w", "xy")
    return small.select("side", "id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def embed(df: DataFrame, text: str = "text", out: str = "embedding", dimensions: int = 384) -> DataFrame:
    """Offline embedding: hashed word counts scaled to length 1."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")
    rows = df.withColumn("_w", F.coalesce(words, F.array().cast("array<string>")))
    counted = HashingTF(numFeatures=dimensions, inputCol="_w", outputCol="_tf").transform(rows)
    scaled = Normalizer(inputCol="_tf", outputCol="_n").transform(counted)
    return scaled.withColumn(out, vector_to_array("_n")).drop("_w", "_tf", "_n")


def embed_with(
    df: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "text",
    out: str = "embedding", batch_size: int = 64,
) -> DataFrame:
    """Embedding by any function from texts to a matrix, called in batches inside the tasks."""
    names = [*df.columns, out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(text).to_pylist()
            vectors: list = []
            for start in range(0, len(texts), batch_size):
                vectors.extend(np.asarray(model(texts[start : start + batch_size]), dtype=float).tolist())
            column = pa.array(vectors, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, column], names=names)

    return df.mapInArrow(run, f"{schema}, `{out}` array<double>")
