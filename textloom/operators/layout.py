"""Points of a plane for vectors: neighbours close together, everything else apart.

The nearest neighbours of every vector (by :mod:`textloom.operators.neighbours`) are edges that attract. Repulsion
comes from a fresh sample of points each round, which stands for all of them. Coordinates stay in a table that every round writes
anew; the driver sees only the sample, at most ``SAMPLE`` points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textloom.functions.hashing import order_key
from textloom.functions.vectors import as_double
from textloom.operators.neighbours import neighbours
from textloom.session import materialize

SAMPLE = 500
MOMENTUM = 0.7


def neighbour_edges(df: DataFrame, key: str, vector: str, k: int, near: DataFrame | None = None) -> DataFrame:
    """(a, b, weight): the k nearest of a, in both directions; 1 where both name each other, else a half. ``near`` (id, neighbour) holds them if they are known."""
    near = neighbours(df, df, key, key, k, True, vector, vector) if near is None else near
    found = near.select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a", "b").agg((F.count("*") / 2).alias("weight"))


def _pushed(batches: Iterator[pa.RecordBatch], others: np.ndarray, rate: float) -> Iterator[pa.RecordBatch]:
    """One step: (id, x, y, vx, vy, ax, ay) with the pull of the edges to new places and speeds."""
    spread = ((others[:, None] - others[None]) ** 2).sum(axis=2)
    whole = (1 / (1 + spread)).mean()
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, vx, vy, ax, ay = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
        at = np.stack([x, y], axis=1)
        gap = at[:, None] - others[None]
        near = 1 / (1 + (gap**2).sum(axis=2))
        push = ((near**2)[:, :, None] * gap).mean(axis=1) / whole
        speed = MOMENTUM * np.stack([vx, vy], axis=1) + np.stack([ax, ay], axis=1) + push
        at = at + rate * speed
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in (at[:, 0], at[:, 1], speed[:, 0], speed[:, 1])]], names=["id", "x", "y", "vx", "vy"])


def layout(start: DataFrame, edges: DataFrame, k: int = 10, rounds: int = 15, rate: float = 3.0, seed: int | str = 42) -> DataFrame:
    """``(id, x, y)`` after some rounds from ``start`` (id, x, y) along ``edges`` (a, b, weight)."""
    edges = materialize(edges, "edges")
    size = start.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.coalesce(F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2), F.lit(0.0)).alias("s")).first()
    if size["mx"] is None:
        return start
    scale = size["s"] or 1.0
    rest = F.lit(0.0)
    state = start.select("id", ((F.col("x") - size["mx"]) / scale).alias("x"), ((F.col("y") - size["my"]) / scale).alias("y"), rest.alias("vx"), rest.alias("vy"))
    state = materialize(state, "layout")
    for number in range(rounds):
        drawn = state.orderBy(order_key("id", f"{seed}-{number}"), "id").limit(SAMPLE).select("x", "y").toArrow()
        others = np.stack([drawn.column(c).to_numpy() for c in ("x", "y")], axis=1)
        a = state.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
        b = state.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
        dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
        pull = F.col("weight") / (k * (1 + dx * dx + dy * dy))
        pulls = edges.join(a, "a").join(b, "b").groupBy("a").agg(F.sum(pull * dx).alias("ax"), F.sum(pull * dy).alias("ay"))
        rows = state.join(pulls.withColumnRenamed("a", "id"), "id", "left").select(
            "id", "x", "y", "vx", "vy", F.coalesce("ax", rest).alias("ax"), F.coalesce("ay", rest).alias("ay")
        )

        def step(batches: Iterator[pa.RecordBatch], others: np.ndarray = others) -> Iterator[pa.RecordBatch]:
            return _pushed(batches, others, rate)

        state = materialize(rows.mapInArrow(step, "id bigint, x double, y double, vx double, vy double"), "layout")
    return state.select("id", "x", "y")


def neighbour_layout(df: DataFrame, key: str, vector: str = "embedding", k: int = 10, rounds: int = 15, seed: int | str = 42, near: DataFrame | None = None) -> DataFrame:
    """``(id, x, y)`` of every row with a vector, from its first two principal components on. Rows have distinct keys.

    ``near`` as in :func:`neighbour_edges`: its search is most of the work.
    """
    from textloom.operators.similarity import reduce_dimensions

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), as_double(vector).alias("v"))
    flat = reduce_dimensions(rows, 2, "v", "p")
    start = flat.select("id", F.coalesce(F.get("p", F.lit(0)), F.lit(0.0)).alias("x"), F.coalesce(F.get("p", F.lit(1)), F.lit(0.0)).alias("y"))
    return layout(start, neighbour_edges(rows, "id", "v", k, near), k, rounds, seed=seed)


def kept_neighbours(near: DataFrame, places: DataFrame, k: int = 10, sample: int = 1000, seed: int | str = 42) -> DataFrame:
    """``(id, kept)``: the share of the k nearest (id, neighbour) that are among the k nearest in the plane.

    A measure: it looks at ``sample`` rows drawn by hash, each compared with all others.
    """
    drawn = places.orderBy(order_key("id", seed), "id").limit(sample).toArrow()
    ids, at = drawn.column("id").to_numpy(), np.stack([drawn.column(c).to_numpy() for c in ("x", "y")], axis=1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = batch.column(0).to_numpy(zero_copy_only=False)
            here = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], axis=1)
            for q, point in zip(ids, at):
                far = ((here - point) ** 2).sum(axis=1)
                far[other == q] = np.inf
                best = np.flatnonzero((far <= (np.partition(far, k - 1)[k - 1] if k < len(far) else np.inf)) & (far < np.inf))
                best = best[np.lexsort((other[best], far[best]))[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(other[best]), pa.array(far[best])], names=["id", "neighbour", "far"])

    close = places.select("id", "x", "y").mapInArrow(nearest, "id bigint, neighbour bigint, far double")
    order = W.partitionBy("id").orderBy("far", "neighbour")
    close = close.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("id", "neighbour", F.lit(1).alias("hit"))
    wanted = near.join(close.select("id").distinct(), "id", "left_semi")
    return wanted.join(close, ["id", "neighbour"], "left").groupBy("id").agg((F.count("hit") / F.count("*")).alias("kept"))
