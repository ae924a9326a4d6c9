"""Kernel discrepancy (Gaussian kernel, biased form) over all rows of both sides.

:func:`kernel_discrepancy` is exact: rows are dealt into tiles, and every two tiles meet once (a triangular schedule), so pairs exist only
inside numpy blocks and leave as one sum per group. Its work grows with the square of the rows.

:func:`discrepancy_within` grows with the rows: orthogonal random features turn the discrepancy into a distance of means. Its
error is estimated from independent blocks of features and returned; features are added until it is small enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.vectors import as_double
from textloom.operators.neighbours import blocks, raw_matrix
from textloom.session import materialize

TILE_BYTES = 16 * 1024 * 1024  # of vectors per tile
FEATURE_BLOCKS = 64  # blocks of features in the first pass
MAX_BLOCKS = 16_384
SIGMAS = 4.0  # width of the stated error in standard errors; block means are skewed, so three are missed too often


def _kernel_sum(x: np.ndarray, y: np.ndarray, gamma: float) -> float:
    total = 0.0
    own, other = (x**2).sum(axis=1), (y**2).sum(axis=1)
    for block in blocks(len(x), len(y)):
        # In place: one matrix is held, not five.
        gaps = x[block] @ y.T
        gaps *= -2.0
        gaps += own[block][:, None]
        gaps += other[None, :]
        gaps *= -gamma
        total += float(np.exp(gaps, out=gaps).sum())
    return total


def _sides(df: DataFrame, other: DataFrame, vector: str, group: str | None) -> tuple[DataFrame, DataFrame]:
    label = F.lit("all") if group is None else F.coalesce(F.col(group).cast("string"), F.lit(""))
    mine = df.where(F.col(vector).isNotNull()).select(label.alias("grp"), as_double(vector).alias("v"))
    return mine, other.where(F.col(vector).isNotNull()).select(F.lit(None).cast("string").alias("grp"), as_double(vector).alias("v"))


def kernel_discrepancy(df: DataFrame, other: DataFrame, vector: str = "embedding", group: str | None = None, gamma: float = 10.0) -> DataFrame:
    """``(grp, mmd)``: exact, each group of ``df`` against all of ``other``; groups have at least one vector.

    0 when ``other`` has no vectors. A radicand below zero gives NaN. A null group is called ''.
    """
    mine, theirs = _sides(df, other, vector, group)
    sizes = [side.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first() for side in (mine, theirs)]
    counts = mine.groupBy("grp").agg(F.count("*").alias("n"))
    if not sizes[1]["n"]:
        return counts.select("grp", F.lit(0.0).alias("mmd"))
    rows_per_tile = max(1, TILE_BYTES // (8 * max(1, sizes[0]["d"], sizes[1]["d"])))
    tiles = [max(1, -(-s["n"] // rows_per_tile)) for s in sizes]
    total = sum(tiles)

    def placed(side: DataFrame, first: int, n: int) -> DataFrame:
        tile = F.lit(first) + F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
        return side.select("grp", "v", tile.alias("tile"))

    rows = placed(mine, 0, tiles[0]).unionByName(placed(theirs, *tiles))
    meets = rows.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(total - 1)))).select(
        "grp", "v", "tile", F.least("tile", "u").alias("i"), F.greatest("tile", "u").alias("j")
    )

    def parts(table: pa.Table) -> dict[str | None, np.ndarray]:
        if not table.num_rows:
            return {}
        table = table.sort_by("grp")
        names = np.array([g if g is not None else "" for g in table.column("grp").to_pylist()], dtype=object)
        rows = raw_matrix(table.column("v"))
        cut = np.flatnonzero(names[1:] != names[:-1]) + 1
        return dict(zip([str(names[c]) for c in [0, *cut]], np.split(rows, cut)))

    def work(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        tile = table.column("tile").to_numpy()
        halves = []
        for t in dict.fromkeys((i, j)):
            here = np.flatnonzero(tile == t)
            tag = 0 if t < tiles[0] else 1
            halves.append((tag, parts(table.take(pa.array(here)))))
        out = []
        (tag_a, a), (tag_b, b) = halves[0], halves[-1]
        times = 1.0 if i == j else 2.0
        if tag_a == tag_b == 0:
            out = [("xx", g, times * _kernel_sum(a[g], b[g], gamma)) for g in a if g in b]
        elif tag_a == tag_b == 1 and a and b:
            out = [("yy", None, times * _kernel_sum(a[""], b[""], gamma))]
        elif tag_a != tag_b and b:
            out = [("xy", g, _kernel_sum(a[g], b[""], gamma)) for g in a]
        kinds = [pa.string(), pa.string(), pa.float64()]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["kind", "grp", "total"])

    sums = materialize(meets.groupBy("i", "j").applyInArrow(work, "kind string, grp string, total double"), "kernel")
    m = F.lit(float(sizes[1]["n"]))
    yy = sums.where("kind = 'yy'").select(F.sum("total")).scalar()
    per = sums.where("kind <> 'yy'").groupBy("grp").agg(
        F.sum(F.when(F.col("kind") == "xx", F.col("total"))).alias("xx"), F.sum(F.when(F.col("kind") == "xy", F.col("total"))).alias("xy")
    )
    n = F.col("n").cast("double")
    return counts.join(per, "grp").select("grp", F.sqrt(F.col("xx") / (n * n) + yy / (m * m) - 2 * F.col("xy") / (n * m)).alias("mmd"))


# --- features -------------------------------------------------------------------------


def orthogonal_block(dimensions: int, gamma: float, seed: int, number: int) -> np.ndarray:
    """``dimensions`` frequencies of the Gaussian kernel, at right angles to each other, with the lengths of independent draws."""
    draw = np.random.default_rng([seed, number])
    q, r = np.linalg.qr(draw.normal(size=(dimensions, dimensions)))
    q *= np.sign(np.diag(r))
    lengths = np.sqrt((draw.normal(size=(dimensions, dimensions)) ** 2).sum(axis=1))
    return np.sqrt(2 * gamma) * lengths[:, None] * q


def _feature_means(side: DataFrame, dimensions: int, gamma: float, seed: int, first: int, last: int, name: str) -> DataFrame:
    """(grp, block, mean cosines and sines) of the blocks first .. last."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = [orthogonal_block(dimensions, gamma, seed, b) for b in range(first, last)]
        total: dict[tuple[str | None, int], list] = {}
        for batch in batches:
            names = batch.column("grp").to_pylist()
            rows = raw_matrix(batch.column("v"))
            for group in dict.fromkeys(names):
                own = rows[[n == group for n in names]] if group is not None else rows
                for number, w in enumerate(frequencies, first):
                    held = total.setdefault((group, number), [np.zeros(2 * dimensions), 0])
                    for block in blocks(len(own), dimensions):
                        angle = own[block] @ w.T
                        held[0][:dimensions] += np.cos(angle).sum(axis=0)
                        held[0][dimensions:] += np.sin(angle).sum(axis=0)
                    held[1] += len(own)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in total], pa.string()), pa.array([b for _, b in total], pa.int32()),
                 pa.array([list(v[0]) for v in total.values()], pa.list_(pa.float64())), pa.array([v[1] for v in total.values()], pa.int64())],
                names=["grp", "block", "total", "n"],
            )

    found = side.mapInArrow(sums, "grp string, block int, total array<double>, n bigint").groupBy("grp", "block")
    summed = found.agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("total")))).alias("total"), F.sum("n").alias("n"))
    return summed.select("grp", "block", F.transform("total", lambda x: x / F.col("n")).alias(name))


def discrepancy_within(
    df: DataFrame, other: DataFrame, vector: str = "embedding", group: str | None = None, gamma: float = 10.0, relative_error: float = 0.05, seed: int = 42
) -> DataFrame:
    """``(grp, mmd, error, n_features)``: one pass per side and round, partial sums, no pairs.

    Every block of features gives an independent estimate of the squared discrepancy; ``error`` is what ``SIGMAS`` standard
    errors of their mean allow for the root. Rounds add blocks until it is within ``relative_error`` for all groups or ``MAX_BLOCKS``
    are used. 0 when ``other`` has no vectors.
    """
    mine, theirs = _sides(df, other, vector, group)
    d = theirs.agg(F.max(F.size("v"))).first()[0]
    if d is None:
        return mine.select("grp", F.lit(0.0).alias("mmd"), F.lit(0.0).alias("error"), F.lit(0).cast("bigint").alias("n_features")).distinct()
    done, wanted, estimates = 0, FEATURE_BLOCKS, None
    while True:
        a = _feature_means(mine, d, gamma, seed, done, wanted, "a")
        b = _feature_means(theirs, d, gamma, seed, done, wanted, "b").drop("grp")
        gap = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / d
        fresh = materialize(a.join(b, "block").select("grp", gap.alias("z")), "features")
        estimates = fresh if estimates is None else estimates.unionByName(fresh)
        done = wanted
        summary = estimates.groupBy("grp").agg(F.avg("z").alias("m"), (F.stddev_samp("z") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("k"))
        mmd, spare = F.sqrt("m"), SIGMAS * F.col("se")
        error: Column = F.greatest(F.sqrt(F.col("m") + spare) - mmd, mmd - F.sqrt(F.greatest(F.col("m") - spare, F.lit(0.0))))
        result = summary.select("grp", mmd.alias("mmd"), error.alias("error"), (F.col("k") * d).alias("n_features"))
        worst = result.agg(F.max(F.try_divide(F.col("error"), "mmd"))).first()[0]
        if worst is None or worst <= relative_error or done >= MAX_BLOCKS:
            return result
        # The error falls with the root of the blocks.
        wanted = min(MAX_BLOCKS, max(2 * done, int(1.2 * done * (worst / relative_error) ** 2) + 1))
