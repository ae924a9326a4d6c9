"""Text embeddings learned from the corpus itself.

A text is the weighted sum of directions of its words: words are hashed into ``features`` places, weighted by the logarithm of their count
and their inverse document frequency, and projected on the leading singular directions of the corpus. Those come from a randomised
method: a few passes multiply the corpus with a thin matrix and its transpose. A pass sums blocks of that
product on the executors; the driver sees matrices of ``features`` x ``dimensions`` only, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.neighbours import vector_array
from textloom.session import materialize

FEATURES = 1 << 14
EXTRA = 16  # directions beyond those wanted, for accuracy
BLOCK_ROWS = 512  # features per block of a summed product
SLICE = 2000  # texts multiplied at once


def _words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\s\p{Punct}]+"), lambda w: w != "")


def _bags(df: DataFrame, text: str, features: int, *keep: str) -> DataFrame:
    """Word places of every text, repeated as often as the words."""
    return df.select(*keep, F.transform(_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int")).alias("bag"))


def shared_words(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(key, shared)``: the words two texts have in common as a share of all their words, repeats counted; pairs without words are absent."""
    sides = [df.select(key, F.explode(_words(c)).alias("word"), F.lit(i).alias("side")) for i, c in enumerate((a, b))]
    counts = sides[0].unionByName(sides[1]).groupBy(key, "word").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    return counts.groupBy(key).agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("shared"))


def _sparse(column: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the texts of a batch; rows have length 1."""
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(n), sizes)
    place = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    key, count = np.unique(row * len(weights) + place, return_counts=True)
    row, place = key // len(weights), key % len(weights)
    value = (1 + np.log(count)) * weights[place]
    norm = np.sqrt(np.bincount(row, value**2, minlength=n))
    return row, place, value / np.maximum(norm[row], 1e-12)


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of every index; the index is sorted."""
    out = np.zeros((n, rows.shape[1]))
    if len(index):
        starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        out[index[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def _times(column: pa.ListArray, weights: np.ndarray, thin: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The batch times a thin matrix, and the batch itself."""
    row, place, value = _sparse(column, weights)
    return _summed(row, value[:, None] * thin[place], len(column)), (row, place, value)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _gram_times(bags: DataFrame, weights: Broadcast, thin: np.ndarray) -> np.ndarray:
    """A'A times a thin matrix, summed block by block on the executors."""
    features, width = thin.shape
    shared = bags.sparkSession.sparkContext.broadcast(thin)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((features, width)), False
        for batch in _slices(batches):
            product, (row, place, value) = _times(batch.column(0), weights.value, shared.value)
            order = np.argsort(place, kind="stable")
            total += _summed(place[order], value[order, None] * product[row[order]], features)
            met = True
        if met:
            starts = range(0, features, BLOCK_ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(starts), pa.int32()), pa.array([total[s : s + BLOCK_ROWS].tobytes() for s in starts], pa.binary())], names=["start", "part"]
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py()) for p in table.column("part"))
        return pa.table([table.column("start").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["start", "part"])

    parts = bags.select("bag").mapInArrow(multiply, "start int, part binary").groupBy("start").applyInArrow(add, "start int, part binary").toArrow()
    shared.destroy()
    out = np.zeros((features, width))
    for start, part in zip(parts.column("start").to_pylist(), parts.column("part")):
        block = np.frombuffer(part.as_py()).reshape(-1, width)
        out[start : start + len(block)] = block
    return out


def learn_directions(bags: DataFrame, features: int, dimensions: int, passes: int = 2, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(weight of every place, places x dimensions) from word places of a corpus."""
    n = bags.count()
    seen = bags.select(F.explode(F.array_distinct("bag")).alias("place")).groupBy("place").agg(F.count("*").alias("n")).toArrow()
    frequency = np.zeros(features)
    frequency[seen.column("place").to_numpy()] = seen.column("n").to_numpy()
    weights = np.log((1 + n) / (1 + frequency)) + 1
    shared = bags.sparkSession.sparkContext.broadcast(weights)
    width = min(features, dimensions + EXTRA)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))
    for _ in range(passes):
        product = _gram_times(bags, shared, basis)
        basis, _ = np.linalg.qr(product)
    # The small problem inside the basis orders its directions.
    values, turn = np.linalg.eigh(basis.T @ _gram_times(bags, shared, basis))
    shared.destroy()
    order = np.argsort(-values, kind="stable")[:dimensions]
    directions = basis @ turn[:, order]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return weights, directions * np.where(signs == 0, 1, signs)


def embed_corpus(df: DataFrame, key: str, text: str = "text", out: str = "embedding", dimensions: int = 64, corpus: DataFrame | None = None,
                 features: int = FEATURES, passes: int = 2, seed: int = 42) -> DataFrame:
    """``(key, out)``: a vector of length 1 per text, learned from ``corpus`` (by default the texts themselves).

    Texts without words have a zero vector.
    """
    learned = materialize(_bags(df if corpus is None else corpus, text, features), "bags")
    weights, directions = learn_directions(learned, features, dimensions, passes, seed)
    shared = df.sparkSession.sparkContext.broadcast((weights, directions))
    keys = df.schema[key].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, _ = _times(batch.column(1), *shared.value)
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            units = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), vector_array(units)], names=[key, out])

    return _bags(df, text, features, key).mapInArrow(project, f"`{key}` {keys}, `{out}` array<double>")
