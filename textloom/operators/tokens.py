"""Token ids for training."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T


SLICE_BYTES = 1 << 20  # of one column, turned into Python objects at once


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs with about ``most`` bytes of a text or id column, without a copy: a task's memory does not grow with its batches."""
    for rows in batches:
        values = rows.column(column)
        width = 4 if pa.types.is_list(values.type) else 1
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * width
        run = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1), rows.num_rows]
        for first, last in zip(cuts, cuts[1:]):
            yield rows.slice(first, last - first)


def byte_tokens(texts: list[str]) -> list[list[int]]:
    """Offline tokenizer: the UTF-8 bytes."""
    return [list(t.encode("utf-8")) for t in texts]


def tokenize(
    df: DataFrame,
    encode: Callable[[list[str]], list[list[int]]] = byte_tokens,
    text: str = "text",
    max_length: int = 2048,
) -> DataFrame:
    """Adds ``input_ids`` cut at ``max_length``, ``labels``, a copy of them, and ``n_tokens``, the uncut length; drops the text."""
    kept = [f for f in df.schema.fields if f.name != text]
    ids = T.ArrayType(T.IntegerType())
    out = T.StructType([*kept, T.StructField("input_ids", ids), T.StructField("labels", ids), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in small_batches(batches, text):
            encoded = encode([t or "" for t in rows.column(text).to_pylist()])
            column = pa.array([e[:max_length] for e in encoded], pa.list_(pa.int32()))
            rest = [rows.column(f.name) for f in kept]
            sizes = pa.array([len(e) for e in encoded], pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, column, column, sizes], names=out.names)

    return df.mapInArrow(run, out)
