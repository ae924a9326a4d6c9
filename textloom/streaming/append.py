"""Append results as they arrive, with progress that survives a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textloom.sources.writers import write_jsonl


def append_jsonl(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    on_batch_end: Callable[[DataFrame, int], None] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Write each micro-batch to ``path/batch_id=N``.

    A batch that is run again after a failure overwrites its own folder, so no row
    is lost or doubled. ``on_batch_end(written, batch_id)`` sees the written rows.
    ``once=True`` handles what is there and stops.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        target = f"{path}/batch_id={batch_id}"
        write_jsonl(rows, target, mode="overwrite")
        if on_batch_end:
            on_batch_end(batch.sparkSession.read.schema(rows.schema).json(target), batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_appended(spark, path: str, schema) -> DataFrame:
    """All rows written so far."""
    return spark.read.schema(schema).json(path).drop("batch_id")
