"""Writers. Output is a folder of part files; ``single_file=True`` is for small results only."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.functions.text import clean_control, or_empty
from textloom.schemas import DIMENSIONS
from textloom.sources.workbook import workbook_bytes

FILE_ROWS = 200_000


def _shape(df: DataFrame, single_file: bool) -> DataFrame:
    return df.coalesce(1) if single_file else df


def write_jsonl(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> str:
    """UTF-8 JSON lines; null fields are kept."""
    _shape(df, single_file).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> str:
    """CSV with a header that pandas and :func:`textloom.sources.load` read back unchanged."""
    options = {"header": "true", "escape": '"', "quote": '"', "emptyValue": '""',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    _shape(df, single_file).write.mode(mode).options(**options).csv(path)
    return path


def _write_files(df: DataFrame, path: str, pack: Callable[[pd.DataFrame], bytes], rows_per_file: int) -> str:
    """Binary files, each of at most ``rows_per_file`` rows of a partition.

    Spark has no binary writer, but its text writer passes bytes through and ends every row with one line end; one row is one
    file. So files reach any store Spark knows, and tasks that run twice leave one copy.
    """

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"content": pa.array([pack(pd.concat(held, ignore_index=True))], pa.binary())})

        for batch in batches:
            frame = batch.to_pandas() if isinstance(batch, pa.RecordBatch) else batch
            for start in range(0, len(frame), rows_per_file):
                piece = frame.iloc[start : start + rows_per_file]
                if size + len(piece) > rows_per_file:
                    yield packed()
                    held, size = [], 0
                held.append(piece)
                size += len(piece)
        if held:
            yield packed()

    content = df.mapInArrow(files, "content binary").select(F.col("content").cast("string").alias("value"))
    content.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1", rows_per_file: int = FILE_ROWS) -> str:
    """Workbooks of one sheet with a header. Arrays and structs become text; control characters take the format's _x0000_ form."""
    names = df.columns

    def pack(frame: pd.DataFrame) -> bytes:
        values = ([None if _is_missing(v) else v for v in row] for row in frame.itertuples(index=False, name=None))
        return workbook_bytes(names, values, sheet)

    return _write_files(df, path, pack, rows_per_file)


def _is_missing(value) -> bool:
    return value is None or value is pd.NaT or (isinstance(value, float) and value != value)


def write_pickle(df: DataFrame, path: str, rows_per_file: int = FILE_ROWS) -> str:
    """Pickled pandas frames."""

    def pack(frame: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        frame.to_pickle(out)
        return out.getvalue()

    return _write_files(df, path, pack, rows_per_file)


def write_training_set(pairs: DataFrame, failed: DataFrame, folder: str, prefix: str) -> dict:
    """Four outputs: training lines, full records, review CSV, and failures when there are any."""
    from textloom.operators.reshape import qa_rows

    paths = {
        "jsonl": write_jsonl(pairs.select("input", "output"), f"{folder}/{prefix}_jsonl"),
        "qa_json": write_jsonl(pairs, f"{folder}/{prefix}_qa_json"),
        "qa_csv": write_csv(qa_rows(pairs), f"{folder}/{prefix}_qa_csv"),
        "failed": None,
    }
    if not failed.isEmpty():
        paths["failed"] = write_jsonl(failed, f"{folder}/{prefix}_failed")
    return paths


def example_rows(examples: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Generated examples as flat review rows: 1-based id, joined labels, nulls as empty text."""
    meta = F.col("metadata")
    dims = [
        or_empty(meta[d]).alias(d) if d == "difficulty" else meta[d].alias(d) for d in DIMENSIONS
    ]
    return examples.select(
        (F.col(row_id) + 1).alias("id"),
        "text",
        meta["example_type"].alias("example_type"),
        or_empty(F.array_join(meta["expected_alert_types"], ", ")).alias("expected_alert_types"),
        or_empty(meta["expected_non_alert_type"]).alias("expected_non_alert_type"),
        *dims,
    )


def selected_rows(selected: DataFrame) -> DataFrame:
    """Selected examples for the review CSV, most similar first."""
    meta = F.col("metadata")
    rows = selected.select(
        "text",
        "organic_similarity",
        or_empty("closest_organic_text").alias("closest_organic_text"),
        F.coalesce(meta["example_type"], F.lit("Unknown")).alias("example_type"),
        or_empty(F.array_join(meta["expected_alert_types"], ", ")).alias("expected_alert_types"),
        or_empty(meta["expected_non_alert_type"]).alias("expected_non_alert_type"),
    )
    # The keys that ranges are found from go to the driver, so they hold only how a text begins. Rows that agree in it share a range.
    best = F.desc("organic_similarity")
    return rows.repartitionByRange(best, F.substring("text", 1, 32)).sortWithinPartitions(best, "text")


def clean_strings(df: DataFrame) -> DataFrame:
    """Control characters out of every text column; other columns untouched."""
    return df.select(
        *[clean_control(name).alias(name) if dtype == "string" else F.col(name)
          for name, dtype in df.dtypes]
    )
