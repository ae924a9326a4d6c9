"""Readers. Schemas of JSON inputs are always explicit."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from textloom.sources import workbook

# pandas writes quotes inside a field as two quotes and keeps line breaks.
PANDAS_CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}

ROWS_PER_BATCH = 5000
_SUFFIXES = {
    ".csv": "csv",
    ".txt": "csv",
    ".parquet": "parquet",
    ".jsonl": "json",
    ".json": "json",
    ".xlsx": "excel",
    ".xls": "excel",
    ".pkl": "pickle",
    ".pickle": "pickle",
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for every file system Spark knows, globs included."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm_path)
    return found is not None and len(found) > 0


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def load(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True
) -> DataFrame:
    """Load by suffix: csv, txt, parquet, jsonl, json, xlsx, xls, pkl, pickle.

    ``multiline=False`` lets Spark split big CSV files; use it when no field
    holds a line break. CSV without a schema is read as text columns.
    """
    suffix = suffix_of(path)
    if suffix not in _SUFFIXES:
        raise ValueError(f"cannot read files of kind {suffix or path!r}")
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no file at {path}")
    kind = _SUFFIXES[suffix]
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if kind == "csv":
        reader = spark.read.options(**{**PANDAS_CSV, "multiLine": str(multiline).lower()})
        return (reader.schema(schema) if schema else reader).csv(path)
    if kind == "json":
        if schema is None:
            raise ValueError("a JSON input needs an explicit schema")
        return read_jsonl(spark, path, schema)
    return (read_excel if kind == "excel" else read_pickle)(spark, path, schema)


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as bytes, read by Spark, so any store it knows will do. A folder stands for the files in it."""
    return spark.read.format("binaryFile").load(path).select("content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for content in batch.column("content"):
            yield content.as_py()


def read_pickle(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Pickled frames, one task per file at least; the driver sees only their schema.

    Unpickling runs code from the file: read only files you trust.
    """
    files = _binary_files(spark, path)
    if schema is None:

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for content in _contents(batches):
                arrow = pa.Schema.from_pandas(pd.read_pickle(io.BytesIO(content)), preserve_index=False)
                yield pa.RecordBatch.from_pydict({"schema": [from_arrow_schema(arrow).json()]})

        # One short row per distinct schema. Files that differ are an error, so no column gets lost.
        found = [r["schema"] for r in files.mapInArrow(describe, "schema string").distinct().collect()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} different schemas in {path}; pass the schema to read")
        schema = T.StructType.fromJson(json.loads(found[0]))
    names = schema.names if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).names

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                frame = pd.read_pickle(io.BytesIO(content))[names]
                for start in range(0, len(frame), ROWS_PER_BATCH):
                    yield frame.iloc[start : start + ROWS_PER_BATCH]

    return files.mapInPandas(unpack, schema)


def read_excel(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sheet: int | str = 0, missing: Sequence[str] = workbook.MISSING
) -> DataFrame:
    """One sheet of every workbook at ``path``; the first row names the columns, columns a file lacks are null.

    Without a schema a first pass over the files finds the narrowest type of every column: whole numbers, numbers, truth
    values, moments, else text. ``missing`` are texts that mean null.
    """
    files = _binary_files(spark, path)
    if schema is None:

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for content in _contents(batches):
                names, rows = workbook.table(content, sheet, missing)
                kinds = ["void"] * len(names)
                for row in rows:
                    for i, value in enumerate(row[: len(kinds)]):
                        if kinds[i] != "string" and value is not None:
                            kinds[i] = workbook.merged(kinds[i], workbook.kind_of([value]))
                yield pa.RecordBatch.from_pydict({"columns": [json.dumps(list(zip(names, kinds)))]})

        # One short row per distinct heading.
        kinds: dict[str, str] = {}
        for found in files.mapInArrow(describe, "columns string").distinct().orderBy("columns").collect():
            for name, kind in json.loads(found["columns"]):
                kinds[name] = workbook.merged(kinds.get(name, "void"), kind)
        schema = T.StructType([T.StructField(n, T._parse_datatype_string("string" if k == "void" else k)) for n, k in kinds.items()])
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    fields = to_arrow_schema(schema)

    def cast(values: list, wanted: pa.DataType) -> pa.Array:
        if pa.types.is_string(wanted) or pa.types.is_large_string(wanted):
            return pa.array([workbook.shown(v) for v in values], wanted)
        kind = workbook.kind_of(values)
        if kind == "double":
            values = [None if v is None else float(v) for v in values]
        array = pa.array(values)
        return array.cast(pa.timestamp("us", "UTC")).cast(wanted) if pa.types.is_timestamp(wanted) and wanted.tz else array.cast(wanted)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _contents(batches):
            names, rows = workbook.table(content, sheet, missing)
            places = [names.index(f.name) if f.name in names else None for f in fields]
            while block := list(islice(rows, ROWS_PER_BATCH)):
                columns = [[None if p is None or p >= len(r) else r[p] for r in block] for p in places]
                yield pa.RecordBatch.from_arrays([cast(c, f.type) for c, f in zip(columns, fields)], names=fields.names)

    return files.mapInArrow(unpack, schema)


def read_jsonl(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, skip_missing: bool = False
) -> DataFrame:
    """JSON lines from one path, a glob, or several. Bad lines fail the job; blank ones are skipped.

    ``skip_missing=True`` leaves out paths that do not exist.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    if skip_missing:
        wanted = [p for p in wanted if path_exists(spark, p)]
        if not wanted:
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(wanted)


def spread(scan: DataFrame) -> DataFrame:
    """Give costly per-row work enough tasks when a scan yields only a few.

    For frames read straight from files. Small files make few splits, and a file
    with one row group makes one busy task; such inputs are small, so the extra
    exchange is cheap. Scans with enough splits stay as they are.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= 2 * wanted else scan.repartition(wanted)


def text_column(df: DataFrame, column: str = "comment") -> DataFrame:
    """One column as text without nulls. Nulls go first, so they never become the text 'None'."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(column))


def replicate(df: DataFrame, times: int, row_id: str | None = None, copy: str = "copy") -> DataFrame:
    """Each row ``times`` times with its copy number; no join.

    With ``row_id`` (0..N-1) the ids of the copies become ``copy * N + row_id``,
    the order a repeated concatenation has.
    """
    out = df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(times - 1)).cast("array<bigint>")))
    if row_id is not None:
        n = df.select(F.count("*")).scalar()
        out = out.withColumn(row_id, F.col(copy) * n + F.col(row_id))
    return out


def inline_texts(spark: SparkSession, texts: Sequence[str], times: int = 1) -> DataFrame:
    """A literal list as ``(row_id, text)``, repeated."""
    rows = [(i, t) for i, t in enumerate(texts)]
    base = spark.createDataFrame(rows, "row_id bigint, text string")
    n = len(rows)
    return replicate(base, times).select((F.col("copy") * n + F.col("row_id")).alias("row_id"), "text")


def csv_column(spark: SparkSession, path: str, column: str = "comment", times: int = 1, multiline: bool = True) -> DataFrame:
    """One column of a CSV file, repeated; only that column is parsed. ``multiline=False`` lets Spark split the file."""
    return replicate(load(spark, path, multiline=multiline).select(column), times)
