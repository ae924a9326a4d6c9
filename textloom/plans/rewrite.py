"""Rewrite comments in the style of reference comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.functions.text import length_between, or_empty, strip_ws
from textloom.operators.inference import Backend, infer
from textloom.operators.parsing import first_output, parse_typed
from textloom.operators.prompts import column_mapping, rewrite_prompt
from textloom.operators.reshape import annotation_paths, explode_annotations
from textloom.operators.sampling import keep_first, random_reference
from textloom.schemas import REWRITE_SCHEMA
from textloom.sources.readers import replicate

def project_filter(df: DataFrame, pattern: str | None, column: str = "project_ids") -> DataFrame:
    """Rows whose ids match the pattern; None keeps every row."""
    return df if pattern is None else df.where(F.col(column).rlike(pattern))


def prepare_inputs(df: DataFrame, times: int = 5, row_id: str = "row_id") -> DataFrame:
    renamed = column_mapping(df, {"text": "input_comment", "comment": "input_comment"})
    return replicate(renamed, times, row_id).drop("copy")


def prepare_references(df: DataFrame, project: str | None = None, row_id: str = "row_id") -> DataFrame:
    """Reference comments of usable length with their paths, one row per comment."""
    rows = column_mapping(project_filter(df, project), {"text": "reference_comment"})
    rows = rows.where(length_between("reference_comment"))
    with_paths = annotation_paths(explode_annotations(rows))
    order = with_paths.withColumn("_order", F.struct(row_id, "annotation_pos"))
    return keep_first(order, "reference_comment", "_order").drop("_order")


def rewrite_prompts(inputs: DataFrame, references: DataFrame, row_id: str = "row_id", seed: int | str = 42) -> DataFrame:
    """Input rows with the reference drawn for each (``ref_id``, ``reference_comment``) and the ``prompt``."""
    refs = references.select(F.col(row_id).alias("ref_id"), "reference_comment")
    paired = random_reference(inputs, refs, row_id, "ref_id", seed)
    return paired.withColumn("prompt", rewrite_prompt("reference_comment", strip_ws("input_comment")))


def rewrite(
    inputs: DataFrame, references: DataFrame, engine: Backend | str, row_id: str = "row_id",
    seed: int | str = 42, **options,
) -> DataFrame:
    """Input rows with ``reference_comment``, ``prompt`` and ``rewritten_comment`` (empty on failure)."""
    columns = inputs.columns
    answered = infer(rewrite_prompts(inputs, references, row_id, seed), engine, schema=REWRITE_SCHEMA, **options)
    parsed = parse_typed(answered.withColumn("response", first_output("outputs")), REWRITE_SCHEMA)
    return parsed.select(
        *columns, "reference_comment", "prompt",
        or_empty(F.col("parsed")["rewritten_comment"]).alias("rewritten_comment"),
    )
