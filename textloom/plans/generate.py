"""Plan, generate, check coverage, fill the gaps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.generation import targeted_tasks, task_queue
from textloom.operators.inference import Backend, infer
from textloom.operators.parsing import first_output, parse_typed
from textloom.operators.prompts import generation_prompt
from textloom.operators.reshape import example_records
from textloom.operators.summaries import example_coverage, missing_values
from textloom.schemas import (
    GENERATED_ALERT_TYPES,
    GENERATED_EXAMPLE_SCHEMA,
    GENERATED_NON_ALERT_TYPES,
)
from textloom.session import materialize

UNIVERSE = {"alert_types": GENERATED_ALERT_TYPES, "non_alert_types": GENERATED_NON_ALERT_TYPES}


def run_tasks(tasks: DataFrame, engine: Backend | str, **options) -> DataFrame:
    """Tasks to example records; failed ones are dropped."""
    answered = infer(generation_prompt(tasks), engine, schema=GENERATED_EXAMPLE_SCHEMA, **options)
    texts = answered.withColumn("response", first_output("outputs")).drop("outputs", "prompt")
    return example_records(parse_typed(texts, GENERATED_EXAMPLE_SCHEMA))


def generate(
    spark: SparkSession,
    n: int,
    engine: Backend | str,
    shares: Mapping[str, float] | None = None,
    per_gap: int = 10,
    seed: int | str = 42,
    **options,
) -> DataFrame:
    """n examples plus ``per_gap`` for every label none of them covers.

    Each part is written to the shared folder before it is read again.
    """
    tasks = task_queue(spark, n, shares, seed).drop("queue_key")
    examples = materialize(run_tasks(tasks, engine, **options), "examples")
    missing = missing_values(example_coverage(examples), UNIVERSE)
    gaps = targeted_tasks(missing, per_gap, first_id=n)
    filled = materialize(run_tasks(gaps, engine, **options), "gap-fill")
    return examples.unionByName(filled)
