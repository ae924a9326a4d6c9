"""Comments in, training data out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from textloom.operators import summaries
from textloom.operators.inference import Backend, infer
from textloom.operators.parsing import first_output, parse_typed
from textloom.operators.prompts import classification_prompt
from textloom.operators.reshape import explode_results, split_failed, training_pairs, unpivot_texts
from textloom.operators.sampling import hash_rank
from textloom.schemas import ALERTS_OUTPUT_SCHEMA
from textloom.session import materialize
from textloom.sources.writers import write_csv, write_training_set


@dataclass
class Classified:
    pairs: DataFrame
    failed: DataFrame
    results: DataFrame
    paths: dict | None = None

    def reports(self) -> dict[str, DataFrame]:
        """Summary tables, each one small."""
        return {
            "summary": summaries.run_summary(self.results),
            "alert_types": summaries.alert_type_histogram(self.results),
            "severities": summaries.severity_histogram(self.results),
            "non_alert_types": summaries.non_alert_histogram(self.results),
            "sources": summaries.source_histogram(self.pairs),
        }


def classify_texts(
    df: DataFrame, engine: Backend | str, text: str = "text", **options
) -> DataFrame:
    """Adds ``parsed`` (null when the answer does not fit the schema). Lazy."""
    prompted = df.withColumn("prompt", classification_prompt(text))
    answered = infer(prompted, engine, schema=ALERTS_OUTPUT_SCHEMA, **options).drop("prompt")
    response = answered.withColumn("response", first_output("outputs")).drop("outputs")
    return parse_typed(response, ALERTS_OUTPUT_SCHEMA)


def run_classification(
    df: DataFrame,
    columns: list[str],
    engine: Backend | str,
    output: str | None = None,
    row_id: str = "row_id",
    prefix: str = "alerts_training",
    **options,
) -> Classified:
    """Unpivot, classify, pair, summarise, save.

    The classified rows go to the shared folder once; every report and file reads
    them from there, so the model runs once per text.
    """
    texts = unpivot_texts(df, columns, row_id)
    classified = classify_texts(texts, engine, **options)
    results = materialize(classified.drop("response"), "classified")
    # Ids follow the hash order of (column, row): dense, and the same on every run.
    from pyspark.sql import functions as F

    keyed = results.withColumn("text_key", F.concat_ws(":", "source_column", "original_row_idx"))
    numbered = materialize(hash_rank(keyed, "text_key", out="row_id"), "numbered")
    pairs = training_pairs(numbered, keep=["source_column", "original_row_idx"])
    good, bad = split_failed(pairs)
    done = Classified(good, bad, results)
    if output:
        done.paths = write_training_set(good, bad, output, prefix)
    return done


def save_exploded(results: DataFrame, path: str, row_id: str = "row_id", text: str = "text") -> str:
    return write_csv(explode_results(results, row_id, text), path)
