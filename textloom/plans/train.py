"""From pairs of input and answer to token ids for fine-tuning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from textloom.operators.prompts import training_text
from textloom.operators.sampling import hash_sample, split_train_validation
from textloom.operators.tokens import byte_tokens, tokenize


def training_set(
    pairs: DataFrame, key: str, cap: int | None = None, share: float = 0.02, max_length: int = 2048,
    encode: Callable[[list[str]], list[list[int]]] = byte_tokens, seed: int | str = 42,
) -> DataFrame:
    """Rows ``(key, split, text, input_ids, labels, n_tokens)`` from ``(key, input, output)``.

    ``cap`` keeps the first rows in hash order, ``share`` of the rest is validation.
    ``n_tokens`` is the length before ids are cut at ``max_length``.
    """
    rows = pairs if cap is None else hash_sample(pairs, key, cap, seed)
    rows = rows.select(key, training_text("input", "output").alias("text"))
    train, validation = split_train_validation(rows, key, share, seed)
    both = train.withColumn("split", F.lit("train"))
    if validation is not None:
        both = both.unionByName(validation.withColumn("split", F.lit("validation")))
    return tokenize(both.withColumn("body", F.col("text")), encode, "body", max_length)
