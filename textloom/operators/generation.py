"""Plans of generation tasks. Tasks are made on the executors, from ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions.hashing import hash_int, order_key, pick
from textloom.functions.text import literal_array
from textloom.schemas import (
    DIMENSIONS,
    GENERATED_ALERT_TYPES,
    GENERATED_NON_ALERT_TYPES,
    TASK,
)

# The two default shares of example types.
DEFAULT_SHARES = {
    "alert": 0.30,
    "non_alert": 0.25,
    "mixed": 0.15,
    "hard_non_alert": 0.15,
    "hard_alert": 0.15,
}
REMOTE_SHARES = {
    "alert": 0.35,
    "non_alert": 0.25,
    "mixed": 0.15,
    "hard_non_alert": 0.15,
    "hard_alert": 0.10,
}


def quotas(n: int, shares: Mapping[str, float] | None = None) -> dict[str, int]:
    """Whole tasks per example type; what rounding loses goes to ``alert``."""
    shares = shares or DEFAULT_SHARES
    if n < 0 or any(p < 0 for p in shares.values()):
        raise ValueError("the number of tasks and all shares must not be negative")
    counts = {kind: int(n * p) for kind, p in shares.items()}
    short = n - sum(counts.values())
    if short > 0:
        counts["alert"] = counts.get("alert", 0) + short
    return counts


def quota_rows(counts: DataFrame, n: str, shares: Mapping[str, float] | None = None) -> DataFrame:
    """:func:`quotas` for every row of a table of counts: one row per example type."""
    whole = {kind: F.floor(F.col(n) * F.lit(p)).cast("bigint") for kind, p in (shares or DEFAULT_SHARES).items()}
    short = F.greatest(F.col(n) - sum(whole.values()), F.lit(0))
    parts = [F.struct(F.lit(k).alias("example_type"), (c + short if k == "alert" else c).alias("task_count")) for k, c in whole.items()]
    return counts.withColumn("_q", F.explode(F.array(*parts))).select(*counts.columns, "_q.*")


def cycle(values: Sequence[str], i: Column) -> Column:
    return F.element_at(literal_array(values), (i % len(values) + 1).cast("int"))


def dimension_columns(i: Column) -> list[Column]:
    return [cycle(values, i).alias(name) for name, values in DIMENSIONS.items()]


def random_dimensions(
    df: DataFrame, key: str, seed: int | str = 42, given: Sequence[str] = ()
) -> DataFrame:
    """Fill the dimensions a row leaves open by hash; columns in ``given`` keep their values.

    Also draws labels: one alert label, one to three for ``mixed``, and a non-alert label.
    """
    for name, values in DIMENSIONS.items():
        drawn = pick(literal_array(values), key, f"{seed}-{name}")
        df = df.withColumn(name, F.coalesce(F.col(name), drawn) if name in given else drawn)
    kind = F.col("example_type")
    n = F.when(kind == "mixed", hash_int(key, f"{seed}-count") % 3 + 1).otherwise(1).cast("int")
    # A different random order of the labels per row; the first n are the sample.
    ranked = F.array_sort(
        F.transform(
            literal_array(GENERATED_ALERT_TYPES),
            lambda a: F.struct(
                order_key(F.concat(F.col(key).cast("string"), F.lit(":"), a), seed).alias("h"), a.alias("a")
            ),
        )
    )
    labels = F.transform(F.slice(ranked, F.lit(1), n), lambda r: r["a"])
    other = pick(literal_array(GENERATED_NON_ALERT_TYPES), key, f"{seed}-other")
    return df.withColumn("alert_types", F.when(kind.isin("alert", "mixed", "hard_alert"), labels)).withColumn(
        "non_alert_type", F.when(kind.isin("non_alert", "hard_non_alert", "mixed"), other)
    )


def label_columns(i: Column) -> list[Column]:
    """Labels of row i of a type: one alert label, one to three for ``mixed``, one other label."""
    kind = F.col("example_type")
    size = len(GENERATED_ALERT_TYPES)
    several = F.transform(
        F.sequence(F.lit(0), (i % 3).cast("int")),
        lambda j: F.element_at(literal_array(GENERATED_ALERT_TYPES), ((i + j) % size + 1).cast("int")),
    )
    alerts = F.when(kind.isin("alert", "hard_alert"), F.array(cycle(GENERATED_ALERT_TYPES, i))).when(
        kind == "mixed", several
    )
    other = F.when(
        kind.isin("non_alert", "hard_non_alert", "mixed"), cycle(GENERATED_NON_ALERT_TYPES, i)
    )
    return [alerts.alias("alert_types"), other.alias("non_alert_type")]


def tasks_for_rows(df: DataFrame, number: str, example_type: Column) -> DataFrame:
    """One task per row of a frame: the row number cycles every dimension."""
    i = F.col(number)
    typed = df.withColumn("example_type", example_type)
    return typed.select("*", *dimension_columns(i), *label_columns(i))


def task_queue(
    spark: SparkSession, n: int, shares: Mapping[str, float] | None = None, seed: int | str = 42
) -> DataFrame:
    """All tasks of a run. ``queue_key`` orders them in a seeded shuffle; ids are ``0..n-1``."""
    from functools import reduce

    parts, start = [], 0
    for kind, count in quotas(n, shares).items():
        if not count:
            continue
        ids = spark.range(start, start + count).select(
            F.col("id").alias("task_id"), (F.col("id") - start).alias("i"), F.lit(kind).alias("example_type")
        )
        parts.append(ids)
        start += count
    if not parts:
        return spark.createDataFrame([], TASK).withColumn("queue_key", F.lit(""))
    ids = reduce(DataFrame.unionByName, parts)
    i = F.col("i")
    return ids.select(
        "task_id",
        "example_type",
        *dimension_columns(i),
        *label_columns(i),
        order_key("task_id", seed).alias("queue_key"),
    )


def targeted_tasks(
    labels: DataFrame, n: int = 10, difficulty: str | None = None, first_id: int = 0
) -> DataFrame:
    """n tasks for each row of ``(dimension, value)``, dimension ``alert_types`` or ``non_alert_types``.

    A ``subtle`` difficulty turns the example type into its hard variant. Ids follow
    ``(dimension, value)`` order; there are at most as many labels as the label sets hold.
    """
    from pyspark.sql import Window as W

    alert = F.col("dimension") == "alert_types"
    prefix = "hard_" if difficulty == "subtle" else ""
    i = F.col("i")
    ranked = labels.withColumn("_l", F.row_number().over(W.orderBy("dimension", "value")) - 1)
    rows = ranked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dims = [
        F.lit(difficulty).alias(name) if name == "difficulty" and difficulty else cycle(values, i).alias(name)
        for name, values in DIMENSIONS.items()
    ]
    return rows.select(
        (F.col("_l") * n + i + first_id).cast("bigint").alias("task_id"),
        F.when(alert, F.lit(f"{prefix}alert")).otherwise(F.lit(f"{prefix}non_alert")).alias("example_type"),
        *dims,
        F.when(alert, F.array("value")).alias("alert_types"),
        F.when(~alert, F.col("value")).alias("non_alert_type"),
    )
