"""Reproducible sampling, ranking and splitting without a global sort.

Rows are ordered by the MD5 of ``seed:key``. The hash is uniform, so a hex prefix
cuts the rows into even ranges: counting per prefix locates any rank, and no step
ever brings the rows together in one task. ``key`` must identify the row; a key
shared by many rows would share one hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.hashing import hash_int, order_key

PREFIX_DIGITS = 3  # 4096 ranges
SMALL_RANGE = 10_000
SALTS = 64
RANGE_ROWS = 100_000


def hash_threshold(df: DataFrame, key: str, n: int, seed: int | str = 42) -> str | None:
    """Largest hash among the first ``n`` rows in hash order; null when n covers all rows.

    Narrows one prefix range at a time. Each step returns at most 4096 counts to
    the driver, the last one at most ``SMALL_RANGE`` hashes.
    """
    hashes = df.select(order_key(key, seed).alias("h"))
    prefix, wanted, whole = "", n, True
    while True:
        inside = hashes.where(F.col("h").startswith(prefix)) if prefix else hashes
        digits = len(prefix) + PREFIX_DIGITS
        ranges = inside.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.count("*").alias("n"))
        counts = sorted((r["p"], r["n"]) for r in ranges.collect())
        if whole and sum(c for _, c in counts) <= n:
            return None
        whole = False
        for name, count in counts:
            if wanted <= count:
                prefix = name
                break
            wanted -= count
        if count <= SMALL_RANGE or digits >= 30:
            last = inside.where(F.col("h").startswith(prefix)).orderBy("h").limit(wanted)
            return last.agg(F.max("h")).first()[0]


def hash_sample(df: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """The n rows first in hash order, as a plain filter; all rows when there are no more than n."""
    if n <= 0:
        return df.where(F.lit(False))
    limit = hash_threshold(df, key, n, seed)
    return df if limit is None else df.where(order_key(key, seed) <= limit)


def split_train_validation(
    df: DataFrame, key: str, share: float = 0.02, seed: int | str = 42
) -> tuple[DataFrame, DataFrame | None]:
    """Exact split: ``ceil(share * n)`` validation rows. A share of 0 gives no validation set."""
    if share <= 0:
        return df, None
    n = math.ceil(share * df.count())
    limit = hash_threshold(df, key, n, seed) if n else ""
    if limit is None:
        return df.where(F.lit(False)), df
    h = order_key(key, seed)
    return df.where(h > limit), df.where(h <= limit)


def hash_rank(df: DataFrame, key: str, seed: int | str = 42, out: str = "hash_rank") -> DataFrame:
    """0-based position in hash order.

    Rank inside a prefix range plus the number of rows in earlier ranges. There are as many
    ranges as keep one near ``RANGE_ROWS`` rows, so tasks stay small at any size.
    """
    n = df.count()
    digits = next(d for d in range(1, 15) if n <= RANGE_ROWS * 16**d)
    hashed = df.withColumn("_h", order_key(key, seed)).withColumn("_p", F.substring("_h", 1, digits))
    sizes = (
        df.select(F.substring(order_key(key, seed), 1, digits).alias("_p"))
        .groupBy("_p").agg(F.count("*").alias("_n"))
    )
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_p").orderBy("_h", key)
    ranked = hashed.withColumn("_r", F.row_number().over(inside)).join(starts, "_p")
    return ranked.withColumn(out, (F.col("_start") + F.col("_r") - 1).cast("bigint")).drop(
        "_h", "_p", "_r", "_start"
    )


def group_sample(
    df: DataFrame, group: str, key: str, n: int = 1000, seed: int | str = 42
) -> DataFrame:
    """Per group the first n rows in hash order.

    Ranked within ``SALTS`` parts of a group first, so one group with most of the rows is cut
    down in many tasks; what meets in one task is ``SALTS * n`` rows at most.
    """
    order = [order_key(key, seed), key]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    part = salted.withColumn("_r", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order)))
    kept = part.where(F.col("_r") <= n).drop("_r", "_salt")
    ranked = kept.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_r") <= n).drop("_r")


def shuffled(df: DataFrame, key: str, seed: int | str = 42) -> DataFrame:
    """Seeded shuffle: a range-partitioned sort by hash."""
    return df.orderBy(order_key(key, seed), key)


def random_reference(
    inputs: DataFrame, references: DataFrame, input_key: str, reference_key: str, seed: int | str = 42
) -> DataFrame:
    """One pseudo-random reference row per input row, by an equi-join on position."""
    n = references.select(F.count("*")).scalar()
    ranked = hash_rank(references, reference_key, seed, "_pos")
    drawn = inputs.withColumn("_pos", hash_int(input_key, f"{seed}-draw") % n)
    return drawn.join(ranked, "_pos").drop("_pos")


def keep_first(df: DataFrame, by: str, order: str) -> DataFrame:
    """First row per value of ``by``.

    The key that is sorted and shuffled is a 128-bit digest with the length in place of the value, so long
    texts are never compared; two values count as equal where both agree. Copies are dropped on the map side before the shuffle.
    """
    whole = F.col(by).cast("string")
    keyed = df.withColumn("_d", F.coalesce(F.concat(F.md5(whole), F.length(whole).cast("string")), F.lit("")))
    window = W.partitionBy("_d").orderBy(order)
    return keyed.withColumn("_r", F.row_number().over(window)).where(F.col("_r") == 1).drop("_r", "_d")


def cycle_to(df: DataFrame, key: str, n: int = 128, seed: int | str = 42) -> DataFrame:
    """Repeat the list in key order until n rows, cut, shuffle by seed.

    Adds ``position`` (place in the repeated list) and ``shuffled_position``. Only
    the first n rows of the list can appear, so at most n rows are ranked.
    """
    head = df.orderBy(key).limit(n)
    by_key = head.withColumn("_i", F.row_number().over(W.orderBy(key)) - 1)
    size = head.select(F.count("*")).scalar()
    steps = F.sequence(F.col("_i").cast("bigint"), F.lit(n - 1).cast("bigint"), size)
    cycled = by_key.withColumn("position", F.explode(steps)).drop("_i")
    order = W.orderBy(order_key("position", seed), "position")
    return cycled.withColumn("shuffled_position", F.row_number().over(order) - 1)


def steps_columns(n: Column, batch: int, epochs: int = 1) -> list[Column]:
    """:func:`training_steps` for a column of row counts."""
    per_epoch = F.floor(n / batch).cast("bigint")
    return [F.lit(batch).alias("effective_batch"), per_epoch.alias("steps_per_epoch"), (per_epoch * epochs).alias("total_steps")]


def training_steps(
    n: int, per_device: int = 8, accumulation: int = 2, devices: int = 1, epochs: int = 1
) -> dict:
    """Effective batch, steps per epoch and total steps."""
    batch = per_device * accumulation * devices
    return {"effective_batch": batch, "steps_per_epoch": n // batch, "total_steps": n // batch * epochs}
