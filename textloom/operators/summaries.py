"""Counts and reports. Every aggregate combines on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.session import materialize


def percent(part: Column, total: Column) -> Column:
    """Percentage; null on an empty total."""
    return F.try_divide(part * F.lit(100.0), total)


def run_summary(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Totals, success and failure, alert share and number of alerts, in one pass.

    ``total_alerts`` counts the spans of every parsed row, whatever its verdict.
    """
    r = F.col(parsed)
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(r.isNotNull()).alias("successful"),
        F.count_if(r.isNull()).alias("failed"),
        F.count_if(r["has_alerts"]).alias("with_alerts"),
        F.count_if(~r["has_alerts"]).alias("without_alerts"),
        F.coalesce(F.sum(F.when(r.isNotNull(), F.size(r["alerts"])).cast("bigint")), F.lit(0)).alias(
            "total_alerts"
        ),
    )
    return counts.select(
        "*",
        percent(F.col("successful"), F.col("total")).alias("successful_pct"),
        percent(F.col("failed"), F.col("total")).alias("failed_pct"),
        percent(F.col("with_alerts"), F.col("successful")).alias("with_alerts_pct"),
        percent(F.col("without_alerts"), F.col("successful")).alias("without_alerts_pct"),
    )


def histogram(df: DataFrame, column: str | Column, name: str, top: int | None = None) -> DataFrame:
    """Values and counts, most frequent first; ties in value order."""
    c = F.col(column) if isinstance(column, str) else column
    counts = df.select(c.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count("*").alias("n")
    )
    ordered = counts.orderBy(F.desc("n"), name)
    return ordered.limit(top) if top is not None else ordered


def _alerts(df: DataFrame, parsed: str) -> DataFrame:
    r = F.col(parsed)
    return df.where(r["has_alerts"]).select(F.inline(r["alerts"]))


def alert_type_histogram(df: DataFrame, parsed: str = "parsed", top: int | None = 10) -> DataFrame:
    return histogram(_alerts(df, parsed), "alert_type", "alert_type", top)


def severity_histogram(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    return histogram(_alerts(df, parsed), "severity", "severity")


def non_alert_histogram(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    r = F.col(parsed)
    named = df.where(~r["has_alerts"] & (r["non_alert_classification"] != ""))
    return histogram(named, r["non_alert_classification"], "non_alert_classification")


def source_histogram(df: DataFrame, column: str = "source_column") -> DataFrame:
    """Counts per source; empty when there is just one source, which needs no report."""
    counts = histogram(df, column, column)
    sources = df.select(F.count_distinct(column)).scalar()
    return counts.where(sources > 1)


# Report names of the counted dimensions.
COVERAGE_DIMENSIONS = {
    "example_types": "example_type",
    "industries": "industry",
    "roles": "role",
    "tones": "tone",
    "writing_styles": "writing_style",
    "difficulties": "difficulty",
    "demographics": "demographic",
}


def coverage(
    df: DataFrame,
    scalars: Mapping[str, Column | str],
    arrays: Mapping[str, Column | str] | None = None,
    count_null: Sequence[str] = (),
) -> DataFrame:
    """``(dimension, value, n)`` for all dimensions in one scan and one shuffle.

    Null and empty values are left out, unless the dimension is in ``count_null``.
    """
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    def pairs(name, values):
        return F.transform(
            values, lambda v: F.struct(F.lit(name).alias("dimension"), v.cast("string").alias("value"))
        )

    sets = [pairs(name, F.array(col(c))) for name, c in scalars.items()]
    empty = F.array().cast("array<string>")
    sets += [pairs(name, F.coalesce(col(c), empty)) for name, c in (arrays or {}).items()]
    # The outer form: plain inline would compute the arrays twice, once for an inferred filter.
    rows = df.select(F.inline_outer(F.concat(*sets))).where(F.col("dimension").isNotNull())
    given = F.col("value").isNotNull() & (F.col("value") != "")
    rows = rows.where(given | F.col("dimension").isin(list(count_null)))
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def example_coverage(examples: DataFrame, count_null_difficulty: bool = False) -> DataFrame:
    """Coverage of generated examples over their nine dimensions."""
    meta = F.col("metadata")
    scalars = {name: meta[field] for name, field in COVERAGE_DIMENSIONS.items()}
    scalars["non_alert_types"] = meta["expected_non_alert_type"]
    return coverage(
        examples, scalars, {"alert_types": meta["expected_alert_types"]},
        ["difficulties"] if count_null_difficulty else [],
    )


def ranked_within(df: DataFrame, group: str, order: Sequence[Column], out: str) -> DataFrame:
    """1-based rank inside each group, spread over many tasks even where one group has most rows.

    Rows are range-partitioned and sorted, so a group lies in neighbouring partitions. A row's place in
    its partition is known from its running number; what lies before a partition comes from one count per partition and group.
    """
    plain = df.select("*", F.struct(group).alias("_g"))
    ranged = plain.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    parts = ranged.groupBy("_g", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition and group.
    starts = parts.select("_g", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = ranged.withColumn("_part", part).join(starts, ["_g", "_part"])
    return joined.select(*df.columns, (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias(out))


def coverage_report(
    counts: DataFrame, total: DataFrame, top: Mapping[str, int] | None = None
) -> DataFrame:
    """Rank and share of every value; dimensions named in ``top`` keep their first k.

    ``counts`` has one row per label of a dimension, ``total`` is the frame whose
    rows are the whole.
    """
    n_total = total.select(F.count("*")).scalar()
    ranked = ranked_within(counts, "dimension", [F.desc("n"), F.asc("value")], "rank")
    for name, k in (top or {}).items():
        ranked = ranked.where((F.col("dimension") != name) | (F.col("rank") <= k))
    return ranked.withColumn("share_pct", percent(F.col("n"), n_total))


def missing_values(counts: DataFrame, universe: Mapping[str, Sequence[str]] | DataFrame) -> DataFrame:
    """``(dimension, value)`` of the universe that were never seen.

    The universe is a set of label lists or a ``(dimension, value)`` frame.
    """
    wanted = universe
    if not isinstance(universe, DataFrame):
        rows = [(name, value) for name, values in universe.items() for value in values]
        wanted = counts.sparkSession.createDataFrame(rows, "dimension string, value string")
    return wanted.join(counts.select("dimension", "value"), ["dimension", "value"], "left_anti")


def topics_with_at_least(df: DataFrame, topic: str, n: int = 5) -> DataFrame:
    return df.groupBy(topic).agg(F.count("*").alias("n")).where(F.col("n") >= n)


def top_k(df: DataFrame, score: str, key: str, k: int = 10) -> DataFrame:
    """Best k; on equal scores the higher key first."""
    return df.orderBy(F.desc(score), F.desc(key)).limit(k)


def lowest_groups(df: DataFrame, metric: str, key: str, k: int = 3) -> DataFrame:
    return df.orderBy(F.asc(metric), F.asc(key)).limit(k)


def length_bin(text: Column | str, size: int = 20) -> Column:
    """Lower end of the length bin, ``floor(length / size) * size``."""
    return (F.floor(F.length(text) / F.lit(size)) * size).cast("int")


def throughput(df: DataFrame, name: str = "throughput") -> tuple[DataFrame, object]:
    """Count rows while they flow. Read ``observation.get['rows']`` after the action."""
    from pyspark.sql import Observation

    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
