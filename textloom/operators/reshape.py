"""Nested results to flat rows and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import is_blank, normalize_path, or_empty, strip_ws, truncate
from textloom.operators.parsing import parse_annotations, training_output
from textloom.schemas import PARSE_FAILED


def available_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of the wanted columns the frame has; none at all is an error."""
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError(
            f"the table has none of {wanted}; it has {df.columns}"
        )
    return found


def unpivot_texts(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """One row per text: ``(original_row_idx, source_column, text)``, stripped, blanks dropped.

    ``column_pos`` gives the column-major order: sort by ``(column_pos, original_row_idx)``.
    """
    columns = available_columns(df, columns)
    long = df.select(row_id, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        row_id, columns, "source_column", "text"
    )
    names = F.array(*[F.lit(c) for c in columns])
    return long.where(~is_blank("text")).select(
        F.col(row_id).alias("original_row_idx"),
        "source_column",
        (F.array_position(names, F.col("source_column")) - 1).cast("int").alias("column_pos"),
        strip_ws("text").alias("text"),
    )


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Strip the text and drop empty and ``nan`` rows."""
    return df.where(~is_blank(text)).withColumn(text, strip_ws(text))


def text_id(row_id: Column | str) -> Column:
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.concat(F.lit("text_"), (c + 1).cast("string"))


def explode_results(
    df: DataFrame, row_id: str = "row_id", text: str = "text", parsed: str = "parsed"
) -> DataFrame:
    """One row per alert, one per text without alerts, one per failed text; a single scan.

    A result that claims alerts but lists none gives no row, and the spans of a
    result that claims none are ignored.
    """
    r = F.col(parsed)
    null_text = F.lit(None).cast("string")

    def line(number, total, alert_type, severity, excerpt, reasoning, other, other_reasoning, flag):
        return F.struct(
            flag.cast("boolean").alias("has_alerts"),
            number.cast("int").alias("alert_number"),
            total.cast("int").alias("total_alerts"),
            alert_type.alias("alert_type"),
            severity.alias("severity"),
            excerpt.alias("excerpt"),
            reasoning.alias("reasoning"),
            other.alias("non_alert_classification"),
            other_reasoning.alias("non_alert_reasoning"),
            F.lit(True).alias("_row"),
        )

    none = F.lit(None)
    failed = line(none, none, *[null_text] * 5, F.lit(PARSE_FAILED), none)
    quiet = line(
        none, F.lit(0), *[null_text] * 4,
        r["non_alert_classification"], r["non_alert_reasoning"], F.lit(False),
    )
    alerts = F.transform(
        r["alerts"],
        lambda a, i: line(
            i + 1, F.size(r["alerts"]), a["alert_type"], a["severity"], a["excerpt"],
            a["reasoning"], null_text, null_text, F.lit(True),
        ),
    )
    lines = F.when(r.isNull(), F.array(failed)).when(r["has_alerts"], alerts).otherwise(F.array(quiet))
    # The outer form builds the lines once; plain inline repeats them in an inferred filter.
    rows = df.select(
        text_id(row_id).alias("text_id"), F.col(text).alias("original_text"), F.inline_outer(lines)
    )
    return rows.where("_row").drop("_row")


def training_pairs(
    df: DataFrame, row_id: str = "row_id", text: str = "text", parsed: str = "parsed",
    keep: list[str] | None = None,
) -> DataFrame:
    """Stripped non-blank texts with their training output; ``error`` is set where parsing failed.

    Source columns named in ``keep`` travel with their own row.
    """
    kept = [c for c in (keep or []) if c in df.columns]
    return (
        df.where(~is_blank(text))
        .select(
            F.col(row_id).alias("id"),
            strip_ws(text).alias("input"),
            *kept,
            training_output(parsed).alias("output"),
            F.col(parsed).alias("output_parsed"),
            F.when(F.col(parsed).isNull(), F.lit(PARSE_FAILED)).alias("error"),
        )
    )


def split_failed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successful, failed)."""
    good = pairs.where(F.col("error").isNull()).drop("error")
    bad = pairs.where(F.col("error").isNotNull()).drop("output", "output_parsed")
    return good, bad


def qa_rows(pairs: DataFrame) -> DataFrame:
    """Flat review rows with empty columns for the reviewer."""
    r = F.col("output_parsed")
    shown = r["has_alerts"] & (F.size(r["alerts"]) > 0)

    def joined(name: str, separator: str) -> Column:
        parts = F.transform(r["alerts"], lambda a: a[name])
        return F.when(shown, F.array_join(parts, separator)).otherwise(F.lit(""))

    source = F.col("source_column") if "source_column" in pairs.columns else F.lit(None).cast("string")
    return pairs.select(
        "id",
        truncate("input", 500).alias("input"),
        r["has_alerts"].alias("has_alerts"),
        F.when(shown, F.size(r["alerts"])).otherwise(F.lit(0)).alias("num_alerts"),
        joined("alert_type", ", ").alias("alert_types"),
        joined("severity", ", ").alias("severities"),
        truncate(joined("excerpt", " | "), 300).alias("excerpts"),
        r["non_alert_classification"].alias("non_alert_classification"),
        truncate(or_empty(r["non_alert_reasoning"]), 200).alias("non_alert_reasoning"),
        source.alias("source_column"),
        F.lit("").alias("qa_status"),
        F.lit("").alias("qa_notes"),
    )


def explode_annotations(df: DataFrame, annotations: str = "annotations") -> DataFrame:
    """One row per annotation with its ``annotation_pos``; a row without any stays, with null."""
    parsed = df.withColumn("_list", parse_annotations(annotations))
    return parsed.select(
        "*", F.posexplode_outer("_list").alias("annotation_pos", "parsed_annotations")
    ).drop("_list")


def annotation_paths(df: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Path columns from ``parsed_annotations``.

    ``drop_empty=False`` keeps rows without a path.
    """
    out = df.withColumn("original_target_path", or_empty("parsed_annotations"))
    out = (
        out.withColumn("reference_target_path", F.col("original_target_path"))
        .withColumn("target_path_lower", F.lower("original_target_path"))
        .withColumn("path_elements_sorted", normalize_path("original_target_path"))
    )
    return out.where(F.col("target_path_lower") != "") if drop_empty else out


def example_records(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Tasks with parsed answers to ``(row_id, text, metadata)``; failed tasks are dropped."""
    from textloom.functions.text import strip_quotes
    from textloom.schemas import DIMENSIONS

    meta = F.struct(
        F.col("example_type"),
        F.col("alert_types").alias("expected_alert_types"),
        F.col("non_alert_type").alias("expected_non_alert_type"),
        *[F.col(d) for d in DIMENSIONS],
    )
    return df.where(F.col(parsed).isNotNull()).select(
        F.col("task_id").alias("row_id"),
        strip_quotes(F.col(parsed)["text"]).alias("text"),
        meta.alias("metadata"),
    )
