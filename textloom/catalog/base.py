"""Registry and shared inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.functions.text import WHITESPACE
from textloom.operators.inference import Rule, rule_response
from textloom.operators.parsing import parse_typed
from textloom.schemas import ALERT_TYPES, ALERTS_OUTPUT_SCHEMA
from textloom.sources.readers import spread

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        CATALOG[name] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {sql_text(WHITESPACE)})"


# Trigger syllables of the test texts, one per alert label in order.
PHRASES = [
    "rewh", "orre", "thatin", "ononst", "inoran", "hehely", "orantion", "thble", "thwh",
    "erwh", "ernd", "eror", "attion", "oner", "ouble", "euxan", "paré", "tionré", "schun",
    "ungen", "ción", "idad", "mente", "eauou", "heit", "keit", "ados",
]
_LEVELS = ["low", "moderate", "high"]
RULES = tuple(
    Rule(label, "critical" if label == "mental_health_crisis" else _LEVELS[i % 3], phrase)
    for i, (label, phrase) in enumerate(zip(ALERT_TYPES, PHRASES, strict=True))
)
NON_ALERT_BY_LANG = {
    "en": "neutral_comment",
    "de": "workload_feedback",
    "fr": "positive_feedback",
    "es": "unclear",
}


def by_lang(values: dict[str, str], lang: str = "lang") -> Column:
    return F.coalesce(*[F.when(F.col(lang) == k, F.lit(v)) for k, v in values.items()])


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """One model answer per document.

    The human label gives the verdict, the rules give the spans. Good documents
    answer inside a code fence; documents without a label answer in prose.
    """
    docs = spread(table(spark, folder, "documents"))
    marks = table(spark, folder, "labels")
    joined = docs.join(marks, "doc_id", "left")
    answer = rule_response("text", RULES, F.col("toxic") == 1, by_lang(NON_ALERT_BY_LANG))
    raw = (
        F.when(F.col("toxic").isNull(), F.concat(F.lit("no label for document "), F.col("doc_id").cast("string")))
        .when(F.col("quality") == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .otherwise(answer)
    )
    return joined.select(F.col("doc_id").alias("row_id"), "text", "lang", "source", raw.alias("response"))


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return parse_typed(responses(spark, folder), ALERTS_OUTPUT_SCHEMA).drop("response")


SQL_RULES = "[" + ", ".join(
    f"{{'label': {sql_text(r.label)}, 'severity': {sql_text(r.severity)}, 'phrase': {sql_text(r.phrase)}}}"
    for r in RULES
) + "]"
SQL_NON_ALERT = "CASE d.lang " + " ".join(
    f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in NON_ALERT_BY_LANG.items()
) + " END"
# failed, has_alerts, alerts (label, severity, phrase) and the non-alert class per document.
SQL_RESPONSES = f"""WITH resp AS (
  SELECT d.doc_id AS row_id, d.text, d.lang, d.source,
         l.doc_id IS NULL AS failed,
         CASE WHEN l.doc_id IS NOT NULL THEN l.toxic = 1 END AS has_alerts,
         CASE WHEN l.doc_id IS NOT NULL THEN
           list_filter({SQL_RULES}, lambda r: contains(lower(d.text), r.phrase)) END AS alerts,
         CASE WHEN l.toxic <> 1 THEN {SQL_NON_ALERT} END AS non_alert,
         CASE WHEN l.toxic <> 1 THEN 'no phrase matched' END AS non_alert_reasoning
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""
