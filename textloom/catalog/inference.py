"""Batch inference with offline backends."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog.base import RULES, SQL_RULES, by_lang, query, table
from textloom.functions.jsonschema import schema_key
from textloom.operators import inference, parsing
from textloom.operators.prompts import classification_prompt
from textloom.schemas import ALERTS_OUTPUT_SCHEMA
from textloom.sources.readers import spread


def _docs(spark, folder):
    return spread(table(spark, folder, "documents")).select("doc_id", "lang", "text")


@query(
    "i1_unconstrained",
    f"""SELECT doc_id, 1 AS n_outputs, CASE WHEN len(a) = 0 THEN 'no alert' ELSE array_to_string(list_transform(a, lambda x: x.label), ', ') END
          AS answer, NULL::VARCHAR AS error
        FROM (SELECT doc_id, list_filter({SQL_RULES}, lambda r: contains(lower(text), r.phrase)) AS a FROM documents)""",
)
def i1(spark, folder):
    out = inference.infer(_docs(spark, folder), inference.RuleBackend(RULES), prompt="text")
    return out.select("doc_id", F.size("outputs").alias("n_outputs"), parsing.first_output("outputs").alias("answer"), "error")


@query(
    "i3_runtime_schema",
    f"""SELECT doc_id, len(a) > 0 AS has_alerts, len(a) AS n_alerts,
               array_to_string(list_transform(a, lambda x: x.label), ',') AS alert_types
        FROM (SELECT doc_id, list_filter({SQL_RULES}, lambda r: contains(lower(text), r.phrase)) AS a FROM documents)""",
)
def i3(spark, folder):
    prompted = _docs(spark, folder).select("doc_id", classification_prompt("text").alias("prompt"))
    out = inference.infer(prompted, inference.RuleBackend(RULES), schema=ALERTS_OUTPUT_SCHEMA)
    answered = out.select("doc_id", parsing.first_output("outputs").alias("response"))
    r = F.col("parsed")
    return parsing.parse_typed(answered, ALERTS_OUTPUT_SCHEMA).select(
        "doc_id", r["has_alerts"].alias("has_alerts"), F.size(r["alerts"]).cast("bigint").alias("n_alerts"),
        F.array_join(r["alerts"]["alert_type"], ",").alias("alert_types"),
    )


LABELS_SCHEMA = {"title": "Labels", "type": "object", "required": ["labels"], "properties": {"labels": {"type": "array", "items": {"type": "string"}}}}
FLAG_SCHEMA = {"title": "Flag", "type": "object", "required": ["flagged"], "properties": {"flagged": {"type": "boolean"}}}
SQL_FOUND = f"(SELECT doc_id, lang, list_transform(list_filter({SQL_RULES}, lambda r: contains(lower(text), r.phrase)), lambda x: x.label) AS a FROM documents)"


@query("i4_json_schema", f"SELECT doc_id, array_to_string(a, ',') AS labels FROM {SQL_FOUND}")
def i4(spark, folder):
    out = inference.infer(_docs(spark, folder), inference.RuleBackend(RULES), prompt="text", schema=LABELS_SCHEMA)
    parsed = parsing.parse_typed(out.withColumn("response", parsing.first_output("outputs")), LABELS_SCHEMA)
    return parsed.select("doc_id", F.array_join(F.col("parsed")["labels"], ",").alias("labels"))


def _with_schema(spark, folder):
    """English documents ask for all labels, French ones for a flag, German ones for everything, others for plain words."""
    texts = by_lang({"en": schema_key(LABELS_SCHEMA), "fr": schema_key(FLAG_SCHEMA), "de": schema_key(ALERTS_OUTPUT_SCHEMA)})
    return _docs(spark, folder).withColumn("json_schema", texts)


@query(
    "i5_heterogeneous",
    f"""SELECT doc_id, CASE WHEN lang = 'en' THEN array_to_string(a, ',') END AS labels, CASE WHEN lang = 'fr' THEN len(a) > 0 END AS flagged,
              CASE WHEN lang = 'de' THEN len(a) > 0 END AS has_alerts,
              CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN CASE WHEN len(a) = 0 THEN 'no alert' ELSE array_to_string(a, ', ') END END AS free_text
        FROM {SQL_FOUND}""",
)
def i5(spark, folder):
    out = inference.infer(_with_schema(spark, folder), inference.RuleBackend(RULES), prompt="text", schema_column="json_schema")
    answer = parsing.first_output("outputs")
    labels = F.from_json(F.get_json_object(answer, "$.labels"), "array<string>")
    return out.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.array_join(labels, ",")).alias("labels"),
        F.when(F.col("lang") == "fr", F.get_json_object(answer, "$.flagged").cast("boolean")).alias("flagged"),
        F.when(F.col("lang") == "de", F.get_json_object(answer, "$.has_alerts").cast("boolean")).alias("has_alerts"),
        F.when(F.col("json_schema").isNull(), answer).alias("free_text"),
    )


@query(
    "i6_schema_groups",
    """SELECT lang IN ('en', 'de') AS typed, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1""",
)
def i6(spark, folder):
    # The same schema with its keys in two orders is one group.
    texts = by_lang({"en": '{"type":"object","title":"A"}', "de": '{"title": "A", "type": "object"}'})
    keyed = _docs(spark, folder).select("doc_id", inference.canonical_schema(texts).alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return groups.select((F.col("key") != "no_schema").alias("typed"), "n", "first_id")


@query(
    "i14_option_merge",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS temperature,
              CASE WHEN role = 'user' THEN 2000.0::DOUBLE ELSE 1000.0::DOUBLE END AS max_tokens,
              0.95::DOUBLE AS top_p FROM conversations""",
)
def i14(spark, folder):
    def literal(options):
        return F.create_map(*[F.lit(x) for k, v in options.items() for x in (k, float(v))])

    override = F.when(F.col("role") == "user", literal({"temperature": 0.5, "max_tokens": 2000})).otherwise(
        F.create_map().cast("map<string,double>")
    )
    merged = inference.merge_options(literal(inference.GUIDED.merged()), override)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", merged.alias("o"))
    return turns.select("conv_id", "turn", *[F.col("o")[k].alias(k) for k in ("temperature", "max_tokens", "top_p")])


@query(
    "i22_native_rules",
    f"""SELECT doc_id, len(list_filter({SQL_RULES}, lambda r: contains(lower(text), r.phrase))) AS n_alerts FROM documents""",
)
def i22(spark, folder):
    answered = _docs(spark, folder).select("doc_id", inference.rule_response("text", RULES).alias("response"))
    parsed = parsing.parse_typed(answered, ALERTS_OUTPUT_SCHEMA)
    return parsed.select("doc_id", F.size(F.col("parsed")["alerts"]).cast("bigint").alias("n_alerts"))
