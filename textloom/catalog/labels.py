"""Parsing, validation, reshaping and summaries of model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog.base import SQL_RESPONSES, classified, query, sql_strip, table
from textloom.operators import parsing, reshape, summaries
from textloom.session import materialize
from textloom.sources.readers import spread

TEXT = sql_strip("text")


@query(
    "j3_typed_parse",
    SQL_RESPONSES
    + """SELECT row_id, has_alerts, len(alerts) AS n_alerts,
           array_to_string(list_transform(alerts, lambda a: concat(a.label, '/', a.severity, '/', a.phrase)), ',') AS spans,
           non_alert AS non_alert_classification FROM resp""",
)
def j3(spark, folder):
    r = F.col("parsed")
    spans = F.transform(r["alerts"], lambda a: F.concat_ws("/", a["alert_type"], a["severity"], a["excerpt"]))
    return classified(spark, folder).select(
        "row_id",
        r["has_alerts"].alias("has_alerts"),
        F.when(r.isNotNull(), F.size(r["alerts"])).cast("bigint").alias("n_alerts"),
        F.array_join(spans, ",").alias("spans"),
        r["non_alert_classification"].alias("non_alert_classification"),
    )


def _events(spark, folder):
    """Event properties as a model would answer: bare, fenced, or followed by chatter."""
    kind = F.col("event_type")
    return spread(table(spark, folder, "events")).withColumn(
        "response",
        F.when(kind == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(kind == "view", F.concat(F.lit("```\n"), "props", F.lit("\n```")))
        .when(kind == "error", F.concat("props", F.lit(" and more")))
        .otherwise(F.col("props")),
    )


@query(
    "j4_untyped_parse",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
              CASE WHEN event_type = 'error' THEN concat(props, ' and more') END AS raw FROM events""",
)
def j4(spark, folder):
    parsed = parsing.parse_untyped(_events(spark, folder))
    return parsed.select("event_id", F.get_json_object("json", "$.k").cast("bigint").alias("k"), "raw")


EVENT_SCHEMA = {
    "type": "object",
    "required": ["k"],
    "properties": {"k": {"type": "integer", "minimum": 50}},
    "additionalProperties": False,
}


@query(
    "j5_schema_validation",
    """SELECT event_id, event_type <> 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AS valid
       FROM events""",
)
def j5(spark, folder):
    return parsing.validate_schema(_events(spark, folder), EVENT_SCHEMA).select("event_id", "valid")


TREE_SCHEMA = {
    "$ref": "#/$defs/node",
    "$defs": {
        "node": {
            "type": "object",
            "required": ["k"],
            "properties": {
                "k": {"type": "integer", "minimum": 0, "maximum": 60},
                "next": {"type": "array", "items": {"$ref": "#/$defs/node"}, "maxItems": 2},
            },
            "additionalProperties": False,
        }
    },
}


@query(
    "j5_recursive",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) <= 60 AND event_id % 5 <> 3 AS valid FROM events",
)
def j5_recursive(spark, folder):
    """Properties nested under 0 to 5 parents; every fifth chain has a parent with too many children."""
    depth = (F.col("event_id") % 6).cast("int")
    wide = F.when(F.col("event_id") % 5 == 3, F.lit('{"k":1,"next":[{"k":1},{"k":2},')).otherwise(F.lit('{"k":1,"next":['))
    nested = F.concat(wide, F.repeat(F.lit('{"k":2,"next":['), depth), "props", F.repeat(F.lit("]}"), depth), F.lit("]}"))
    rows = spread(table(spark, folder, "events")).select("event_id", nested.alias("response"))
    return parsing.validate_schema(rows, TREE_SCHEMA).select("event_id", "valid")


@query(
    "j3_json_fences_only",
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') AND CAST(json_extract(props, '$.k') AS BIGINT) >= 50
              THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def j3_fences(spark, folder):
    """Answers behind bare backticks fail where only json fences are taken off."""
    return parsing.parse_typed(_events(spark, folder), EVENT_SCHEMA, bare_fence=False).select("event_id", F.col("parsed.k").alias("k"))


@query(
    "j1_flatten_outputs",
    """SELECT conv_id, turn, unnest(range(2)) AS output_idx, md5(unnest([text, role])) AS digest
       FROM conversations""",
)
def j1(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.array("text", "role").alias("outputs"))
    return parsing.explode_outputs(rows).select(
        "conv_id", "turn", F.col("output_idx").cast("bigint").alias("output_idx"), F.md5("response").alias("digest")
    )


@query(
    "j2_first_output",
    "SELECT conv_id, turn, CASE WHEN role <> 'system' THEN md5(text) END AS digest FROM conversations",
)
def j2(spark, folder):
    none = F.array().cast("array<string>")
    rows = table(spark, folder, "conversations").withColumn(
        "outputs", F.when(F.col("role") == "system", none).otherwise(F.array("text", "role"))
    )
    return rows.select("conv_id", "turn", F.md5(parsing.first_output("outputs")).alias("digest"))


@query(
    "j6_simplify_labels",
    SQL_RESPONSES
    + """SELECT row_id, CASE WHEN has_alerts THEN array_to_string(list_transform(alerts, lambda a: a.label), ',') ELSE '' END AS alert_types,
           coalesce(non_alert, '') AS non_alert_types FROM resp WHERE NOT failed""",
)
def j6(spark, folder):
    good = classified(spark, folder).where("parsed is not null")
    s = good.select("row_id", parsing.simplified_labels(parsing.training_output("parsed")).alias("s"))
    return s.select(
        "row_id",
        F.array_join("s.alert_types", ",").alias("alert_types"),
        F.array_join("s.non_alert_types", ",").alias("non_alert_types"),
    )


@query(
    "j7_training_output",
    SQL_RESPONSES
    + """SELECT row_id, CASE WHEN has_alerts THEN 'true' ELSE 'false' END AS flag, alerts[1].label AS first_type,
           alerts[1].phrase AS first_excerpt, non_alert AS other FROM resp WHERE NOT failed""",
)
def j7(spark, folder):
    good = classified(spark, folder).where("parsed is not null")
    out = good.select("row_id", parsing.training_output("parsed").alias("o"))
    return out.select(
        "row_id",
        F.get_json_object("o", "$.has_alerts").alias("flag"),
        F.get_json_object("o", "$.alerts[0].alert_type").alias("first_type"),
        F.get_json_object("o", "$.alerts[0].excerpt").alias("first_excerpt"),
        F.get_json_object("o", "$.non_alert_classification").alias("other"),
    )


@query(
    "j8_extract_json",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
              CASE WHEN event_type = 'error' THEN 'Failed to parse JSON' END AS error,
              CASE WHEN event_type = 'error' THEN 'nothing here' END AS raw_response FROM events""",
)
def j8(spark, folder):
    kind = F.col("event_type")
    noisy = spread(table(spark, folder, "events")).withColumn(
        "response",
        F.when(kind == "click", F.concat(F.lit("<s>[INST] say {x} [/INST] Sure: "), "props", F.lit("</s>")))
        .when(kind == "error", F.lit("[INST] a [/INST] nothing here </s>"))
        .otherwise(F.concat(F.lit("answer:\n"), "props", F.lit("\nbye"))),
    )
    out = parsing.extract_json(noisy)
    return out.select(
        "event_id", F.get_json_object("json", "$.k").cast("bigint").alias("k"), "error", "raw_response"
    )


@query(
    "j11_safe_attribute",
    SQL_RESPONSES + "SELECT row_id, coalesce(non_alert_reasoning, '') AS reasoning FROM resp",
)
def j11(spark, folder):
    from textloom.functions.text import or_empty

    return classified(spark, folder).select(
        "row_id", or_empty(F.col("parsed")["non_alert_reasoning"]).alias("reasoning")
    )


# --- reshape -----------------------------------------------------------------------------

SQL_EXPLODED = """SELECT concat('text_', row_id + 1) AS text_id, md5(text) AS digest, has_alerts, alert_number,
  total_alerts, alert_type, severity, excerpt, reasoning, non_alert_classification, non_alert_reasoning FROM (
  SELECT row_id, text, NULL::BOOLEAN AS has_alerts, NULL::INTEGER AS alert_number, NULL::INTEGER AS total_alerts,
    NULL::VARCHAR AS alert_type, NULL::VARCHAR AS severity, NULL::VARCHAR AS excerpt, NULL::VARCHAR AS reasoning,
    NULL::VARCHAR AS non_alert_classification, 'PARSE_FAILED' AS non_alert_reasoning FROM resp WHERE failed
  UNION ALL
  SELECT row_id, text, true, CAST(i AS INTEGER), CAST(len(alerts) AS INTEGER), alerts[i].label, alerts[i].severity,
    alerts[i].phrase, concat('matched ', alerts[i].phrase), NULL, NULL
  FROM (SELECT *, unnest(range(1, len(alerts) + 1)) AS i FROM resp WHERE has_alerts)
  UNION ALL
  SELECT row_id, text, false, NULL, 0, NULL, NULL, NULL, NULL, non_alert, non_alert_reasoning
  FROM resp WHERE NOT has_alerts)"""


def exploded(spark, folder):
    rows = reshape.explode_results(classified(spark, folder))
    return rows.withColumn("digest", F.md5("original_text")).drop("original_text")


@query("n3_explode_results", SQL_RESPONSES + SQL_EXPLODED)
def n3(spark, folder):
    return exploded(spark, folder)


SQL_QA = f"""SELECT row_id AS id, left({TEXT}, 500) AS input, has_alerts,
  CASE WHEN has_alerts THEN CAST(len(alerts) AS INTEGER) ELSE 0 END AS num_alerts,
  CASE WHEN has_alerts THEN array_to_string(list_transform(alerts, lambda a: a.label), ', ') ELSE '' END AS alert_types,
  CASE WHEN has_alerts THEN array_to_string(list_transform(alerts, lambda a: a.severity), ', ') ELSE '' END AS severities,
  CASE WHEN has_alerts THEN left(array_to_string(list_transform(alerts, lambda a: a.phrase), ' | '), 300) ELSE '' END AS excerpts,
  non_alert AS non_alert_classification, coalesce(non_alert_reasoning, '') AS non_alert_reasoning,
  source AS source_column, '' AS qa_status, '' AS qa_notes
  FROM resp WHERE NOT failed AND lower({TEXT}) NOT IN ('', 'nan')"""


def pairs(spark, folder):
    rows = classified(spark, folder).withColumnRenamed("source", "source_column")
    return reshape.training_pairs(rows, keep=["source_column", "lang"])


@query("n5_qa_flatten", SQL_RESPONSES + SQL_QA)
def n5(spark, folder):
    return reshape.qa_rows(reshape.split_failed(pairs(spark, folder))[0])


SQL_PAIRS = f"""SELECT row_id AS id, md5({TEXT}) AS digest, source AS source_column,
  CASE WHEN failed THEN 'PARSE_FAILED' END AS error, NOT failed AS has_output
  FROM resp WHERE lower({TEXT}) NOT IN ('', 'nan')"""


@query("n6_training_pairs", SQL_RESPONSES + SQL_PAIRS)
def n6(spark, folder):
    return pairs(spark, folder).select(
        "id", F.md5("input").alias("digest"), "source_column", "error",
        F.col("output").isNotNull().alias("has_output"),
    )


@query(
    "n9_source_columns",
    SQL_RESPONSES
    + f"""SELECT row_id AS id, source AS source_column, lang, failed FROM resp
          WHERE lower({TEXT}) NOT IN ('', 'nan')""",
)
def n9(spark, folder):
    good, bad = reshape.split_failed(materialize(pairs(spark, folder), "n9-pairs"))
    columns = ["id", "source_column", "lang"]
    return good.select(*columns, F.lit(False).alias("failed")).unionByName(
        bad.select(*columns, F.lit(True).alias("failed"))
    )


@query(
    "f9_split_failed",
    SQL_RESPONSES
    + f"""SELECT CASE WHEN failed THEN 'failed' ELSE 'parsed' END AS status, count(*) AS n, min(row_id) AS first_id
          FROM resp WHERE lower({TEXT}) NOT IN ('', 'nan') GROUP BY 1""",
)
def f9(spark, folder):
    rows = pairs(spark, folder).withColumn("status", F.when(F.col("error").isNull(), "parsed").otherwise("failed"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


# --- summaries ---------------------------------------------------------------------------

SQL_SUMMARY = """, c AS (SELECT count(*) AS total, count(*) FILTER (NOT failed) AS successful, count(*) FILTER (failed) AS failed,
    count(*) FILTER (has_alerts) AS with_alerts, count(*) FILTER (NOT has_alerts) AS without_alerts,
    CAST(coalesce(sum(len(alerts)), 0) AS BIGINT) AS total_alerts FROM resp) """


@query(
    "a1_run_summary",
    SQL_RESPONSES.rstrip()
    + SQL_SUMMARY
    + """SELECT total, successful, failed, round(successful * 100.0::DOUBLE / total, 6) AS successful_pct,
                round(failed * 100.0::DOUBLE / total, 6) AS failed_pct FROM c""",
)
def a1(spark, folder):
    s = summaries.run_summary(classified(spark, folder))
    return s.select("total", "successful", "failed", F.round("successful_pct", 6).alias("successful_pct"),
                    F.round("failed_pct", 6).alias("failed_pct"))


@query(
    "a2_alert_split",
    SQL_RESPONSES.rstrip()
    + SQL_SUMMARY
    + """SELECT with_alerts, without_alerts, round(with_alerts * 100.0::DOUBLE / successful, 6) AS with_alerts_pct,
                round(without_alerts * 100.0::DOUBLE / successful, 6) AS without_alerts_pct FROM c""",
)
def a2(spark, folder):
    s = summaries.run_summary(classified(spark, folder))
    return s.select("with_alerts", "without_alerts", F.round("with_alerts_pct", 6).alias("with_alerts_pct"),
                    F.round("without_alerts_pct", 6).alias("without_alerts_pct"))


@query("a3_total_alerts", SQL_RESPONSES.rstrip() + SQL_SUMMARY + "SELECT total_alerts FROM c")
def a3(spark, folder):
    return summaries.run_summary(classified(spark, folder)).select("total_alerts")


def _sql_histogram(field: str, name: str, top: str = "") -> str:
    return (
        SQL_RESPONSES
        + f"""SELECT a.{field} AS {name}, count(*) AS n FROM (SELECT unnest(alerts) AS a FROM resp WHERE has_alerts)
              GROUP BY 1 ORDER BY n DESC, 1 {top}"""
    )


@query("a4_alert_type_top10", _sql_histogram("label", "alert_type", "LIMIT 10"))
def a4(spark, folder):
    return summaries.alert_type_histogram(classified(spark, folder))


@query("a4_alert_type_all", _sql_histogram("label", "alert_type"))
def a4_all(spark, folder):
    return summaries.alert_type_histogram(classified(spark, folder), top=None)


@query(
    "a4_span_histogram",
    """SELECT concat(l_returnflag, '/', l_linestatus) AS alert_type, count(*) AS n FROM lineitem
       GROUP BY 1 ORDER BY n DESC, 1""",
)
def a4_flat(spark, folder):
    kind = F.concat_ws("/", "l_returnflag", "l_linestatus")
    return summaries.histogram(table(spark, folder, "lineitem"), kind, "alert_type")


@query("a5_severity_histogram", _sql_histogram("severity", "severity"))
def a5(spark, folder):
    return summaries.severity_histogram(classified(spark, folder))


@query(
    "a6_non_alert_histogram",
    SQL_RESPONSES
    + """SELECT non_alert AS non_alert_classification, count(*) AS n FROM resp
         WHERE NOT has_alerts AND non_alert <> '' GROUP BY 1 ORDER BY n DESC, 1""",
)
def a6(spark, folder):
    return summaries.non_alert_histogram(classified(spark, folder))


@query(
    "a6_priority_histogram",
    """SELECT o_orderpriority AS non_alert_classification, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1""",
)
def a6_flat(spark, folder):
    return summaries.histogram(table(spark, folder, "orders"), "o_orderpriority", "non_alert_classification")


@query(
    "a7_source_histogram",
    "SELECT source AS source_column, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1",
)
def a7(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("source").alias("source_column"))
    return summaries.source_histogram(docs)


SQL_COVERAGE = """SELECT dimension, value, count(*) AS n FROM (
    SELECT 'lang' AS dimension, d.lang AS value FROM documents d
    UNION ALL SELECT 'source', d.source FROM documents d
    UNION ALL SELECT 'toxic', CAST(l.toxic AS VARCHAR) FROM labels l JOIN documents d ON l.doc_id = d.doc_id
    UNION ALL SELECT 'pair', unnest([d.lang, d.source]) FROM documents d)
  WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2"""


def coverage_counts(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id", "lang", "source").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return summaries.coverage(
        joined, {"lang": "lang", "source": "source", "toxic": "toxic"}, {"pair": F.array("lang", "source")}
    )


@query("a8_coverage", SQL_COVERAGE)
def a8(spark, folder):
    return coverage_counts(spark, folder)


@query(
    "a9_missing_values",
    """SELECT 'nation' AS dimension, n_name AS value FROM nation WHERE n_nationkey NOT IN
         (SELECT s_nationkey FROM supplier)""",
)
def a9(spark, folder):
    nations = table(spark, folder, "nation")
    suppliers = table(spark, folder, "supplier").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    seen = summaries.coverage(suppliers, {"nation": "n_name"})
    universe = nations.select(F.lit("nation").alias("dimension"), F.col("n_name").alias("value"))
    return summaries.missing_values(seen, universe)


@query(
    "a10_coverage_report",
    f"""SELECT dimension, value, n, rank, round(n * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS share_pct FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS INTEGER) AS rank
          FROM ({SQL_COVERAGE})) WHERE dimension NOT IN ('source', 'pair') OR rank <= 5""",
)
def a10(spark, folder):
    report = summaries.coverage_report(
        coverage_counts(spark, folder), table(spark, folder, "documents"), {"source": 5, "pair": 5}
    )
    return report.withColumn("share_pct", F.round("share_pct", 6))


@query(
    "a11_topic_having",
    "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 5",
)
def a11(spark, folder):
    return summaries.topics_with_at_least(table(spark, folder, "embeddings"), "label", 5)


@query(
    "a17_union_gap_rows",
    """SELECT kind, count(*) AS n, sum(conv_id) AS total FROM (
         SELECT role AS kind, conv_id FROM conversations
         UNION ALL SELECT 'gap', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
       GROUP BY 1""",
)
def a17(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("role").alias("kind"), "conv_id")
    docs, marks = table(spark, folder, "documents"), table(spark, folder, "labels")
    gaps = docs.join(marks, "doc_id", "left_anti").select(
        F.lit("gap").alias("kind"), F.col("doc_id").alias("conv_id")
    )
    both = turns.unionByName(gaps)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("conv_id").cast("decimal(38,0)").alias("total"))
