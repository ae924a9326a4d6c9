"""Whole flows from input tables to result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog.base import RULES, SQL_RULES, query, table
from textloom.catalog.vectors import (
    SQL_BEST,
    SQL_CENTROID,
    SQL_COVER,
    SQL_DIVERSITY,
    SQL_SIDES,
    SQL_TOPICS,
    sql_exact,
    sql_mean,
)
from textloom.operators import summaries
from textloom.operators.inference import RuleBackend
from textloom.operators.reshape import explode_results
from textloom.plans import compare as compare_plan
from textloom.plans.classify import classify_texts, run_classification
from textloom.plans.rewrite import prepare_inputs, prepare_references, rewrite_prompts
from textloom.plans.train import training_set
from textloom.sources.readers import spread


@query(
    "flow_alert_histogram",
    f"""WITH a AS (SELECT unnest(list_filter({SQL_RULES}, lambda r: contains(lower(text), r.phrase))) AS r
                   FROM documents)
        SELECT r.label AS alert_type, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, 1""",
)
def histogram(spark, folder):
    """Prompt, infer, parse, explode, count."""
    docs = spread(table(spark, folder, "documents"))
    rows = docs.select(F.col("doc_id").alias("row_id"), "text")
    parsed = classify_texts(rows, RuleBackend(RULES))
    return summaries.histogram(explode_results(parsed), "alert_type", "alert_type")


@query(
    "flow_classify",
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS row_id, role, text FROM conversations),
        u AS (SELECT row_id, 'role' AS source_column, role AS text FROM t UNION ALL SELECT row_id, 'text', text FROM t)
        SELECT row_id AS original_row_idx, source_column, len(list_filter({SQL_RULES}, lambda r: contains(lower(text), r.phrase))) AS n_alerts
        FROM u WHERE trim(text) <> ''""",
)
def classify(spark, folder):
    turns = spread(table(spark, folder, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "role", "text"
    )
    done = run_classification(turns, ["role", "text", "absent"], RuleBackend(RULES))
    return done.pairs.select(
        "original_row_idx", "source_column", F.size("output_parsed.alerts").cast("bigint").alias("n_alerts")
    )


SQL_REPORT = (
    SQL_TOPICS.rstrip()
    + f""", k AS (SELECT greatest(1, 50 // count(DISTINCT label)) AS share FROM s),
  picked AS (SELECT id FROM (SELECT id, c, row_number() OVER (PARTITION BY label ORDER BY c DESC, id) <= share AS in_quota FROM best, k)
    ORDER BY in_quota DESC, c DESC, id LIMIT 50),
  p AS (SELECT s.* FROM s JOIN picked ON s.vec_id = picked.id),
  tops AS (SELECT row_number() OVER (ORDER BY c DESC, id DESC) AS r, id, label, c FROM best ORDER BY c DESC, id DESC LIMIT 10),
  lines AS (
    SELECT 0 AS a, 0 AS b, 'ORGANIC AND SYNTHETIC DATA' AS content
    UNION ALL SELECT 1, 0, concat('organic rows: ', (SELECT count(*) FROM o))
    UNION ALL SELECT 2, 0, concat('synthetic rows: ', (SELECT count(*) FROM s))
    UNION ALL SELECT 3, 0, format('centroid distance: {{:.4f}}', (SELECT {SQL_CENTROID} FROM {sql_mean('s')} a, {sql_mean('o')} b))
    UNION ALL SELECT 4, 0, format('kernel discrepancy: {{:.4f}}', {sql_exact('s', 'o')})
    UNION ALL SELECT 5, 0, format('coverage: {{:.2f}}%', 100 * ({SQL_COVER.format(t=0.7)}))
    UNION ALL SELECT 6, 0, format('mean best similarity: {{:.4f}}', (SELECT avg(c) FROM best))
    UNION ALL SELECT 7, 0, format('diversity: {{:.4f}}', ({SQL_DIVERSITY.format(t='s')}))
    UNION ALL SELECT 8, 0, format('diversity of the selection: {{:.4f}}', ({SQL_DIVERSITY.format(t='p')}))
    UNION ALL SELECT 9, 0, 'TOPICS'
    UNION ALL SELECT 10, row_number() OVER (ORDER BY topic), concat(rpad(topic, 20, ' '), rpad(CAST(n AS VARCHAR), 10, ' '),
      rpad(format('{{:.4f}}', mean_similarity), 10, ' '), rpad(format('{{:.4f}}', centroid_distance), 10, ' '), rpad(format('{{:.4f}}', mmd), 10, ' '),
      format('{{:.4f}}', diversity)) FROM topics
    UNION ALL SELECT 11, 0, 'TOP 10'
    UNION ALL SELECT 12, r, concat(r, '. ', format('{{:.4f}}', c), ' ', coalesce(left(text, 100), 'None'), ' [', label, ']')
      FROM tops LEFT JOIN documents d ON d.doc_id = tops.id)
SELECT row_number() OVER (ORDER BY a, b) - 1 AS line, content FROM lines"""
)


@query("k10_report_lines", SQL_REPORT)
def report(spark, folder):
    s, o = _corpora(spark, folder)
    lines = compare_plan.report_lines(compare_plan.compare(s, o, n_select=50, cluster_column="example_type"), o)
    return spark.createDataFrame(list(enumerate(lines)), "line bigint, content string")


def _corpora(spark, folder):
    """Vectors with the texts of the documents of the same id; labelled ones are organic."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("example_type")
    )
    rows = vectors.join(docs, "id", "left").withColumn("metadata", F.struct("example_type"))
    marked = table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return rows.join(marked, "id", "left_anti"), rows.join(marked, "id", "left_semi")


@query(
    "flow_compare",
    SQL_SIDES
    + SQL_BEST
    + """, k AS (SELECT greatest(1, 50 // count(DISTINCT label)) AS share FROM s),
      ranked AS (SELECT id, nearest_id, c, row_number() OVER (PARTITION BY label ORDER BY c DESC, id) <= share AS in_quota FROM best, k)
    SELECT id, round(c, 6) AS organic_similarity, md5(d.text) AS closest
    FROM (SELECT * FROM ranked ORDER BY in_quota DESC, c DESC, id LIMIT 50) r LEFT JOIN documents d ON d.doc_id = r.nearest_id""",
)
def compare(spark, folder):
    s, o = _corpora(spark, folder)
    return compare_plan.compare(s, o, n_select=50, cluster_column="example_type").selected.select(
        "id", F.round("organic_similarity", 6).alias("organic_similarity"), F.md5("closest_organic_text").alias("closest")
    )


# The reference flow of rewriting takes comments of 50 to 1000 characters as style references.
@query(
    "flow_rewrite",
    """WITH r AS (SELECT text, min(doc_id) AS ref_id FROM documents WHERE length(text) BETWEEN 50 AND 1000 GROUP BY text),
         refs AS (SELECT ref_id, text AS reference, row_number() OVER (ORDER BY md5(concat('42:', ref_id)), ref_id) - 1 AS pos FROM r),
         inp AS (SELECT copy * (SELECT count(*) FROM documents) + doc_id AS row_id, text FROM documents, range(2) c(copy))
       SELECT row_id, ref_id, md5(concat('Rewrite the comment in the style of the reference. Keep its meaning and length.\nReference:\n', reference,
         '\nComment:\n', trim(text, chr(32) || chr(10) || chr(9)), '\nAnswer in JSON: {"rewritten_comment": "..."}')) AS prompt_digest
       FROM inp JOIN refs ON pos = CAST(concat('0x', substr(md5(concat('42-draw:', row_id)), 1, 15)) AS BIGINT) % (SELECT count(*) FROM refs)""".replace("\\n", "\n"),
)
def rewritten(spark, folder):
    """Copies of every document with the reference drawn for each and the prompt made of both."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "text")
    refs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), "text", F.col("source").alias("project_ids"),
        F.concat(F.lit("['"), "lang", F.lit(" > "), "source", F.lit("']")).alias("annotations"),
    )
    out = rewrite_prompts(prepare_inputs(docs, 2), prepare_references(refs))
    return out.select("row_id", "ref_id", F.md5("prompt").alias("prompt_digest"))


@query(
    "flow_training_set",
    """WITH p AS (SELECT d.doc_id, concat('<s>[INST] ', text, ' [/INST]', coalesce(CAST(quality AS VARCHAR), 'Unknown'), '</s>') AS t
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
       r AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', doc_id))) AS rn, count(*) OVER () AS n FROM p)
     SELECT doc_id, CASE WHEN rn <= ceil(0.02::DOUBLE * n) THEN 'validation' ELSE 'train' END AS split, md5(t) AS digest,
       strlen(t) AS n_tokens, least(strlen(t), 2048) AS n_kept FROM r""",
)
def training_flow(spark, folder):
    """Pairs, exact split, training text, token ids."""
    marks = table(spark, folder, "labels").select("doc_id", "quality")
    docs = spread(table(spark, folder, "documents")).join(marks, "doc_id", "left")
    pairs = docs.select("doc_id", F.col("text").alias("input"), F.coalesce(F.col("quality").cast("string"), F.lit("Unknown")).alias("output"))
    out = training_set(pairs, "doc_id")
    return out.select("doc_id", "split", F.md5("text").alias("digest"), "n_tokens", F.size("input_ids").cast("bigint").alias("n_kept"))
