"""Generation plans sized by the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog.base import by_lang, query, sql_list, table
from textloom.operators import generation, prompts, summaries
from textloom.operators.reshape import example_records
from textloom.schemas import (
    DIMENSIONS,
    GENERATED_ALERT_TYPES,
    GENERATED_NON_ALERT_TYPES,
)

ALERTS, OTHERS = sql_list(GENERATED_ALERT_TYPES), sql_list(GENERATED_NON_ALERT_TYPES)
SQL_DIMENSIONS = ", ".join(
    f"{sql_list(values)}[i % {len(values)} + 1] AS {name}" for name, values in DIMENSIONS.items()
)
SQL_LABELS = f"""CASE WHEN example_type IN ('alert', 'hard_alert') THEN {ALERTS}[i % 24 + 1]
    WHEN example_type = 'mixed' THEN array_to_string(list_transform(range(0, i % 3 + 1),
      lambda j: {ALERTS}[(i + j) % 24 + 1]), ',') END AS alert_types,
  CASE WHEN example_type IN ('non_alert', 'hard_non_alert', 'mixed') THEN {OTHERS}[i % 9 + 1] END AS non_alert_type"""
SQL_QUOTAS = """WITH n AS (SELECT count(*) AS n FROM documents),
  s(pos, example_type, share) AS (VALUES (0, 'alert', 0.30::DOUBLE), (1, 'non_alert', 0.25::DOUBLE),
    (2, 'mixed', 0.15::DOUBLE), (3, 'hard_non_alert', 0.15::DOUBLE), (4, 'hard_alert', 0.15::DOUBLE)),
  raw AS (SELECT pos, example_type, CAST(floor(n * share) AS BIGINT) AS c, n FROM s, n),
  q AS (SELECT pos, example_type, c + CASE WHEN pos = 0 THEN greatest(n - sum(c) OVER (), 0) ELSE 0 END AS task_count FROM raw)
"""


@query(
    "g1_quotas",
    """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
      s(pos, example_type, share) AS (VALUES (0, 'alert', 0.30::DOUBLE), (1, 'non_alert', 0.25::DOUBLE),
        (2, 'mixed', 0.15::DOUBLE), (3, 'hard_non_alert', 0.15::DOUBLE), (4, 'hard_alert', 0.15::DOUBLE)),
      raw AS (SELECT lang, pos, example_type, CAST(floor(n * share) AS BIGINT) AS c, n FROM s, n)
    SELECT lang, example_type, CAST(c + CASE WHEN pos = 0 THEN greatest(n - sum(c) OVER (PARTITION BY lang), 0) ELSE 0 END AS BIGINT) AS task_count FROM raw""",
)
def g1(spark, folder):
    """As many tasks per language as it has documents."""
    counts = table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return generation.quota_rows(counts, "n").select("lang", "example_type", "task_count")


@query(
    "g2_g3_task_queue",
    SQL_QUOTAS
    + f""", t AS (SELECT example_type, pos, CAST(i AS BIGINT) AS i,
             CAST(sum(1) OVER (ORDER BY pos, i) - 1 AS BIGINT) AS task_id
           FROM (SELECT pos, example_type, unnest(range(CAST(task_count AS BIGINT))) AS i FROM q))
       SELECT task_id, example_type, {SQL_DIMENSIONS}, {SQL_LABELS}, md5(concat('42:', task_id)) AS queue_key FROM t""",
)
def g2(spark, folder):
    queue = generation.task_queue(spark, table(spark, folder, "documents").count())
    return queue.withColumn("alert_types", F.array_join("alert_types", ","))


SQL_TYPES = """CASE lang WHEN 'en' THEN 'alert' WHEN 'de' THEN 'non_alert' WHEN 'fr' THEN 'mixed'
  ELSE 'hard_non_alert' END"""
TYPE_BY_LANG = {"en": "alert", "de": "non_alert", "fr": "mixed", "es": "hard_non_alert"}


def _tasks(spark, folder):
    """One task per document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    tasks = generation.tasks_for_rows(docs, "doc_id", by_lang(TYPE_BY_LANG))
    return tasks.withColumn("task_id", F.col("doc_id"))


SQL_TASKS = f"""WITH t AS (SELECT doc_id AS i, {SQL_TYPES} AS example_type FROM documents),
  tasks AS (SELECT i AS task_id, example_type, {SQL_DIMENSIONS}, {SQL_LABELS} FROM t) """


@query(
    "p5_generation_prompt",
    SQL_TASKS
    + r"""SELECT task_id, example_type, md5(concat(CASE example_type
        WHEN 'alert' THEN 'Write a workplace comment that shows: '
        WHEN 'non_alert' THEN 'Write an ordinary workplace comment of the kind: '
        WHEN 'mixed' THEN 'Write a comment that mixes these alerts and an ordinary remark: '
        ELSE 'Write a comment that sounds alarming but is only: ' END,
      concat_ws('; ', replace(alert_types, ',', ', '), non_alert_type),
      '\nindustry: ', industry, '\nrole: ', role, '\ntone: ', tone, '\nwriting_style: ', writing_style,
      '\ndemographic: ', demographic,
      CASE WHEN example_type IN ('alert', 'mixed') THEN concat('\ndifficulty: ', difficulty) ELSE '' END,
      '\nAnswer in JSON: {"text": "..."}')) AS digest FROM tasks""".replace("\\n", "\n"),
)
def p5(spark, folder):
    return prompts.generation_prompt(_tasks(spark, folder)).select(
        "task_id", "example_type", F.md5("prompt").alias("digest")
    )


SQL_PROMPT_HEAD = """concat(CASE example_type
        WHEN 'alert' THEN 'Write a workplace comment that shows: '
        WHEN 'non_alert' THEN 'Write an ordinary workplace comment of the kind: '
        WHEN 'mixed' THEN 'Write a comment that mixes these alerts and an ordinary remark: '
        ELSE 'Write a comment that sounds alarming but is only: ' END,
      concat_ws('; ', replace(alert_types, ',', ', '), non_alert_type),
      '\nindustry: ', industry, '\nrole: ', role, '\ntone: ', tone, '\nwriting_style: ', writing_style,
      '\ndemographic: ', demographic,
      CASE WHEN example_type IN ('alert', 'mixed') THEN concat('\ndifficulty: ', difficulty) ELSE '' END,"""


@query(
    "p5_few_shot_prompt",
    SQL_TASKS.rstrip()
    + f""", shots AS (SELECT label, list(text ORDER BY rn) AS samples FROM (SELECT {ALERTS}[item_id % 24 + 1] AS label, text,
          row_number() OVER (PARTITION BY item_id % 24 ORDER BY item_id) AS rn FROM benchmark) WHERE rn <= 3 GROUP BY label),
      x AS (SELECT task_id, unnest(string_split(alert_types, ',')) AS label, generate_subscripts(string_split(alert_types, ','), 1) AS pos FROM tasks
        WHERE alert_types IS NOT NULL),
      few AS (SELECT task_id, flatten(list(samples ORDER BY pos))[1:5] AS f FROM x JOIN shots USING (label) GROUP BY task_id)
    SELECT task_id, coalesce(len(f), 0) AS n_samples, md5({SQL_PROMPT_HEAD}
      CASE WHEN len(f) > 0 THEN concat('\nSamples:\n', array_to_string(list_transform(f, lambda t: concat('- ', t)), '\n')) ELSE '' END,
      '\nAnswer in JSON: {{"text": "..."}}')) AS digest FROM tasks LEFT JOIN few USING (task_id)""",
)
def p5_few_shot(spark, folder):
    """Prompts with up to five samples of the task's labels, three per label; the benchmark's items are the samples."""
    label = generation.cycle(GENERATED_ALERT_TYPES, F.col("item_id")).alias("label")
    shots = prompts.few_shot_examples(table(spark, folder, "benchmark").select("item_id", "text", label), "label", "text", 3, key="item_id")
    tasks = prompts.attach_few_shot(_tasks(spark, folder), shots, "label")
    out = prompts.generation_prompt(tasks, few_shot="few_shot")
    return out.select("task_id", F.size("few_shot").cast("bigint").alias("n_samples"), F.md5("prompt").alias("digest"))


@query(
    "p6_attach_few_shot",
    """WITH s AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
            shots AS (SELECT lang, list(md5(text) ORDER BY rn) AS samples FROM s WHERE rn <= 3 GROUP BY lang)
       SELECT e.doc_id AS task_id, array_to_string(list_concat(
           (SELECT samples FROM shots WHERE lang = 'en'), (SELECT samples FROM shots WHERE lang = 'fr'))[1:5], ',') AS few_shot
       FROM documents e""",
)
def p6(spark, folder):
    docs = table(spark, folder, "documents")
    shots = prompts.few_shot_examples(docs, "lang", "text", 3, key="doc_id")
    tasks = docs.select(
        F.col("doc_id").alias("task_id"), F.array(F.lit("en"), F.lit("fr")).alias("alert_types")
    )
    with_shots = prompts.attach_few_shot(tasks, shots, "lang")
    return with_shots.select("task_id", F.array_join(F.transform("few_shot", F.md5), ",").alias("few_shot"))


def _fixed(labels: str) -> str:
    return f"""WITH w AS ({labels}),
      r AS (SELECT *, row_number() OVER (ORDER BY dimension, value) - 1 AS l FROM w),
      t AS (SELECT dimension, value, l * 10 + i AS task_id, i FROM r, range(10) g(i))
      SELECT task_id, CASE WHEN dimension = 'alert_types' THEN 'alert' ELSE 'non_alert' END AS example_type,
        {SQL_DIMENSIONS}, CASE WHEN dimension = 'alert_types' THEN value END AS alert_types,
        CASE WHEN dimension <> 'alert_types' THEN value END AS non_alert_type FROM t"""


@query(
    "g4_targeted_tasks",
    _fixed("SELECT DISTINCT 'alert_types' AS dimension, source AS value FROM documents"),
)
def g4(spark, folder):
    labels = table(spark, folder, "documents").select(
        F.lit("alert_types").alias("dimension"), F.col("source").alias("value")
    ).distinct()
    return generation.targeted_tasks(labels, 10).withColumn("alert_types", F.array_join("alert_types", ","))


def _sql_pick(values, name: str) -> str:
    return (
        f"{sql_list(values)}[CAST(concat('0x', substr(md5(concat('42-{name}:', doc_id)), 1, 15)) AS BIGINT)"
        f" % {len(values)} + 1] AS {name}"
    )


@query(
    "g5_random_dimensions",
    f"""WITH t AS (SELECT doc_id, {SQL_TYPES} AS example_type, {', '.join(_sql_pick(v, k) for k, v in DIMENSIONS.items())},
               CAST(concat('0x', substr(md5(concat('42-count:', doc_id)), 1, 15)) AS BIGINT) % 3 + 1 AS k,
               {_sql_pick(GENERATED_NON_ALERT_TYPES, 'other')} FROM documents)
        SELECT doc_id, example_type, {', '.join(DIMENSIONS)},
          CASE WHEN example_type IN ('alert', 'mixed') THEN array_to_string(list_transform(
            list_sort(list_transform({ALERTS}, lambda a: {{'h': md5(concat('42:', doc_id, ':', a)), 'a': a}})),
            lambda x: x.a)[1:(CASE WHEN example_type = 'mixed' THEN k ELSE 1 END)], ',') END AS alert_types,
          CASE WHEN example_type <> 'alert' THEN other END AS non_alert_type FROM t""",
)
def g5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", by_lang(TYPE_BY_LANG).alias("example_type"))
    out = generation.random_dimensions(docs, "doc_id")
    return out.withColumn("alert_types", F.array_join("alert_types", ","))


@query(
    "g6_gap_fill",
    SQL_TASKS.rstrip()
    + f""", labelled AS (SELECT t.*, concat(p_brand, ' ', p_type) AS label FROM tasks t LEFT JOIN part ON p_partkey = task_id),
      seen AS (SELECT DISTINCT label AS v FROM labelled WHERE label IS NOT NULL),
      used AS (SELECT DISTINCT unnest(string_split(alert_types, ',')) AS v FROM tasks),
      w AS (SELECT 'non_alert_types' AS dimension, v AS value FROM (SELECT DISTINCT concat(p_brand, ' ', p_type) AS v FROM part) WHERE v NOT IN (SELECT v FROM seen)
            UNION ALL SELECT 'alert_types', v FROM (SELECT unnest({ALERTS}) AS v) WHERE v NOT IN (SELECT v FROM used WHERE v IS NOT NULL)),
      r AS (SELECT *, row_number() OVER (ORDER BY dimension, value) - 1 AS l FROM w),
      g AS (SELECT dimension, value, l * 10 + i AS task_id, i FROM r, range(10) x(i))
    SELECT task_id, CASE WHEN dimension = 'alert_types' THEN 'alert' ELSE 'non_alert' END AS example_type,
      CASE WHEN dimension = 'alert_types' THEN value END AS alert_types,
      CASE WHEN dimension <> 'alert_types' THEN value END AS non_alert_type,
      {sql_list(DIMENSIONS['tone'])}[i % 10 + 1] AS tone FROM g""",
)
def g6(spark, folder):
    """Ten tasks for every label that no task has: brands and types of parts as classes, each task labelled by the part of its number."""
    label = F.concat("p_brand", F.lit(" "), "p_type")
    parts = table(spark, folder, "part")
    tasks = _tasks(spark, folder).join(parts.select(F.col("p_partkey").alias("task_id"), label.alias("label")), "task_id", "left")
    seen = summaries.coverage(tasks, {"non_alert_types": "label"}, {"alert_types": "alert_types"})
    wanted = parts.select(F.lit("non_alert_types").alias("dimension"), label.alias("value")).distinct()
    alerts = spark.createDataFrame([("alert_types", a) for a in GENERATED_ALERT_TYPES], "dimension string, value string")
    rows = generation.targeted_tasks(summaries.missing_values(seen, wanted.unionByName(alerts)), 10)
    return rows.select("task_id", "example_type", F.array_join("alert_types", ",").alias("alert_types"),
                       "non_alert_type", "tone")


@query(
    "g7_example_records",
    SQL_TASKS.rstrip()
    + """, answered AS (SELECT t.*, trim(trim(text, '"'), '''') AS said FROM tasks t JOIN documents d ON d.doc_id = t.task_id)
      SELECT task_id AS row_id, md5(said) AS digest, example_type, alert_types AS expected_alert_types,
           non_alert_type AS expected_non_alert_type, difficulty FROM answered WHERE example_type <> 'mixed'""",
)
def g7(spark, folder):
    """The text of its document, in quotes, as the answer of every task but the mixed ones, which failed."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("task_id"), F.concat(F.lit(' "'), "text", F.lit('"\n')).alias("said"))
    answered = _tasks(spark, folder).join(docs, "task_id").withColumn("parsed", F.when(F.col("example_type") != "mixed", F.struct(F.col("said").alias("text"))))
    m = F.col("metadata")
    return example_records(answered).select(
        "row_id", F.md5("text").alias("digest"), m["example_type"].alias("example_type"),
        F.array_join(m["expected_alert_types"], ",").alias("expected_alert_types"),
        m["expected_non_alert_type"].alias("expected_non_alert_type"), m["difficulty"].alias("difficulty"),
    )


def examples(spark, folder):
    """One example per document, its text taken from the document."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("task_id"), "text")
    tasks = _tasks(spark, folder).join(docs, "task_id")
    return example_records(tasks.withColumn("parsed", F.struct("text")))


@query(
    "a8_example_coverage",
    SQL_TASKS
    + """, c AS (SELECT 'example_types' AS dimension, example_type AS value FROM tasks
        UNION ALL SELECT 'industries', industry FROM tasks UNION ALL SELECT 'roles', role FROM tasks
        UNION ALL SELECT 'tones', tone FROM tasks UNION ALL SELECT 'writing_styles', writing_style FROM tasks
        UNION ALL SELECT 'difficulties', difficulty FROM tasks UNION ALL SELECT 'demographics', demographic FROM tasks
        UNION ALL SELECT 'non_alert_types', non_alert_type FROM tasks
        UNION ALL SELECT 'alert_types', unnest(string_split(alert_types, ',')) FROM tasks)
      SELECT dimension, value, count(*) AS n FROM c WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def a8(spark, folder):
    records = _tasks(spark, folder).withColumn("parsed", F.struct(F.lit("").alias("text")))
    return summaries.example_coverage(example_records(records))
