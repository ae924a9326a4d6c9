"""Projections, filters, prompts and small parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog.base import query, sql_strip, sql_text, table
from textloom.functions.text import (
    clean_control,
    length_between,
    normalize_path,
    or_empty,
    strip_quotes,
    strip_ws,
    truncate,
)
from textloom.operators import prompts
from textloom.operators.reshape import (
    annotation_paths,
    available_columns,
    drop_blank,
    explode_annotations,
    text_id,
    unpivot_texts,
)
from textloom.operators.sampling import random_reference
from textloom.operators.summaries import length_bin
from textloom.plans.rewrite import project_filter
from textloom.sources.readers import text_column

STRIPPED = sql_strip("text")


@query("f1_available_columns", "SELECT doc_id, lang, source FROM documents")
def f1(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", *available_columns(docs, ["comment", "lang", "source"]))


@query(
    "f2_unpivot_texts",
    f"""SELECT c_custkey AS original_row_idx, 'c_name' AS source_column, CAST(0 AS INTEGER) AS column_pos,
               {sql_strip('c_name')} AS text
        FROM customer WHERE lower({sql_strip('c_name')}) NOT IN ('', 'nan')
        UNION ALL
        SELECT c_custkey, 'c_mktsegment', CAST(1 AS INTEGER), {sql_strip('c_mktsegment')}
        FROM customer WHERE lower({sql_strip('c_mktsegment')}) NOT IN ('', 'nan')""",
)
def f2(spark, folder):
    return unpivot_texts(table(spark, folder, "customer"), ["c_name", "c_mktsegment", "c_note"], "c_custkey")


@query(
    "f3_blank_filter",
    f"""SELECT doc_id, length({STRIPPED}) AS n, md5({STRIPPED}) AS digest FROM documents
        WHERE {STRIPPED} <> '' AND lower({STRIPPED}) <> 'nan'""",
)
def f3(spark, folder):
    docs = drop_blank(table(spark, folder, "documents"))
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query(
    "f4_length_range",
    "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 50 AND 1000",
)
def f4(spark, folder):
    docs = table(spark, folder, "documents").where(length_between("text"))
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("f5_regex_contains", "SELECT doc_id, source FROM documents WHERE regexp_matches(source, '2')")
def f5(spark, folder):
    return project_filter(table(spark, folder, "documents"), "2", "source").select("doc_id", "source")


@query(
    "f6_control_clean",
    r"""SELECT page_id, length(c) AS n, md5(c) AS digest FROM (
          SELECT page_id, replace(regexp_replace(concat(html, chr(7), '_x000D_', chr(31)),
            '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '_x000D_', ' ') AS c FROM pages)""",
)
def f6(spark, folder):
    dirty = F.concat("html", F.lit("\x07"), F.lit("_x000D_"), F.lit("\x1f"))
    pages = table(spark, folder, "pages").select("page_id", clean_control(dirty).alias("c"))
    return pages.select("page_id", F.length("c").cast("bigint").alias("n"), F.md5("c").alias("digest"))


@query("f7_rename_present", "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def f7(spark, folder):
    renamed = prompts.column_mapping(
        table(spark, folder, "conversations"), {"text": "input_comment", "comment": "input_comment"}
    )
    return renamed.select("conv_id", "turn", F.md5("input_comment").alias("digest"))


SQL_ANNOTATED = """SELECT p_partkey, unnest(CASE WHEN p_size <= 5 THEN [NULL]
    ELSE [p_type || ' > ' || p_brand, p_name] END) AS annotation FROM part"""


def _parts(spark, folder):
    """Parts with printed annotation lists as CSV exports have them; small parts have none."""
    listed = F.concat(F.lit("['"), F.col("p_type"), F.lit(" > "), F.col("p_brand"), F.lit("', '"),
                      F.col("p_name"), F.lit("']"))
    annotations = F.when(F.col("p_size") <= 5, F.lit("[]")).otherwise(listed)
    return table(spark, folder, "part").withColumn("annotations", annotations)


@query(
    "f8_nonempty_path",
    f"""SELECT p_partkey, annotation AS original_target_path, lower(annotation) AS target_path_lower
        FROM ({SQL_ANNOTATED}) WHERE annotation IS NOT NULL AND annotation <> ''""",
)
def f8(spark, folder):
    rows = annotation_paths(explode_annotations(_parts(spark, folder)))
    return rows.select("p_partkey", "original_target_path", "target_path_lower")


SUBTLE = ["thor", "whthe", "blean"]


@query(
    "f10_subtle_words",
    "SELECT doc_id FROM documents WHERE "
    + " OR ".join(f"contains(lower(text), {sql_text(w)})" for w in SUBTLE)
    + " ORDER BY doc_id LIMIT 5",
)
def f10(spark, folder):
    return prompts.subtle_examples(table(spark, folder, "documents"), "text", "doc_id", SUBTLE).select("doc_id")


@query(
    "f11_defaults",
    """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'Unknown') AS quality,
              CASE WHEN lang = 'en' THEN lang ELSE '' END AS lang_or_empty
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def f11(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.col("quality").cast("string"), F.lit("Unknown")).alias("quality"),
        or_empty(F.when(F.col("lang") == "en", F.col("lang"))).alias("lang_or_empty"),
    )


@query(
    "f12_unused_rows",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def f12(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return docs.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query("s2_text_column", "SELECT lang AS comment, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def s2(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("lang", "comment")
    return text_column(docs).groupBy("comment").agg(F.count("*").alias("n"))


# --- prompts ---------------------------------------------------------------------------


@query(
    "p1_classification_prompt",
    f"""SELECT doc_id, length(p) AS n, md5(p) AS digest FROM (
          SELECT doc_id, concat({sql_text(prompts.CLASSIFY_HEAD)}, text) AS p FROM documents)""",
)
def p1(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", prompts.classification_prompt("text").alias("p"))
    return docs.select("doc_id", F.length("p").cast("bigint").alias("n"), F.md5("p").alias("digest"))


@query(
    "p2_chat_template",
    """SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' THEN text ELSE concat(
          '<|im_start|>user\n', text, '<|im_end|>\n<|im_start|>assistant\n') END) AS digest
       FROM conversations""".replace("\\n", "\n"),
)
def p2(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("formatted", F.col("role") == "assistant")
    once = prompts.chat_format(turns, "text")
    twice = prompts.chat_format(once, "text")  # already formatted: no second wrap
    return twice.select("conv_id", "turn", F.md5("text").alias("digest"))


@query(
    "p3_instruct_wrap",
    """SELECT conv_id, turn, md5(concat('<s>[INST] ', text, ' [/INST]')) AS plain,
              md5(concat('<s>[INST] """
    + prompts.SYSTEM_LINE
    + """\n\nComment:\n', text, ' [/INST]')) AS with_system
       FROM conversations""",
)
def p3(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.md5(prompts.instruct("text")).alias("plain"),
        F.md5(prompts.instruct("text", prompts.SYSTEM_LINE)).alias("with_system"),
    )


@query(
    "p4_training_text",
    """SELECT q.conv_id, q.turn, md5(concat('<s>[INST] ', q.text, ' [/INST]', a.text, '</s>')) AS digest
       FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
       WHERE q.role = 'user' AND a.role = 'assistant'""",
)
def p4(spark, folder):
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user")
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answers, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.md5(prompts.training_text("text", "answer")).alias("digest")
    )


@query(
    "p6_few_shot",
    """SELECT source, string_agg(md5(text), ',' ORDER BY rn) AS samples FROM (
         SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY md5(concat('42:', text)), text) AS rn
         FROM documents) WHERE rn <= 2 GROUP BY source""",
)
def p6(spark, folder):
    shots = prompts.few_shot_examples(table(spark, folder, "documents"), "source", "text")
    return shots.select("source", F.array_join(F.transform("samples", F.md5), ",").alias("samples"))


@query(
    "p7_rewrite_prompt",
    """WITH refs AS (SELECT text AS reference, row_number() OVER (ORDER BY md5(concat('42:', item_id)), item_id) - 1 AS pos
                     FROM benchmark),
            n AS (SELECT count(*) AS c FROM benchmark)
       SELECT doc_id, md5(concat('Rewrite the comment in the style of the reference. Keep its meaning and length.\nReference:\n',
         reference, '\nComment:\n', text, '\nAnswer in JSON: {"rewritten_comment": "..."}')) AS digest
       FROM documents, n JOIN refs ON true
       WHERE pos = CAST(concat('0x', substr(md5(concat('42-draw:', doc_id)), 1, 15)) AS BIGINT) % c""",
)
def p7(spark, folder):
    refs = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("reference"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    paired = random_reference(docs, refs, "doc_id", "item_id")
    return paired.select("doc_id", F.md5(prompts.rewrite_prompt("reference", "text")).alias("digest"))


# --- shapes and small text functions ---------------------------------------------------


@query(
    "n1_explode_annotations",
    f"SELECT p_partkey, annotation AS parsed_annotations FROM ({SQL_ANNOTATED})",
)
def n1(spark, folder):
    return explode_annotations(_parts(spark, folder)).select("p_partkey", "parsed_annotations")


@query(
    "n2_path_normalize",
    """SELECT p_partkey, array_to_string(list_sort(list_transform(
          string_split(lower(concat(p_type, ' > ', p_brand, '>', p_name)), '>'), lambda x: trim(x))), '|') AS path
       FROM part""",
)
def n2(spark, folder):
    path = F.concat("p_type", F.lit(" > "), "p_brand", F.lit(">"), "p_name")
    return table(spark, folder, "part").select("p_partkey", normalize_path(path).alias("path"))


@query("n4_text_id", "SELECT doc_id, concat('text_', doc_id + 1) AS text_id FROM documents")
def n4(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text_id("doc_id").alias("text_id"))


@query(
    "j9_annotation_literal",
    """SELECT p_partkey, CASE WHEN p_size <= 5 THEN 0 ELSE 2 END AS n,
              CASE WHEN p_size <= 5 THEN '' ELSE concat(p_type, ' > ', p_brand, '; ', p_name) END AS items
       FROM part""",
)
def j9(spark, folder):
    """Printed lists, read without Python."""
    from textloom.operators.parsing import plain_annotations

    rows = _parts(spark, folder).withColumn("list", plain_annotations("annotations"))
    return rows.select("p_partkey", F.size("list").alias("n"), F.array_join("list", "; ").alias("items"))


@query(
    "j10_quote_cleanup",
    f"""SELECT doc_id, md5(trim(trim({sql_strip("concat(' \"''', text, '''\"', chr(10))")}, '"'), '''')) AS digest
        FROM documents""",
)
def j10(spark, folder):
    quoted = F.concat(F.lit(" \"'"), "text", F.lit("'\"\n"))
    return table(spark, folder, "documents").select("doc_id", F.md5(strip_quotes(quoted)).alias("digest"))


@query(
    "a24_length_bins",
    """SELECT CAST(floor(length(text) / 20) * 20 AS INTEGER) AS bin, count(*) AS n,
              min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1""",
)
def a24(spark, folder):
    docs = table(spark, folder, "documents").withColumn("bin", length_bin("text"))
    return docs.groupBy("bin").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query(
    "x_scalar_functions",
    f"""SELECT doc_id, md5({STRIPPED}) AS stripped, lower(lang) AS low, length(text) AS n,
               left(text, 100) AS head, CAST(greatest(5, CAST(floor(length(text) * 0.7::DOUBLE) AS INTEGER)) AS INTEGER) AS min_len,
               CAST(floor(length(text) * 1.3::DOUBLE) AS INTEGER) AS max_len,
               contains(lower(text), 'thor') AS has_word FROM documents""",
)
def scalars(spark, folder):
    from textloom.functions.text import contains_any
    from textloom.operators.matching import length_range

    low, high = length_range(F.length("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(strip_ws("text")).alias("stripped"), F.lower("lang").alias("low"),
        F.length("text").cast("bigint").alias("n"), truncate("text", 100).alias("head"),
        low.alias("min_len"), high.alias("max_len"), contains_any("text", ["thor"]).alias("has_word"),
    )
