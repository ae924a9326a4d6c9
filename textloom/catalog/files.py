"""Writers and readers, checked by reading back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.catalog.base import SQL_RESPONSES, classified, query, table
from textloom.catalog.generation import SQL_TASKS, examples
from textloom.catalog.labels import SQL_EXPLODED, SQL_QA, TEXT, pairs
from textloom.catalog.vectors import SQL_BEST, SQL_SIDES, sides
from textloom.operators import parsing, reshape, similarity
from textloom.schemas import TRAINING_PAIR
from textloom.session import materialize, new_path
from textloom.sources import csv_column, load, read_jsonl, readers, writers
from textloom.streaming.append import append_jsonl, read_appended



def _sql_good(columns: str) -> str:
    return SQL_RESPONSES + f"SELECT {columns} FROM resp WHERE NOT failed AND lower({TEXT}) NOT IN ('', 'nan')"


def _good(spark, folder):
    return reshape.split_failed(pairs(spark, folder))[0]


@query(
    "k1_training_jsonl",
    _sql_good(columns=f"md5({TEXT}) AS digest, CASE WHEN has_alerts THEN 'true' ELSE 'false' END AS flag"),
)
def k1(spark, folder):
    path = writers.write_jsonl(_good(spark, folder).select("input", "output"), new_path(spark, "k1"))
    back = read_jsonl(spark, path, TRAINING_PAIR)
    return back.select(F.md5("input").alias("digest"), F.get_json_object("output", "$.has_alerts").alias("flag"))


@query("k2_qa_json", _sql_good(columns="row_id AS id, source AS source_column, has_alerts, len(alerts) AS n_alerts"))
def k2(spark, folder):
    good = _good(spark, folder)
    path = writers.write_jsonl(good, new_path(spark, "k2"))
    back = read_jsonl(spark, path, good.schema)
    return back.select("id", "source_column", F.col("output_parsed.has_alerts").alias("has_alerts"),
                       F.size("output_parsed.alerts").cast("bigint").alias("n_alerts"))


@query("k3_qa_csv", SQL_RESPONSES + f"SELECT CAST(id AS VARCHAR) AS id, md5(input) AS digest, CAST(num_alerts AS VARCHAR) AS num_alerts, nullif(alert_types, '') AS alert_types, non_alert_classification, source_column FROM ({SQL_QA})")
def k3(spark, folder):
    path = writers.write_csv(reshape.qa_rows(_good(spark, folder)), new_path(spark, "k3") + ".csv")
    back = load(spark, path)
    return back.select("id", F.md5("input").alias("digest"), "num_alerts", F.nullif("alert_types", F.lit("")).alias("alert_types"),
                       "non_alert_classification", "source_column")


@query(
    "k4_failed_json",
    SQL_RESPONSES
    + f"SELECT row_id AS id, 'PARSE_FAILED' AS error, source AS source_column FROM resp WHERE failed AND lower({TEXT}) NOT IN ('', 'nan')",
)
def k4(spark, folder):
    good, bad = reshape.split_failed(materialize(pairs(spark, folder), "k4-pairs"))
    paths = writers.write_training_set(good, bad, new_path(spark, "k4"), "set")
    if paths["failed"] is None:
        return bad.select("id", "error", "source_column")
    return read_jsonl(spark, paths["failed"], "id bigint, error string, source_column string")


@query(
    "k5_exploded_csv",
    SQL_RESPONSES
    + f"SELECT text_id, CAST(alert_number AS VARCHAR) AS alert_number, alert_type, severity, non_alert_reasoning FROM ({SQL_EXPLODED})",
)
def k5(spark, folder):
    rows = reshape.explode_results(classified(spark, folder))
    back = load(spark, writers.write_csv(rows, new_path(spark, "k5") + ".csv"))
    return back.select("text_id", "alert_number", "alert_type", "severity", "non_alert_reasoning")


@query(
    "k6_streaming_append",
    """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def k6(spark, folder):
    """Files are picked up as a stream, parsed and appended batch by batch."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    path = new_path(spark, "k6")

    def parse(batch):
        parsed = parsing.parse_typed(batch, {"type": "object", "properties": {"k": {"type": "integer"}}}, "props")
        return parsed.select("event_id", "event_type", F.col("parsed.k").alias("k"))

    append_jsonl(stream, path, new_path(spark, "k6-progress"), parse).awaitTermination()
    return read_appended(spark, path, "event_id bigint, event_type string, k bigint")


@query(
    "k7_bulk_jsonl",
    SQL_TASKS + "SELECT task_id, example_type, tone, alert_types FROM tasks",
)
def k7(spark, folder):
    rows = examples(spark, folder).select("text", "metadata", "row_id")
    path = writers.write_jsonl(rows, new_path(spark, "k7"))
    back = read_jsonl(spark, path, rows.schema)
    return back.select(
        F.col("row_id").alias("task_id"), F.col("metadata.example_type").alias("example_type"),
        F.col("metadata.tone").alias("tone"),
        F.array_join("metadata.expected_alert_types", ",").alias("alert_types"),
    )


@query(
    "k8_examples_csv",
    SQL_TASKS
    + """SELECT CAST(task_id + 1 AS VARCHAR) AS id, example_type, coalesce(replace(alert_types, ',', ', '), '') AS expected_alert_types,
           coalesce(non_alert_type, '') AS expected_non_alert_type, difficulty FROM tasks""",
)
def k8(spark, folder):
    path = writers.write_csv(writers.example_rows(examples(spark, folder)), new_path(spark, "k8") + ".csv")
    back = load(spark, path)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return back.select("id", "example_type", empty("expected_alert_types"), empty("expected_non_alert_type"), "difficulty")


@query(
    "k9_selected_csv",
    SQL_SIDES
    + SQL_BEST
    + """SELECT md5(d.text) AS digest, round(c, 6) AS organic_similarity, md5(o2.text) AS closest,
           CASE WHEN d.lang = 'en' THEN 'en' ELSE 'Unknown' END AS example_type
         FROM best LEFT JOIN documents d ON d.doc_id = best.id LEFT JOIN documents o2 ON o2.doc_id = best.nearest_id""",
)
def k9(spark, folder):
    s, o = sides(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    best = similarity.nearest(s, o, "vec_id", "vec_id")
    closest = docs.select(F.col("doc_id").alias("nearest_id"), F.col("text").alias("closest_organic_text"))
    rows = best.join(docs.withColumnRenamed("doc_id", "id"), "id", "left").join(closest, "nearest_id", "left")
    none = F.lit(None)
    meta = F.struct(
        F.when(F.col("lang") == "en", F.col("lang")).alias("example_type"),
        none.cast("array<string>").alias("expected_alert_types"),
        none.cast("string").alias("expected_non_alert_type"),
    )
    selected = rows.select("text", F.col("max_similarity").alias("organic_similarity"), "closest_organic_text", meta.alias("metadata"))
    back = load(spark, writers.write_csv(writers.selected_rows(selected), new_path(spark, "k9") + ".csv"))
    return back.select(
        F.md5("text").alias("digest"), F.round(F.col("organic_similarity").cast("double"), 6).alias("organic_similarity"),
        F.md5("closest_organic_text").alias("closest"), "example_type",
    )


@query(
    "k11_cleaned_csv",
    r"""SELECT CAST(page_id AS VARCHAR) AS page_id, md5(replace(replace(regexp_replace(html,
          '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '_x000D_', ' '), chr(13), chr(10))) AS digest FROM pages""",
)
def k11(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.concat(F.lit("\x07"), "html").alias("html"))
    back = load(spark, writers.write_csv(writers.clean_strings(pages), new_path(spark, "k11") + ".csv"))
    return back.select("page_id", F.md5(F.replace("html", F.lit("\r"), F.lit("\n"))).alias("digest"))


@query(
    "k13_simplified_jsonl",
    _sql_good(
        columns=f"md5({TEXT}) AS digest, CASE WHEN has_alerts THEN len(alerts) ELSE 0 END AS n_types, non_alert AS first_other"
    ),
)
def k13(spark, folder):
    simple = _good(spark, folder).select(
        "input", F.to_json(parsing.simplified_labels("output")).alias("output")
    )
    back = read_jsonl(spark, writers.write_jsonl(simple, new_path(spark, "k13")), TRAINING_PAIR)
    labels = F.from_json("output", "alert_types array<string>, non_alert_types array<string>")
    return back.select(
        F.md5("input").alias("digest"), F.size(labels["alert_types"]).cast("bigint").alias("n_types"),
        F.try_element_at(labels["non_alert_types"], F.lit(1)).alias("first_other"),
    )


# --- sources -----------------------------------------------------------------------------


@query(
    "s1_load_formats",
    """SELECT f.format, count(*) AS n, sum(p_partkey) AS keys, min(p_name) AS first_name FROM part,
         (SELECT unnest(['csv', 'txt', 'parquet', 'jsonl', 'pkl', 'xlsx']) AS format) f GROUP BY 1""",
)
def s1(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    base = new_path(spark, "s1")
    part.write.parquet(f"{base}/a.parquet")
    writers.write_csv(part, f"{base}/a.csv")
    writers.write_csv(part, f"{base}/a.txt")
    writers.write_jsonl(part, f"{base}/a.jsonl")

    writers.write_pickle(part, f"{base}/a.pkl", 700)
    writers.write_excel(part, f"{base}/a.xlsx", rows_per_file=900)
    parts = {f: load(spark, f"{base}/a.{f}", part.schema if f in ("csv", "txt", "jsonl") else None) for f in ("csv", "txt", "parquet", "jsonl", "pkl", "xlsx")}
    rows = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("format"), "p_partkey", "p_name")
        rows = df if rows is None else rows.unionByName(df)
    return rows.groupBy("format").agg(
        F.count("*").alias("n"), F.sum("p_partkey").cast("decimal(38,0)").alias("keys"), F.min("p_name").alias("first_name")
    )


@query(
    "s1_excel",
    "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice, p_size % 2 = 0 AS even, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS brand, "
    "CASE WHEN p_size % 7 <> 0 THEN TIMESTAMP '2020-02-28 06:00:00' + p_size * INTERVAL 1 DAY END AS moment, p_size % 5 = 0 AS mixed_is_text FROM part",
)
def s1_excel(spark, folder):
    """Cells of every type through workbooks: numbers, truth values, moments, blanks, and a column of numbers and texts."""
    size = F.col("p_size")
    moment = F.lit("2020-02-28 06:00:00").cast("timestamp_ntz") + F.make_dt_interval(size)
    part = table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_size", "p_retailprice", (size % 2 == 0).alias("even"), F.when(size % 3 != 0, F.col("p_brand")).alias("brand"),
        F.when(size % 7 != 0, moment).alias("moment"), F.when(size % 5 == 0, F.concat(F.lit("size "), size)).otherwise("12").alias("mixed"),
    )
    path = writers.write_excel(part, new_path(spark, "s1") + ".xlsx", "Parts", 1500)
    return load(spark, path).withColumn("mixed_is_text", F.col("mixed").startswith("size ")).drop("mixed")


@query("s2_excel_column", "SELECT p_brand AS comment, count(*) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY 1")
def s2_excel(spark, folder):
    """The text column of a workbook, blanks dropped before anything becomes text."""
    part = table(spark, folder, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("comment"))
    path = writers.write_excel(part, new_path(spark, "s2") + ".xlsx")
    return readers.text_column(load(spark, path)).groupBy("comment").agg(F.count("*").alias("n"))


def _jsonl(spark, folder, name):
    path = new_path(spark, name)
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    writers.write_jsonl(rows, path)
    return path


JSONL_SCHEMA = "conv_id bigint, turn bigint, text string"


@query("s3_jsonl", "SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def s3(spark, folder):
    back = read_jsonl(spark, _jsonl(spark, folder, "s3"), JSONL_SCHEMA)
    return back.select("conv_id", "turn", F.md5("text").alias("digest"))


@query("s4_jsonl_blank_lines", "SELECT conv_id, turn FROM conversations")
def s4(spark, folder):
    path = new_path(spark, "s4")
    turns = table(spark, folder, "conversations").select(
        F.concat(F.to_json(F.struct("conv_id", "turn")), F.lit("\n  \n")).alias("value")
    )
    turns.write.text(path)
    return read_jsonl(spark, path, "conv_id bigint, turn bigint")


@query("s5_many_files", "SELECT conv_id, count(*) * 2 AS n FROM conversations GROUP BY 1")
def s5(spark, folder):
    paths = [_jsonl(spark, folder, "s5"), new_path(spark, "never-written"), _jsonl(spark, folder, "s5")]
    return read_jsonl(spark, paths, JSONL_SCHEMA, skip_missing=True).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("s6_glob", "SELECT conv_id, count(*) * 2 AS n FROM conversations GROUP BY 1")
def s6(spark, folder):
    base = new_path(spark, "s6")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    for part in ("one", "two"):
        writers.write_jsonl(rows, f"{base}/{part}.jsonl")
    return read_jsonl(spark, f"{base}/*.jsonl", JSONL_SCHEMA).groupBy("conv_id").agg(F.count("*").alias("n"))


@query(
    "s8_csv_column",
    "SELECT md5(replace(text, chr(13), chr(10))) AS digest, count(*) * 10 AS n FROM conversations GROUP BY 1",
)
def s8(spark, folder):
    path = new_path(spark, "s8") + ".csv"
    writers.write_csv(table(spark, folder, "conversations").withColumnRenamed("text", "comment"), path)
    rows = csv_column(spark, path, "comment", 10)
    return rows.groupBy(F.md5(F.replace("comment", F.lit("\r"), F.lit("\n"))).alias("digest")).agg(F.count("*").alias("n"))


