"""Samples, splits, replication, dedup, reference matching."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from textloom.catalog.base import query, sql_strip, table
from textloom.operators import matching, sampling
from textloom.operators.subwords import Subwords, detokenize
from textloom.operators.tokens import tokenize
from textloom.session import materialize
from textloom.functions.text import strip_ws
from textloom.sources.readers import replicate, spread


@query(
    "n7_replicate",
    """SELECT copy * (SELECT count(*) FROM documents) + doc_id AS row_id, copy, md5(text) AS digest
       FROM documents, range(5) r(copy)""",
)
def n7(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), F.md5("text").alias("digest"))
    return replicate(docs, 5, "row_id")


@query(
    "s7_list_times_ten",
    "SELECT md5(text) AS digest, 10 * count(*) AS n FROM benchmark GROUP BY 1",
)
def s7(spark, folder):
    ten = replicate(table(spark, folder, "benchmark").select("text"), 10)
    return ten.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query(
    "n8_cycle_128",
    """WITH b AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS i, least(count(*) OVER (), 128) AS m FROM benchmark),
            c AS (SELECT p AS position, item_id FROM range(128) r(p) JOIN b ON b.i = p % b.m)
       SELECT position, item_id, CAST(row_number() OVER (ORDER BY md5(concat('42:', position)), position) - 1 AS BIGINT)
         AS shuffled_position FROM c""",
)
def n8(spark, folder):
    rows = sampling.cycle_to(table(spark, folder, "benchmark").select("item_id"), "item_id", 128)
    return rows.select("position", "item_id", F.col("shuffled_position").cast("bigint").alias("shuffled_position"))


@query(
    "a16_dedup_first",
    "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text",
)
def a16(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sampling.keep_first(docs, "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


SQL_DRAW = "CAST(concat('0x', substr(md5(concat('42-draw:', doc_id)), 1, 15)) AS BIGINT)"


@query(
    "a18_random_reference",
    f"""WITH refs AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5(concat('42:', k)), k) - 1 AS pos FROM
               (SELECT *, concat(conv_id, '-', turn) AS k FROM conversations))
        SELECT doc_id, conv_id, turn FROM documents d JOIN refs
          ON pos = {SQL_DRAW} % (SELECT count(*) FROM conversations)""",
)
def a18(spark, folder):
    refs = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("k")
    )
    docs = table(spark, folder, "documents").select("doc_id")
    return sampling.random_reference(docs, refs, "doc_id", "k").drop("k")


@query(
    "a19_seeded_cap",
    "SELECT doc_id, md5(text) AS digest FROM documents ORDER BY md5(concat('42:', doc_id)) LIMIT 350",
)
def a19(spark, folder):
    docs = table(spark, folder, "documents")
    return sampling.hash_sample(docs, "doc_id", 350).select("doc_id", F.md5("text").alias("digest"))


@query(
    "a20_train_validation",
    """SELECT doc_id, CASE WHEN rn <= ceil(0.02::DOUBLE * n) THEN 'validation' ELSE 'train' END AS split FROM (
         SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id))) AS rn, count(*) OVER () AS n FROM documents)""",
)
def a20(spark, folder):
    train, validation = sampling.split_train_validation(table(spark, folder, "documents"), "doc_id", 0.02)
    return train.select("doc_id", F.lit("train").alias("split")).unionByName(
        validation.select("doc_id", F.lit("validation").alias("split"))
    )


@query(
    "a21_shuffle_rank",
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) - 1 AS hash_rank FROM orders""",
)
def a21(spark, folder):
    return sampling.hash_rank(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "a22_training_steps",
    """SELECT source, n AS samples, 32 AS effective_batch, CAST(floor(n / 32) AS BIGINT) AS steps_per_epoch,
              CAST(floor(n / 32) AS BIGINT) * 3 AS total_steps
       FROM (SELECT source, count(*) AS n FROM (
         SELECT source, row_number() OVER (ORDER BY md5(concat('42:', doc_id))) AS rn, count(*) OVER () AS total FROM documents)
       WHERE rn > ceil(0.02::DOUBLE * total) GROUP BY source)""",
)
def a22(spark, folder):
    """Steps per source over the rows that the split leaves for training."""
    train, _ = sampling.split_train_validation(table(spark, folder, "documents"), "doc_id", 0.02)
    counts = train.groupBy("source").agg(F.count("*").alias("samples"))
    return counts.select("source", "samples", *sampling.steps_columns(F.col("samples"), 8 * 2 * 2, 3))


@query(
    "a23_throughput",
    "SELECT count(*) AS rows FROM documents",
)
def a23(spark, folder):
    from textloom.operators.summaries import throughput

    watched, observation = throughput(table(spark, folder, "documents"), "docs")
    watched.write.format("noop").mode("overwrite").save()
    return spark.range(1).select(F.lit(observation.get["rows"]).cast("bigint").alias("rows"))


@query(
    "g8_tokenize",
    """SELECT doc_id, least(strlen(text), 2048) AS n_kept, strlen(text) AS n_tokens, CAST(concat('0x', left(hex(text), 2)) AS INTEGER) AS first_token,
              true AS labels_equal FROM documents""",
)
def g8(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokenize(docs).select(
        "doc_id", F.size("input_ids").cast("bigint").alias("n_kept"), "n_tokens", F.get("input_ids", F.lit(0)).alias("first_token"),
        (F.col("input_ids") == F.col("labels")).alias("labels_equal"),
    )


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("g8_subwords", "SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS digest, true AS fewer FROM documents")
def g8_subwords(spark, folder):
    """Subword ids of every whole text, and the text they stand for again."""
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"))
    tokenizer = Subwords(TOKENIZER)
    back = detokenize(tokenize(docs, tokenizer, max_length=2**31 - 1), tokenizer)
    fewer = F.col("n_tokens") < F.when(F.col("n_bytes") < 20, F.col("n_bytes") + 1).otherwise(F.col("n_bytes"))
    return back.select("doc_id", "n_bytes", F.md5("text").alias("digest"), fewer.alias("fewer"))


# --- reference matching ------------------------------------------------------------------


def _references(spark, folder):
    """Distinct comments of usable length."""
    from textloom.functions.text import length_between

    usable = spread(table(spark, folder, "documents")).where(length_between("text")).select("doc_id", "text")
    return sampling.keep_first(usable, "text", "doc_id").select(F.col("doc_id").alias("ref_id"), "text")


SQL_MATCH = f"""WITH refs AS (
    SELECT ref_id, text AS ref_text, length(text) AS len,
           row_number() OVER (ORDER BY length(text), md5(concat('42:', ref_id)), ref_id) - 1 AS position
    FROM (SELECT min(doc_id) AS ref_id, text FROM documents WHERE length(text) BETWEEN 50 AND 1000 GROUP BY text)),
  total AS (SELECT count(*) AS t FROM refs),
  inp AS (SELECT doc_id AS input_id, {sql_strip('text')} AS body FROM documents),
  keyed AS (SELECT *, md5(lower(body)) AS k, greatest(5, CAST(floor(length(body) * 0.7::DOUBLE) AS INTEGER)) AS lo,
                   CAST(floor(length(body) * 1.3::DOUBLE) AS INTEGER) AS hi FROM inp),
  copies AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5(concat('42-copy:', input_id)), input_id) - 1 AS c FROM keyed),
  rng AS (SELECT *, (SELECT count(*) FROM refs WHERE len < lo) AS a, (SELECT count(*) FROM refs WHERE len <= hi) AS b FROM copies),
  s AS (SELECT *, greatest(b - a, 0) AS n, CAST(concat('0x', substr(md5(concat('42:', k)), 1, 15)) AS BIGINT) AS st FROM rng),
  p AS (SELECT input_id, CASE WHEN c < n THEN
           a + (st % greatest(n, 1) + (c % greatest(n, 1)) * (2654435761 % greatest(n, 1))) % greatest(n, 1)
         WHEN c < t THEN (b + c - n) % t ELSE (st + c) % t END AS position FROM s, total)
  SELECT input_id, ref_id, md5(ref_text) AS digest FROM p JOIN refs USING (position)"""


@query("v15_length_match", SQL_MATCH)
def v15(spark, folder):
    inputs = spread(table(spark, folder, "documents")).select("doc_id", "text")
    matched = matching.match_by_length(
        inputs, _references(spark, folder), "doc_id", "text", "ref_id", "text", threshold=None
    )
    return matched.select("input_id", "ref_id", F.md5("ref_text").alias("digest"))


def _checked(spark, folder, matched, bin_size=None):
    """Facts of a match: who got which kind of reference.

    The reference exists with its own text; one in the length range is not too similar; copies of one text have different
    references; exact comparisons are at most as many as candidates. Texts travel only where they can be compared: an input
    whose range begins beyond the longest reference goes by its length and digest, and what a reference says by its digest.
    """
    from textloom.functions.text import length_between

    docs = table(spark, folder, "documents").select("doc_id", "text")
    longest = docs.where(length_between("text")).agg(F.max(F.length("text"))).first()[0]

    def digest(text):
        return F.concat(F.md5(text), F.length(text).cast("string"))

    refs = docs.select(F.col("doc_id").alias("ref_id"), digest(F.col("text")).alias("own"))
    body = docs.select(F.col("doc_id").alias("input_id"), strip_ws(F.col("text")).alias("body"))
    low, high = matching.length_range(F.length("body"), bin_size)
    body = body.select("input_id", low.alias("low"), high.alias("high"), F.md5(F.lower("body")).alias("key"), F.when(low <= longest, F.col("body")).alias("body"))
    rows = matched.join(body, "input_id").join(refs, "ref_id", "left")
    inside = F.length("ref_text").between(F.col("low"), F.col("high"))
    unsure = inside & (matching.ratio_bound(*[matching.letter_counts(F.when(inside, F.col(c))) for c in ("ref_text", "body")]) > 0.9)
    rows = rows.withColumn("exists", F.col("own") == digest(F.col("ref_text"))).withColumn("inside", inside).withColumn("unsure", unsure)
    texts = [F.when(F.col("unsure"), F.col(c)).alias(c) for c in ("ref_text", "body")]
    rows = materialize(rows.select("input_id", "ref_id", "key", "exists", "inside", "probes", "compared", *texts), "matched")
    rows = rows.withColumn("ratio", matching.similarity_ratio("ref_text", "body"))
    # A pair of text and reference that more than one copy has: counted, never collected.
    shared = rows.groupBy("key", "ref_id").agg(F.count("*").alias("users")).where("users > 1")
    rows = rows.join(shared, ["key", "ref_id"], "left")
    return rows.select(
        "input_id", "exists", (F.coalesce("ratio", F.lit(0.0)) <= 0.9).alias("different"),
        F.col("users").isNull().alias("fresh"), (F.col("compared") <= F.col("probes")).alias("few_compared"), "inside", "probes",
    )


# References a length range holds, and the number of a copy among equal texts: an input gets one of its range if there are enough.
SQL_INSIDE = """, ranged AS (SELECT input_id, c, (SELECT count(*) FROM refs WHERE len >= {low}) - (SELECT count(*) FROM refs WHERE len > {high}) AS held FROM copies)
  SELECT input_id, true AS "exists", true AS fresh, true AS few_compared, c < held AS inside"""


# An input whose range holds only similar texts takes one outside, so the range is not part of the answer here.
@query(
    "v15_length_match_checked",
    'SELECT doc_id AS input_id, true AS "exists", true AS different, true AS fresh, true AS few_compared FROM documents',
)
def v15_checked(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text")
    return _checked(spark, folder, matching.match_by_length(docs, _references(spark, folder), "doc_id", "text", "ref_id", "text")).drop("probes", "inside")


@query(
    "v16_binned_match",
    SQL_MATCH[: SQL_MATCH.index(",\n  rng AS")]
    + SQL_INSIDE.format(low="lo // 20 * 20", high="hi // 20 * 20 + 19").replace("c < held AS inside", "c < held AS inside, true AS within_limit")
    + " FROM ranged",
)
def v16(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text")
    matched = matching.match_by_length(docs, _references(spark, folder), "doc_id", "text", "ref_id", "text", bin_size=20, max_probes=30)
    rows = _checked(spark, folder, matched, 20).drop("different")
    return rows.withColumn("within_limit", F.col("probes") <= 30).drop("probes")


@query("v15_similarity_ratio", SQL_MATCH.replace("SELECT input_id, ref_id, md5(ref_text) AS digest FROM p", "SELECT input_id AS doc_id, ref_id, true AS in_bounds FROM p"))
def ratio(spark, folder):
    """The ratio is at least 0, at most the bound by letter counts, which is at most what the lengths allow, and 1 for equal texts."""
    docs = spread(table(spark, folder, "documents")).select("doc_id", "text")
    matched = matching.match_by_length(
        docs, _references(spark, folder), "doc_id", "text", "ref_id", "text", threshold=None
    )
    both = docs.join(matched, docs.doc_id == matched.input_id).withColumn("ratio", matching.similarity_ratio("ref_text", "text"))
    a, b = F.length("ref_text"), F.length("text")
    same = F.when(F.lower("ref_text") == F.lower("text"), F.col("ratio") == 1).otherwise(True)
    bound = matching.ratio_bound(matching.letter_counts("ref_text"), matching.letter_counts("text"))
    ordered = F.col("ratio").between(0, bound + 1e-9) & (bound <= F.least(a, b) * 2 / (a + b) + 1e-9)
    return both.select("doc_id", "ref_id", (ordered & same).alias("in_bounds"))
