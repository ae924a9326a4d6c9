"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short, a document may be very long, so their Jaccard similarity says nothing;
what counts is the share of the item's shingles that the document contains. The item's
sketch is its smallest shingle hashes (bottom-k MinHash). How many depends on its size n:
with a required containment t, any ``n - ceil(t n) + 1`` shingles of the item include at least
one that a containing document shares, so a sketch of that length misses nothing. Items are
partitioned by size (powers of two); each partition has the largest hash of its sketches as
its threshold, and a document shingle above every threshold of its width is dropped at
once. What is left meets the sketches in an equi-join on the hash. Candidates are
verified by the exact containment of shingle texts, so hash collisions do no harm.

Words are separated by ASCII white space and compared in lower case. Shingles have five words; an item of
fewer words is one shingle of its own length. Everything runs as built-in expressions.

Defined results: null or blank texts contain nothing; blank items are never found; empty
tables give an empty result. Repeated document ids give one row with the fullest hit.
A null id is an id like any other. Columns besides id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm.common import documents, let, words

WIDTH = 5
CONTAINMENT = 80  # per cent
BROADCAST_ROWS = 200_000  # sketch rows of 20 bytes: 4 MB


def _shingle_hashes(hashes: Column, width: int) -> Column:
    def combined(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        return F.when(F.size(h) >= width, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))

    return let(hashes, combined)


def _shingle_texts(w: Column, width: Column) -> Column:
    def texts(own: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(own) - width + 1)
        shingles = F.transform(at, lambda i: F.array_join(F.slice(own, i, width), " "))
        return F.array_distinct(F.when(F.size(own) >= width, shingles).otherwise(F.array().cast("array<string>")))

    return let(w, texts)


def _hashed(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    split = df.select(F.col(key).alias(out), words(F.lower(text)).alias("w"))
    return split.select(out, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def item_sketches(items: DataFrame, key: str = "item_id", text: str = "text", percent: int = CONTAINMENT) -> DataFrame:
    """item, width, size class and the hashes of its sketch."""
    rows = None
    base = _hashed(items, key, text, "item").where(F.size("w") > 0)
    for width in range(1, WIDTH + 1):
        fits = base.where(F.size("w") >= WIDTH) if width == WIDTH else base.where(F.size("w") == width)
        one = fits.select("item", F.lit(width).alias("width"), F.array_sort(F.array_distinct(_shingle_hashes(F.col("h"), width))).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    n = F.size("s")
    k = n - F.ceil(n * F.lit(percent) / 100).cast("int") + 1
    return rows.select("item", "width", F.floor(F.log2(n)).cast("int").alias("size_class"), F.slice("s", 1, k).alias("sketch"))


def find_contained(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", percent: int = CONTAINMENT
) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment for every pair at or above the containment."""
    sketches = item_sketches(items, item_key, text, percent)
    flat = sketches.select("item", "width", "size_class", F.explode("sketch").alias("hash"))
    # One row per width and size class: at most 5 * 64.
    limits: dict[int, int] = {}
    total = 0
    for r in flat.groupBy("width", "size_class").agg(F.max("hash").alias("top"), F.count("*").alias("n")).collect():
        limits[r["width"]] = max(limits.get(r["width"], r["top"]), r["top"])
        total += r["n"]
    hashed = _hashed(docs, doc_key, text, "doc")
    candidates = None
    keys = flat.select("item", F.col("width").alias("_width"), F.col("hash").alias("_hash"))
    for width, top in sorted(limits.items()):
        shingles = hashed.select("doc", F.explode(_shingle_hashes(F.col("h"), width)).alias("hash")).where(F.col("hash") <= top)
        mine = keys.where(F.col("_width") == width)
        mine = F.broadcast(mine) if total <= BROADCAST_ROWS else mine
        met = shingles.join(mine, shingles["hash"] == mine["_hash"]).select("doc", "item")
        candidates = met if candidates is None else candidates.unionByName(met)
    if candidates is None:
        candidates = docs.select(F.col(doc_key).alias("doc")).crossJoin(items.select(F.col(item_key).alias("item")).limit(0)).limit(0)
    return _verified(candidates.distinct(), docs, items, doc_key, item_key, text, percent)


def _verified(candidates: DataFrame, docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, percent: int) -> DataFrame:
    item_words = items.select(F.col(item_key).alias("_item"), words(F.lower(text)).alias("_iw"))
    width = F.least(F.size("_iw"), F.lit(WIDTH))
    item_sets = item_words.where(F.size("_iw") > 0).select("_item", width.alias("_width"), _shingle_texts(F.col("_iw"), width).alias("_is"))
    pairs = candidates.join(item_sets, candidates["item"].eqNullSafe(item_sets["_item"]))
    texts = docs.select(F.col(doc_key).alias("_doc"), F.col(text).alias("_text"))
    both = texts.join(pairs, texts["_doc"].eqNullSafe(pairs["doc"])).select("doc", "item", "_is", "_width", words(F.lower("_text")).alias("_w"))
    counted = both.select(
        "doc", "item", F.size("_is").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("_is", _shingle_texts(F.col("_w"), F.col("_width")))).cast("long").alias("n_found"),
    )
    hits = counted.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
    best = hits.groupBy("doc", "item").agg(F.max(F.struct("n_found", "n_shingles")).alias("b"))
    return best.select(
        F.col("doc").alias(doc_key), F.col("item").alias(item_key), F.col("b.n_shingles").alias("n_shingles"), F.col("b.n_found").alias("n_found"),
        (F.col("b.n_found") / F.col("b.n_shingles")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents that contain no test item, columns unchanged."""
    hit = find_contained(docs, items, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items they contain."""
    return find_contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ishingle AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM iw WHERE len(w) > 0)),
dshingle AS (SELECT DISTINCT doc_id, k AS width, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM dw, (SELECT DISTINCT width AS k FROM ishingle) WHERE len(w) >= k)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM ishingle GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM dshingle JOIN ishingle USING (width, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING 100 * count(*) >= 80 * n_shingles
"""
