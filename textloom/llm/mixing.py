"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is a stream of words: its documents in seeded order, one after the other, cut
into blocks of ``block`` words. Seats are blocks. Sainte-Laguë gives the next seat to the
source with the highest quotient ``target / (2 * seats + 1)``; because it only ever adds
seats, the quota of shard k is what k shards would get together minus what k - 1 would get.
A seeded permutation of a source's blocks says which blocks fill which quota; once every
block was used, the second pass over the same permutation begins. The mix has ``shards`` shards, and a taken block carries
the shard whose quota it fills, once per pass.

Where things happen: targets and seats need one row per source. The order of documents
comes from hashed ranges whose number follows the number of documents, so a source with a third of
all rows is spread over many tasks; the sum of sizes before a range comes from a table with
one row per source and range. Blocks are never materialised: a document finds its own
blocks by arithmetic.

Defined results: null text has size 0, is never taken and keeps its row. Null is a source of
its own, last in order. Rows that share an id, null ids among them, are told apart by a 128-bit digest of their text
and take their own words; only copies equal in id and text take the same ones. Null ids are ordered by the digest, so many of them spread over the ranges. An empty table gives an empty result. Columns that clash with the ones
added are replaced; all other columns pass through in :func:`mix_documents`.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from textloom.llm.common import SPACE, SPACE_CHARS, checkpointed, documents, n_words, packed, unpacked

WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARDS = 64
DOCS_PER_RANGE = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: src, source_size, target.

    Sources in code point order (null last) carry the weights in turn. No target exceeds
    ``most`` times its source; what is cut off goes to the others by weight. With shares
    ``level * weight`` the sources that hit their cap are those with the lowest
    cap-to-weight ratio, so one ordered pass over the table of sources finds the level.
    ``sizes`` has one row per source; the windows run over that table alone.
    """
    order = W.orderBy(F.col("src").isNull(), F.hex(F.encode("src", "UTF-8")))
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "_i").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_ratio), zero)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), zero)
    )
    # The first source in ratio order that stays below its cap fixes the level.
    found = ranked.withColumn("_level", level)
    found = found.withColumn("_open", F.when(F.col("_level") * F.col("weight") < F.col("cap"), F.col("_level")))
    first = F.min(F.when(F.col("_open").isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("_i"), F.col("_level").alias("level")))).over(everything)
    found = found.withColumn("_level", first["level"])
    share = F.coalesce(F.least(F.col("_level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return found.select("src", "source_size", share.alias("target"))


def sainte_lague(targets: list[float], seats: int) -> list[int]:
    """Seats by highest quotient target / (2 s + 1); ties go to the earlier source.

    The quotient that the last seat needs is searched; all higher ones have a seat for certain, and
    only seats at that quotient are dealt one by one.
    """
    total = sum(targets)
    if seats <= 0 or total <= 0:
        return [0] * len(targets)
    all_targets = np.array(targets, float)

    def above(q: float) -> np.ndarray:
        """Quotients higher than q, per source."""
        n = np.floor((all_targets / q + 1) / 2)
        n -= (n > 0) & (all_targets / np.maximum(2 * n - 1, 1) <= q)
        return n + (all_targets / (2 * n + 1) > q)

    high = low = float(all_targets.max())
    while above(low).sum() <= seats:
        high, low = low, low / 2
    while low < (q := (low + high) / 2) < high:
        low, high = (q, high) if above(q).sum() > seats else (low, q)
    given = above(high).astype(int).tolist()
    heap = [(-(t / (2 * s + 1)), i) for i, (t, s) in enumerate(zip(targets, given)) if t > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (-(targets[i] / (2 * given[i] + 1)), i))
    return given


def shard_quotas(targets: list[float], block: int, shards: int) -> list[list[int]]:
    """Blocks per source for every shard: differences of growing Sainte-Laguë allocations."""
    seats = round(sum(targets) / block)
    total = [sainte_lague(targets, seats * k // shards) for k in range(shards + 1)]
    return [[b - a for a, b in zip(total[k], total[k + 1])] for k in range(shards)]


def _hash(text: Column) -> Column:
    """60 bits of MD5, which any engine can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _permuted(index: Column, n: Column, key: Column) -> Column:
    """Place of a block in its source's seeded order: a keyed affine map on [0, n).

    The multiplier is a large prime, so the map is a permutation unless n is a multiple of
    it; then the order stays unmixed. The product is a decimal and cannot overflow.
    """
    prime = F.lit(2_147_483_647).cast("decimal(20,0)")
    mixed = (index.cast("decimal(18,0)") * prime + key.cast("decimal(20,0)")) % n.cast("decimal(18,0)")
    return F.when(n % 2_147_483_647 == 0, index).otherwise(mixed.cast("long"))


def _positions(docs: DataFrame, seed: int) -> DataFrame:
    """src, doc_id, size, _start: the words of its source that lie before each document.

    ``docs`` needs _key, src, size. Ranges of the seeded hash are summed first; inside a
    range a window adds up.
    """
    n = docs.count()
    ranges = max(1, math.ceil(n / DOCS_PER_RANGE))
    order = _hash(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.col("_sign1").cast("string")))))
    keyed = docs.withColumn("_h", order).withColumn("_r", F.floor(F.col("_h") / F.lit(float(1 << 60)) * ranges).cast("int"))
    per_range = keyed.groupBy("src", "_r").agg(F.sum("size").alias("_n"))
    before = W.partitionBy("src").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(F.col("src").alias("_s"), F.col("_r").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("src", "_r").orderBy("_h", "doc_id", "size", "_sign1", "_sign2").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(offsets, placed.src.eqNullSafe(offsets._s) & (placed._r == offsets._q))
    return joined.withColumn("_start", F.col("_before") + F.col("_in")).drop("_s", "_q", "_before", "_in", "_h", "_r")


def _sources(docs: DataFrame, weights: tuple[int, ...], budget: float, most: float, block: int, shards: int) -> DataFrame:
    """The table of sources with target, number of blocks, seats, and seats up to each shard's end. One row per source."""
    spark = docs.sparkSession
    sizes = docs.groupBy("src").agg(F.sum("size").alias("source_size"))
    rows = source_targets(sizes, weights, budget, most).collect()
    targets = [r["target"] for r in rows]
    ends = np.cumsum(np.array(shard_quotas(targets, block, shards), np.int64).reshape(shards, len(rows)), axis=0).T.tolist()
    data = [(r["src"], r["source_size"], r["target"], -(-r["source_size"] // block), e[-1], e) for r, e in zip(rows, ends)]
    return spark.createDataFrame(data, "src string, source_size long, target double, _blocks long, _seats long, _ends array<long>")


def _taken(block: int) -> Column:
    """Per document: array of (from, to, times, shards) in words of the document, one entry per block it touches; one shard per time."""
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)

    def piece(j: Column) -> Column:
        rank = _permuted(j, F.col("_blocks"), _hash(F.coalesce(F.col("src"), F.lit(""))))
        full = F.floor(F.col("_seats") / F.col("_blocks"))
        times = full + F.when(rank < F.col("_seats") % F.col("_blocks"), 1).otherwise(0)
        low = F.greatest(j * block - F.col("_start"), F.lit(0))
        high = F.least((j + 1) * block - F.col("_start"), F.col("size"))
        times = F.least(times, F.lit(2)).cast("long")
        places = F.slice(F.array(rank, rank + F.col("_blocks")), F.lit(1), times.cast("int"))
        shards = F.transform(places, lambda k: F.size(F.filter("_ends", lambda end: end <= k)))
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), times.alias("times"), shards.alias("shards"))

    none = F.array().cast("array<struct<low:bigint,high:bigint,times:bigint,shards:array<int>>>")
    return F.when(F.col("size") > 0, F.transform(F.sequence(first, last), piece)).otherwise(none)


def _signs(text: Column) -> dict[str, Column]:
    """Two 64-bit digests of a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return {"_sign1": F.xxhash64(text), "_sign2": F.xxhash64(F.lit(1), text)}


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 42, shards: int = SHARDS) -> DataFrame:
    """Add size, source_size, target and _pieces (which words are taken, how often, for which shards) to documents."""
    own = {"src", "size", "source_size", "target", "_pieces", "_start", "_blocks", "_seats", "_ends"}
    base = docs.drop(*[c for c in docs.columns if c in own])
    sized = base.withColumn("src", F.col("source").cast("string")).withColumn("size", n_words("text")).withColumns(_signs(F.col("text")))
    slim = checkpointed(sized.select("doc_id", "src", "size", "_sign1", "_sign2"), "mix-sizes")
    return _mixed(slim, weights, budget, most, block, seed, shards)


def _mixed(slim: DataFrame, weights, budget, most, block, seed, shards) -> DataFrame:
    table = _sources(slim, weights, budget, most, block, shards).withColumnRenamed("src", "_src")
    placed = _positions(slim, seed)
    joined = placed.join(table, placed.src.eqNullSafe(table._src)).drop("_src")
    return joined.withColumn("_pieces", _taken(block))


def words_taken(pieces: Column | str = "_pieces") -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + (p["high"] - p["low"]) * p["times"])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: one row per document and pass with the words taken, in the document's columns.

    A document taken as a whole keeps its text. Of others the words of a block are joined by
    spaces and blocks by line breaks; n_chars follows the new text.
    """
    pieces = mix(docs, **options).select(F.col("doc_id").alias("_id"), F.col("_sign1").alias("_a"), F.col("_sign2").alias("_b"), "_pieces")
    pieces = pieces.groupBy("_id", "_a", "_b").agg(F.max("_pieces").alias("_pieces"))
    rows = packed(docs, _key=F.col("doc_id"), _text=F.coalesce(F.col("text"), F.lit("")), **_signs(F.col("text")))
    both = rows.join(pieces, rows["_key"].eqNullSafe(pieces["_id"]) & (rows["_sign1"] == pieces["_a"]) & (rows["_sign2"] == pieces["_b"]))
    passes = both.withColumn("_pass", F.explode(F.array(F.lit(1), F.lit(2))))
    passes = passes.withColumn("_used", F.filter("_pieces", lambda p: p["times"] >= F.col("_pass")))
    passes = passes.withColumn("_n", F.aggregate("_used", F.lit(0).cast("long"), lambda a, p: a + p["high"] - p["low"])).where(F.col("_n") > 0)
    passes = passes.withColumn("_words", F.split(F.btrim("_text", F.lit(SPACE_CHARS)), SPACE))
    cut = F.array_join(F.transform("_used", lambda p: F.array_join(F.slice("_words", (p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int")), " ")), "\n")
    text = F.when(F.col("_n") == F.size("_words"), F.col("_text")).otherwise(cut)
    passes = passes.withColumn("_cut", text)
    return unpacked(passes, docs.columns, text=F.col("_cut"), n_chars=F.length("_cut").cast(dict(docs.dtypes).get("n_chars", "long")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their source's target and the words the mix takes from each."""
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", words_taken().alias("taken"))


SQL = r"""
WITH z AS (SELECT doc_id, source AS src, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
so AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS i FROM z GROUP BY src),
wt AS (SELECT *, CAST([5, 2, 1][i % 3 + 1] AS DOUBLE) AS weight, 2::DOUBLE * source_size AS cap FROM so),
lv AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM wt WINDOW o AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fl AS (SELECT level FROM lv WHERE level * weight < cap ORDER BY cap / weight, i LIMIT 1),
tg AS (SELECT src, i, source_size, coalesce(least((SELECT level FROM fl) * weight, cap), cap) AS target, CAST(ceil(source_size / 64) AS BIGINT) AS blocks FROM wt),
qs AS (SELECT i, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, i) AS place FROM (SELECT i, target, unnest(range(0, 2 * blocks + 3)) AS s FROM tg WHERE target > 0)),
st AS (SELECT tg.*, coalesce(n, 0) AS seats FROM tg LEFT JOIN (SELECT i, count(*) AS n FROM qs
  WHERE place <= (SELECT round(sum(target) / 64) FROM tg) GROUP BY i) USING (i)),
ps AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY CAST(concat('0x', substr(md5(concat('42:', doc_id)), 1, 15)) AS BIGINT), doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM z),
bl AS (SELECT ps.*, st.source_size, st.target, st.blocks, st.seats FROM ps JOIN st ON ps.src IS NOT DISTINCT FROM st.src),
pc AS (SELECT doc_id, j, greatest(j * 64 - begin, 0) AS low, least((j + 1) * 64 - begin, size) AS high, seats // blocks
    + CASE WHEN (CAST(j AS HUGEINT) * 2147483647 + CAST(concat('0x', substr(md5(coalesce(src, '')), 1, 15)) AS BIGINT)) % blocks < seats % blocks THEN 1 ELSE 0 END AS times
  FROM (SELECT *, unnest(range(CAST(begin // 64 AS BIGINT), CAST((begin + size - 1) // 64 + 1 AS BIGINT))) AS j FROM bl WHERE size > 0)),
tk AS (SELECT doc_id, CAST(sum((high - low) * least(times, 2)) AS BIGINT) AS taken FROM pc GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken FROM bl LEFT JOIN tk USING (doc_id)
"""
