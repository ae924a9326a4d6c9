"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: each byte shifts the hash left and adds its own
random number, so the hash depends on the last 32 bytes only. A chunk ends after a word where the hash falls
into a third of its range and the last possible end lies far enough back. Both tests look only at nearby
bytes, so an insertion moves the borders around it and no others. A window begins at every chunk and takes as many
chunks as it needs for ``min_words`` words. Windows are told apart by a 64-bit digest of their words; one that
another document has as a whole is a repeated passage, and repeated windows that touch become spans.
Windows that an earlier document has and windows this document is the first to have are put together apart.

At 100 TB about one window in ten million meets the digest of another one by chance.

Scale: window rows, one per chunk, are counted per digest with map-side combining, then joined to the table of repeated digests
(one row each), which the planner can split when a digest is hot. Spans are put together per document.

Defined results: null, blank and empty texts have no chunks. Rows with equal ids are one document;
rows without an id are not looked at. Repeats inside one document do not count. White space between
words does not matter. Empty tables give an empty result. Other columns pass through in
:func:`drop_repeats` and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textloom.llm.arrays import Texts, _powers, mix64, text_slices
from textloom.llm.common import documents, packed, unpacked

MIN_WORDS = 16
MIN_BYTES = 8
MAX_WORDS = 64
CUT_BELOW = np.uint32((1 << 32) // 3)
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)
REACH = 32


def gear_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, beginning anew with every text.

    Sums over 2, 4, 8, 16 and 32 bytes follow from each other, so five passes give all.
    """
    h = GEAR[data]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    reach = 1
    while reach < REACH:
        earlier = np.zeros_like(h)
        earlier[reach:] = h[:-reach] << np.uint32(reach)
        earlier[place < reach] = 0
        h = h + earlier
        reach *= 2
    return h


def chunks(texts: Texts) -> dict[str, np.ndarray]:
    """Chunks of every text: doc (row), index, digest, first and last word."""
    n = len(texts.start)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("doc", "index", "first", "last")} | {"digest": np.zeros(0, np.uint64)}
    doc = texts.doc_of_word()
    cut = gear_hash(texts.data, texts.offsets)[texts.end - 1] < CUT_BELOW
    at = np.flatnonzero(cut)
    far = np.ones(len(at), bool)
    far[1:] = (texts.end[at[1:]] - texts.end[at[:-1]] >= MIN_BYTES) | (doc[at[1:]] != doc[at[:-1]])
    last = np.union1d(at[far], texts.bounds[1:][np.diff(texts.bounds) > 0] - 1)
    first = np.concatenate([[0], last[:-1] + 1])
    # Longer stretches without an end are cut by count.
    pieces = (last - first) // MAX_WORDS + 1
    step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + step * MAX_WORDS
    end = np.minimum(begin + MAX_WORDS - 1, np.repeat(last, pieces))
    owner = doc[begin]
    start_of = np.searchsorted(owner, np.arange(len(texts)))
    return {"doc": owner, "index": np.arange(len(begin)) - start_of[owner], "digest": _digests(texts, begin, end), "first": begin, "last": end}


def _digests(texts: Texts, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Digest of the words first .. last, for every pair."""
    n = len(texts.start)
    up, down = _powers(1 << max(16, int(max(n + 1, len(texts.data))).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(texts.hashes() * up[:n], out=sums[1:])
    return mix64((sums[last + 1] - sums[first]) * down[first] + (last - first + 1).astype(np.uint64))


def windows(texts: Texts, min_words: int) -> dict[str, np.ndarray]:
    """Fewest whole chunks of at least ``min_words`` words, from every chunk on: as :func:`chunks`, with their number."""
    c = chunks(texts)
    to = np.searchsorted(c["last"], c["first"] + min_words - 1)
    at = np.flatnonzero(to < len(c["last"]))
    at = at[c["doc"][to[at]] == c["doc"][at]]
    first, last = c["first"][at], c["last"][to[at]]
    digest = _digests(texts, first, last) if len(at) else np.zeros(0, np.uint64)
    return {"doc": c["doc"][at], "index": c["index"][at], "digest": digest, "first": first, "last": last, "n_chunks": to[at] - at + 1}


def _window_rows(batches: Iterator[pa.RecordBatch], spans: bool, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in text_slices(batch.column(1)):
            texts = Texts(data, offsets)
            c = windows(texts, min_words)
            columns = [pa.array(ids[i:j][c["doc"]], pa.int64()), pa.array(c["digest"].view(np.int64))]
            names = ["doc", "digest"]
            if spans:
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                zero = points[texts.offsets[c["doc"]]]
                begin = points[texts.start[c["first"]]] - zero
                end = points[texts.end[c["last"]]] - zero
                word = texts.bounds[:-1][c["doc"]]
                columns += [pa.array(x.astype(np.int32)) for x in (c["index"], c["n_chunks"], c["first"] - word, c["last"] - word, begin, end)]
                names += ["index", "n_chunks", "first", "last", "start", "end"]
            yield pa.record_batch(columns, names=names)


def window_table(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, spans: bool = True) -> DataFrame:
    slim = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text).cast("string"))
    schema = "doc long, digest long" + (", index int, n_chunks int, first int, last int, start int, end int" if spans else "")
    return slim.mapInArrow(partial(_window_rows, spans=spans, min_words=min_words), schema)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end (code points), n_words, n_chunks, first_doc_id, n_repeated_words.

    One row per stretch of windows that other documents also have, in every document that has it. Windows
    that an earlier document has make stretches of their own, with n_repeated_words = n_words; those that this document
    is the first to have make others, with 0. Where one kind follows the other, stretches may share words.
    first_doc_id is the smallest id that has any of the windows.
    """
    found = window_table(docs, key, text, min_words, spans=False).groupBy("digest").agg(F.min("doc").alias("owner"), F.max("doc").alias("_hi"))
    repeated = found.where("owner < _hi").select("digest", "owner")
    hits = window_table(docs, key, text, min_words).join(repeated, "digest").withColumn("_early", F.col("owner") < F.col("doc"))
    inside = W.partitionBy("doc", "_early").orderBy("index")
    reached = F.max(F.col("index") + F.col("n_chunks")).over(inside.rowsBetween(W.unboundedPreceding, -1))
    new = hits.withColumn("_new", F.when(F.col("index") <= reached, 0).otherwise(1))
    runs = new.withColumn("_run", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    n_words = F.max("last").cast("long") - F.min("first") + 1
    return runs.groupBy("doc", "_early", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), n_words.alias("n_words"), (F.max(F.col("index") + F.col("n_chunks")) - F.min("index")).cast("long").alias("n_chunks"),
        F.min("owner").alias("first_doc_id"), F.when(F.col("_early"), n_words).otherwise(0).alias("n_repeated_words"),
    ).withColumnRenamed("doc", "doc_id").drop("_early", "_run")


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the passages that an earlier document has; columns unchanged.

    A passage goes when an earlier document has it as a whole; what follows or precedes it stays.
    """
    gone = repeated_spans(docs, key, text, min_words).where("n_repeated_words = n_words")
    per_doc = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_gone"))
    rows = packed(docs, _key=F.col(key).cast("long"), _text=F.col(text))
    both = rows.join(per_doc, rows["_key"] == per_doc["_id"], "left")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.substring(F.col("_text"), acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(s["end"].alias("pos"), F.concat(acc["out"], piece).alias("out"))

    rest = F.aggregate("_gone", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["pos"] + 1, F.length("_text"))))
    return unpacked(both, docs.columns, **{text: F.when(F.col("_gone").isNotNull(), rest).otherwise(F.col("_text"))})


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share, in every document that has them."""
    return repeated_spans(documents(spark, sf_dir))
