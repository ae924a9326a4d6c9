"""Token ids in training order, as fixed-stride shards.

Documents are tokenised with a public byte-level BPE and each ends with the end-of-text id. The tokens of
a task form one stream, cut into sequences of ``length`` ids; the last one of a task is filled up
with the end-of-text id. Sequences are written to the shared folder once, so tokenising runs once.

Order: sequences are numbered 0 .. n-1 (task, then place in the task). A keyed Feistel network
permutes that range: it works on pairs (x, y) with x < a, y < b, a * b >= n and steps outside the range are
walked on until the result lies inside. The result is the slot in training order; slots are exactly
0 .. n-1, each taken once, and the permutation needs neither a sort nor a table.

Shards: ``per_shard`` slots each, put together by a range partitioning on the slot. A sequence lies at
``(slot % per_shard) * stride`` bytes in shard ``slot // per_shard``, so a reader resumes anywhere by
arithmetic. :func:`write_shards` writes the files; a file is written under a name of the attempt and renamed when it is
whole, so a repeated task does no harm.

Defined results: null text is empty text, which is one end-of-text id. Repeated rows and ids are written
as often as they come. An empty table gives no sequences. Other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm.common import checkpointed, documents

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256
LENGTH = 1024
PER_SHARD = 8192
ROUNDS = 4
WALK = 64
# Fixed value: how the vocabulary's authors split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The tokenizer, read once per Python worker. The folder must exist on every machine."""
    import tiktoken

    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sequences(batches: Iterator[pa.RecordBatch], folder: str, length: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to sequences (part, number, n_tokens, doc_ids, starts, tokens)."""
    encode = encoder(folder).encode_to_numpy
    part = TaskContext.get().partitionId()
    held, held_ids, held_starts, filled, number = [], [], [], 0, 0

    def record(tokens: np.ndarray, n: int) -> tuple:
        return part, number, n, list(held_ids), list(held_starts), tokens.astype("<u2").tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = ["part", "number", "n_tokens", "doc_ids", "starts", "tokens"]
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = encode(text.as_py() or "", disallowed_special=())
            tokens = np.append(own, np.uint32(END))
            at = 0
            while at < len(tokens):
                take = min(length - filled, len(tokens) - at)
                held.append(tokens[at : at + take])
                held_ids.append(key)
                # Negative: the sequence begins inside the document.
                held_starts.append(filled - at)
                filled, at = filled + take, at + take
                if filled == length:
                    rows.append(record(np.concatenate(held), length))
                    held, held_ids, held_starts, filled, number = [], [], [], 0, number + 1
            if len(rows) >= 2048:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)
    if filled:
        pad = np.full(length - filled, END, np.uint32)
        yield batch_of([record(np.concatenate([*held, pad]), filled)])


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, folder: str = TOKENIZERS) -> DataFrame:
    schema = "part int, number long, n_tokens int, doc_ids array<bigint>, starts array<int>, tokens binary"
    slim = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return slim.mapInArrow(partial(_sequences, folder=folder, length=length), schema)


def feistel(index: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """Image of index under the keyed permutation of [0, n), by cycle-walking.

    One network permutes [0, a * b) with a * b - n < a. A walk leaves the range with a
    probability of about 1 / sqrt(n) per step; where fewer than ``WALK`` points lie outside, the walk cannot be longer than they are.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(value: Column) -> Column:
        x, y, p, q = ((value - value % b) / b).cast("long"), value % b, a, b
        for r in range(rounds):
            # (x, y) in [0, p) x [0, q) becomes (y, x + f(y)) in [0, q) x [0, p).
            mixed = (x + F.pmod(F.xxhash64(y, F.lit(seed * 1000 + r).cast("long")), F.lit(p))) % p
            x, y, p, q = y, mixed, q, p
        return x * q + y

    outside = a * b - n
    walked = once(index)
    if outside:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(WALK, outside))), walked, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return walked.cast("long")


def training_order(docs: DataFrame, seed: int = 42, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Sequences with slot, shard and offset, range-partitioned by shard and sorted by slot."""
    made = checkpointed(sequences(docs, key, text, length, folder), "sequences")
    # One row per task.
    counts = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count("*").alias("n")).collect())
    n = sum(c for _, c in counts)
    firsts, before = [], 0
    for part, count in counts:
        firsts.append((part, before))
        before += count
    offsets = made.sparkSession.createDataFrame(firsts, "part int, _first long")
    numbered = made.join(F.broadcast(offsets), "part").withColumn("_i", F.col("_first") + F.col("number"))
    slot = numbered.withColumn("slot", feistel(F.col("_i"), n, seed))
    placed = slot.withColumns({"shard": F.floor(F.col("slot") / per_shard).cast("long"), "offset": (F.col("slot") % per_shard * (2 * length)).cast("long")})
    shards = max(1, -(-n // per_shard))
    dealt = placed.select("slot", "shard", "offset", "n_tokens", "doc_ids", "starts", "tokens").repartitionByRange(shards, "shard")
    return dealt.sortWithinPartitions("slot")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One file per shard; rows come sorted by slot, a shard is never split over tasks."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        store, root = fs.FileSystem.from_uri(folder)
    else:
        store, root = fs.LocalFileSystem(), folder
    shard, sink, name, digest, n = None, None, "", hashlib.sha256(), 0

    def finish() -> pa.RecordBatch:
        sink.close()
        path = f"{root}/shard-{shard:08d}.bin"
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_file(path)
        store.move(name, path)
        kinds = {"shard": pa.int64(), "path": pa.string(), "n_sequences": pa.int64(), "sha256": pa.string()}
        return pa.record_batch([pa.array([v], k) for v, k in zip((shard, path, n, digest.hexdigest()), kinds.values())], names=list(kinds))

    for batch in batches:
        for number, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
            if number != shard:
                if sink is not None:
                    yield finish()
                shard, digest, n = number, hashlib.sha256(), 0
                name = f"{root}/.shard-{shard:08d}-{uuid.uuid4().hex}"
                sink = store.open_output_stream(name)
            raw = tokens.as_buffer()
            sink.write(raw)
            digest.update(raw)
            n += 1
    if sink is not None:
        yield finish()


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write the frame of :func:`training_order` as raw files; shard, path, n_sequences, sha256 per file.

    ``folder`` must exist and be reachable from every executor (a path or a URI that pyarrow knows).
    """
    made = ordered.select("shard", "tokens").mapInArrow(partial(_write, folder=folder), "shard long, path string, n_sequences long, sha256 string")
    return checkpointed(made, "manifest")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the corpus at its place in training order."""
    return training_order(documents(spark, sf_dir))
