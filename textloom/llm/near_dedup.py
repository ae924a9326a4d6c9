"""Near-duplicate detection by circulant MinHash.

Signature: one permutation scatters the shingles over 32 bits; a second one, shifted
circularly by k, gives coordinate k as the smallest ``pi(sigma(x) - k)``. Two permutations are enough for
all coordinates. Twenty bands of four coordinates make candidates: at a similarity of 0.8
a pair shares no band with a probability of 2.6e-5, at 0.9 of 4e-10.

From bands to classes without pairs of everything:

1. Texts with the same shingle set are one class, found by a digest of the set.
2. In every bucket of a band the first representative is a pivot. Members are compared
   with it, exactly, on whole sets; the links give components.
3. Buckets whose members already lie in one component are done. In the others the member that agrees
   best with the bucket (its medoid) is the pivot, block by block; links again give components.
4. What still differs inside a bucket: in buckets of up to ``SMALL`` members the pairs of different
   components whose signatures agree in at least 46 of 80 places (a linked pair fails that with a
   probability of about 2e-6) are compared exactly. Larger buckets are compared tile by tile: a task gets the texts of two blocks,
   counts common shingles by a matrix product and returns links that join components, never more than
   it has rows. No bucket has a cap: a large one has more tiles.

So every pair of a bucket is linked, compared, or of one component.

Defined results: null, empty and blank texts have no shingles, link with nothing and are their own
component. Rows with equal ids are one document with the larger set. Rows with a null id keep
their row with a null component and are kept. Empty tables give empty results. Columns besides id and text
pass through in :func:`drop_near_duplicates` and do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from textloom.llm.arrays import Texts, mix64, text_slices
from textloom.llm.common import checkpointed, documents, packed, unpacked
from textloom.llm.components import components

BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
WIDTH = 5
PERCENT = 80
AGREE = 46
TILE = 1024
SMALL = 32
COLUMNS = 4096
BROADCAST_IDS = 2_000_000  # of 8 bytes
BLOCK = 1 << 14


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within the text, and their borders.

    A text with fewer words than a shingle is one shingle; a text without words has none.
    """
    h = texts.hashes()
    counts = texts.counts()
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(texts.bounds[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    left = np.repeat(texts.bounds[1:], n) - first
    total = np.zeros(bounds[-1], np.uint64)
    for k in range(width):
        there = left > k
        step = np.where(there, h[np.minimum(first + k, max(len(h) - 1, 0))], np.uint64(k + 1)) if len(h) else total
        total = mix64(total * np.uint64(0x9FB21C651E98DF25) + step)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.argsort(total)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    total, doc = total[order], doc[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    total, doc = total[new], doc[new]
    return total, np.searchsorted(doc, np.arange(len(texts) + 1))


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation: shingle hash to a place on the circle of 2**32."""
    return (mix64(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signature of every non-empty set; empty sets get zeros."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    rows = np.flatnonzero(np.diff(bounds))
    place = scatter(sets)
    i = 0
    while i < len(rows):
        # As many sets as fit a block that stays in the processor's cache.
        j = max(i + 1, int(np.searchsorted(bounds[rows + 1], bounds[rows[i]] + BLOCK, "right")))
        low, high = bounds[rows[i]], bounds[rows[j - 1] + 1]
        x, starts = place[low:high], bounds[rows[i:j]] - low
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(COORDINATES):
            # The second permutation, shifted by k.
            np.subtract(x, np.uint32(k), out=y)
            np.multiply(y, np.uint32(0x7FEB352D), out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x846CA68B), out=y)
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            out[rows[i:j], k] = np.minimum.reduceat(y, starts)
        i = j
    return out


def _list_column(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * width + 1, width, dtype=np.int32)), pa.array(values.ravel(), kind))


def _binary_column(values: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
    offsets = np.arange(0, len(raw) * width + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def _sign(batches: Iterator[pa.RecordBatch], width: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column(1)):
            sets, bounds = shingle_sets(Texts(data, offsets, lower), width)
            sizes = np.diff(bounds)
            # Two sums of mixed hashes and the size: equal for equal sets, whatever the order.
            digest = np.zeros((j - i, 3), np.uint64)
            digest[:, 2] = sizes
            for c, salt in enumerate((0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(salt)))])
                digest[:, c] = sums[bounds[1:]] - sums[bounds[:-1]]
            sig = signatures(sets, bounds)
            bands = np.zeros((j - i, BANDS), np.uint64)
            for b in range(BANDS):
                key = np.full(j - i, b + 1, np.uint64)
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0x9FB21C651E98DF25) + sig[:, b * ROWS + r])
                bands[:, b] = key
            yield pa.record_batch(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(sizes, pa.int64()),
                    _binary_column(digest),
                    _binary_column((sig & 0xFF).astype(np.uint8)),
                    _list_column(bands.view(np.int64), BANDS, pa.int64()),
                ],
                names=["doc", "n_shingles", "digest", "sig", "bands"],
            )


def sign(docs: DataFrame, key: str, text: str, width: int, lower: bool) -> DataFrame:
    """doc, n_shingles, digest of the set, short signature, band hashes."""
    schema = "doc long, n_shingles long, digest binary, sig binary, bands array<long>"
    slim = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return slim.mapInArrow(partial(_sign, width=width, lower=lower), schema)


def _compare(batches: Iterator[pa.RecordBatch], width: int, lower: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text of a, text of b) to links (u, v)."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        linked = np.zeros(len(a), bool)
        left = [(i, shingle_sets(Texts(d, o, lower), width)) for i, _, d, o in text_slices(batch.column(2))]
        # Sets of the second text are matched slice by slice with those of the first.
        firsts = _joined(left)
        for i, j, data, offsets in text_slices(batch.column(3)):
            sets, bounds = shingle_sets(Texts(data, offsets, lower), width)
            for r in range(i, j):
                x, y = firsts[r], sets[bounds[r - i] : bounds[r - i + 1]]
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))] == x)) if len(x) and len(y) else 0
                union = len(x) + len(y) - both
                linked[r] = union > 0 and both * 100 >= percent * union
        yield pa.record_batch([pa.array(a[linked], pa.int64()), pa.array(b[linked], pa.int64())], names=["u", "v"])


def _joined(parts: list) -> list[np.ndarray]:
    return [sets[bounds[r] : bounds[r + 1]] for _, (sets, bounds) in parts for r in range(len(bounds) - 1)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that agree in their first two columns and stand together, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            key = (int(keys[0, low]), int(keys[1, low]))
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _pair_rows(batches: Iterator[pa.RecordBatch], medoid: bool) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tile, doc, component, sig), sorted by bucket and tile, to pairs worth comparing."""
    for table in _groups(batches):
        doc, comp = table["doc"].to_numpy(), table["component"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(doc), COORDINATES)
        pivots = range(len(doc))
        if medoid:
            # The member whose signature agrees most often with the commonest value of each place.
            votes = np.zeros(len(doc), np.int64)
            for k in range(COORDINATES):
                votes += np.bincount(sig[:, k], minlength=256)[sig[:, k]]
            pivots = [int(np.lexsort((doc, -votes))[0])]
        a, b = [], []
        for i in pivots:
            rest = np.flatnonzero((comp != comp[i]) if medoid else (comp != comp[i]) & (doc > doc[i]))
            rest = rest[(sig[rest] == sig[i]).sum(axis=1) >= AGREE]
            a.append(np.minimum(doc[rest], doc[i]))
            b.append(np.maximum(doc[rest], doc[i]))
        yield pa.record_batch([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every left with every right set of hashes.

    Hashes that occur once take no part. The others are columns of 0/1 matrices, multiplied a few thousand columns at a time.
    """
    sides = [(np.concatenate(x) if x else np.zeros(0, np.uint64), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (left, right)]
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for hashes, row in sides:
        at = np.searchsorted(shared, hashes)
        there = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == hashes) if len(shared) else np.zeros(len(hashes), bool)
        at, row = at[there], row[there]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], row[order]))
    for low in range(0, len(shared), COLUMNS):
        blocks = []
        for (at, row), n in zip(placed, out.shape):
            a, b = np.searchsorted(at, [low, low + COLUMNS])
            block = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            block[row[a:b], at[a:b] - low] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def _tile_links(batches: Iterator[pa.RecordBatch], width: int, lower: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tile, doc, component, text, block), sorted by bucket and tile, to links between components."""
    for table in _groups(batches):
        doc, comp, block = (table[c].to_numpy() for c in ("doc", "component", "block"))
        parts = [(i, shingle_sets(Texts(d, o, lower), width)) for i, _, d, o in text_slices(table["text"])]
        sets = _joined(parts)
        sizes = np.array([len(x) for x in sets], np.float64)
        x = np.flatnonzero(block == block.min())
        y = np.flatnonzero(block == block.max())
        both = common_counts([sets[i] for i in x], [sets[i] for i in y]).astype(np.float64)
        linked = both * 100 >= percent * (sizes[x][:, None] + sizes[y][None, :] - both)
        linked &= comp[x][:, None] != comp[y][None, :]
        root = {c: c for c in np.unique(comp).tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        u, v = [], []
        for i, j in zip(*np.nonzero(linked)):
            p, q = find(int(comp[x[i]])), find(int(comp[y[j]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                u.append(int(doc[x[i]]))
                v.append(int(doc[y[j]]))
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _only(texts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The texts that are asked for. A bounded list of ids is sent to the scan, so other texts are not shuffled; a longer one is a plain join later."""
    few = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids), texts["doc"] == ids[key], "left_semi") if few else texts


def _linked(pairs: DataFrame, texts: DataFrame, width: int, lower: bool, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, as u, v."""
    texts = _only(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return rows.mapInArrow(partial(_compare, width=width, lower=lower, percent=percent), "u long, v long")


def _unresolved(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, doc, component of the buckets that hold more than one component."""
    named = buckets.join(labels, buckets["doc"] == labels["node"], "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    return named.join(mixed.select("bucket", "n"), "bucket")


def _dealt(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("bucket", "tile", "doc", "component", *more).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, lower: bool = True
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    signed = checkpointed(sign(docs, key, text, width, lower), "signed")
    filled = signed.where((F.col("n_shingles") > 0) & F.col("doc").isNotNull())
    classes = filled.groupBy("digest").agg(F.min("doc").alias("rep"))
    firsts = checkpointed(
        filled.join(classes, (filled["doc"] == classes["rep"]) & (filled["digest"] == classes["digest"])).select("doc", "sig", "bands").dropDuplicates(["doc"]), "firsts"
    )
    members = firsts.select("doc", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    buckets = checkpointed(members.join(shared, "bucket").select("bucket", "pivot", "doc"), "buckets")
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where(F.col("doc").isNotNull())

    # 2. Stars around the first member of a bucket, sorted out by signature.
    sigs = firsts.select("doc", "sig")
    star = buckets.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    near = star.join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
    near = checkpointed(near.mapInArrow(_agreeing, "a long, b long"), "star-pairs")
    links = checkpointed(_linked(near, texts, width, lower, percent), "star-links")
    labels = components(links)

    # 3. Medoids of the buckets that still differ, block by block.
    rest = checkpointed(_unresolved(buckets.select("bucket", "doc"), labels), "open")
    tiled = rest.join(sigs, "doc").withColumn("tile", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / TILE).cast("int")).cast("long"))
    new = checkpointed(_dealt(tiled, "sig").mapInArrow(partial(_pair_rows, medoid=True), "a long, b long").distinct().join(near, ["a", "b"], "left_anti"), "medoid-pairs")
    more = checkpointed(_linked(new, texts, width, lower, percent), "medoid-links")
    links = links.unionByName(more)
    labels = labels if more.isEmpty() else components(links)

    # 4. Everything that differs after that: pairs of small buckets, tiles of large ones.
    rest = checkpointed(_unresolved(rest.select("bucket", "doc"), labels), "open")
    small = rest.where(F.col("n") <= SMALL).join(sigs, "doc").withColumn("tile", F.lit(0).cast("long"))
    pairs = _dealt(small, "sig").mapInArrow(partial(_pair_rows, medoid=False), "a long, b long").distinct()
    pairs = checkpointed(pairs.join(near, ["a", "b"], "left_anti").join(new, ["a", "b"], "left_anti"), "small-pairs")
    more = checkpointed(_linked(pairs, texts, width, lower, percent), "small-links")
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    large = rest.where(F.col("n") > SMALL).withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("int"))
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.withColumn("tile", F.least("block", "_other").cast("long") * blocks + F.greatest("block", "_other"))
    wanted = rest.where(F.col("n") > SMALL).select(F.col("doc").alias("id")).distinct()
    dealt = _dealt(large.join(_only(texts, wanted, "id"), "doc"), "text", "block")
    tiles = checkpointed(dealt.mapInArrow(partial(_tile_links, width=width, lower=lower, percent=percent), "u long, v long"), "tile-links")
    if not (more.isEmpty() and tiles.isEmpty()):
        labels = components(links.unionByName(more).unionByName(tiles))

    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(F.col("digest").alias("_d"), F.coalesce("component", "rep").alias("_c"))
    out = signed.select("doc", "n_shingles", "digest").join(named, (F.col("digest") == F.col("_d")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("_c", "doc")
    kept = F.col("doc").isNull() | (F.col("doc") == component)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, a, sa, sb) whose signatures agree often enough."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = batch.schema.names
        sa, sb = (np.frombuffer(b"".join(batch.column(names.index(c)).to_pylist()), np.uint8).reshape(n, COORDINATES) for c in ("sa", "sb"))
        good = pa.array((sa == sb).sum(axis=1) >= AGREE)
        yield pa.record_batch([batch.column(names.index(c)).filter(good) for c in ("a", "b")], names=["a", "b"])


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group, columns unchanged; of rows that repeat an id the first by text stays, rows without an id all stay."""
    judged = near_duplicates(docs, key, text, **options).where(F.col("doc_id").isNotNull())
    per_id = judged.groupBy(F.col("doc_id").alias("_gone")).agg(F.min("kept").alias("_kept"), F.count("*").alias("_n"))
    marked = checkpointed(per_id.where(~F.col("_kept") | (F.col("_n") > 1)).select("_gone", "_kept"), "marked-ids")
    gone = marked.select("_gone")
    left = docs.join(gone, docs[key].cast("long") == gone["_gone"], "left_anti")
    again = marked.where("_kept").select(F.col("_gone").alias("id"))
    if again.isEmpty():
        return left
    # Only rows whose id is repeated are ranked.
    rows = packed(docs, doc=F.col(key).cast("long"), _text=F.col(text).cast("string"))
    repeated = _only(rows, again, "id").join(again, F.col("doc") == F.col("id"), "left_semi")
    order = W.partitionBy("doc").orderBy(F.col("_text").asc_nulls_last(), F.to_json("_row"))
    first = repeated.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return left.unionByName(unpacked(first, docs.columns))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, 80 per cent: set size, component and verdict for every document."""
    return near_duplicates(documents(spark, sf_dir), width=2, percent=80, lower=True)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.node)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN reach r ON r.node = d.doc_id
GROUP BY d.doc_id, z.n
"""
