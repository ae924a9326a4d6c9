"""Exact nearest neighbours and coverage by cosine.

Both need the best of all pairs; pairs exist only inside numpy blocks and never become rows. A small base side (checked)
is broadcast. Beyond that the base side is written once as an index: every row has a unit vector, the
cell of its nearest pivot and the angle to it. Cells, cut into rings of that angle where they are big, are packed into
tiles of ``TILE_BYTES``. By the triangle inequality no row of a ring is closer to a query than its ring allows, so a query

1. probes the one tile that promises most, and
2. then visits only tiles that can still beat what it found there.

It is sent once per tile, not per cell. Tiles that many queries visit take them in bounded parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.hashing import order_key
from textloom.functions.vectors import as_double
from textloom.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024
TILE_BYTES = 16 * 1024 * 1024  # of vectors per side; a bigger tile means less shuffling, but a task holds several copies of it
VISIT_ROWS = 4096  # rows per Arrow batch when queries fan out to tiles
BLOCK_CELLS = 1_000_000  # similarity values held at once
QUERY_ROWS = 1024  # queries that meet the base rows together
MAX_PIVOTS = 1024
RINGS = 64  # parts of the half circle that a cell may be cut into
DIGITS = 12  # similarities equal to this many decimals tie; the lowest id wins
SLACK = 2 * 10.0**-DIGITS
ANGLE_SLACK = 3e-6  # more than rounding a cosine to DIGITS can move its angle
BUCKET = 32_768  # numbers in one bitmap


# --- numpy helpers used inside tasks -------------------------------------------------


def raw_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def unit_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows scaled to length 1; zero vectors stay zero."""
    rows = raw_matrix(column)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def vector_array(rows: np.ndarray) -> pa.Array:
    """A matrix as an array of lists, without a copy per row."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(rows.ravel()))


def blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, BLOCK_CELLS // max(1, width))
    for start in range(0, n, step):
        yield slice(start, min(n, start + step))


def _keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def best_of(queries: np.ndarray, base: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base row, similarity) of the k best rows of each query, best first; of equal ones the first row. ``skip`` is a row a query does not count, or -1."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first in range(0, len(queries), QUERY_ROWS):
        query, row, sim = _best_of_few(queries[first : first + QUERY_ROWS], base, k, None if skip is None else skip[first : first + QUERY_ROWS])
        out.append((query + first, row, sim))
    query, row, sim = (np.concatenate(x) for x in zip(*out))
    return query, row, sim


def _best_of_few(queries: np.ndarray, base: np.ndarray, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`best_of` in passes over strips of the base: only what can still be among the k best is rounded and sorted."""
    query, row, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    worst = np.full(len(queries), -np.inf)
    odd = bool(np.isnan(queries).any() or np.isnan(base).any())
    step = max(1, BLOCK_CELLS // max(1, len(queries)))
    for first in range(0, len(base), step):
        sims = queries @ base[first : first + step].T
        if odd:
            sims[np.isnan(sims)] = -np.inf
        if skip is not None:
            own = np.flatnonzero((skip >= first) & (skip < first + sims.shape[1]))
            sims[own, skip[own] - first] = -np.inf
        least = worst
        if not first and k < sims.shape[1]:
            least = sims.max(axis=1) if k == 1 else np.partition(sims, -k, axis=1)[:, -k]
        # The slack is more than rounding can move a similarity.
        q, r = np.nonzero((sims >= (least - SLACK)[:, None]) & (sims > -np.inf))
        query = np.concatenate([query, q])
        sim = np.concatenate([sim, np.round(sims[q, r], DIGITS)])
        row = np.concatenate([row, r + first])
        order = np.lexsort((row, -sim, query))
        query, row, sim = query[order], row[order], sim[order]
        starts = np.searchsorted(query, np.arange(len(queries) + 1))
        keep = np.arange(len(query)) - starts[query] < k
        query, row, sim = query[keep], row[keep], sim[keep]
        starts = np.searchsorted(query, np.arange(len(queries) + 1))
        full = np.flatnonzero(np.diff(starts) == k)
        worst[full] = sim[starts[1:][full] - 1]
    return query, row, sim


def any_close(queries: np.ndarray, group: np.ndarray, threshold: float) -> np.ndarray:
    """Per query: is any row of the group close enough?"""
    out = np.zeros(len(queries), bool)
    for block in blocks(len(queries), len(group)):
        sims = queries[block] @ group.T
        sure = (sims >= threshold + SLACK).any(axis=1)
        # Rounding decides only what is as close as the threshold.
        open_rows = np.flatnonzero(~sure & (sims >= threshold - SLACK).any(axis=1))
        sure[open_rows] = (np.round(sims[open_rows], DIGITS) >= threshold).any(axis=1)
        out[block] = sure
    return out


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _cells(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, angle to it)."""
    cell, own = np.empty(len(rows), np.int32), np.empty(len(rows))
    for block in blocks(len(rows), len(pivots)):
        angles = _angles(rows[block], pivots)
        cell[block], own[block] = angles.argmin(axis=1), angles.min(axis=1)
    return cell, own


def _vectors(df: DataFrame, key: str, vector: str, *more: Column) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), as_double(vector).alias("v"), *more)


def _as_sent(rows: DataFrame, base: DataFrame, vector: str) -> DataFrame:
    """Rows for the driver: single precision where the vectors have no more, which is half the bytes and the same numbers."""
    single = base.schema[vector].dataType.simpleString() == "array<float>"
    return rows.withColumn("v", F.col("v").cast("array<float>")) if single else rows


def _shape(base: DataFrame) -> tuple[int, int]:
    """Rows and dimensions."""
    size = base.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    return size["n"], size["d"]


# --- the index ------------------------------------------------------------------------


@dataclass
class Index:
    """Base rows with their tile, and what is known of every tile.

    rows: (tile, id, unit vector v, further columns). pieces: (tile, pivot, least and greatest angle) sorted by tile.
    """

    rows: DataFrame
    pivots: Broadcast
    pieces: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    n_tiles: int
    tile_rows: int

    def bounds(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function from unit vectors to (least possible angle to each tile, most promising tile)."""
        pivots, (tile, pivot, low, high), starts = self.pivots, self.pieces, np.searchsorted(self.pieces[0], np.arange(self.n_tiles))

        def bound(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            least, home = np.empty((len(rows), len(starts))), np.empty(len(rows), tile.dtype)
            for block in blocks(len(rows), len(tile)):
                angles = _angles(rows[block], pivots.value)[:, pivot]
                gaps = np.maximum(np.maximum(angles - high, low - angles), 0.0)
                # Of pieces that promise the same, the one around the nearest pivot.
                home[block] = tile[(gaps + angles * 1e-3).argmin(axis=1)]
                least[block] = np.minimum.reduceat(gaps, starts, axis=1)
            return least, home

        return bound


def _pack(found: list[tuple[int, int, int, float, float]], order: list[int], tile_rows: int) -> tuple[list[tuple], list[tuple], int]:
    """Rings (pivot, ring, rows, least, greatest angle) to tiles: (pivot, ring, first tile, tiles), pieces, number of tiles."""
    place = {p: i for i, p in enumerate(order)}
    plan, pieces, tile, held = [], {}, 0, 0
    for pivot, ring, n, low, high in sorted(found, key=lambda r: (place[r[0]], r[1])):
        if held and held + n > tile_rows:
            tile, held = tile + 1, 0
        parts = -(-n // tile_rows)
        plan.append((pivot, ring, tile, parts))
        for t in range(tile, tile + parts):
            before = pieces.get((t, pivot), (low, high))
            pieces[t, pivot] = (min(before[0], low), max(before[1], high))
        tile, held = (tile, held + n) if parts == 1 else (tile + parts, 0)
    return plan, [(t, p, *a) for (t, p), a in sorted(pieces.items())], tile + (held > 0)


def _chain(pivots: np.ndarray) -> list[int]:
    """Pivots in an order in which neighbours are close, so that a tile of several cells is compact."""
    left, order = np.ones(len(pivots), bool), [0]
    left[0] = False
    while left.any():
        sims = np.where(left, pivots @ pivots[order[-1]], -np.inf)
        order.append(int(sims.argmax()))
        left[order[-1]] = False
    return order


def build_index(base: DataFrame, shape: tuple[int, int]) -> Index:
    """Index ``base`` (id, v, further columns) of the given rows and dimensions, at least one row."""
    spark = base.sparkSession
    n, dimensions = shape
    tile_rows = max(1, TILE_BYTES // (8 * max(1, dimensions)))
    n_pivots = int(min(MAX_PIVOTS, max(1, n**0.5)))
    sample = base.orderBy(order_key("id", "pivot"), "id").limit(n_pivots).select("v").toArrow()
    vectors = unit_matrix(sample.column("v"))
    pivots = spark.sparkContext.broadcast(vectors)
    names = base.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                units = unit_matrix(rows.column("v"))
                cell, own = _cells(units, pivots.value)
                ring = np.minimum((own * (RINGS / np.pi)).astype(np.int32), RINGS - 1)
                held = [vector_array(units) if c == "v" else rows.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*held, pa.array(cell), pa.array(ring), pa.array(own)], names=[*names, "cell", "ring", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    placed = materialize(base.mapInArrow(assign, f"{fields}, cell int, ring int, angle double"), "cells")
    rings = placed.groupBy("cell", "ring").agg(F.count("*"), F.min("angle"), F.max("angle"))
    # At most MAX_PIVOTS x RINGS rows.
    plan, pieces, n_tiles = _pack([tuple(r) for r in rings.collect()], _chain(vectors), tile_rows)
    tiles = F.broadcast(spark.createDataFrame(plan, "cell int, ring int, first int, parts int"))
    rows = placed.join(tiles, ["cell", "ring"]).select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("tile"), *names)
    columns = tuple(np.array(c) for c in zip(*pieces))
    return Index(rows, pivots, columns, n_tiles, tile_rows)


def _visits(
    index: Index, queries: DataFrame, reach: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray], columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(visits, counts): queries, or some of their columns, with the tiles they are sent to, and (tile, n).

    ``reach`` says from the batch, the bounds and the most promising tile which tiles a query visits. Counts are
    summed inside tasks, so they can be known before any vector is sent.
    """
    bound, names = index.bounds(), columns or queries.columns
    n_tiles = index.n_tiles

    def chosen(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(reach(rows, *bound(raw_matrix(rows.column("v")))))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, VISIT_ROWS):
                yield rows.slice(start, VISIT_ROWS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            row, tile = chosen(rows)
            for part in range(0, len(row), VISIT_ROWS):
                at = pa.array(row[part : part + VISIT_ROWS])
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c).take(at) for c in names], pa.array(tile[part : part + VISIT_ROWS].astype(np.int32))], names=[*names, "tile"]
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_tiles, np.int64)
        for rows in slices(batches):
            total += np.bincount(chosen(rows)[1], minlength=n_tiles)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["tile", "n"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*names).schema.fields)
    counts = queries.mapInArrow(count, "tile int, n bigint").groupBy("tile").agg(F.sum("n").alias("n"))
    return queries.mapInArrow(send, f"{fields}, tile int"), counts


def _meet(index: Index, visits: DataFrame, counts: list, work: Callable, schema: str) -> DataFrame:
    """Queries meet the rows of their tiles; a tile that very many visit takes them in several parts."""
    parts = [(r["tile"], -(-r["n"] // index.tile_rows)) for r in counts]
    # One row per tile.
    split = F.broadcast(visits.sparkSession.createDataFrame(parts, "tile int, parts int"))
    left = visits.join(split, "tile").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    right = index.rows.join(split, "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["tile", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


# --- nearest neighbours ---------------------------------------------------------------

_FOUND = "id bigint, similarity double, neighbour bigint"


def _answers(asked: np.ndarray, keys: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, similarity, neighbour); ``ids`` are sorted."""
    skip = None
    if skip_self:
        at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
        skip = np.where(ids[at] == keys, at, -1)
    query, row, sim = best_of(asked, matrix, k, skip)
    return query, sim, ids[row]


def neighbours(
    queries: DataFrame, base: DataFrame, query_key: str, base_key: str, k: int = 1, skip_self: bool = False,
    query_vector: str = "embedding", base_vector: str = "embedding", broadcast_bytes: int | None = None,
) -> DataFrame:
    """``(id, similarity, neighbour)``: the k base rows with the best cosine per query row; ties go to lower ids.

    ``skip_self`` leaves out the base row with the query's own id. Base rows have distinct ids.
    """
    left, right = _vectors(queries, query_key, query_vector), _vectors(base, base_key, base_vector)
    n_base, dimensions = _shape(right)
    spark = base.sparkSession
    if n_base == 0:
        return spark.createDataFrame([], _FOUND)
    names = ["id", "similarity", "neighbour"]
    if n_base * dimensions * 8 <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        table = _as_sent(right, base, base_vector).toArrow().sort_by("id")
        shared = spark.sparkContext.broadcast((table.column("id").to_numpy(), unit_matrix(table.column("v"))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                if rows.num_rows:
                    keys = _keys(rows.column("id"))
                    at, sim, found = _answers(unit_matrix(rows.column("v")), keys, *shared.value, k, skip_self)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(sim), pa.array(found)], names=names)

        return left.mapInArrow(scan, _FOUND)

    index = build_index(right, (n_base, dimensions))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column("id"), vector_array(unit_matrix(rows.column("v")))], names=["id", "v"])

    asked = left.mapInArrow(units, "id bigint, v array<double>")
    n_tiles = index.n_tiles

    probed = pa.schema([
        ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("home", pa.int32()), ("worst", pa.float64()),
        ("similarities", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())),
    ])

    def probe(q: pa.Table, b: pa.Table) -> pa.Table:
        """The best of the home tile, in one row per query, and the similarity that another tile has to reach."""
        if not q.num_rows:
            return probed.empty_table()
        b = b.sort_by("id")
        asked = raw_matrix(q.column("v"))
        at, sim, found = _answers(asked, _keys(q.column("id")), b.column("id").to_numpy(), raw_matrix(b.column("v")), k, skip_self)
        first = np.searchsorted(at, np.arange(q.num_rows + 1))
        worst = np.full(q.num_rows, -1.0)
        full = np.flatnonzero(np.diff(first) == k)
        worst[full] = sim[first[1:][full] - 1]
        offsets = pa.array(first.astype(np.int32))
        home = np.full(q.num_rows, b.column("tile")[0].as_py(), np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (sim, found)]
        return pa.table([q.column("id"), vector_array(asked), pa.array(home), pa.array(worst), *lists], schema=probed)

    def home_only(_: pa.RecordBatch, least: np.ndarray, home: np.ndarray) -> np.ndarray:
        return np.arange(n_tiles)[None, :] == home[:, None]

    visits, counts = _visits(index, asked, home_only)
    schema = "id bigint, v array<double>, home int, worst double, similarities array<double>, ids array<bigint>"
    first = _meet(index, visits, counts.collect(), probe, schema)
    if n_tiles > 1:
        first = materialize(first, "probed")
    one = first.select("id", F.explode(F.arrays_zip("similarities", "ids")).alias("f"))
    one = one.select("id", F.col("f.similarities").alias("similarity"), F.col("f.ids").alias("neighbour"))
    if n_tiles == 1:
        return one

    def can_beat(rows: pa.RecordBatch, least: np.ndarray, _: np.ndarray) -> np.ndarray:
        worst = np.arccos(np.clip(_keys(rows.column("worst")), -1.0, 1.0))
        out = least <= worst[:, None] + ANGLE_SLACK
        out[np.arange(len(out)), _keys(rows.column("home"))] = False
        return out

    def compare(q: pa.Table, b: pa.Table) -> pa.Table:
        keys, sim, found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if q.num_rows and b.num_rows:
            b = b.sort_by("id")
            keys = _keys(q.column("id"))
            at, sim, found = _answers(raw_matrix(q.column("v")), keys, b.column("id").to_numpy(), raw_matrix(b.column("v")), k, skip_self)
            good = sim >= _keys(q.column("worst"))[at]
            keys, sim, found = keys[at[good]], sim[good], found[good]
        return pa.table([pa.array(keys), pa.array(sim), pa.array(found)], names=names)

    visits, counts = _visits(index, first.select("id", "v", "home", "worst"), can_beat)
    more = counts.collect()
    if not more:
        return one
    both = one.unionByName(_meet(index, visits, more, compare, _FOUND))
    if k == 1:
        best = both.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("neighbour")).alias("neg"))).alias("m"))
        return best.select("id", F.col("m.similarity"), (-F.col("m.neg")).alias("neighbour"))
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def nearest(
    queries: DataFrame, base: DataFrame, query_key: str, base_key: str,
    query_vector: str = "embedding", base_vector: str = "embedding", broadcast_bytes: int | None = None,
) -> DataFrame:
    """``(id, max_similarity, nearest_id)`` per query row: best cosine over all base rows; nulls where there are none."""
    found = neighbours(queries, base, query_key, base_key, 1, False, query_vector, base_vector, broadcast_bytes)
    if base.where(F.col(base_vector).isNotNull()).isEmpty():
        left = _vectors(queries, query_key, query_vector)
        return left.select("id", F.lit(None).cast("double").alias("max_similarity"), F.lit(None).cast("bigint").alias("nearest_id"))
    return found.select("id", F.col("similarity").alias("max_similarity"), F.col("neighbour").alias("nearest_id"))


# --- coverage -------------------------------------------------------------------------


def _grouped(b: pa.Table, matrix: Callable = raw_matrix) -> list[tuple[str, np.ndarray]]:
    """(group, its rows)."""
    if not b.num_rows:
        return []
    b = b.sort_by("grp")
    rows = matrix(b.column("v"))
    groups, starts = np.unique(b.column("grp").to_numpy(zero_copy_only=False).astype(str), return_index=True)
    return [(str(g), part) for g, part in zip(groups, np.split(rows, starts[1:]))]


def covered_counts(
    queries: DataFrame, base: DataFrame, query_key: str, base_key: str, group: str | None = None,
    threshold: float = 0.7, query_vector: str = "embedding", base_vector: str = "embedding",
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """``(grp, covered)``: per group of base rows, how many query rows have a cosine ≥ threshold with it.

    Groups that cover nothing are absent; a null group is left out. A query may meet a group in many tiles: queries have
    numbers, a tile marks those it covers in a bitmap, and bitmaps of a group are merged. So what leaves a tile is
    a few bitmaps per group, never (query, group) rows.
    """
    label = F.lit("all") if group is None else F.col(group).cast("string")
    left = _vectors(queries, query_key, query_vector)
    right = _vectors(base.withColumn("_g", label).where(F.col("_g").isNotNull()), base_key, base_vector, F.col("_g").alias("grp"))
    n_base, dimensions = _shape(right)
    spark = base.sparkSession
    if n_base == 0:
        return spark.createDataFrame([], "grp string, covered bigint")
    if n_base * dimensions * 8 <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        shared = spark.sparkContext.broadcast(_grouped(_as_sent(right, base, base_vector).toArrow(), unit_matrix))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = shared.value
            covered = np.zeros(len(groups), np.int64)
            for rows in batches:
                if rows.num_rows:
                    asked = unit_matrix(rows.column("v"))
                    covered += [any_close(asked, part, threshold).sum() for _, part in groups]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups], pa.string()), pa.array(covered)], names=["grp", "n"])

        counts = left.mapInArrow(scan, "grp string, n bigint").groupBy("grp")
        return counts.agg(F.sum("n").alias("covered")).where("covered > 0")

    index = build_index(right, (n_base, dimensions))
    within = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + ANGLE_SLACK

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column("id"), vector_array(unit_matrix(rows.column("v")))], names=["id", "v"])

    # Written once, so that the numbers stay as they are.
    numbered = left.select(F.monotonically_increasing_id().alias("id"), "v").mapInArrow(units, "id bigint, v array<double>")
    numbered = materialize(numbered, "numbered")
    # Parts are runs of numbers here: the queries of a part share few bitmaps.
    span = BUCKET * max(1, index.tile_rows // BUCKET)

    def reachable(_: pa.RecordBatch, least: np.ndarray, home: np.ndarray) -> np.ndarray:
        return least <= within

    visits, _ = _visits(index, numbered, reachable)
    chunk = F.floor(F.col("id") / span).alias("chunk")

    def marks(q: pa.Table, b: pa.Table) -> pa.Table:
        groups, buckets, bits = [], [], []
        if q.num_rows and b.num_rows:
            number, asked = _keys(q.column("id")), raw_matrix(q.column("v"))
            for name, part in _grouped(b):
                hit = number[any_close(asked, part, threshold)]
                for bucket in np.unique(hit // BUCKET):
                    seen = np.zeros(BUCKET, bool)
                    seen[hit[hit // BUCKET == bucket] % BUCKET] = True
                    groups.append(name)
                    buckets.append(int(bucket))
                    bits.append(np.packbits(seen, bitorder="little").tobytes())
        return pa.table([pa.array(groups, pa.string()), pa.array(buckets, pa.int64()), pa.array(bits, pa.binary())], names=["grp", "bucket", "bits"])

    sent = visits.select("*", chunk)
    # Which parts meet at all: one row per tile and run of numbers.
    parts = _visits(index, numbered, reachable, ["id"])[0].select("tile", chunk).distinct()
    keys = ["tile", "chunk"]
    met = sent.groupBy(*keys).cogroup(index.rows.join(parts, "tile").groupBy(*keys)).applyInArrow(marks, "grp string, bucket bigint, bits binary")
    merged = met.groupBy("grp", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("grp").agg(F.sum(F.bitmap_count("bits")).alias("covered"))
