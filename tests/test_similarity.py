import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import kernels, neighbours as near, similarity as sim


def frame(spark, rows, **more):
    data = [(i, [float(x) for x in v], *[c[i] for c in more.values()]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "id long, embedding array<double>" + "".join(f", {n} string" for n in more))


def cosine(a, b):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    return np.round(unit(a) @ unit(b).T, 12)


@pytest.fixture(scope="module")
def clustered():
    """A third of each side sits in one tight spot; one zero vector and one exact copy."""
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 8))
    def side(n):
        rows = np.vstack([centers[0] + 0.01 * rng.normal(size=(n // 3, 8)),
                          centers[rng.integers(1, 12, n - n // 3)] + 0.1 * rng.normal(size=(n - n // 3, 8))])
        rows[-1] = 0
        rows[-2] = rows[0]
        return rows
    return side(600), side(450)


def nearest(spark, q, b, **options):
    out = sim.nearest(frame(spark, q), frame(spark, b), "id", "id", **options).collect()
    return {r["id"]: (r["max_similarity"], r["nearest_id"]) for r in out}


@pytest.mark.parametrize("path", ["broadcast", "tiles"])
def test_nearest_matches_brute_force(spark, clustered, path, monkeypatch):
    monkeypatch.setattr(near, "TILE_BYTES", 40 * 8 * 8)  # the hot cell needs many tiles
    q, b = clustered
    got = nearest(spark, q, b, broadcast_bytes=0 if path == "tiles" else 1 << 30)
    want = cosine(q, b)
    assert len(got) == len(q)
    for i in range(len(q)):
        assert got[i][0] == pytest.approx(want[i].max(), abs=1e-9)
        assert got[i][1] == want[i].argmax()


@pytest.fixture
def sent(monkeypatch):
    """(rows a side) of every pair of tile and part that met."""
    seen = []
    meet = near._meet

    def counted(index, visits, counts, work, schema):
        tile = index.rows.groupBy("tile").count()
        seen.append((sum(r["n"] for r in counts), tile.agg(F.max("count")).first()[0], max(r["n"] for r in counts)))
        return meet(index, visits, counts, work, schema)

    monkeypatch.setattr(near, "_meet", counted)
    return seen


def test_tiles_stay_bounded_and_queries_skip_them(spark, clustered, sent, monkeypatch):
    monkeypatch.setattr(near, "TILE_BYTES", 40 * 8 * 8)
    q, b = clustered
    got = nearest(spark, q, b, broadcast_bytes=0)
    want = cosine(q, b)
    assert all(got[i][1] == want[i].argmax() for i in range(len(q)))
    (first, largest, _), (second, _, _) = sent
    assert first == len(q) and largest <= 40 * 2
    # The hot spot alone fills several tiles, and all of them can hold the best.
    assert second < len(q) * len(b) / 40 / 2


def test_vectors_without_clusters_are_sent_once_per_tile(spark, sent, monkeypatch):
    monkeypatch.setattr(near, "TILE_BYTES", 50 * 8 * 16)
    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(300, 16)), rng.normal(size=(400, 16))
    got = nearest(spark, q, b, broadcast_bytes=0)
    want = cosine(q, b)
    assert all(got[i][1] == want[i].argmax() for i in range(len(q)))
    n_tiles = 400 / 50 * 2
    assert sent[0][0] == 300 and sent[1][0] <= 300 * n_tiles


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("k", [1, 4, 700])
def test_k_nearest(spark, clustered, limit, skip, k, monkeypatch):
    monkeypatch.setattr(near, "TILE_BYTES", 60 * 8 * 8)
    rows = clustered[0][:200]
    df = frame(spark, rows)
    got = near.neighbours(df, df, "id", "id", k, skip, broadcast_bytes=limit).collect()
    sims = cosine(rows, rows)
    if skip:
        np.fill_diagonal(sims, -9)
    order = np.lexsort((np.broadcast_to(np.arange(200), sims.shape), -sims))[:, : min(k, 200 - skip)]
    assert {(r.id, r.neighbour) for r in got} == {(i, int(j)) for i in range(200) for j in order[i]}
    assert all(r.similarity == pytest.approx(sims[r.id, r.neighbour], abs=1e-9) for r in got)


def test_nearest_edge_cases(spark):
    q = np.array([[1.0, 0.0], [0.0, 0.0]])
    b = np.array([[2.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert nearest(spark, q, b) == nearest(spark, q, b, broadcast_bytes=0) == {0: (1.0, 0), 1: (0.0, 0)}
    none = frame(spark, b).where("id < 0")
    rows = sim.nearest(frame(spark, q), none, "id", "id").collect()
    assert [(r["max_similarity"], r["nearest_id"]) for r in rows] == [(None, None)] * 2
    assert sim.mean_similarity(frame(spark, q), none, "id").first()["mean_similarity"] is None


def test_mean_similarity(spark, clustered):
    q, b = clustered
    got = {r["id"]: r["mean_similarity"] for r in sim.mean_similarity(frame(spark, q), frame(spark, b), "id").collect()}
    assert np.allclose([got[i] for i in range(len(q))], cosine(q, b).mean(axis=1), atol=1e-9)


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("threshold", [0.7, 0.999, -1.0])
def test_coverage_by_group(spark, clustered, limit, threshold, monkeypatch):
    monkeypatch.setattr(near, "TILE_BYTES", 50 * 8 * 8)
    q, b = clustered
    groups = np.array([str(i % 3) for i in range(len(b))])
    got = sim.covered_counts(frame(spark, q), frame(spark, b, g=groups), "id", "id", "g", threshold, broadcast_bytes=limit)
    close = cosine(q, b) >= threshold
    want = {g: int(close[:, groups == g].any(axis=1).sum()) for g in "012"}
    assert {r["grp"]: r["covered"] for r in got.collect()} == {g: n for g, n in want.items() if n}


def test_threshold_is_inclusive(spark):
    q, b = np.array([[1.0, 0.0]]), np.array([[0.7, np.sqrt(1 - 0.49)]])
    assert sim.covered_counts(frame(spark, q), frame(spark, b), "id", "id", threshold=0.7).first()["covered"] == 1


def test_diversity_equals_pair_mean(spark, clustered):
    rows = clustered[0]
    want = (1 - cosine(rows, rows))[np.triu_indices(len(rows), k=1)].mean()
    assert sim.diversity(frame(spark, rows)).first()["diversity"] == pytest.approx(want, abs=1e-9)
    assert sim.diversity(frame(spark, rows[:1])).first()["diversity"] == 0.0
    assert sim.diversity(frame(spark, rows).where("false")).first()["diversity"] == 0.0


def test_mmd_and_centroid(spark, clustered):
    x, y = clustered[0] / 5, clustered[1] / 5
    def k(a, b):
        return np.exp(-10 * ((a[:, None] - b[None]) ** 2).sum(-1)).mean()
    want = np.sqrt(k(x, x) + k(y, y) - 2 * k(x, y))
    assert sim.mmd(frame(spark, x), frame(spark, y), "id", "id").first()["mmd"] == pytest.approx(want, abs=1e-9)
    assert kernels.kernel_discrepancy(frame(spark, x), frame(spark, y)).first()["mmd"] == pytest.approx(want, abs=1e-9)
    gap = np.linalg.norm(x.mean(0) - y.mean(0))
    assert sim.centroid_distance(frame(spark, x), frame(spark, y)).first()[0] == pytest.approx(gap, abs=1e-9)


@pytest.mark.parametrize("tile", [7, 100, 10_000])
def test_exact_discrepancy_of_groups(spark, clustered, tile, monkeypatch):
    monkeypatch.setattr(kernels, "TILE_BYTES", tile * 8 * 8)
    x, y = clustered[0][:150] / 5, clustered[1][:90] / 5
    groups = np.array(["a", "b", "b", None, "a"])[np.arange(150) % 5]

    def k(a, b):
        return np.exp(-10 * ((a[:, None] - b[None]) ** 2).sum(-1)).mean()

    got = {r.grp: r.mmd for r in kernels.kernel_discrepancy(frame(spark, x, g=list(groups)), frame(spark, y), group="g").collect()}
    assert got.keys() == {"a", "b", ""}
    for g, value in got.items():
        own = x[[(h or "") == g for h in groups]]
        assert value == pytest.approx(np.sqrt(k(own, own) + k(y, y) - 2 * k(own, y)), abs=1e-9)
    assert kernels.kernel_discrepancy(frame(spark, x), frame(spark, y).where("false")).first()["mmd"] == 0.0
    assert kernels.kernel_discrepancy(frame(spark, x).where("false"), frame(spark, y)).count() == 0


@pytest.mark.parametrize("gamma", [0.5, 10.0])
def test_features_stay_within_their_error(spark, clustered, gamma):
    x, y = frame(spark, clustered[0][:200] / 5, g=[str(i % 2) for i in range(200)]), frame(spark, clustered[1][:200] / 5 + 0.1)
    for group in (None, "g"):
        exact = {r.grp: r.mmd for r in kernels.kernel_discrepancy(x, y, group=group, gamma=gamma).collect()}
        near_by = kernels.discrepancy_within(x, y, group=group, gamma=gamma, relative_error=0.04).collect()
        assert len(near_by) == len(exact)
        for r in near_by:
            assert abs(r.mmd - exact[r.grp]) <= r.error <= 0.04 * r.mmd


def test_empty_side_is_zero(spark, clustered):
    some = frame(spark, clustered[0][:20])
    for a, b in ((some, some.where("false")), (some.where("false"), some)):
        assert tuple(sim.distribution_metrics(a, b, "id", "id").first()) == (0.0, 0.0, 0.0)


def test_topics_need_five_rows(spark, clustered):
    rows = clustered[0][:29]
    topic = ["big"] * 20 + ["five"] * 5 + ["four"] * 4
    out = sim.topic_metrics(frame(spark, rows, t=topic), frame(spark, clustered[1]), "id", "id", "t").collect()
    assert {r["topic"]: r["n"] for r in out} == {"big": 20, "five": 5}
    want = cosine(rows, clustered[1])[20:25].max(axis=1).mean()
    assert {r["topic"]: r["mean_similarity"] for r in out}["five"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("n_select,k", [(10, 4), (3, 4), (1000, 2), (2600, 2)])
def test_selection(spark, n_select, k):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % k if i % 3 else 0), float(s)) for i, s in enumerate(rng.random(3000).round(2))]
    df = spark.createDataFrame(rows, "id long, c int, s double")
    got = {r["id"] for r in sim.select_diverse(df, "id", "c", "s", n_select, k).collect()}
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    quota = [r for c in range(k) for r in [x for x in ordered if x[1] == c][: max(1, n_select // k)]]
    rest = [r for r in ordered if r not in set(quota)]
    want = (sorted(quota, key=lambda r: (-r[2], r[0])) + rest)[:n_select]
    assert got == {r[0] for r in want}


def test_clusters(spark, clustered):
    df = frame(spark, clustered[0][:40])
    assert sim.cluster(df, 50).select("cluster").distinct().count() <= 20
    assert sim.cluster(df.limit(1), 50).count() == 0
    assert sim.cluster(df.limit(2), 50).count() == 2


def test_projection_and_embedding(spark, clustered):
    df = frame(spark, clustered[0])
    assert sim.reduce_dimensions(df, 3).select(F.size("reduced")).first()[0] == 3
    assert sim.reduce_dimensions(df, 50).select(F.size("reduced")).first()[0] == 8
    points = sim.plot_coordinates(df, df, "id", "id", max_points=100)
    assert {(r["side"], r["count"]) for r in points.groupBy("side").count().collect()} == {("synthetic", 100), ("organic", 100)}
    texts = spark.createDataFrame([(1, "a b b"), (2, ""), (3, None)], "id int, text string")
    norms = [float(np.linalg.norm(r["embedding"])) for r in sim.embed(texts, dimensions=16).orderBy("id").collect()]
    assert norms == pytest.approx([1.0, 0.0, 0.0])
    custom = sim.embed_with(texts, lambda t: np.array([[len(x or "")] for x in t]), batch_size=2).orderBy("id").collect()
    assert [r["embedding"] for r in custom] == [[5.0], [0.0], [0.0]]


@pytest.mark.parametrize("cells, queries", [(50, 7), (400, 7), (1_000_000, 1024)])
def test_best_of_strips_by_brute_force(monkeypatch, cells, queries):
    monkeypatch.setattr(near, "BLOCK_CELLS", cells)
    monkeypatch.setattr(near, "QUERY_ROWS", queries)
    rng = np.random.default_rng(0)
    for m, k in ((1, 1), (3, 5), (60, 1), (60, 4), (60, 60), (0, 3)):
        # Few distinct directions: many ties.
        b, q = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) for v in (rng.integers(-1, 2, size=(n, 3)).astype(float) for n in (m, 25)))
        skip = np.where(rng.random(25) < 0.5, rng.integers(0, max(1, m), 25), -1)
        sims = np.round(q @ b.T, 12)
        if m:
            sims[np.flatnonzero(skip >= 0), skip[skip >= 0]] = -np.inf
        want = [(i, j, sims[i, j]) for i in range(25) for j in np.argsort(-sims[i], kind="stable")[:k] if sims[i, j] > -np.inf]
        assert list(zip(*near.best_of(q, b, k, skip if m else None))) == want
        for threshold in (0.0, 0.5, 1 / np.sqrt(2), 1.0):
            assert (near.any_close(q, b, threshold) == (np.round(q @ b.T, 12) >= threshold).any(axis=1)).all()


def test_blocks_hold_little_at_once():
    import tracemalloc

    rows = np.random.default_rng(0).normal(size=(20_000, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for work in (lambda: near.best_of(rows[:300], rows, 10), lambda: near.any_close(rows[:300], rows, 0.9999), lambda: kernels._kernel_sum(rows[:300], rows, 10.0)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6, peak


def test_bounds_and_cells_hold_bounded_blocks():
    """Angles of a batch to all pivots or pieces are never held whole, several times over."""
    rng = np.random.default_rng(5)

    def units(n):
        rows = rng.normal(size=(n, 8))
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    pivots, rows = units(1024), units(near.VISIT_ROWS)
    low = rng.uniform(0, 1, 1024)
    pieces = (np.arange(1024) // 256, np.arange(1024), low, low + 0.1)
    index = near.Index(None, SimpleNamespace(value=pivots), pieces, 4, 10)
    angles = np.arccos(np.clip(rows @ pivots.T, -1, 1))
    gaps = np.maximum(np.maximum(angles - low - 0.1, low - angles), 0)
    tracemalloc.start()
    least, home = index.bounds()(rows)
    cell, own = near._cells(rows, pivots)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    np.testing.assert_allclose(least, gaps.reshape(len(rows), 4, 256).min(axis=2), atol=1e-9)
    assert (home == (gaps + angles * 1e-3).argmin(axis=1) // 256).all()
    assert (cell == angles.argmin(axis=1)).all() and np.allclose(own, angles.min(axis=1))
    assert held < 6 * 8 * near.BLOCK_CELLS


def test_single_precision_is_sent_as_it_is(spark):
    """The driver gets four bytes a number; the answers are those of the same numbers in double precision."""
    rng = np.random.default_rng(6)
    q, b = rng.normal(size=(40, 8)), rng.normal(size=(50, 8))
    single = [frame(spark, m).withColumn("embedding", F.col("embedding").cast("array<float>")) for m in (q, b)]
    double = [df.withColumn("embedding", F.col("embedding").cast("array<double>")) for df in single]
    rows = near._vectors(single[1], "id", "embedding")
    assert dict(near._as_sent(rows, single[1], "embedding").dtypes)["v"] == "array<float>"
    assert dict(near._as_sent(rows, double[1], "embedding").dtypes)["v"] == "array<double>"
    one, two = [sorted(map(tuple, sim.nearest(*pair, "id", "id").collect())) for pair in (single, double)]
    assert one == two and len(one) == 40
    covered = [sim.covered_counts(*pair, "id", "id", threshold=0.5).collect() for pair in (single, double)]
    assert covered[0] == covered[1]
