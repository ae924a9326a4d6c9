import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import COLUMNS, prose, rows_of
from textloom.llm.arrays import mix64
from textloom.llm.components import components
from textloom.llm.near_dedup import _tile_links, common_counts, drop_near_duplicates, near_duplicates, signatures


def sets_of(texts, width):
    out = []
    for t in texts:
        w = (t or "").lower().split(" ") if (t or "").strip() else []
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").split(" ") if x]
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute(ids, texts, width, percent=80):
    sets = sets_of(texts, width)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for y in range(x):
            both, union = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            if union and both * 100 >= percent * union:
                p, q = find(a), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_matches_brute_force(corpus, width):
    rows = corpus.collect()
    want = brute([r.doc_id for r in rows], [r.text for r in rows], width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(corpus, width=width).collect()}
    assert got == want
    kept = {r.doc_id for r in drop_near_duplicates(corpus, width=width).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_large_group_of_near_copies(spark):
    """Copies further from each other than from their common source, which is not the first of them."""
    base = prose(5, 400).split(" ")
    draw = np.random.default_rng(3)
    texts = []
    for i in range(300):
        w = list(base)
        for at in draw.choice(400, 22, replace=False):
            w[at] = f"edit{i}x{at}"
        texts.append(" ".join(w))
    texts.insert(150, " ".join(base))
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    want = brute(list(range(len(texts))), texts, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=2).collect()}
    assert got == want


def test_signature_estimates_similarity():
    x = np.arange(5000, dtype=np.uint64)
    found = []
    for seed in range(40):
        a = mix64(x + np.uint64(seed << 40))
        b = np.concatenate([a[:4444], mix64(x[:556] + np.uint64((seed << 40) + (1 << 30)))])
        s = signatures(np.concatenate([a, b]), np.array([0, 5000, 10000]))
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - 4444 / 5556) < 0.03


def test_edges(nothing, messy):
    assert near_duplicates(nothing).count() == 0
    rows = near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    assert {r.component_id for r in rows if r.doc_id == 4} == {1}
    assert all(r.kept and r.n_shingles == 0 for r in rows if r.doc_id in (2, 3))
    left = drop_near_duplicates(messy)
    assert left.columns == messy.columns and 4 not in {r.doc_id for r in left.collect()}


def test_of_rows_that_repeat_an_id_one_stays(messy):
    rows = drop_near_duplicates(messy).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3]
    texts = [r.text for r in messy.collect() if r.doc_id == 1]
    assert [r.text for r in rows if r.doc_id == 1] == [min(texts)]
    assert sum(r.doc_id is None for r in rows) == 2


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 299), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 150)} == {100} and got[300] == got[299] == 299
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_common_counts_match_set_intersections():
    draw = np.random.default_rng(6)
    left, right = ([np.unique(draw.integers(0, 9000, draw.integers(0, 6000)).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    got = common_counts(left, right)
    assert [[int(x) for x in row] for row in got] == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert common_counts([], right).shape == (0, 5) and common_counts([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]).tolist() == [[0]]


@pytest.mark.parametrize("blocks", [1, 2])
def test_tiles_link_what_brute_force_links(blocks):
    """Rows of two tiles, cut into small batches: the links of a tile join the same components as all its pairs."""
    texts = [prose(i // 6, 60) + f" tail{i} more{i}" * (i % 5) for i in range(48)]
    rows = [(1, t, i, i, texts[i], i % blocks) for t in (0, 1) for i in range(48)]
    names = ["bucket", "tile", "doc", "component", "text", "block"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    for out in _tile_links(iter(batches), width=2, lower=True, percent=80):
        got = {frozenset(x) for x in zip(out["u"].to_pylist(), out["v"].to_pylist())}
        sets = sets_of(texts, 2)
        allowed = {frozenset((a, b)) for a in range(48) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and (blocks == 1 or a % 2 != b % 2)}
        assert got <= allowed and classes(got) == classes(allowed) and len(got) < 48


def classes(links):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in map(sorted, links):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in list(root)}
