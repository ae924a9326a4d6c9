import collections
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import COLUMNS, rows_of
from textloom.llm import spelling


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows):
    """(form, root, n, n_near, form_n) by word, from (doc_id, text)."""
    count = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, w, n, len(others), words.get(form)]
    for w, r in out.items():
        while out[r[1]][0] is not None:
            r[1] = out[r[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def spelled(draw, n):
    """Words that differ by little, with accents, doubled letters and capitals."""
    stems = ["banana", "committee", "éclair", "straße", "naïveté", "aaaaaa", "abcdefghij"]
    out = []
    for _ in range(n):
        w = list(draw.choice(stems))
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            i = draw.randrange(len(w))
            w[i : i + draw.choice([0, 1])] = draw.choice(["", "a", "e", "é", "É", "ß", "×", "n", "B"])
        out.append("".join(w))
    return " ".join(out)


def test_variants_match_brute_force(spark):
    draw = random.Random(4)
    rows = [(i, spelled(draw, 250)) for i in range(40)] + [(None, spelled(draw, 50)), (3, None), (3, ""), (5, "x" * 3000 + " " + ("x" * 2999 + " ") * 3)]
    rows += rows[:2]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], COLUMNS)
    want = brute_force(rows)
    assert sum(r[3] > 0 for r in want.values()) > 100 and any(r[0] != r[1] != w for w, r in want.items())
    for cell_words in (3, 40, spelling.CELL_WORDS):
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.word_counts(df), cell_words=cell_words).collect()}
        assert got == want


def test_every_pair_comes_once():
    draw = random.Random(1)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randrange(1, 6))) for _ in range(500)})
    pairs = collections.Counter(frozenset((words[a], words[b])) for x, y in spelling.near_pairs(words, np.ones(len(words), bool)) for a, b in zip(x, y))
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if near(a, b)} and set(pairs.values()) == {1}


def test_cells_hold_a_bounded_number_of_words(spark):
    draw = random.Random(6)
    words = {"".join(draw.choice("abcdeinrst") for _ in range(6)) for _ in range(3000)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    cells = spelling.plan_cells(df, 50)
    tree = spelling._tree(cells)
    vectors = spelling.Words(sorted(words)).vectors().tolist()
    home = collections.Counter(next(spelling._reach(tree, tuple(v))) for v in vectors)
    assert max(home.values()) <= 50 and sum(home.values()) == len(words)


def test_spelling_edges(spark, nothing, messy):
    assert spelling.variants(spelling.word_counts(nothing)).count() == 0
    texts = [None, "", "abcd abcd abcd", "word1word"]
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    assert spelling.variants(spelling.word_counts(df)).count() == 0
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.word_counts(messy)).collect()}
    assert got == brute_force(rows)


@pytest.mark.parametrize("words", [["abcde"], ["abcde", "abcdf"], []])
def test_few_words(words):
    assert sum(len(x) for x, _ in spelling.near_pairs(words, np.ones(len(words), bool))) == (len(words) == 2)
