import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from textloom.llm.arrays import Texts, hash_of, text_slices

TEXT = st.one_of(st.none(), st.text(alphabet="aBé \t\n\x0b\x0c\r |", max_size=20))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=12), st.integers(1, 40))
def test_words_match_the_pattern(texts, limit):
    got = []
    for i, j, data, offsets in text_slices(pa.array(texts, pa.string()), limit):
        t = Texts(data, offsets)
        assert len(t) == j - i
        got += [[t.word(k).decode() for k in range(a, b)] for a, b in zip(t.bounds, t.bounds[1:])]
    assert got == [split(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_equal_words_have_equal_hashes(texts):
    seen: dict = {}
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        t = Texts(data, offsets)
        for k, h in enumerate(t.hashes()):
            assert seen.setdefault(t.word(k), h) == h
    assert len(set(seen.values())) == len(seen)
    assert all(hash_of(w) == h for w, h in seen.items())


def test_lower_case_is_ascii_only():
    data = np.frombuffer("AZ É az".encode(), np.uint8)
    t = Texts(data, np.array([0, len(data)]), lower=True)
    assert [t.word(k).decode() for k in range(3)] == ["az", "É", "az"]


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_slices_cover_all_rows(limit):
    texts = ["x" * n for n in (0, 5, 50, 0, 1, 200, 3)]
    parts = list(text_slices(pa.array(texts), limit))
    assert [i for i, *_ in parts] == [0, *[j for _, j, *_ in parts[:-1]]] and parts[-1][1] == len(texts)
    assert sum(len(d) for *_, d, _ in parts) == sum(map(len, texts))
