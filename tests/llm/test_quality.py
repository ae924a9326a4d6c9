import collections
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import COLUMNS, prose, rows_of
from tests.oracle import connect
from textloom.llm import quality_model as m, quality_rules as q

SPACE = r"[^\x20\x09-\x0D]+"


def base_counts(text):
    w = re.findall(SPACE, text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_columns_match_brute_force(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab c\n\t#|.é") for _ in range(draw.randrange(80))) for _ in range(120)]
    texts += ["a b c a b c x", "a a a a", "\n\n", "x\nx\n x\nx", None, prose(7, 20_000), prose(8, 60), (prose(9, 30) + "\n") * 3]
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    for r in q.measured(df).collect():
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


@pytest.mark.parametrize(
    "line,fails",
    [
        ("This is an ordinary sentence that ends well.", False), ("Home | About | Contact | Login", True), ("### $$$ %%% &&& stuff", True),
        ("EVERYTHING HERE IS WRITTEN IN CAPITALS.", True), ("All rights reserved by the owner of it.", True), ("No mark here", True),
        ("A long line of prose that was broken by hand before its end came", False),
    ],
)
def test_line_rules(spark, line, fails):
    df = spark.createDataFrame([(line,)], "x string")
    assert df.select(q.line_fails(df.x)).first()[0] is fails


def test_clean_removes_lines_and_documents(spark, nothing, messy):
    good = "\n".join(prose(i, 20) for i in range(4))
    df = spark.createDataFrame(rows_of([good + "\nHome | News | Login", "Home | News\n" * 40, "short.", None]), COLUMNS)
    rows = q.clean(df).collect()
    assert [(r.doc_id, r.text) for r in rows] == [(0, good)]
    assert q.clean(nothing).count() == 0
    cleaned = q.clean(messy)
    assert cleaned.columns == messy.columns and {r.doc_id for r in cleaned.collect()} == {1, 4, None}


def test_label_model_finds_accuracies():
    draw = np.random.default_rng(1)
    truth = (draw.random(20_000) < 0.2).astype(int)
    right = [0.95, 0.8, 0.7]
    votes = np.stack([np.where(draw.random(20_000) < r, truth, 1 - truth) for r in right], axis=1)
    votes[draw.random(20_000) < 0.3, 2] = -1
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy, prior = m.fit_label_model(patterns, counts)
    assert abs(prior - 0.2) < 0.04
    assert np.abs(accuracy.mean(axis=1) - right).max() < 0.06
    assert ((posterior[at.ravel()] >= 0.5) == truth).mean() > 0.93


def test_agrees_with_people(spark):
    """Against labels people gave, which junk labellers never see."""
    folder = "/root/testdata/sf0.01"
    labels = connect(folder).execute("SELECT doc_id, quality, toxic FROM labels").fetchall()
    kept = {r.doc_id: r.kept for r in m.op2_quality_model(spark, folder).select("doc_id", "kept").collect()}
    clean = [kept[i] for i, good, bad in labels if good and not bad]
    junk = [kept[i] for i, good, _ in labels if not good]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1


def test_mined_words(spark):
    """Words that only toxic documents have are found, common ones are not."""
    texts = [prose(i, 30) + (" Zzfoul, zzvile" if i % 10 == 0 else "") for i in range(400)]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    mined = set(m.mined_words(docs, labels).tolist())
    assert {m.hash_of(b"zzfoul"), m.hash_of(b"zzvile")} <= mined and m.hash_of(b"alpha") not in mined
    gone = {r.doc_id for r in m.judged(docs, labels).where("not kept").collect()}
    assert gone == {i for i in range(400) if i % 10 == 0}


def test_model_edges(nothing, messy):
    assert m.judged(nothing).count() == 0
    rows = m.judged(messy).collect()
    assert len(rows) == messy.count() and all(r.kept for r in rows if r.doc_id in (2, 3))
    assert m.keep_good(messy).columns == messy.columns
