import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators.embedding import embed_corpus, shared_words
from textloom.operators.subwords import Subwords, detokenize
from textloom.operators.tokens import tokenize

FOLDER = "/opt/tokenizers"


def vectors(df, **options):
    return {r.id: np.array(r.embedding) for r in embed_corpus(df, "id", **options).collect()}


def test_texts_on_one_subject_are_close(spark):
    rng = random.Random(3)
    subjects = [[f"{s}word{i}" for i in range(40)] for s in "abcd"]
    common = [f"the{i}" for i in range(10)]
    texts = [" ".join(rng.choice(subjects[i % 4]) if rng.random() < 0.5 else rng.choice(common) for _ in range(30)) for i in range(200)]
    texts += [None, "", "unseen"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    got = vectors(df, dimensions=6, features=1024)
    assert len(got) == 203 and not got[200].any() and not got[201].any()
    assert all(np.linalg.norm(got[i]) == pytest.approx(1) for i in range(200))
    m = np.array([got[i] for i in range(200)])
    sims, same = m @ m.T, np.equal.outer(np.arange(200) % 4, np.arange(200) % 4)
    off = ~np.eye(200, dtype=bool)
    # Texts of a subject share few words each; the learned directions bring them together all the same.
    assert sims[same & off].mean() > sims[~same].mean() + 0.3
    again = vectors(df.repartition(2), dimensions=6, features=1024)
    assert all(np.allclose(again[i], got[i], atol=1e-6) for i in got)


def test_directions_hold_as_much_as_singular_vectors(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{j}" for j in rng.choice(60, 12, p=np.arange(1, 61) / np.arange(1, 61).sum())) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    from textloom.operators import embedding as e

    bags = e._bags(df, "text", 64)
    weights, directions = e.learn_directions(bags, 64, 5, passes=3)
    assert np.allclose(directions.T @ directions, np.eye(5), atol=1e-9)
    row, place, value = e._sparse(bags.select("bag").toArrow().column("bag").combine_chunks(), weights)
    a = np.zeros((120, 64))
    a[row, place] = value
    best = np.linalg.svd(a, compute_uv=False)[:5]
    assert (np.linalg.norm(a @ directions) ** 2) >= 0.98 * (best**2).sum()


def test_a_near_copy_may_be_closer_than_a_thinned_text(spark, tmp_path):
    from textloom.catalog import CATALOG

    other = lambda i: i + 1 + int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:15], 16) % 97
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(220)]
    texts[other(3)] = texts[3] + " more"  # one word more
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in CATALOG["v1_learned_embedding"][0](spark, str(tmp_path)).collect()}
    assert got == {i for i in range(220) if other(i) < 220}


def test_shared_words(spark):
    df = spark.createDataFrame([(1, "a b b c", "B, b a d"), (2, "a", "a"), (3, "a", None), (4, "", None)], "id long, x string, y string")
    got = {r.id: r.shared for r in shared_words(df, "id", "x", "y").collect()}
    assert got == {1: 0.6, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"])
def test_subwords_round_trip(spark, name):
    texts = ["hello world", "Zwölf Füße, été", "", None, "<|endoftext|> x", "a\U0001f600b", "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokenizer = Subwords(f"{FOLDER}/{name}")
    ids = tokenize(df, tokenizer, max_length=10**6)
    back = {r.id: r for r in detokenize(ids, tokenizer, out="back").withColumn("n", F.size("input_ids")).collect()}
    for i, t in enumerate(texts):
        assert back[i].back == (t or "") or (name.endswith(".model") and back[i].back == (t or "").strip())
        assert back[i].n == back[i].n_tokens and (i not in (0, 1) or back[i].n < len(t.encode()))
    cut = tokenize(df, tokenizer, max_length=4).where("id = 6").first()
    assert len(cut.input_ids) == 4 and cut.n_tokens > 4


def test_long_rows_are_taken_in_small_runs(spark):
    import pyarrow as pa

    from textloom.operators.tokens import small_batches

    rows = pa.record_batch({"t": ["a" * 40, None, "", "b" * 300, "c" * 30, "d" * 30], "i": [[1] * 20, None, [], [2] * 90, [3], [4]]})
    for column in ("t", "i"):
        runs = list(small_batches(iter([rows, rows.slice(0, 0)]), column, 100))
        assert pa.Table.from_batches(runs).to_pylist() == rows.to_pylist()
        assert [r.num_rows for r in runs] == [4, 2, 0]
    # What the tokenizer gets at once stays small, however long the batch of the task is.
    texts = [c * 5000 for c in "abcdefghij"] * 100

    def encode(part):
        assert sum(map(len, part)) < 1_200_000, "too much at once"
        return [[1] for _ in part]

    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert tokenize(df, encode).count() == 1000


def test_texts_without_tokens(spark, tmp_path):
    from textloom.catalog import CATALOG

    texts = ["", None, "é", "a" * 3000, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in CATALOG["g8_tokenize"][0](spark, str(tmp_path)).collect()}
    none = (0, 0, None, True)
    assert got == {0: none, 1: none, 2: (2, 2, 0xC3, True), 3: (2048, 3000, 97, True), 4: none}


def test_unknown_vocabulary_files_are_refused():
    with pytest.raises(ValueError, match="no tokenizer file"):
        Subwords("vocabulary.bin")(["x"])
