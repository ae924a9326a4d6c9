import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.operators import sampling
from textloom.sources.readers import inline_texts, replicate


def digest(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def first(n, total):
    return set(sorted(range(total), key=digest)[:n])


@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
def test_sample_is_exact(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "SMALL_RANGE", 3)  # forces several narrowing steps
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", 1)
    got = {r["id"] for r in sampling.hash_sample(spark.range(500), "id", n).collect()}
    assert got == first(n, 500)


@pytest.mark.parametrize("share,want", [(0.02, 10), (0.001, 1), (0.5, 250), (0, None)])
def test_split(spark, share, want):
    train, validation = sampling.split_train_validation(spark.range(500), "id", share)
    if want is None:
        assert validation is None and train.count() == 500
        return
    assert {r["id"] for r in validation.collect()} == first(want, 500)
    assert train.count() == 500 - want


def test_split_of_nothing(spark):
    train, validation = sampling.split_train_validation(spark.range(0), "id", 0.02)
    assert train.count() == 0 and validation.count() == 0


def test_rank_is_dense_and_in_hash_order(spark):
    got = {r["id"]: r["hash_rank"] for r in sampling.hash_rank(spark.range(3000), "id").collect()}
    assert got == {k: i for i, k in enumerate(sorted(range(3000), key=digest))}


def test_group_sample_with_a_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2500, "hot").otherwise(F.col("id").cast("string")))
    out = sampling.group_sample(df, "g", "id", 5)
    assert {r["id"] for r in out.where("g = 'hot'").collect()} == {k for k in sorted(range(2500), key=digest)[:5]}
    assert out.where("g != 'hot'").count() == 500


def test_groups_are_trimmed_before_the_shuffle(spark):
    plan = sampling.keep_first(spark.range(10).withColumn("t", F.col("id") % 2), "t", "id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit")  # partial and final


def test_random_reference_draws_every_row_once(spark):
    refs = spark.range(7).withColumnRenamed("id", "ref")
    drawn = sampling.random_reference(spark.range(400), refs, "id", "ref")
    assert drawn.count() == 400 and drawn.select("ref").distinct().count() == 7


def test_cycle(spark):
    rows = sampling.cycle_to(spark.range(5), "id", 12).orderBy("position").collect()
    assert [r["id"] for r in rows] == [i % 5 for i in range(12)]
    assert sorted(r["shuffled_position"] for r in rows) == list(range(12))
    assert [r["id"] for r in sampling.cycle_to(spark.range(50), "id", 3).orderBy("position").collect()] == [0, 1, 2]


def test_replicate(spark):
    rows = replicate(spark.range(3).withColumnRenamed("id", "row_id"), 2, "row_id").orderBy("row_id").collect()
    assert [(r["row_id"], r["copy"]) for r in rows] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)]
    assert [r["text"] for r in inline_texts(spark, ["a", "b"], 2).orderBy("row_id").collect()] == ["a", "b", "a", "b"]


def test_steps():
    assert sampling.training_steps(1000, 8, 2, 6, 2) == {"effective_batch": 96, "steps_per_epoch": 10, "total_steps": 20}
