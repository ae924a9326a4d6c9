import pytest
from pyspark.sql import functions as F

from textloom.operators import generation
from tests.backends import Echo
from textloom.plans.generate import generate
from textloom.schemas import ALERT_TYPES, DIMENSIONS, GENERATED_ALERT_TYPES, GENERATED_NON_ALERT_TYPES


@pytest.mark.parametrize("shares", [generation.DEFAULT_SHARES, generation.REMOTE_SHARES])
@pytest.mark.parametrize("n", [0, 1, 10, 999, 10_000])
def test_quotas_sum(n, shares):
    assert sum(generation.quotas(n, shares).values()) == n


def test_quotas_refuse_negative():
    with pytest.raises(ValueError):
        generation.quotas(10, {"alert": -0.1})
    assert sum(generation.quotas(10, {"alert": 0.8, "mixed": 0.7}).values()) == 15  # too much is not trimmed


def test_label_sets():
    assert len(ALERT_TYPES) == 27 and len(GENERATED_ALERT_TYPES) == 24
    assert set(GENERATED_ALERT_TYPES) < set(ALERT_TYPES)


def test_queue(spark):
    rows = generation.task_queue(spark, 200).orderBy("task_id").collect()
    assert [r["task_id"] for r in rows] == list(range(200))
    by_type = {}
    for r in rows:
        i = by_type.setdefault(r["example_type"], -1) + 1
        by_type[r["example_type"]] = i
        for name, values in DIMENSIONS.items():
            assert r[name] == values[i % len(values)]
        if r["example_type"] == "mixed":
            assert r["alert_types"] == [GENERATED_ALERT_TYPES[(i + j) % 24] for j in range(i % 3 + 1)]
        if r["example_type"] in ("alert", "hard_alert"):
            assert r["alert_types"] == [GENERATED_ALERT_TYPES[i % 24]] and r["non_alert_type"] is None
        else:
            assert r["non_alert_type"] == GENERATED_NON_ALERT_TYPES[i % 9]
    assert generation.task_queue(spark, 0).count() == 0


def test_targeted(spark):
    labels = spark.createDataFrame([("non_alert_types", "unclear"), ("alert_types", "fraud")], "dimension string, value string")
    rows = generation.targeted_tasks(labels, 3, "subtle", first_id=100).orderBy("task_id").collect()
    assert [r["task_id"] for r in rows] == list(range(100, 106))
    assert {(r["example_type"], r["difficulty"]) for r in rows} == {("hard_alert", "subtle"), ("hard_non_alert", "subtle")}
    assert [r["non_alert_type"] for r in rows] == [None] * 3 + ["unclear"] * 3


def test_random_dimensions_respect_given_values(spark):
    df = spark.range(60).withColumn("example_type", F.lit("mixed")).withColumn("tone", F.when(F.col("id") < 5, "mine"))
    rows = generation.random_dimensions(df, "id", given=["tone"]).orderBy("id").collect()
    assert all(r["tone"] == "mine" for r in rows[:5]) and all(r["tone"] in DIMENSIONS["tone"] for r in rows[5:])
    assert {len(r["alert_types"]) for r in rows} == {1, 2, 3}
    assert all(len(set(r["alert_types"])) == len(r["alert_types"]) for r in rows)


def test_generate_fills_gaps(spark):
    out = generate(spark, 20, Echo())
    labels = {r[0] for r in out.select(F.explode("metadata.expected_alert_types")).collect()}
    others = {r[0] for r in out.select("metadata.expected_non_alert_type").collect()}
    assert labels == set(GENERATED_ALERT_TYPES)
    assert others - {None} == set(GENERATED_NON_ALERT_TYPES)
    assert out.select("row_id").distinct().count() == out.count()
