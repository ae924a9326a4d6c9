import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.backends import Echo
from textloom.operators.inference import Rule, RuleBackend
from textloom.plans import compare as compare_plan, rewrite as rewrite_plan
from textloom.plans.classify import run_classification, save_exploded

ENGINE = RuleBackend((Rule("fraud", "low", "invoice"), Rule("bullying", "high", "mocked")))


def test_classification(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "bad invoice", None), (1, " ", "he mocked me"), (2, "fine", "nan")], "row_id long, a string, b string"
    )
    done = run_classification(df, ["a", "b", "c"], ENGINE, str(tmp_path / "out"))
    rows = {(r["source_column"], r["original_row_idx"]): r for r in done.pairs.collect()}
    assert set(rows) == {("a", 0), ("b", 1), ("a", 2)}
    assert sorted(r["id"] for r in rows.values()) == [0, 1, 2]
    reports = done.reports()
    assert reports["summary"].first()["total"] == 3
    assert {r["alert_type"] for r in reports["alert_types"].collect()} == {"fraud", "bullying"}
    assert reports["sources"].count() == 2
    assert done.paths["failed"] is None
    numbered = done.results.withColumn("row_id", F.col("original_row_idx"))
    save_exploded(numbered, str(tmp_path / "exploded.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "exploded.csv")).count() == 3


@pytest.fixture
def corpora(spark):
    rng = np.random.default_rng(2)
    def side(n, shift):
        rows = [(i, f"text {shift} {i}", (rng.normal(size=6) + shift).tolist(), f"t{i % 2}") for i in range(n)]
        df = spark.createDataFrame(rows, "id long, text string, embedding array<double>, example_type string")
        return df.withColumn("metadata", F.struct(
            "example_type", F.array(F.lit("a"), F.lit("b")).alias("expected_alert_types"),
            F.lit(None).cast("string").alias("expected_non_alert_type")))
    return side(60, 0.5), side(30, 1.0)


def test_comparison(spark, corpora, tmp_path):
    s, o = corpora
    c = compare_plan.compare(s, o, n_select=20)
    assert c.selected.count() == 20
    assert {r["topic"] for r in c.topics.collect()} == {"t0", "t1"}
    closest = c.selected.select("nearest_id", "closest_organic_text").collect()
    assert all(r["closest_organic_text"] == f"text 1.0 {r['nearest_id']}" for r in closest)
    lines = compare_plan.report_lines(c, o)
    assert "synthetic rows: 60" in lines and lines[-10].startswith("1. ")
    path = compare_plan.save_selected(c, str(tmp_path / "sel.csv"))
    rows = spark.read.option("header", True).csv(path)
    assert rows.count() == 20 and rows.first()["expected_alert_types"] == "a, b"
    assert compare_plan.compare(s, o, method="other").selected.count() == 0


def test_rewrite(spark):
    inputs = spark.createDataFrame([(0, " first "), (1, "second")], "row_id long, comment string")
    refs = spark.createDataFrame(
        [(0, "x" * 60, "12", "['B > A', 'C']"), (1, "x" * 60, "12", "['D']"), (2, "y" * 60, "3", "['E']"),
         (3, "short", "2", "['F']"), (4, "z" * 60, "2", "[]")],
        "row_id long, text string, project_ids string, annotations string",
    )
    kept = rewrite_plan.prepare_references(refs).orderBy("row_id").collect()
    assert [(r["row_id"], r["path_elements_sorted"]) for r in kept] == [(0, "a|b"), (2, "e")]
    assert [r["row_id"] for r in rewrite_plan.prepare_references(refs, "2").collect()] == [0]
    ready = rewrite_plan.prepare_inputs(inputs, 3)
    out = rewrite_plan.rewrite(ready, rewrite_plan.prepare_references(refs), Echo()).collect()
    assert sorted(r["row_id"] for r in out) == list(range(6))
    assert all(r["rewritten_comment"] for r in out) and {r["reference_comment"][0] for r in out} <= {"x", "y"}


def test_comparison_reads_the_organic_side_once_for_all_metrics(spark):
    """Metrics pass over stored vectors; only the texts of the neighbours are looked up in the source again."""
    rng = np.random.default_rng(2)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            read.add(rows.num_rows)
            yield rows

    fields = "id long, text string, embedding array<float>, example_type string"

    def side(first, n):
        return spark.createDataFrame([(first + i, f"t{i}", [float(x) for x in rng.normal(size=4)], "ab"[i % 2]) for i in range(n)], fields)

    o = side(100, 40).mapInArrow(counted, fields)
    c = compare_plan.compare(side(0, 30), o, n_select=5, cluster_column="example_type")
    assert c.overall.count() == 1 and c.topics.count() == 2 and c.selected.count() == 5
    assert read.value <= 2 * 40
