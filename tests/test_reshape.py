from textloom.operators import reshape, summaries
from textloom.schemas import ALERTS_OUTPUT

A = ("e1", "r1", "fraud", "low")
B = ("e2", "r2", "bullying", "high")
ROWS = [
    (0, " one ", (True, [A, B], None, None)),
    (1, "two", (False, [A], "unclear", "why")),
    (2, "three", None),
    (3, "four", (True, [], None, None)),
    (4, " nan ", (True, [A], None, None)),
]


def frame(spark):
    return spark.createDataFrame(ROWS, f"row_id long, text string, parsed {ALERTS_OUTPUT.simpleString()}")


def test_explode(spark):
    rows = [tuple(r) for r in reshape.explode_results(frame(spark)).collect()]
    n = None
    assert sorted(rows, key=str) == sorted(
        [
            ("text_1", " one ", True, 1, 2, "fraud", "low", "e1", "r1", n, n),
            ("text_1", " one ", True, 2, 2, "bullying", "high", "e2", "r2", n, n),
            ("text_2", "two", False, n, 0, n, n, n, n, "unclear", "why"),
            ("text_3", "three", n, n, n, n, n, n, n, n, "PARSE_FAILED"),
            ("text_5", " nan ", True, 1, 1, "fraud", "low", "e1", "r1", n, n),
        ],
        key=str,
    )


def test_pairs_and_review_rows(spark):
    good, bad = reshape.split_failed(reshape.training_pairs(frame(spark)))
    assert [r["id"] for r in good.orderBy("id").collect()] == [0, 1, 3]
    assert [(r["id"], r["input"], r["error"]) for r in bad.collect()] == [(2, "three", "PARSE_FAILED")]
    rows = reshape.qa_rows(good).orderBy("id").collect()
    assert (rows[0]["num_alerts"], rows[0]["alert_types"], rows[0]["excerpts"]) == (2, "fraud, bullying", "e1 | e2")
    assert (rows[1]["num_alerts"], rows[1]["alert_types"], rows[1]["non_alert_reasoning"]) == (0, "", "why")
    assert len(rows[0].asDict()) == 12


def test_summaries(spark):
    df = frame(spark)
    s = summaries.run_summary(df).first()
    assert (s["total"], s["successful"], s["failed"], s["with_alerts"], s["total_alerts"]) == (5, 4, 1, 3, 4)
    assert s["successful_pct"] == 80.0
    empty = summaries.run_summary(df.where("false")).first()
    assert empty["total"] == 0 and empty["successful_pct"] is None
    assert [tuple(r) for r in summaries.alert_type_histogram(df).collect()] == [("fraud", 2), ("bullying", 1)]
    assert [tuple(r) for r in summaries.severity_histogram(df).collect()] == [("low", 2), ("high", 1)]
    assert [tuple(r) for r in summaries.non_alert_histogram(df).collect()] == [("unclear", 1)]
    one_source = spark.createDataFrame([("a",)], "source_column string")
    assert summaries.source_histogram(one_source).count() == 0


def test_annotations_without_path(spark):
    df = spark.createDataFrame([(1, "['B > a', '']"), (2, "[]")], "id int, annotations string")
    exploded = reshape.explode_annotations(df)
    assert exploded.count() == 3
    assert [r["path_elements_sorted"] for r in reshape.annotation_paths(exploded).collect()] == ["a|b"]
    assert reshape.annotation_paths(exploded, drop_empty=False).count() == 3


def test_coverage_and_missing(spark):
    df = spark.createDataFrame([("a", ["x", "y"], None), ("a", None, "h"), (None, [], "")], "k string, l array<string>, d string")
    counts = summaries.coverage(df, {"k": "k", "d": "d"}, {"l": "l"})
    assert {(r[0], r[1], r[2]) for r in counts.collect()} == {("k", "a", 2), ("d", "h", 1), ("l", "x", 1), ("l", "y", 1)}
    with_null = summaries.coverage(df, {"d": "d"}, count_null=["d"])
    assert {(r[1], r[2]) for r in with_null.collect()} == {(None, 1), ("h", 1), ("", 1)}
    gone = summaries.missing_values(counts, {"k": ["a", "b"], "l": ["x", "z"]})
    assert {tuple(r) for r in gone.collect()} == {("k", "b"), ("l", "z")}
    report = summaries.coverage_report(counts, df, {"l": 1}).collect()
    assert {(r["dimension"], r["value"], r["rank"]) for r in report} == {("k", "a", 1), ("d", "h", 1), ("l", "x", 1)}
