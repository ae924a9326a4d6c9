import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.operators import prompts, reshape
from textloom.schemas import TASK


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn("c")).first()[0]


STRIP = ["\t a \n", "\xa0x ", "\x1cy\x1f", "plain", " \n ", "", "a​", "　z ", "\x85w"]


def test_strip_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in STRIP], "c string")
    assert [r[0] for r in df.select(t.strip_ws("c")).collect()] == [s.strip() for s in STRIP]
    assert one(spark, None, t.strip_ws) is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=20, max_size=40))
def test_strip_matches_python_on_random_texts(spark, values):
    values = [v for v in values if not any(0xD800 <= ord(c) <= 0xDFFF for c in v)]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r[0] for r in df.select(t.strip_ws("c")).collect()] == [v.strip() for v in values]


@pytest.mark.parametrize("value,blank", [("", True), ("nan", True), (" NaN\n", True), (None, True), ("nana", False)])
def test_blank(spark, value, blank):
    assert one(spark, value, t.is_blank) is blank


def test_length_counts_code_points(spark):
    for n, inside in [(49, False), (50, True), (1000, True), (1001, False)]:
        assert one(spark, "😀" * n, t.length_between) is inside
    assert one(spark, None, t.length_between) is False


def test_control_characters(spark):
    assert one(spark, "a\x00b\x08\t\x0b\x0c\n\x0d\x1fz_x000D_y", t.clean_control) == "ab\t\n\x0dz y"


def test_words(spark):
    words = ["a.b", "Sure"]
    assert one(spark, "I am SURE", lambda c: t.contains_any(c, words)) is True
    assert one(spark, "axb", lambda c: t.contains_any(c, words)) is False
    assert one(spark, None, lambda c: t.contains_any(c, words)) is False


def test_quotes_and_fences(spark):
    assert one(spark, " \"'a\"b'\" ", t.strip_quotes) == " \"'a\"b'\" ".strip().strip('"').strip("'")
    assert one(spark, "```json\nx```y\n```", t.strip_fences) == "x```y"


def test_paths(spark):
    assert one(spark, "B > a>C ", t.normalize_path) == "a|b|c"
    assert one(spark, "", t.normalize_path) == "" and one(spark, None, t.normalize_path) == ""


def test_let_evaluates_once(spark):
    doubled = spark.range(50).select(t.let(F.rand(), lambda v: v - v).alias("d"))
    assert doubled.where("d != 0").count() == 0


def test_unpivot_keeps_order_and_drops_blanks(spark):
    df = spark.createDataFrame([(0, " x ", "nan"), (1, None, "y"), (2, "", "z")], "row_id long, a string, b string")
    rows = reshape.unpivot_texts(df, ["a", "b", "gone"]).orderBy("column_pos", "original_row_idx").collect()
    assert [(r["source_column"], r["original_row_idx"], r["text"]) for r in rows] == [("a", 0, "x"), ("b", 1, "y"), ("b", 2, "z")]
    with pytest.raises(ValueError, match="it has"):
        reshape.unpivot_texts(df, ["gone"])


def test_rename_refuses_duplicates(spark):
    df = spark.createDataFrame([("a", "b")], "text string, comment string")
    with pytest.raises(ValueError, match="duplicate"):
        prompts.column_mapping(df, {"text": "input_comment", "comment": "input_comment"})
    assert prompts.column_mapping(df.drop("comment"), {"text": "x", "comment": "x"}).columns == ["x"]


def test_chat_format_wraps_once(spark):
    df = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "prompt string, formatted boolean")
    out = prompts.chat_format(prompts.chat_format(df, template="instruct"), template="instruct")
    assert [r["prompt"] for r in out.collect()] == ["<s>[INST] a [/INST]", "b", "<s>[INST] c [/INST]"]
    assert [r["prompt"] for r in prompts.chat_format(df, template="unknown").collect()] == ["a", "b", "c"]


def test_generation_prompt(spark):
    row = (0, "mixed", "i", "r", "t", "w", "d", "g", ["a", "b"], "n")
    text = prompts.generation_prompt(spark.createDataFrame([row], TASK)).first()["prompt"]
    assert "a, b; n" in text and "difficulty: d" in text
    bad = spark.createDataFrame([(0, "odd", *row[2:])], TASK)
    with pytest.raises(Exception, match="no prompt for example type odd"):
        prompts.generation_prompt(bad).collect()


def test_few_shot(spark):
    examples = spark.createDataFrame([(i, "a" if i < 90 else "b", f"t{i}") for i in range(91)], "id int, label string, text string")
    first = {r["label"]: r["samples"] for r in prompts.few_shot_examples(examples, "label", "text", 3, key="id").collect()}
    assert first == {"a": ["t0", "t1", "t2"], "b": ["t90"]}
    drawn = {r["label"]: r["samples"] for r in prompts.few_shot_examples(examples, "label", "text", 2).collect()}
    assert len(drawn["a"]) == 2 and drawn["b"] == ["t90"]
    tasks = spark.createDataFrame([(1, ["b", "a"]), (2, ["none"]), (3, None)], "task_id int, alert_types array<string>")
    shots = prompts.few_shot_examples(examples, "label", "text", 3, key="id")
    got = {r["task_id"]: r["few_shot"] for r in prompts.attach_few_shot(tasks, shots, "label", limit=3).collect()}
    assert got == {1: ["t90", "t0", "t1"], 2: [], 3: []}
