import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from textloom.operators import inference as inf
from textloom.operators.parsing import parse_typed
from textloom.plans.classify import classify_texts
from textloom.schemas import ALERTS_OUTPUT_SCHEMA


@dataclass(frozen=True)
class Recorder:
    """Answers with the batch it was called with; fails on marked prompts."""

    name: str = "recorder"

    def load(self):
        pass

    def generate(self, prompts, schema, options):
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        if any("short" in p for p in prompts):
            return []
        info = {"size": len(prompts), "schema": (schema or {}).get("title"), "t": options["temperature"]}
        return [[json.dumps({**info, "p": p}), "second"] for p in prompts]


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, prompt string").coalesce(1)


def answers(df):
    return {r["row_id"]: (r["outputs"] and json.loads(r["outputs"][0]), r["error"]) for r in df.collect()}


def test_batches_options_and_outputs(spark):
    got = answers(inf.infer(prompts(spark, ["a"] * 7), Recorder(), batch_size=3))
    assert [got[i][0]["size"] for i in range(7)] == [3, 3, 3, 3, 3, 3, 1]
    assert got[0][0]["t"] == 0.95
    guided = answers(inf.infer(prompts(spark, ["a"]), Recorder(), schema={"title": "T"}, options={"temperature": 0.3}))
    assert guided[0][0] == {"size": 1, "schema": "T", "t": 0.3, "p": "a"}
    assert answers(inf.infer(prompts(spark, ["a", "b"]), Recorder(), batch_size=1))[1][0]["size"] == 1


def test_one_bad_prompt_does_not_take_its_batch(spark):
    got = answers(inf.infer(prompts(spark, ["a", "bad", "b", "short"]), Recorder(), retries=1))
    assert got[0][0]["p"] == "a" and got[2][0]["p"] == "b"
    assert got[1] == (None, "RuntimeError: refused")
    assert got[3][1] == "ValueError: 0 answers for 1 prompts"


def test_rows_with_their_own_schema(spark):
    texts = [('{"title": "A", "type": "object"}',), (None,), ('{"type":"object","title":"A"}',), ('{"title": "B"}',)]
    df = spark.createDataFrame([(i, f"p{i}", t[0]) for i, t in enumerate(texts)], "row_id long, prompt string, s string").coalesce(1)
    got = answers(inf.infer(df, Recorder(), schema_column="s"))
    assert [(got[i][0]["schema"], got[i][0]["size"], got[i][0]["p"]) for i in range(4)] == [
        ("A", 2, "p0"), (None, 1, "p1"), ("A", 2, "p2"), ("B", 1, "p3")]
    keys = [r[0] for r in df.select(inf.canonical_schema("s")).collect()]
    assert keys[0] == keys[2] != keys[3] and keys[1] == "no_schema"


def test_rows_keep_big_ids_and_nulls(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "a", None), (big + 2, "b", big)], "row_id long, prompt string, other long")
    rows = inf.infer(df, Recorder()).orderBy("row_id").collect()
    assert [(r["row_id"], r["other"]) for r in rows] == [(big, None), (big + 2, big)]


def test_callback(spark, tmp_path):
    target = str(tmp_path)

    def note(keys, asked, outputs):
        with open(f"{target}/{keys[0]}", "w") as f:
            f.write(f"{len(keys)} {len(asked)} {len(outputs)}")

    inf.infer(prompts(spark, ["a"] * 5), Recorder(), batch_size=2, on_batch=note, row_id="row_id").collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "2", "4"]
    assert (tmp_path / "4").read_text() == "1 1 1"


def test_broken_backend_fails_the_job(spark):
    rules = (inf.Rule("fraud", "nonsense", "x"),)
    with pytest.raises(Exception, match="unknown severity"):
        inf.infer(prompts(spark, ["a"]), inf.RuleBackend(rules)).collect()


def test_template_is_applied_once(spark):
    df = inf.infer(prompts(spark, ["a"]), Recorder(), template="instruct")
    assert answers(df)[0][0]["p"] == "<s>[INST] a [/INST]"
    assert answers(inf.infer(prompts(spark, ["a"]), Recorder(), template="instruct", formatted=True))[0][0]["p"] == "a"


def test_registry():
    inf.register_backend("mine", Recorder)
    assert inf.backend("mine") == Recorder()
    with pytest.raises(ValueError, match="unknown backend"):
        inf.backend("other")


def test_profiles(spark):
    shared = inf.gpu_profile(copies_per_gpu=4).taskResources["gpu"].amount
    assert shared == 0.25
    assert inf.gpu_profile(gpus_per_copy=2).taskResources["gpu"].amount == 2
    with pytest.raises(ValueError):
        inf.gpu_profile(2, 2)


def test_rule_backend_and_expression_agree(spark):
    rules = (inf.Rule("fraud", "low", "fake invoice"), inf.Rule("bullying", "high", "mocked"))
    texts = ["A fake invoice, and he MOCKED me", "all fine", "mocked"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    python = classify_texts(df, inf.RuleBackend(rules)).orderBy("row_id").collect()
    native = parse_typed(df.withColumn("response", inf.rule_response("text", rules)), ALERTS_OUTPUT_SCHEMA)
    for a, b in zip(python, native.orderBy("row_id").collect()):
        a, b = a["parsed"], b["parsed"]
        assert a["has_alerts"] == b["has_alerts"]
        assert [x["alert_type"] for x in a["alerts"]] == [x["alert_type"] for x in b["alerts"]]
        assert a["non_alert_classification"] == b["non_alert_classification"]


def test_options_merge_columns(spark):
    def m(d):
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])

    row = spark.range(1).select(inf.merge_options(m({"a": 1.0, "b": 2.0}), m({"b": 3.0, "c": 4.0})).alias("m")).first()
    assert row["m"] == {"a": 1.0, "b": 3.0, "c": 4.0}
