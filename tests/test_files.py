import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators.reshape import split_failed, training_pairs
from textloom.schemas import ALERTS_OUTPUT
from textloom.session import materialize, new_path, work_dir
from textloom.sources import csv_column, load, read_jsonl, text_column, write_csv, write_jsonl
from textloom.sources.writers import clean_strings, selected_rows, write_training_set
from textloom.streaming.append import append_jsonl, read_appended

TRICKY = ['a,"b"', "two\nlines", " padded ", "back\\slash", "é😀", '"', "\\\"", "nan"]


def test_csv_round_trip_and_pandas(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "id int, comment string")
    path = write_csv(df, str(tmp_path / "x.csv"), single_file=True)
    back = {int(r["id"]): r["comment"] for r in load(spark, path).collect()}
    assert back == dict(enumerate(TRICKY))
    file = next((tmp_path / "x.csv").glob("part-*"))
    assert list(pd.read_csv(file, keep_default_na=False)["comment"]) == TRICKY


def test_reads_what_pandas_writes(spark, tmp_path):
    frame = pd.DataFrame({"id": range(len(TRICKY)), "comment": TRICKY})
    frame.to_csv(tmp_path / "a.CSV", index=False)
    frame.to_csv(tmp_path / "a.txt", index=False)
    frame.to_pickle(tmp_path / "a.pkl")
    frame.to_parquet(tmp_path / "a.parquet")
    frame.to_json(tmp_path / "a.jsonl", orient="records", lines=True)
    for name in ("a.CSV", "a.txt", "a.pkl", "a.parquet", "a.jsonl"):
        schema = "id long, comment string" if name.endswith("jsonl") else None
        rows = load(spark, str(tmp_path / name), schema).collect()
        assert sorted((int(r["id"]), r["comment"]) for r in rows) == list(enumerate(TRICKY)), name
    assert csv_column(spark, str(tmp_path / "a.CSV"), "comment", 3).count() == 3 * len(TRICKY)


def test_load_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.doc").write_text("")
    with pytest.raises(ValueError, match="cannot read"):
        load(spark, str(tmp_path / "x.doc"))
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(ValueError, match="schema"):
        load(spark, str(tmp_path / "x.json"))


def test_jsonl(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text('{"x": 1}\n\n  \n{"x": 2}\n')
    one, glob = str(tmp_path / "a.jsonl"), str(tmp_path / "*.jsonl")
    assert read_jsonl(spark, one, "x int").count() == 2
    assert read_jsonl(spark, glob, "x int").count() == 4
    assert read_jsonl(spark, [one, str(tmp_path / "gone.jsonl")], "x int", skip_missing=True).count() == 2
    assert read_jsonl(spark, [str(tmp_path / "gone.jsonl")], "x int", skip_missing=True).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl"), "x int").collect()


def test_text_column_drops_nulls_before_the_cast(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "comment double")
    assert [r[0] for r in text_column(df).collect()] == ["1.5"]


def test_training_set_files(spark, tmp_path):
    parsed = (False, [], "unclear", "é")
    df = spark.createDataFrame([(0, "good", parsed), (1, "bad", None)], f"row_id long, text string, parsed {ALERTS_OUTPUT.simpleString()}")
    good, bad = split_failed(training_pairs(df))
    paths = write_training_set(good, bad, str(tmp_path / "o"), "set")
    parts = (tmp_path / "o" / "set_jsonl").glob("part-*json")
    line = json.loads("".join(p.read_text() for p in parts))
    assert list(line) == ["input", "output"] and json.loads(line["output"])["non_alert_reasoning"] == "é"
    assert read_jsonl(spark, paths["failed"], "id long, error string").first()["error"] == "PARSE_FAILED"
    assert write_training_set(good, bad.where("false"), str(tmp_path / "p"), "set")["failed"] is None


def test_clean_strings_leaves_other_types(spark):
    df = spark.createDataFrame([("a\x00", 1, ["\x01"])], "s string, n int, l array<string>")
    assert tuple(clean_strings(df).first()) == ("a", 1, ["\x01"])


def test_json_keeps_nulls(spark, tmp_path):
    write_jsonl(spark.createDataFrame([(None, 1)], "a string, b int"), str(tmp_path / "j"), single_file=True)
    assert '{"a":null,"b":1}' in next((tmp_path / "j").glob("part-*json")).read_text()


def test_stream_appends_and_resumes(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    seen = []

    def run():
        stream = spark.readStream.schema("x long").parquet(source)
        query = append_jsonl(stream, target, progress, lambda b: b.withColumn("y", F.col("x") * 2),
                             lambda rows, batch_id: seen.append(rows.count()))
        query.awaitTermination()

    spark.range(5).toDF("x").write.parquet(source)
    run()
    spark.range(5, 8).toDF("x").write.mode("append").parquet(source)
    run()
    run()  # nothing new
    rows = read_appended(spark, target, "x long, y long").collect()
    assert sorted((r["x"], r["y"]) for r in rows) == [(i, 2 * i) for i in range(8)]
    assert sum(seen) == 8


def test_work_dir(spark, tmp_path, monkeypatch):
    assert new_path(spark, "a") != new_path(spark, "a")
    conf = type(spark.conf)
    read = conf.get

    def get(self, key, *default):
        return str(tmp_path / "shared/") if key == "spark.checkpoint.dir" else read(self, key, *default)

    monkeypatch.setattr(conf, "get", get)
    assert work_dir(spark) == str(tmp_path / "shared")
    files = materialize(spark.range(3)).inputFiles()
    assert files[0].split("://")[-1].lstrip("/").startswith(f"{tmp_path}/shared".lstrip("/"))


def test_selected_rows_are_sorted_without_sending_texts(spark):
    """Most similar first, then by text; what ranges are found from holds only how a text begins."""
    same = "x" * 40
    texts = [same + "b", same + "a", None, "é", "z", "😀", same[:32], "", same + "a", "y" * 5000, "\uffff", same[:31] + "é"]
    rows = [(texts[i % len(texts)], s) for i, s in enumerate([0.5, 0.9, None] * 24)]
    df = spark.createDataFrame(rows, "text string, organic_similarity double").withColumn("closest_organic_text", F.lit(None).cast("string"))
    df = df.withColumn("metadata", F.struct(F.lit("a").alias("example_type"), F.array(F.lit("l")).alias("expected_alert_types"), F.lit("n").alias("expected_non_alert_type")))
    out = selected_rows(df.repartition(5))
    got = [(r["organic_similarity"], r["text"]) for r in out.collect()]
    plain = [(s, t) for t, s in rows]
    assert got == sorted(plain, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    keys = out._jdf.queryExecution().executedPlan().toString()
    keys = keys[keys.index("rangepartitioning(") :].splitlines()[0]
    assert "text#" not in keys or "substring" in keys
