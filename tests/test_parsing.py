import json

import pytest
from pyspark.sql import functions as F

from textloom.functions.jsonschema import compile_schema, schema_key
from textloom.operators import parsing
from textloom.schemas import ALERTS_OUTPUT, ALERTS_OUTPUT_SCHEMA

SPAN = {"excerpt": "e", "reasoning": "r", "alert_type": "fraud", "severity": "low"}


def answer(**changes):
    base = {"has_alerts": True, "alerts": [SPAN]}
    return json.dumps({**base, **changes})


PARSED = (True, [("e", "r", "fraud", "low")], None, None)
CASES = [
    ("valid", answer(), PARSED),
    ("json fence", f"```json\n{answer()}\n```", PARSED),
    ("bare fence", f"```\n{answer()}```", PARSED),
    ("white space", f"\n  {answer()}\t", PARSED),
    ("backticks inside", answer(alerts=[{**SPAN, "excerpt": "a```b"}]), (True, [("a```b", "r", "fraud", "low")], None, None)),
    ("trailing text", answer() + " done", None),
    ("second object", answer() + answer(), None),
    ("tail after brace", answer() + "} x", None),
    ("tail after bracket", answer() + "] x", None),
    ("tail after comma", answer() + ',"a":1', None),
    ("text before", "Here: " + answer(), None),
    ("single quotes", answer().replace('"', "'"), None),
    ("missing required", '{"has_alerts": true}', None),
    ("null alerts", answer(alerts=None), None),
    ("bad enum", answer(alerts=[{**SPAN, "alert_type": "other"}]), None),
    ("bad severity", answer(alerts=[{**SPAN, "severity": "huge"}]), None),
    ("missing nested", answer(alerts=[{"excerpt": "e"}]), None),
    ("number for text", answer(alerts=[{**SPAN, "excerpt": 5}]), None),
    ("object for text", answer(alerts=[{**SPAN, "excerpt": {}}]), None),
    ("word for boolean", answer(has_alerts="yes"), PARSED),
    ("one for boolean", answer(has_alerts=1), PARSED),
    ("off for boolean", answer(has_alerts="OFF"), (False, [("e", "r", "fraud", "low")], None, None)),
    ("two for boolean", answer(has_alerts=2), None),
    ("other word", answer(has_alerts="maybe"), None),
    ("extra key", answer(extra=1), PARSED),
    ("duplicate key", '{"has_alerts": false, "has_alerts": true, "alerts": []}', (True, [], None, None)),
    ("array on top", f"[{answer()}]", None),
    ("empty", "", None),
    ("blank", "  \n", None),
    ("null", None, None),
    ("quiet", answer(has_alerts=False, alerts=[], non_alert_classification="unclear", non_alert_reasoning="é"),
     (False, [], "unclear", "é")),
    ("quiet bad class", answer(has_alerts=False, alerts=[], non_alert_classification="x"), None),
]


def test_typed_parse(spark):
    df = spark.createDataFrame([(n, t) for n, t, _ in CASES], "name string, response string")
    out = parsing.parse_typed(df, ALERTS_OUTPUT_SCHEMA)
    assert out.schema["parsed"].dataType.simpleString() == ALERTS_OUTPUT.simpleString()
    got = {r["name"]: r["parsed"] for r in out.collect()}
    for name, _, want in CASES:
        r = got[name]
        flat = None if r is None else (r[0], [tuple(a) for a in r[1]], r[2], r[3])
        assert flat == want, name


def test_parse_without_validation_keeps_what_fits(spark):
    df = spark.createDataFrame([('{"has_alerts": true}',), ("[1]",)], "response string")
    rows = [r["parsed"] for r in parsing.parse_typed(df, ALERTS_OUTPUT_SCHEMA, validate=False).collect()]
    assert rows[0]["has_alerts"] is True and rows[0]["alerts"] is None
    assert rows[1] is None


def test_untyped_parse(spark):
    df = spark.createDataFrame(
        [(1, '```\n{"a": [1, null]}\n```'), (2, "plain"), (3, None), (4, "7"), (5, "")], "id int, response string"
    )
    got = {r["id"]: (r["json"], r["raw"]) for r in parsing.parse_untyped(df).collect()}
    assert got == {1: ('{"a":[1,null]}', None), 2: (None, "plain"), 3: (None, None), 4: ("7", None), 5: (None, "")}
    with pytest.raises(Exception, match="not JSON"):
        parsing.parse_untyped(df, strict=True).collect()


SCHEMA = {
    "type": "object",
    "required": ["n"],
    "properties": {
        "n": {"type": "integer", "minimum": 1, "maximum": 9},
        "s": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"},
        "tags": {"type": "array", "items": {"enum": ["x", "y"]}, "minItems": 1, "maxItems": 2},
        "v": {"type": ["number", "null"]},
        "k": {"const": "fix"},
        "u": {"anyOf": [{"type": "string"}, {"type": "integer"}]},
    },
    "additionalProperties": False,
}
VALID = ['{"n":1}', '{"n":2.0}', '{"n":9,"s":"ab","tags":["x","y"],"v":null,"k":"fix","u":1}', '{"n":3,"u":"t","v":1.5}']
INVALID = [
    "{}", '{"n":0}', '{"n":10}', '{"n":1.5}', '{"n":"1"}', '{"n":true}', '{"n":null}', '{"n":1,"s":"a"}',
    '{"n":1,"s":"abcd"}', '{"n":1,"s":"bb"}', '{"n":1,"tags":[]}', '{"n":1,"tags":["z"]}', '{"n":1,"tags":["x","x","x"]}',
    '{"n":1,"v":"1"}', '{"n":1,"k":"other"}', '{"n":1,"u":[]}', '{"n":1,"more":1}', "[1]", "1", "nope",
]


def test_json_schema(spark):
    df = spark.createDataFrame([(t,) for t in VALID + INVALID], "response string")
    got = {r["response"]: r["valid"] for r in parsing.validate_schema(df, SCHEMA).collect()}
    assert got == {**{t: True for t in VALID}, **{t: False for t in INVALID}}
    with pytest.raises(Exception, match="schema violation"):
        parsing.validate_schema(df, SCHEMA, strict=True).collect()


def test_lenient_numbers(spark):
    schema = {"type": "object", "properties": {"i": {"type": "integer"}, "d": {"type": "number"}}}
    df = spark.createDataFrame([('{"i":"5","d":"1.5"}',), ('{"i":4,"d":2}',), ('{"i":"x"}',)], "response string")
    rows = [r["parsed"] and tuple(r["parsed"]) for r in parsing.parse_typed(df, schema).collect()]
    assert rows == [(5, 1.5), (4, 2.0), None]


def test_unsupported_schema_is_refused():
    with pytest.raises(ValueError, match="unsupported schema keywords"):
        compile_schema({"type": "object", "unevaluatedProperties": False})
    tree = {"$defs": {"t": {"type": "object", "properties": {"next": {"$ref": "#/$defs/t"}}}}}
    for word in ("not", "if", "contains"):
        with pytest.raises(ValueError, match="choice|inside"):
            compile_schema({**tree, "$ref": "#/$defs/t", "$defs": {"t": {"type": "object", "properties": {"next": {word: {"$ref": "#/$defs/t"}}}}}})
    assert schema_key({"b": 1, "a": 2}) == schema_key({"a": 2, "b": 1})
    assert schema_key(None) == "no_schema"


def test_extract_json(spark):
    texts = [
        '<s>[INST] a {b} [/INST] ok {"x": 1}</s>',
        'say {"x": {"y": 2}} bye',
        "[INST] q [/INST] nothing</s>",
        '"just a string"',
        "z" * 600,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, response string")
    got = {r["id"]: (r["json"], r["error"], r["raw_response"]) for r in parsing.extract_json(df).collect()}
    failed = "Failed to parse JSON"
    assert got[0] == ('{"x":1}', None, None)
    assert got[1] == ('{"x":{"y":2}}', None, None)
    assert got[2] == (None, failed, "nothing")
    assert got[3] == ('"just a string"', None, None)
    assert got[4] == (None, failed, "z" * 500)


def test_training_output_and_simplified(spark):
    df = spark.createDataFrame([(t,) for t in (answer(), answer(has_alerts=False, non_alert_classification="unclear"),
                                               answer(has_alerts=False))], "response string")
    parsed = parsing.parse_typed(df, ALERTS_OUTPUT_SCHEMA).select(parsing.training_output("parsed").alias("o"))
    rows = parsed.select("o", parsing.simplified_labels("o").alias("s")).collect()
    first = json.loads(rows[0]["o"])
    assert list(first) == ["has_alerts", "alerts", "non_alert_classification", "non_alert_reasoning"]
    assert list(first["alerts"][0]) == ["excerpt", "alert_type", "severity", "reasoning"]
    assert first["non_alert_reasoning"] is None
    assert [(list(r["s"][0]), list(r["s"][1])) for r in rows] == [(["fraud"], []), ([], ["unclear"]), ([], [])]


KEYWORDS = [
    ({"not": {"type": "string"}}, [1, None, []], ["a"]),
    ({"not": {"type": "null"}}, [1, "a"], [None]),
    ({"type": "array", "uniqueItems": True}, [[], [1, 2], [1, "1"], [{"a": 1}, {"a": 2}]], [[1, 1], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
    ({"multipleOf": 3}, [9, -6, 0, "x"], [10, 1.5]),
    ({"multipleOf": 0.5}, [1.5, 2], [1.25]),
    ({"type": "object", "minProperties": 1, "maxProperties": 2}, [{"a": 1}, {"a": 1, "b": 2}], [{}, {"a": 1, "b": 2, "c": 3}]),
    ({"type": "object", "patternProperties": {"^n_": {"type": "integer"}}}, [{}, {"n_a": 1, "x": "y"}], [{"n_a": "1"}]),
    ({"type": "object", "properties": {"a": {}}, "patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": False},
     [{"a": "x", "n_b": 1}], [{"b": 1}, {"n_b": []}]),
    ({"type": "object", "properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "boolean"}}, [{"a": "x", "b": True}], [{"b": 1}]),
    ({"type": "array", "prefixItems": [{"type": "string"}, {"type": "integer"}], "items": {"type": "boolean"}},
     [[], ["a"], ["a", 1], ["a", 1, True, False]], [[1], ["a", "b"], ["a", 1, 2]]),
    ({"if": {"type": "integer"}, "then": {"minimum": 5}, "else": {"type": "string"}}, [5, "a"], [4, True, None]),
    ({"type": "array", "contains": {"const": "x"}}, [["x"], [1, "x"]], [[], ["y"]]),
    ({"type": "object", "dependentRequired": {"a": ["b", "c"]}}, [{}, {"b": 1}, {"a": 1, "b": 1, "c": 1}], [{"a": 1}, {"a": 1, "b": 1}]),
    ({"type": "object", "required": ["a"]}, [{"a": None}], [{}]),
    ({"properties": {"never": False}, "type": "object"}, [{}], [{"never": 1}]),
]


@pytest.mark.parametrize("schema,good,bad", KEYWORDS)
def test_keywords(spark, schema, good, bad):
    values = [(json.dumps({"v": v}), True) for v in good] + [(json.dumps({"v": v}), False) for v in bad]
    df = spark.createDataFrame(values, "response string, want boolean")
    whole = {"type": "object", "properties": {"v": schema}, "required": ["v"]}
    for r in parsing.validate_schema(df, whole).collect():
        assert r.valid == r.want, r.response


def test_recursive_schema(spark):
    """Trees of two kinds of nodes that lead to each other, checked level by level."""
    schema = {
        "$ref": "#/$defs/folder",
        "$defs": {
            "folder": {
                "type": "object", "required": ["name"], "additionalProperties": False,
                "properties": {"name": {"type": "string", "minLength": 1}, "files": {"type": "array", "items": {"$ref": "#/$defs/file"}},
                               "sub": {"anyOf": [{"$ref": "#/$defs/folder"}, {"type": "null"}]}},
            },
            "file": {"type": "object", "properties": {"size": {"type": "integer", "minimum": 0}},
                     "patternProperties": {"^link": {"$ref": "#/$defs/folder"}}},
        },
    }

    def chain(n, last):
        return last if n == 0 else {"name": "d", "files": [{"size": 1}, {}], "sub": chain(n - 1, last)}

    values = [
        (chain(1, None), True), (chain(6, None), True), (chain(6, {"name": ""}), False), (chain(3, {"name": "a", "files": [{"size": -1}]}), False),
        (chain(2, {"name": "a", "files": [{"link1": chain(2, None)}, {"link2": {"name": "z"}}]}), True),
        (chain(2, {"name": "a", "files": [{"link1": chain(2, {"nam": 1})}]}), False), ([], False), ({"name": "x", "sub": 5}, False),
    ]
    rows = [(json.dumps(v), w) for v, w in values] + [("not json", False), (None, False)]
    df = spark.createDataFrame(rows, "response string, want boolean")
    got = parsing.validate_schema(df, schema).collect()
    assert len(got) == len(rows) and all(r.valid == r.want for r in got), [r for r in got if r.valid != r.want]
    typed = parsing.parse_typed(df, schema).where("parsed IS NOT NULL").select("parsed.name", "parsed.sub").collect()
    assert len(typed) == 3 and all(r.name == "d" for r in typed)
    with pytest.raises(Exception, match="schema violation"):
        parsing.validate_schema(df, schema, strict=True).collect()


def test_bare_fences_are_an_option(spark):
    texts = [f"```json\n{answer()}\n```", f"```\n{answer()}\n```", answer()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, response string")
    for bare, want in ((True, [True, True, True]), (False, [True, False, True])):
        rows = parsing.parse_typed(df, ALERTS_OUTPUT_SCHEMA, bare_fence=bare).orderBy("id").collect()
        assert [r.parsed is not None for r in rows] == want
        assert [r.json is not None for r in parsing.parse_untyped(df, bare_fence=bare).orderBy("id").collect()] == want


def test_literals_in_the_jvm_agree_with_python(spark):
    texts = [
        "[]", "[ ]", "['a']", '["a", "b c"]', "['it', \"it's\", '']", "['a',]", "[,]", "['a',,'b']", "['a' 'b']", "['a'], ['b']", "[['a']]", "'a'", " ['a']",
        "\n['a']", "['a'\n,\t'b' ]", "['a\\'b']", "['a\nb']", "[1, 'a']", "[None]", "hello", "hello, ['a']", "True", "Nonesense", "None", "b'x'", "br'x'", "f'x'", "x'y",
        "set()", "settled", "\ue000", "['\ue000']", "[\ue000]", "", " ", "['a']#c", "['a", "[]]", "é", "_x", "['é', 'x, y', '[1]']", None, "['a',  ]", "[  ,'a']", "['']",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, a string")
    got = {r.id: (r.plain, r.all) for r in df.select("id", parsing.plain_annotations("a").alias("plain"), parsing.parse_annotations("a").alias("all")).collect()}
    for i, t in enumerate(texts):
        want = parsing._literal_items(t)
        assert got[i][1] == want, t
        assert got[i][0] in (None, want), t
    assert {r.id: r.l for r in parsing.with_annotations(df, "a", "l").collect()} == {i: parsing._literal_items(t) for i, t in enumerate(texts)}
    settled = {texts[i] for i, (plain, _) in got.items() if plain is not None}
    assert {"[]", "['a']", '["a", "b c"]', "['a',]", "hello", "['é', 'x, y', '[1]']", None, "['']"} <= settled
    long = spark.createDataFrame([("[" + ", ".join(["'item'"] * 50_000) + "]",)], "a string")
    assert long.select(F.size(parsing.plain_annotations("a"))).first()[0] == 50_000


def test_annotations(spark):
    texts = ["['a > b', 'c']", "[]", "not a list [", None, "5", "('x', 'y')", "[None, 'z']"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, a string")
    got = {r[0]: r[1] for r in df.select("id", parsing.parse_annotations("a")).collect()}
    assert got == {0: ["a > b", "c"], 1: [], 2: ["not a list ["], 3: [], 4: ["5"], 5: ["x", "y"], 6: ["", "z"]}


def test_outputs(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, outputs array<string>")
    rows = sorted((r["id"], r["output_idx"], r["response"]) for r in parsing.explode_outputs(df).fillna(-1).collect())
    assert rows == [(1, 0, "a"), (1, 1, "b"), (2, -1, None), (3, -1, None)]
    assert [r[0] for r in df.orderBy("id").select(parsing.first_output("outputs")).collect()] == ["a", None, None]
