"""Parse and validate model responses with built-in JSON functions."""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions.jsonschema import Node, compile_schema, quoted
from textloom.functions.text import let, or_empty, strip_fences, strip_ws, truncate, with_computed
from textloom.schemas import ALERTS_OUTPUT
from textloom.session import materialize, prepare


def first_output(outputs: Column | str) -> Column:
    """Text of the first completion; null when there is none."""
    return F.try_element_at(F.col(outputs) if isinstance(outputs, str) else outputs, F.lit(1))


def explode_outputs(df: DataFrame, outputs: str = "outputs", text: str = "response") -> DataFrame:
    """One row per completion, keyed by ``(row key, output_idx)``. Rows without any are kept."""
    rest = [F.col(c) for c in df.columns if c != outputs]
    return df.select(*rest, F.posexplode_outer(outputs).alias("output_idx", text))


def strict_json(text: Column) -> Column:
    """Whole text to VARIANT; null unless the text is exactly one JSON value.

    The JSON reader stops after the first value, so ``{"a":1} tail`` would pass.
    Inside ``{"r":…}`` only a tail that starts with ``}`` or ``,`` can slip by,
    and inside ``[…]`` only one that starts with ``]`` or ``,``; a comma makes two
    array items. Passing both wrappers with one item means no tail at all.
    """

    def checked(t: Column) -> Column:
        in_object = F.try_parse_json(F.concat(F.lit('{"r":'), t, F.lit("}")))
        in_array = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        alone = F.size(F.try_variant_get(in_array, "$", "array<variant>")) == 1
        return F.when(alone, F.try_variant_get(in_object, "$.r", "variant"))

    return let(text, checked)


def parse_typed(
    df: DataFrame,
    schema: dict,
    text: str = "response",
    out: str = "parsed",
    validate: bool = True,
    bare_fence: bool = True,
) -> DataFrame:
    """Parse to the schema's struct; null when the text is not JSON or breaks the schema.

    ``bare_fence=False`` takes off only fences that say ``json``, so an answer behind three bare backticks fails.
    """
    node = compile_schema(schema)
    fits = node.check("tree", lax=True) if validate else "startswith(schema_of_variant(tree), 'OBJECT')"
    if node.refers:
        if not validate:
            raise ValueError("a recursive schema has no type of its own; parse it with validate=True")
        valid = validate_schema(df, schema, text, "_fits", lax=True, bare_fence=bare_fence)
        parsed = _with_tree(valid, text, out, f"CASE WHEN _fits THEN {node.value('tree', lax=True)} END", bare_fence)
        return parsed.drop("_fits")
    return _with_tree(df, text, out, f"CASE WHEN {fits} THEN {node.value('tree', lax=True)} END", bare_fence)


def _with_tree(df: DataFrame, text: str, out: str, body: str, bare_fence: bool = True) -> DataFrame:
    """Add a SQL expression over ``tree``, the parsed text, computed once per row."""
    prepare(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]
    parsed = df.select("*", F.array(strict_json(strip_fences(text, bare_fence))).alias("_trees"))
    # A generator keeps the optimizer from copying the parse; see with_computed.
    return parsed.select(*rest, F.expr(f"explode_outer(transform(_trees, tree -> {body}))").alias(out))


def parse_untyped(df: DataFrame, text: str = "response", strict: bool = False, bare_fence: bool = True) -> DataFrame:
    """Adds ``json`` (canonical text of the value) and ``raw`` (the cleaned text when not JSON).

    ``strict=True`` fails the job on the first bad text instead.
    """
    prepare(df.sparkSession)

    def both(cleaned: Column) -> Column:
        value = F.to_json(strict_json(cleaned))
        return F.struct(value.alias("json"), cleaned.alias("text"))

    parts = F.col("_parts")
    bad = parts["json"].isNull()
    raw = F.when(bad, parts["text"])
    if strict:
        message = F.concat(F.lit("not JSON: "), truncate(parts["text"], 200))
        raw = F.when(bad & parts["text"].isNotNull(), F.raise_error(message).cast("string"))
    return (
        with_computed(df, "_parts", strip_fences(text, bare_fence), both)
        .withColumn("json", parts["json"])
        .withColumn("raw", raw)
        .drop("_parts")
    )


def validate_schema(
    df: DataFrame, schema: dict, text: str = "response", out: str = "valid", strict: bool = False, lax: bool = False, bare_fence: bool = True
) -> DataFrame:
    """Boolean per row: an object that satisfies the JSON schema. Anything else is False.

    Schemas that refer to themselves are checked level by level, see :func:`_validate_levels`.
    """
    node = compile_schema(schema)
    is_object = "coalesce(startswith(schema_of_variant(tree), 'OBJECT'), false)"
    if node.refers:
        checked = _validate_levels(df, node, text, out, lax, bare_fence)
    else:
        checked = _with_tree(df, text, out, f"{is_object} AND {node.check('tree', lax)}", bare_fence)
    if strict:
        message = F.concat(F.lit("schema violation: "), truncate(or_empty(text), 200))
        failed = F.raise_error(message).cast("boolean")
        checked = checked.withColumn(out, F.when(F.col(out), F.lit(True)).otherwise(failed))
    return checked


def _validate_levels(df: DataFrame, node: Node, text: str, out: str, lax: bool, bare_fence: bool) -> DataFrame:
    """A value against a recursive schema: each round checks the nodes of one level and takes those below them apart.

    A node is checked against its own definition once, with everything below the next reference left to the next
    round. There are as many rounds as references nest in the data, and nodes of one large value spread over the tasks.
    """
    prepare(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]
    rows = materialize(df.select(*rest, F.monotonically_increasing_id().alias("_row")), "validate")
    is_object = "coalesce(startswith(schema_of_variant(tree), 'OBJECT'), false)"
    start = F.expr(f"transform(_trees, tree -> named_struct('ok', {is_object} AND {node.check('tree', lax)}, 'below', {node.below('tree')}))")
    level = rows.select("_row", F.array(strict_json(strip_fences(text, bare_fence))).alias("_trees")).select("_row", F.explode(start).alias("s"))
    failed: list[DataFrame] = []
    known = node.definitions().items()
    ok = " ".join(f"WHEN {quoted(name)} THEN {d.check('x.node', lax)}" for name, d in known)
    below = " ".join(f"WHEN {quoted(name)} THEN {d.below('x.node')}" for name, d in known)
    step = F.expr(f"transform(array(struct(name, node)), x -> named_struct('ok', CASE x.name {ok} END, 'below', CASE x.name {below} END))[0]")
    while True:
        level = materialize(level.select("_row", "s.ok", "s.below"), "level")
        failed.append(level.where(~F.coalesce("ok", F.lit(False))).select("_row"))
        under = level.where("ok").select("_row", F.posexplode("below").alias("_at", "n"))
        if under.isEmpty():
            break
        nodes = under.select("_row", "_at", "n.name", F.parse_json("n.node").alias("node")).repartition("_row", "_at")
        level = nodes.select("_row", step.alias("s"))
    bad = reduce(DataFrame.unionByName, failed).distinct().withColumn("_bad", F.lit(True))
    return rows.join(bad, "_row", "left").select(*rest, F.col("_bad").isNull().alias(out))


def extract_json(df: DataFrame, text: str = "response") -> DataFrame:
    """Find the object inside chatter.

    Takes what follows the last ``[/INST]`` without ``</s>``, then the widest
    ``{…}``; adds ``json``, and on failure ``error`` with ``raw_response``.
    """
    prepare(df.sparkSession)
    source = F.col(text)
    marked = source.contains("[/INST]")
    after = F.replace(F.element_at(F.split(source, r"\[/INST\]"), -1), F.lit("</s>"), F.lit(""))
    body = F.when(marked, strip_ws(after)).otherwise(source)

    def search(cleaned: Column) -> Column:
        found = F.nullif(F.regexp_extract(cleaned, r"(?s)\{.*\}", 0), F.lit(""))
        value = F.coalesce(strict_json(found), strict_json(strip_ws(cleaned)))
        return F.struct(F.to_json(value).alias("json"), truncate(cleaned, 500).alias("head"))

    parts, failed = F.col("_parts"), F.col("_parts.json").isNull()
    return (
        with_computed(df, "_parts", body, search)
        .withColumn("json", parts["json"])
        .withColumn("error", F.when(failed, F.lit("Failed to parse JSON")))
        .withColumn("raw_response", F.when(failed, parts["head"]))
        .drop("_parts")
    )


def training_output(parsed: Column | str) -> Column:
    """Parsed response in training key order, as JSON text that keeps nulls."""
    r = F.col(parsed) if isinstance(parsed, str) else parsed
    alerts = F.transform(
        r["alerts"],
        lambda a: F.struct(
            a["excerpt"].alias("excerpt"),
            a["alert_type"].alias("alert_type"),
            a["severity"].alias("severity"),
            a["reasoning"].alias("reasoning"),
        ),
    )
    record = F.struct(
        r["has_alerts"].alias("has_alerts"),
        alerts.alias("alerts"),
        r["non_alert_classification"].alias("non_alert_classification"),
        r["non_alert_reasoning"].alias("non_alert_reasoning"),
    )
    return F.when(r.isNotNull(), F.to_json(record, {"ignoreNullFields": "false"}))


def simplified_labels(output: Column | str) -> Column:
    """Full training output (JSON text) to ``{alert_types[], non_alert_types[]}``."""
    r = F.from_json(output, ALERTS_OUTPUT)
    empty = F.array().cast("array<string>")
    types = F.coalesce(F.transform(r["alerts"], lambda a: a["alert_type"]), empty)
    named = F.coalesce(r["non_alert_classification"], F.lit("")) != ""
    has_alerts = F.coalesce(r["has_alerts"], F.lit(False))
    others = F.when(~has_alerts & named, F.array(r["non_alert_classification"])).otherwise(empty)
    return F.struct(
        F.when(has_alerts, types).otherwise(empty).alias("alert_types"),
        others.alias("non_alert_types"),
    )


def _literal_items(text: str | None) -> list[str]:
    if text is None:
        return []
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        value = [text]
    items = list(value) if isinstance(value, (list, tuple, set)) else [value]
    return [str(x) if x else "" for x in items]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _python_literals(texts: pd.Series) -> pd.Series:
    return texts.map(_literal_items)


_ITEM = r"""'[^'\\\x00\r\n\x{E000}]*'|"[^"\\\x00\r\n\x{E000}]*\""""
_MARK = "\ue000"  # stands for a quoted item; texts that hold it themselves are left to Python
# Words that Python may read as a value, and the prefixes of its strings.
_VALUE = r"""^[ \t]*(?:True|False|None|set|[A-Za-z]{1,2}['"])"""


def plain_annotations(text: Column | str) -> Column:
    """Elements of a printed list of quoted texts, without Python; null where the text needs a real reader.

    The list is folded in two steps: every quoted item becomes a mark, then ``mark,`` vanishes.
    What is left of a plain list is ``[]`` or ``[mark]``. Text that begins like a word is no literal and becomes one element; null has none.
    """
    text = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")

    def read(t: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(t, _ITEM, _MARK), r"[ \t\r\n]", "")
        core = F.replace(marked, F.lit(_MARK + ","), F.lit(""))
        items = F.transform(F.regexp_extract_all(t, F.lit(_ITEM), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
        # Only a trailing comma may stand alone after its item, so an empty core means a comma too few or none.
        is_list = core.isin("[]", f"[{_MARK}]") & t.rlike(r"^[ \t]*\[") & ~t.contains(_MARK)
        is_word = t.rlike(r"^[ \t]*[A-Za-z_]") & ~t.rlike(_VALUE)
        return F.when(t.isNull(), none).when(is_word, F.array(t)).when(is_list, items)

    return let(text, read)


def parse_annotations(text: Column | str) -> Column:
    """Printed list literal to its elements as text; other text becomes a one-element list. Python gets only the texts that need it."""
    text = F.col(text) if isinstance(text, str) else text
    plain = plain_annotations(text)
    return F.coalesce(plain, _python_literals(F.when(plain.isNull(), text)))


def with_annotations(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the elements of printed lists. Rows with plain lists never pass a Python stage."""
    read = df.withColumn(out, plain_annotations(text))
    rest = df.where(plain_annotations(text).isNull()).withColumn(out, _python_literals(text))
    return read.where(F.col(out).isNotNull()).unionByName(rest)
