"""Turn a JSON schema into Spark SQL expressions over a VARIANT.

``compile_schema(schema)`` gives a node with three things: the Spark type of the
value, a boolean check and a typed extraction. Both are SQL text, so a schema of
any size reaches Spark in one call and runs in the JVM.

References that lead back to themselves stay references: ``refers`` is then set, ``check`` covers a value down to its next
references, ``below`` lists the nodes that stand there, and ``definitions()`` has what they are to be checked against.

Two modes. ``lax=False`` is plain JSON-schema validation. ``lax=True`` also takes
the values a data model coerces: ``"yes"``/``1`` for a boolean, ``"5"`` for an
integer.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

# The strings a lenient boolean field accepts.
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]

_ANNOTATIONS = {
    "title", "description", "default", "examples", "$defs", "definitions", "$schema", "$id", "format",
}
_KEYWORDS = {
    "type", "properties", "required", "items", "enum", "const", "anyOf", "oneOf", "allOf", "$ref",
    "additionalProperties", "minLength", "maxLength", "pattern", "minimum", "maximum",
    "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "not", "uniqueItems", "patternProperties", "if", "then", "else",
    "prefixItems", "multipleOf", "minProperties", "maxProperties", "contains", "dependentRequired",
}


def schema_key(schema: dict | None) -> str:
    """Canonical text of a schema, used to tell schemas apart."""
    return "no_schema" if schema is None else json.dumps(schema, sort_keys=True)


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _get(v: str, kind: str, path: str = "$") -> str:
    return f"try_variant_get({v}, {quoted(path)}, '{kind}')"


def _member(v: str, name: str) -> str:
    key = name.replace("\\", "\\\\").replace("'", "\\'")
    return _get(v, "variant", f"$['{key}']")


def _kind(v: str) -> str:
    return f"schema_of_variant({v})"


def _is_null(v: str) -> str:
    return f"({v} IS NULL OR is_variant_null({v}))"


def _text(v: str) -> str:
    return _get(v, "string")


def _is_text(v: str) -> str:
    return f"{_kind(v)} = 'STRING'"


def _is_list(v: str) -> str:
    return f"startswith({_kind(v)}, 'ARRAY')"


def _is_object(v: str) -> str:
    return f"startswith({_kind(v)}, 'OBJECT')"


def _is_number(v: str) -> str:
    return f"({_kind(v)} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({_kind(v)}, 'DECIMAL'))"


def _is_word(v: str, words: list[str]) -> str:
    return f"lower({_text(v)}) IN ({', '.join(map(quoted, words))})"


_NOTHING = "CAST(array() AS array<struct<name: string, node: string>>)"


class Node:
    """A compiled schema position. ``v`` is the SQL text of a VARIANT expression."""

    def __init__(self, dtype: T.DataType, nullable: bool = False):
        self.dtype = dtype
        self.nullable = nullable
        self.rules: list[Callable[[str], str]] = []
        self.always: list[Callable[[str, bool], str]] = []  # rules that hold for null as well
        self.root: _Root | None = None

    @property
    def refers(self) -> bool:
        """Does the whole schema refer to itself?"""
        return self.root is not None and bool(self.root.nodes)

    def definitions(self) -> dict[str, Node]:
        return self.root.nodes

    def check(self, v: str, lax: bool = False) -> str:
        """Never null. A missing member is the parent's business."""
        tests = [self._check(v, lax), *[rule(v) for rule in self.rules]]
        ok = " AND ".join(f"coalesce({t}, false)" for t in tests)
        own = f"({_is_null(v)} OR ({ok}))" if self.nullable else f"(NOT {_is_null(v)} AND {ok})"
        return f"({' AND '.join([own, *[f'coalesce({rule(v, lax)}, false)' for rule in self.always]])})" if self.always else own

    def leads_on(self) -> bool:
        """Is there a reference anywhere in it?"""
        return any(part.leads_on() for part in self.parts())

    def parts(self) -> list[Node]:
        return []

    def below(self, v: str) -> str:
        """array<struct<name, node: JSON text>> of the nodes at the next references."""
        return f"CASE WHEN NOT {_is_null(v)} THEN {self._below(v)} ELSE {_NOTHING} END" if self.leads_on() else _NOTHING

    def _below(self, v: str) -> str:
        raise ValueError("a reference back to itself cannot stand inside a choice")

    def value(self, v: str, lax: bool = False) -> str:
        return f"CASE WHEN NOT {_is_null(v)} THEN {self._value(v, lax)} END"

    def _check(self, v: str, lax: bool) -> str:
        raise NotImplementedError

    def _value(self, v: str, lax: bool) -> str:
        return _get(v, self.dtype.simpleString())


class _Ref(Node):
    """A definition that is being compiled already: left to the next round."""

    def __init__(self, name: str):
        super().__init__(T.StringType(), nullable=True)
        self.name = name
        self.or_null = False

    def _check(self, v, lax):
        return "true"

    def _value(self, v, lax):
        return f"to_json({v})"

    def leads_on(self):
        return True

    def below(self, v):
        there = f"NOT {_is_null(v)}" if self.or_null else f"{v} IS NOT NULL"
        return f"CASE WHEN {there} THEN array(named_struct('name', {quoted(self.name)}, 'node', to_json({v}))) ELSE {_NOTHING} END"


class _Any(Node):
    def _check(self, v, lax):
        return "true"

    def _value(self, v, lax):
        return f"to_json({v})"


class _String(Node):
    def _check(self, v, lax):
        return _is_text(v)


class _Boolean(Node):
    def _check(self, v, lax):
        strict = f"{_kind(v)} = 'BOOLEAN'"
        if not lax:
            return strict
        word = f"{_is_text(v)} AND {_is_word(v, TRUE_WORDS + FALSE_WORDS)}"
        number = f"{_is_number(v)} AND {_get(v, 'double')} IN (0D, 1D)"
        return f"({strict} OR ({word}) OR ({number}))"

    def _value(self, v, lax):
        if not lax:
            return super()._value(v, lax)
        number = f"CASE WHEN {_is_number(v)} THEN {_get(v, 'double')} = 1D END"
        return f"coalesce({number}, {_is_word(v, TRUE_WORDS)})"


class _Integer(Node):
    def _check(self, v, lax):
        number = _get(v, "double")
        strict = f"({_is_number(v)} AND {number} = floor({number}))"
        if not lax:
            return strict
        pattern = quoted(r"^\s*[+-]?\d+\s*$")
        return f"({strict} OR ({_is_text(v)} AND regexp_like({_text(v)}, {pattern})))"

    def _value(self, v, lax):
        whole = _get(v, "bigint")
        return f"coalesce({whole}, try_cast(trim({_text(v)}) AS BIGINT))" if lax else whole


class _Number(Node):
    def _check(self, v, lax):
        if not lax:
            return _is_number(v)
        return f"({_is_number(v)} OR ({_is_text(v)} AND try_cast(trim({_text(v)}) AS DOUBLE) IS NOT NULL))"

    def _value(self, v, lax):
        number = _get(v, "double")
        return f"coalesce({number}, try_cast(trim({_text(v)}) AS DOUBLE))" if lax else number


class _Null(Node):
    def _check(self, v, lax):
        return _is_null(v)


class _Array(Node):
    """Items of one schema, after ``prefix`` items of their own."""

    def __init__(self, item: Node, variable: str, prefix: list[Node] = ()):
        super().__init__(T.ArrayType(item.dtype if not prefix else T.StringType()))
        self.item, self.variable, self.prefix = item, variable, list(prefix)

    def parts(self):
        return [self.item, *self.prefix]

    def _items(self, v):
        every = _get(v, "array<variant>")
        return f"slice({every}, {len(self.prefix) + 1}, greatest(size({every}) - {len(self.prefix)}, 0))" if self.prefix else every

    def _place(self, v, i):
        return _get(v, "variant", f"$[{i}]")

    def _check(self, v, lax):
        x = self.variable
        tests = [_is_list(v), f"forall({self._items(v)}, {x} -> {self.item.check(x, lax)})"]
        size = f"size({_get(v, 'array<variant>')})"
        tests += [f"({size} <= {i} OR {node.check(self._place(v, i), lax)})" for i, node in enumerate(self.prefix)]
        return " AND ".join(tests)

    def _value(self, v, lax):
        x = self.variable
        if self.prefix:  # items of different types: kept as JSON text
            return f"transform({_get(v, 'array<variant>')}, {x} -> to_json({x}))"
        return f"transform({_get(v, 'array<variant>')}, {x} -> {self.item.value(x, lax)})"

    def _below(self, v):
        x = self.variable
        found = [f"flatten(transform({self._items(v)}, {x} -> {self.item.below(x)}))"] if self.item.leads_on() else []
        found += [node.below(self._place(v, i)) for i, node in enumerate(self.prefix) if node.leads_on()]
        return f"CASE WHEN {_is_list(v)} THEN concat({', '.join(found)}) ELSE {_NOTHING} END"


class _Object(Node):
    """Members of their own schemas; ``others`` is the schema of all further members (None: none allowed), ``patterns`` of those whose name matches."""

    def __init__(self, members: dict[str, Node], required: set[str], others: Node | None, patterns: dict[str, Node], variable: str):
        fields = [T.StructField(name, node.dtype) for name, node in members.items()]
        super().__init__(T.StructType(fields) if members else T.StringType())
        self.members, self.required, self.others, self.patterns, self.variable = members, required, others, patterns, variable

    def parts(self):
        return [*self.members.values(), *self.patterns.values(), *([self.others] if self.others else [])]

    def _entries(self, v):
        return f"map_entries({_get(v, 'map<string,variant>')})"

    def _further(self, key):
        """Is a member none of the named or matching ones?"""
        known = f"{key} IN ({', '.join(map(quoted, self.members))})" if self.members else "false"
        return " AND ".join([f"NOT {known}", *[f"NOT regexp_like({key}, {quoted(p)})" for p in self.patterns]])

    def _check(self, v, lax):
        tests, e = [_is_object(v)], self.variable
        for name, node in self.members.items():
            member = _member(v, name)
            fine = node.check(member, lax)
            needed = name in self.required
            tests.append(f"({member} IS NOT NULL AND {fine})" if needed else f"({member} IS NULL OR {fine})")
        tests += [f"{_member(v, name)} IS NOT NULL" for name in sorted(self.required - set(self.members))]
        for pattern, node in self.patterns.items():
            tests.append(f"forall({self._entries(v)}, {e} -> NOT regexp_like({e}.key, {quoted(pattern)}) OR {node.check(f'{e}.value', lax)})")
        if self.others is None:
            tests.append(f"NOT exists({self._entries(v)}, {e} -> {self._further(f'{e}.key')})")
        elif type(self.others) is not _Any or self.others.rules:
            tests.append(f"forall({self._entries(v)}, {e} -> NOT ({self._further(f'{e}.key')}) OR {self.others.check(f'{e}.value', lax)})")
        return "(" + " AND ".join(tests) + ")"

    def _value(self, v, lax):
        if not self.members:
            return f"to_json({v})"
        parts = [f"{quoted(name)}, {node.value(_member(v, name), lax)}" for name, node in self.members.items()]
        return f"named_struct({', '.join(parts)})"

    def _below(self, v):
        e, found = self.variable, [node.below(_member(v, name)) for name, node in self.members.items() if node.leads_on()]
        for pattern, node in self.patterns.items():
            if node.leads_on():
                found.append(f"flatten(transform(filter({self._entries(v)}, {e} -> regexp_like({e}.key, {quoted(pattern)})), {e} -> {node.below(f'{e}.value')}))")
        if self.others is not None and self.others.leads_on():
            found.append(f"flatten(transform(filter({self._entries(v)}, {e} -> {self._further(f'{e}.key')}), {e} -> {self.others.below(f'{e}.value')}))")
        return f"CASE WHEN {_is_object(v)} THEN concat({', '.join(found)}) ELSE {_NOTHING} END"


class _Union(Node):
    """Any one of several alternatives; the value is kept as JSON text when their types differ."""

    def __init__(self, options: list[Node], exactly_one: bool):
        types = {o.dtype.simpleString(): o.dtype for o in options}
        super().__init__(next(iter(types.values())) if len(types) == 1 else T.StringType())
        self.options, self.exactly_one, self.same = options, exactly_one, len(types) == 1

    def parts(self):
        return self.options

    def _check(self, v, lax):
        hits = " + ".join(f"CAST({o.check(v, lax)} AS INT)" for o in self.options)
        return f"({hits}) {'=' if self.exactly_one else '>='} 1"

    def _value(self, v, lax):
        if not self.same:
            return f"to_json({v})"
        fits = [f"WHEN {o.check(v, lax)} THEN {o.value(v, lax)}" for o in self.options]
        return f"CASE {' '.join(fits)} END"


class _AllOf(Node):
    def __init__(self, options: list[Node]):
        super().__init__(options[0].dtype)
        self.options = options

    def parts(self):
        return self.options

    def _below(self, v):
        return f"concat({', '.join(o.below(v) for o in self.options)})"

    def _check(self, v, lax):
        return " AND ".join(o.check(v, lax) for o in self.options)

    def _value(self, v, lax):
        return self.options[0].value(v, lax)


def _resolve(root: dict, ref: str) -> dict:
    if not ref.startswith("#/"):
        raise ValueError(f"only local references are supported: {ref}")
    target: Any = root
    for part in ref[2:].split("/"):
        target = target[part]
    return target


def _constraints(schema: dict) -> list[Callable[[str], str]]:
    def rule(applies, test):
        # A keyword only constrains values of its own type.
        return lambda v: f"(NOT coalesce({applies(v)}, false) OR {test(v)})"

    def length(v):
        return f"length({_text(v)})"

    def number(v):
        return _get(v, "double")

    def count(v):
        return f"size({_get(v, 'array<variant>')})"

    def members(v):
        return f"size(map_keys({_get(v, 'map<string,variant>')}))"

    comparisons = {
        "minLength": (_is_text, length, ">="),
        "maxLength": (_is_text, length, "<="),
        "minimum": (_is_number, number, ">="),
        "maximum": (_is_number, number, "<="),
        "exclusiveMinimum": (_is_number, number, ">"),
        "exclusiveMaximum": (_is_number, number, "<"),
        "minItems": (_is_list, count, ">="),
        "maxItems": (_is_list, count, "<="),
        "minProperties": (_is_object, members, ">="),
        "maxProperties": (_is_object, members, "<="),
    }
    rules = []
    for word, (applies, measure, sign) in comparisons.items():
        if word in schema:
            bound = f"{float(schema[word])!r}D"
            rules.append(rule(applies, lambda v, m=measure, s=sign, b=bound: f"{m(v)} {s} {b}"))
    if "pattern" in schema:
        pattern = quoted(schema["pattern"])
        rules.append(rule(_is_text, lambda v: f"regexp_like({_text(v)}, {pattern})"))
    if "multipleOf" in schema:
        # Whole numbers divide exactly; otherwise the quotient has to be whole.
        step = schema["multipleOf"]
        whole = f"{_get('{v}', 'bigint')} % {step} = 0" if isinstance(step, int) else None

        def divides(v):
            quotient = f"{number(v)} / {float(step)!r}D"
            even = f"{quotient} = floor({quotient})"
            return f"CASE WHEN {_kind(v)} = 'BIGINT' THEN {whole.replace('{v}', v)} ELSE {even} END" if whole else f"({even})"

        rules.append(rule(_is_number, divides))
    if schema.get("uniqueItems"):
        rules.append(rule(_is_list, lambda v: f"size(array_distinct(transform({_get(v, 'array<variant>')}, u -> to_json(u)))) = {count(v)}"))
    for name, needed in schema.get("dependentRequired", {}).items():
        rules.append(rule(_is_object, lambda v, n=name, w=needed: f"({_member(v, n)} IS NULL OR ({' AND '.join(f'{_member(v, x)} IS NOT NULL' for x in w) or 'true'}))"))
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None:
        # Compare canonical JSON, so 1 and "1" stay apart.
        texts = [json.dumps(a, separators=(",", ":"), ensure_ascii=False) for a in allowed]
        rules.append(lambda v: f"to_json({v}) IN ({', '.join(map(quoted, texts))})")
    return rules


class _Root:
    """The whole schema while it is compiled: definitions that are open, and those that something refers back to."""

    def __init__(self, schema: dict):
        self.schema = schema
        self.open: list[str] = []
        self.nodes: dict[str, Node] = {}

    def referred(self, ref: str, depth: int) -> Node:
        if ref in self.open:
            self.nodes.setdefault(ref, None)
            return _Ref(ref)
        if ref in self.nodes:
            return _Ref(ref)
        self.open.append(ref)
        node = _node(self.schema if ref == "#" else _resolve(self.schema, ref), self, depth)
        self.open.pop()
        if ref in self.nodes:
            self.nodes[ref] = node
        return node


def _node(schema: dict | bool, root: _Root, depth: int = 0) -> Node:
    if schema is True or schema == {}:
        return _Any(T.StringType(), nullable=True)
    if schema is False:
        node = _Any(T.StringType(), nullable=True)
        node.always.append(lambda v, lax: "false")
        return node
    if not isinstance(schema, dict):
        raise ValueError(f"unsupported schema: {schema!r}")
    unknown = set(schema) - _KEYWORDS - _ANNOTATIONS
    if unknown:
        raise ValueError(f"unsupported schema keywords: {sorted(unknown)}")
    if "$ref" in schema:
        return root.referred(schema["$ref"], depth)
    node = _plain_node(schema, root, depth)
    for rule in _choices(schema, root, depth):
        node.always.append(rule)
    return node


def _choices(schema: dict, root: _Root, depth: int) -> list[Callable[[str, bool], str]]:
    """Keywords that hang on whether another schema fits."""

    def other(word: str) -> Node | None:
        if word not in schema:
            return None
        node = _node(schema[word], root, depth + 1)
        if node.leads_on():
            raise ValueError(f"a reference back to itself cannot stand inside {word!r}")
        return node

    rules: list[Callable[[str, bool], str]] = []
    no, cond, then, els, some = (other(w) for w in ("not", "if", "then", "else", "contains"))
    if no is not None:
        rules.append(lambda v, lax: f"NOT {no.check(v, lax)}")
    if cond is not None and then is not None:
        rules.append(lambda v, lax: f"(NOT {cond.check(v, lax)} OR {then.check(v, lax)})")
    if cond is not None and els is not None:
        rules.append(lambda v, lax: f"({cond.check(v, lax)} OR {els.check(v, lax)})")
    if some is not None:
        x = f"some{depth}"
        rules.append(lambda v, lax: f"(NOT coalesce({_is_list(v)}, false) OR exists({_get(v, 'array<variant>')}, {x} -> {some.check(x, lax)}))")
    return rules


def _plain_node(schema: dict, root: _Root, depth: int) -> Node:
    for word in ("anyOf", "oneOf"):
        if word in schema:
            options = [s for s in schema[word] if not (isinstance(s, dict) and s.get("type") == "null")]
            nullable = len(options) < len(schema[word])
            nodes = [_node(s, root, depth) for s in options]
            node = nodes[0] if len(nodes) == 1 else _Union(nodes, word == "oneOf")
            if isinstance(node, _Ref):
                node.or_null = nullable
            node.nullable = node.nullable or nullable
            node.rules += _constraints(schema)
            return node
    if "allOf" in schema:
        return _AllOf([_node(s, root, depth) for s in schema["allOf"]])

    kind = schema.get("type")
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        nodes = [_plain_node({**schema, "type": k}, root, depth) for k in rest]
        node = nodes[0] if len(nodes) == 1 else _Union(nodes, False)
        node.nullable = len(rest) < len(kind)
        return node
    if kind is None:
        kind = "object" if "properties" in schema else "string" if _all_text(schema) else "any"
    if kind == "object":
        members = {n: _node(s, root, depth) for n, s in schema.get("properties", {}).items()}
        patterns = {p: _node(s, root, depth + 1) for p, s in schema.get("patternProperties", {}).items()}
        extra = schema.get("additionalProperties", True)
        others = None if extra is False else _node(extra, root, depth + 1)
        if not members and not patterns and extra is True and not schema.get("required"):
            node = _Any(T.StringType())
            node.rules.append(_is_object)
        else:
            node = _Object(members, set(schema.get("required", [])), others, patterns, f"entry{depth}")
    elif kind == "array":
        prefix = [_node(s, root, depth + 1) for s in schema.get("prefixItems", [])]
        node = _Array(_node(schema.get("items", True), root, depth + 1), f"item{depth}", prefix)
    elif kind == "null":
        node = _Null(T.StringType(), nullable=True)
    else:
        simple = {
            "string": (_String, T.StringType()),
            "boolean": (_Boolean, T.BooleanType()),
            "integer": (_Integer, T.LongType()),
            "number": (_Number, T.DoubleType()),
            "any": (_Any, T.StringType()),
        }
        if kind not in simple:
            raise ValueError(f"unsupported type: {kind}")
        maker, dtype = simple[kind]
        node = maker(dtype, nullable=kind == "any")
    node.rules += _constraints(schema)
    return node


def _all_text(schema: dict) -> bool:
    values = schema.get("enum", [schema["const"]] if "const" in schema else [])
    return bool(values) and all(isinstance(x, str) for x in values)


def compile_schema(schema: dict) -> Node:
    root = _Root(schema)
    node = root.referred("#", 0)
    node.root = root
    return node
