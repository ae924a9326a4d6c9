"""Batch inference as a narrow Spark stage.

A backend is loaded once per Python worker and called with small batches. Rows
keep their key, so order needs no queue: sort by the key if it matters. A batch
that fails is retried a bounded number of times and then row by row; a row that
still fails carries its error instead of stopping the job.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder
from pyspark.resource import TaskResourceRequests
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions.jsonschema import quoted, schema_key
from textloom.functions.text import let
from textloom.operators.prompts import chat_format
from textloom.operators.tokens import small_batches
from textloom.schemas import ALERT_TYPES, SEVERITIES


@dataclass(frozen=True)
class SamplingOptions:
    """Decoding options. The two default sets."""

    temperature: float = 0.95
    top_k: int = 50
    top_p: float = 0.95
    max_tokens: int = 4098
    frequency_penalty: float = 2.0
    repetition_penalty: float = 1.1

    def merged(self, override: Mapping[str, float] | None = None) -> dict:
        """Defaults with the caller's values on top."""
        return {**asdict(self), **(override or {})}


UNGUIDED = SamplingOptions()
GUIDED = SamplingOptions(0.1, 50, 0.95, 1000, 0.0, 1.0)


def merge_options(defaults: Column, override: Column) -> Column:
    """The same merge for ``map<string,double>`` columns, one set of options per row."""
    kept = F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(override), k))
    return F.map_concat(kept, override)


class Backend(Protocol):
    """What an inference engine has to offer. Instances travel to the executors by pickle."""

    name: str

    def load(self) -> None:
        """Called once per Python worker; an error here fails the task."""

    def generate(
        self, prompts: Sequence[str], schema: dict | None, options: Mapping[str, float]
    ) -> Sequence[Sequence[str]]:
        """One list of completions per prompt, in order."""


@dataclass(frozen=True)
class Rule:
    """Offline labelling rule: the phrase in a comment means this label."""

    label: str
    severity: str
    phrase: str


def default_rules() -> list[Rule]:
    """The label's own words are its trigger phrase."""
    return [
        Rule(label, "critical" if label == "mental_health_crisis" else "moderate", label.replace("_", " "))
        for label in ALERT_TYPES
    ]


@dataclass(frozen=True)
class RuleBackend:
    """Labels comments by the phrases in them: all details, labels only, one flag, or plain words without a schema."""

    rules: tuple[Rule, ...] = field(default_factory=lambda: tuple(default_rules()))
    marker: str = "Comment:\n"
    name: str = "rules"

    def load(self) -> None:
        for rule in self.rules:
            if rule.severity not in SEVERITIES:
                raise ValueError(f"unknown severity: {rule.severity}")

    def generate(self, prompts, schema, options):
        return [[self._answer(p, schema)] for p in prompts]

    def _answer(self, prompt: str, schema: dict | None) -> str:
        comment = prompt.rsplit(self.marker, 1)[-1]
        fields = (schema or {}).get("properties", {})
        found = [r.label for r in self.rules if r.phrase in comment.lower()]
        if schema is None:
            return ", ".join(found) or "no alert"
        if "has_alerts" in fields:
            lowered = comment.lower()
            alerts = [
                {
                    "excerpt": comment[(at := lowered.find(r.phrase)) : at + len(r.phrase)],
                    "reasoning": f"matched {r.phrase}",
                    "alert_type": r.label,
                    "severity": r.severity,
                }
                for r in self.rules
                if r.phrase in lowered
            ]
            answer = {
                "has_alerts": bool(alerts),
                "alerts": alerts,
                "non_alert_classification": None if alerts else "neutral_comment",
                "non_alert_reasoning": None if alerts else "no phrase matched",
            }
        elif "labels" in fields:
            answer = {"labels": found}
        elif "flagged" in fields:
            answer = {"flagged": bool(found)}
        else:
            raise ValueError(f"the rules cannot answer {sorted(fields)}")
        return json.dumps(answer, ensure_ascii=False)


def rule_response(
    text: str,
    rules: Sequence[Rule],
    has_alerts: Column | None = None,
    non_alert: Column | None = None,
) -> Column:
    """The rule backend as a Spark expression: no Python workers at all.

    ``has_alerts`` overrides the verdict, e.g. with a human label, and
    ``non_alert`` the class of comments without alerts.
    """
    spans = ", ".join(
        f"CASE WHEN contains(t, {quoted(r.phrase)}) THEN named_struct('excerpt', {quoted(r.phrase)}, "
        f"'reasoning', {quoted('matched ' + r.phrase)}, 'alert_type', {quoted(r.label)}, "
        f"'severity', {quoted(r.severity)}) END"
        for r in rules
    )
    alerts = F.expr(f"transform(array(lower(`{text}`)), t -> array_compact(array({spans})))[0]")

    def record(found: Column) -> Column:
        verdict = F.size(found) > 0 if has_alerts is None else has_alerts
        other = F.lit("neutral_comment") if non_alert is None else non_alert
        return F.struct(
            verdict.alias("has_alerts"),
            found.alias("alerts"),
            F.when(~verdict, other).alias("non_alert_classification"),
            F.when(~verdict, F.lit("no phrase matched")).alias("non_alert_reasoning"),
        )

    return F.to_json(let(alerts, record), {"ignoreNullFields": "false"})


# Backends by name; register your own model server client or local model here.
_BACKENDS: dict[str, Callable[[], Backend]] = {"rules": RuleBackend}


def register_backend(name: str, maker: Callable[[], Backend]) -> None:
    _BACKENDS[name] = maker


def backend(name: str) -> Backend:
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {sorted(_BACKENDS)}")
    return _BACKENDS[name]()


def gpu_profile(copies_per_gpu: int = 1, gpus_per_copy: int = 1) -> ResourceProfile:
    """Resources of an inference stage.

    Several model copies on one GPU, or one copy spread over several GPUs.
    """
    if copies_per_gpu > 1 and gpus_per_copy > 1:
        raise ValueError("choose either several copies per GPU or several GPUs per copy")
    amount = gpus_per_copy if gpus_per_copy > 1 else 1.0 / copies_per_gpu
    executor = ExecutorResourceRequests().resource("gpu", gpus_per_copy)
    task = TaskResourceRequests().resource("gpu", amount)
    return ResourceProfileBuilder().require(executor).require(task).build


_loaded: dict[str, Backend] = {}


def _ready(engine: Backend, key: str) -> Backend:
    """One loaded instance per worker process, shared by all its tasks."""
    if key not in _loaded:
        engine.load()
        _loaded[key] = engine
    return _loaded[key]


def _call(
    engine: Backend, prompts: list[str], schema: dict | None, options: dict, retries: int, pause: float
) -> tuple[list[list[str] | None], list[str | None]]:
    """Completions and errors, aligned with the prompts."""
    error = "no answer"
    for _ in range(retries + 1):
        try:
            answers = engine.generate(prompts, schema, options)
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
            return [list(a) for a in answers], [None] * len(prompts)
        except Exception as err:  # noqa: BLE001 - any backend error becomes data
            error = f"{type(err).__name__}: {err}"
        finally:
            if pause:
                time.sleep(pause)
    if len(prompts) == 1:
        return [None], [error]
    # One bad prompt must not take its batch with it.
    parts = [_call(engine, [p], schema, options, 0, pause) for p in prompts]
    return [p[0][0] for p in parts], [p[1][0] for p in parts]


def infer(
    df: DataFrame,
    engine: Backend | str,
    prompt: str = "prompt",
    schema: dict | None = None,
    schema_column: str | None = None,
    options: Mapping[str, float] | None = None,
    batch_size: int = 25,
    retries: int = 2,
    pause: float = 0.0,
    template: str | None = None,
    formatted: bool = False,
    on_batch: Callable[[list, list, list], None] | None = None,
    row_id: str | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add ``outputs array<string>`` and ``error string`` to every row.

    ``schema`` is one JSON schema for all rows; ``schema_column`` holds a schema
    (JSON text, null for none) per row. Rows of one schema are batched together
    inside each task, without a shuffle, so a schema most rows share cannot
    overload a task. ``batch_size=1`` sends prompts one by one.
    ``on_batch(keys, prompts, outputs)`` is called on the executor after each
    batch; the keys come from the ``row_id`` column.
    """
    engine = backend(engine) if isinstance(engine, str) else engine
    if template and not formatted:
        df = chat_format(df, prompt, template)
    engine_key = hashlib.md5(cloudpickle.dumps(engine)).hexdigest()
    guided = schema is not None or schema_column is not None
    settings = (GUIDED if guided else UNGUIDED).merged(options)
    kept = [c for c in df.columns if c not in ("outputs", "error")]
    df = df.select(*kept)
    added = [T.StructField("outputs", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
    out = T.StructType(df.schema.fields + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _ready(engine, engine_key)
        # Canonical name by schema text: parsed once per distinct text of a task.
        named: dict[str | None, str | None] = {None: schema_key(None) if schema_column else None}
        for rows in small_batches(batches, prompt):
            prompts = rows.column(prompt).to_pylist()
            keys = rows.column(row_id).to_pylist() if row_id else list(range(len(prompts)))
            texts = rows.column(schema_column).to_pylist() if schema_column else [None] * len(prompts)
            groups: dict[str | None, list[int]] = {}
            for at, text in enumerate(texts):
                if text not in named:
                    named[text] = schema_key(json.loads(text))
                groups.setdefault(named[text], []).append(at)
            outputs: list = [None] * len(prompts)
            errors: list = [None] * len(prompts)
            for positions in groups.values():
                first = texts[positions[0]]
                used = schema if not schema_column else None if first is None else json.loads(first)
                for start in range(0, len(positions), batch_size):
                    part = positions[start : start + batch_size]
                    asked = [prompts[i] for i in part]
                    answers, failures = _call(ready, asked, used, settings, retries, pause)
                    for i, answer, failure in zip(part, answers, failures):
                        outputs[i], errors[i] = answer, failure
                    if on_batch is not None:
                        on_batch([keys[i] for i in part], asked, answers)
            columns = list(rows.columns) + [
                pa.array(outputs, pa.list_(pa.string())),
                pa.array(errors, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return df.mapInArrow(run, out, profile=profile)


def canonical_schema(schema_column: Column | str) -> Column:
    """Grouping key of a schema column: keys sorted, ``no_schema`` for null.

    A parsed VARIANT stores object keys in sorted order, so its text is canonical.
    """
    c = F.col(schema_column) if isinstance(schema_column, str) else schema_column
    return F.when(c.isNull(), F.lit("no_schema")).otherwise(F.to_json(F.parse_json(c)))
