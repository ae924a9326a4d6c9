"""Prompt text from columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from textloom.functions.hashing import order_key
from textloom.functions.text import contains_any, or_empty
from textloom.schemas import ALERT_TYPES, EXAMPLE_TYPES, NON_ALERT_TYPES, SEVERITIES

CLASSIFY_HEAD = (
    "Read the workplace comment and answer with one JSON object.\n"
    f"Alert types: {', '.join(ALERT_TYPES)}.\n"
    f"Severities: {', '.join(SEVERITIES)}; mental_health_crisis is always critical.\n"
    f"Without an alert pick one of: {', '.join(NON_ALERT_TYPES)}.\n"
    "Keys: has_alerts, alerts[excerpt, reasoning, alert_type, severity], "
    "non_alert_classification, non_alert_reasoning.\n\nComment:\n"
)
SYSTEM_LINE = "Classify workplace comments. Answer in JSON."


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classification_prompt(text: Column | str) -> Column:
    return F.concat(F.lit(CLASSIFY_HEAD), _c(text))


def instruct(text: Column | str, system: str | None = None) -> Column:
    """Instruction wrap of one user turn, optionally after a system line."""
    body = _c(text) if system is None else F.concat(F.lit(f"{system}\n\nComment:\n"), _c(text))
    return F.concat(F.lit("<s>[INST] "), body, F.lit(" [/INST]"))


def training_text(text: Column | str, answer: Column | str) -> Column:
    return F.concat(instruct(text), _c(answer), F.lit("</s>"))


# Templates of a single user turn that ends where the model has to go on.
TEMPLATES = {
    "plain": lambda c: c,
    "instruct": instruct,
    "chatml": lambda c: F.concat(
        F.lit("<|im_start|>user\n"), c, F.lit("<|im_end|>\n<|im_start|>assistant\n")
    ),
}


def chat_format(
    df: DataFrame, prompt: str = "prompt", template: str | None = "chatml", formatted: str = "formatted"
) -> DataFrame:
    """Wrap prompts once. Rows whose ``formatted`` flag is set already stay as they are.

    An unknown or missing template leaves the prompt unchanged.
    """
    done = F.coalesce(F.col(formatted), F.lit(False)) if formatted in df.columns else F.lit(False)
    wrap = TEMPLATES.get(template or "plain", TEMPLATES["plain"])
    return df.withColumn(
        prompt, F.when(done, F.col(prompt)).otherwise(wrap(F.col(prompt)))
    ).withColumn(formatted, F.lit(True))


def rewrite_prompt(reference: Column | str, text: Column | str) -> Column:
    return F.concat(
        F.lit("Rewrite the comment in the style of the reference. Keep its meaning and length.\n"
              "Reference:\n"),
        _c(reference),
        F.lit("\nComment:\n"),
        _c(text),
        F.lit('\nAnswer in JSON: {"rewritten_comment": "..."}'),
    )


_OPENINGS = {
    "alert": "Write a workplace comment that shows: ",
    "non_alert": "Write an ordinary workplace comment of the kind: ",
    "hard_non_alert": "Write a comment that sounds alarming but is only: ",
    "hard_alert": "Write a comment in which this is real but easy to miss: ",
    "mixed": "Write a comment that mixes these alerts and an ordinary remark: ",
}


def generation_prompt(df: DataFrame, out: str = "prompt", few_shot: str | None = None) -> DataFrame:
    """Prompt per task, by ``example_type``; an unknown type fails the job.

    ``few_shot`` names an ``array<string>`` column with sample texts.
    """
    labels = F.concat_ws(
        "; ", F.array_join("alert_types", ", "), F.col("non_alert_type")
    )
    kind = F.col("example_type")
    opening = F.coalesce(*[F.when(kind == t, F.lit(_OPENINGS[t])) for t in EXAMPLE_TYPES])
    facts = [
        F.concat(F.lit(f"\n{name}: "), or_empty(name))
        for name in ("industry", "role", "tone", "writing_style", "demographic")
    ]
    # The plain types without an alert carry no difficulty line.
    level = F.when(kind.isin("non_alert", "hard_non_alert"), F.lit("")).otherwise(
        F.concat(F.lit("\ndifficulty: "), or_empty("difficulty"))
    )
    samples = F.lit("")
    if few_shot:
        listed = F.array_join(F.transform(few_shot, lambda t: F.concat(F.lit("- "), t)), "\n")
        samples = F.when(F.size(few_shot) > 0, F.concat(F.lit("\nSamples:\n"), listed)).otherwise("")
    prompt = F.concat(
        opening, labels, *facts, level, samples, F.lit('\nAnswer in JSON: {"text": "..."}')
    )
    unknown = F.raise_error(F.concat(F.lit("no prompt for example type "), or_empty(kind)))
    return df.withColumn(out, F.when(opening.isNotNull(), prompt).otherwise(unknown))


def few_shot_examples(
    examples: DataFrame, label: str, text: str, per_label: int = 2, key: str | None = None, seed: int = 42
) -> DataFrame:
    """Per label at most ``per_label`` samples: hash order, or the first ones by ``key``.

    Returns ``(label, samples)``. The window keeps only ``per_label`` rows of a label on
    every map task before the shuffle, so a huge label costs no more than a small one.
    """
    order = [F.col(key)] if key else [order_key(text, seed), F.col(text)]
    window = W.partitionBy(label).orderBy(*order)
    kept = examples.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= per_label)
    rows = F.array_sort(F.collect_list(F.struct("_rank", F.col(text).alias("t"))))
    return kept.groupBy(label).agg(F.transform(rows, lambda r: r["t"]).alias("samples"))


def attach_few_shot(
    tasks: DataFrame, shots: DataFrame, label: str, labels: str = "alert_types", limit: int = 5
) -> DataFrame:
    """Add ``few_shot``: samples of all labels of the task, in label order, cut to ``limit``.

    ``shots`` has one short row per label and is looked up as one map, so tasks are
    neither multiplied nor shuffled.
    """
    by_label = shots.select(F.map_from_entries(F.collect_list(F.struct(label, "samples")))).scalar()
    none = F.array().cast("array<string>")
    found = F.transform(labels, lambda name: F.coalesce(F.element_at(F.col("_shots"), name), none))
    rows = tasks.withColumn("_shots", by_label)
    return rows.withColumn("few_shot", F.slice(F.coalesce(F.flatten(found), none), 1, limit)).drop("_shots")


def subtle_examples(examples: DataFrame, text: str, key: str, words: Sequence[str], limit: int = 5) -> DataFrame:
    """First examples, by key, that hold one of the words that hint at a subtle case."""
    return examples.where(contains_any(text, words)).orderBy(key).limit(limit)


def column_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; refuses to make two columns of one name."""
    names = [mapping.get(c, c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"renaming gives duplicate columns: {twice}")
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
