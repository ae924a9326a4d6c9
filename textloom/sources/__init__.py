"""Readers and writers."""

from textloom.sources.readers import (  # noqa: F401
    csv_column,
    inline_texts,
    load,
    read_jsonl,
    replicate,
    spread,
    text_column,
)
from textloom.sources.writers import write_csv, write_jsonl  # noqa: F401
