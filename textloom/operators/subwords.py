"""Subword tokens from the vocabulary file of a public tokenizer.

Files are loaded once per Python worker; the path has to exist on every executor. Three formats by suffix: ``.json`` (a
tokenizer description), ``.tiktoken`` (ranks of byte sequences) and ``.model`` (sentence pieces). Nothing is trained here.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from textloom.operators.tokens import small_batches

# Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _loaded(path: str, pattern: str):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True  # their strings in a text are ordinary text
        return found
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    raise ValueError(f"no tokenizer file: {path!r}")


@dataclass(frozen=True)
class Subwords:
    """A tokenizer by its file; call it with texts for their ids. It travels to the executors as its path."""

    path: str
    pattern: str = SPLIT

    def __call__(self, texts: list[str]) -> list[list[int]]:
        found = _loaded(self.path, self.pattern)
        if self.path.endswith(".json"):
            return [e.ids for e in found.encode_batch(texts, add_special_tokens=False)]
        if self.path.endswith(".model"):
            return found.encode(texts, num_threads=1)
        return [found.encode_ordinary(t) for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        found = _loaded(self.path, self.pattern)
        if self.path.endswith(".json"):
            return found.decode_batch(ids, skip_special_tokens=False)
        if self.path.endswith(".model"):
            return found.decode(ids)
        return [found.decode(i) for i in ids]


def detokenize(df: DataFrame, tokenizer: Subwords, ids: str = "input_ids", out: str = "text") -> DataFrame:
    """Add the text of an id column; null ids give a null text."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in small_batches(batches, ids):
            values = rows.column(ids).to_pylist()
            texts = iter(tokenizer.decode([v for v in values if v is not None]))
            column = pa.array([None if v is None else next(texts) for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in kept], column], names=schema.names)

    return df.mapInArrow(run, schema)
