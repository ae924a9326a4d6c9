"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CARRIAGE_RETURN_MARK = "_x000D_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_array(values: Sequence, element: str = "string") -> Column:
    """A constant array from one call; the optimizer folds it into a literal."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), f"array<{element}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    A repeated column expression may be evaluated again at each use, above all
    inside lambdas and after the optimizer merges projections.
    """
    return F.transform(F.array(value), body)[0]


def with_computed(df: DataFrame, name: str, value: Column, body: Callable[[Column], Column]) -> DataFrame:
    """Add ``body(value)`` as a column that later filters and projections read but never recompute.

    The generator stops the optimizer from copying a costly expression into every
    place that uses it; the outer form adds no inferred filter of its own.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.explode_outer(F.transform(F.array(value), body)).alias(name))


def strip_ws(c: Column | str) -> Column:
    """Strip Unicode white space from both ends (``trim`` alone strips spaces only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """True for null, white-space-only and ``nan`` texts."""
    stripped = strip_ws(c)
    return F.coalesce((stripped == "") | (F.lower(stripped) == "nan"), F.lit(True))


def length_between(c: Column | str, low: int = 50, high: int = 1000) -> Column:
    """Length in code points, both ends included; null counts as outside."""
    return F.coalesce(F.length(_col(c)).between(low, high), F.lit(False))


def clean_control(c: Column | str) -> Column:
    """Drop the control characters spreadsheets refuse; the escaped CR mark becomes a space."""
    return F.replace(
        F.regexp_replace(_col(c), CONTROL_CHARS, ""), F.lit(CARRIAGE_RETURN_MARK), F.lit(" ")
    )


def truncate(c: Column | str, n: int) -> Column:
    """First ``n`` code points; null stays null."""
    return F.substring(_col(c), 1, n)


def or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """Case-insensitive: true when any of the words occurs in the text."""
    pattern = "|".join(re.escape(word.lower()) for word in words)
    return F.coalesce(F.lower(_col(c)).rlike(pattern), F.lit(False))


def strip_fences(c: Column | str, bare: bool = True) -> Column:
    """Remove a leading ```json or ``` line and a trailing ```; inner backticks stay. ``bare=False`` leaves texts alone whose fence does not say json."""
    body = strip_ws(c)
    if bare:
        return strip_ws(F.regexp_replace(body, r"^```(?:json)?\s*|\s*```$", ""))
    return let(body, lambda t: F.when(t.startswith("```json"), strip_ws(F.regexp_replace(t, r"^```json\s*|\s*```$", ""))).otherwise(t))


def strip_quotes(c: Column | str) -> Column:
    """Strip white space, then double quotes, then single quotes, from both ends."""
    return F.btrim(F.btrim(strip_ws(c), F.lit('"')), F.lit("'"))


def normalize_path(c: Column | str) -> Column:
    """``B > a`` becomes ``a|b``: lower-cased elements, trimmed, sorted, joined by ``|``."""
    path = F.lower(or_empty(c))
    parts = F.transform(F.split(path, ">"), strip_ws)
    return F.when(path == "", F.lit("")).otherwise(F.array_join(F.array_sort(parts), "|"))
