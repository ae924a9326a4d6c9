"""Pick a reference text of similar length for every input.

References are numbered in ``(length, hash)`` order, so "length between lo and hi"
is a range of positions known from the length histogram. A hashed permutation of
that range says which position to try, and the text is fetched by an equi-join on
the position. No input ever meets all its candidates.

Whether a candidate is too similar is mostly settled by letter counts in the JVM: what two texts have in
common letter by letter bounds their ratio from above. Only pairs above the threshold by that bound are compared exactly in Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from textloom.functions.hashing import hash_int, order_key
from textloom.functions.text import let, strip_ws
from textloom.session import materialize

STRIDES = (2654435761, 2147483647)  # primes: a stride that does not divide n permutes 0..n-1


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of the lower-cased texts."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return SequenceMatcher(None, x.lower(), y.lower()).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


# Characters counted one by one; all others are counted together.
COUNTED = "etaoinsrhldcumfpgbvwé .,"


def letter_counts(text: Column | str) -> Column:
    """How many of each counted character the lower-cased text has; the rest comes last."""

    def counted(t: Column) -> Column:
        size = F.length(t)
        each = F.array(*[size - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in COUNTED])
        return let(each, lambda a: F.concat(a, F.array(size - F.aggregate(a, F.lit(0), lambda s, x: s + x))))

    return let(F.lower(text), counted)


def ratio_bound(a: Column | str, b: Column | str) -> Column:
    """Upper bound of the matching-block ratio from two :func:`letter_counts`; 1 for two empty texts."""

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0), lambda s, x: s + x)

    def bound(x: Column, y: Column) -> Column:
        common = total(F.zip_with(x, y, lambda p, q: F.least(p, q)))
        return F.coalesce(F.try_divide(2.0 * common, (total(x) + total(y)).cast("double")), F.lit(1.0))

    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return let(a, lambda x: let(b, lambda y: bound(x, y)))


def too_similar_udf(threshold: float):
    """Null texts, pairs that are settled already, are not too similar."""

    @F.pandas_udf(T.BooleanType())
    def too_similar(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> bool:
            if x is None or y is None:
                return False
            matcher = SequenceMatcher(None, x.lower(), y.lower())
            # Both quick ratios are upper bounds, so a low one settles the question.
            return (
                matcher.real_quick_ratio() > threshold
                and matcher.quick_ratio() > threshold
                and matcher.ratio() > threshold
            )

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="bool")

    return too_similar


def _split_rank(
    df: DataFrame, groups: list[str], key: str, digits: int, out: str, seed: int | str, size: str | None = None
) -> DataFrame:
    """0-based position within the group in hash order, and the group's row count as ``size``.

    A group is ranked in ``16**digits`` separate parts, so a group with a third of
    all rows spreads over as many tasks.
    """
    df = df.withColumn("_h", order_key(key, seed)).withColumn("_p", F.substring("_h", 1, digits))
    part = [*groups, "_p"]
    sizes = df.groupBy(*part).agg(F.count("*").alias("_n"))
    group = W.partitionBy(*groups)
    before = group.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    totals = [F.sum("_n").over(group).alias(size)] if size else []
    starts = sizes.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *totals)
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*part).orderBy("_h", key)))
    joined = ranked.join(starts, part)
    return joined.withColumn(out, F.col("_start") + F.col("_r") - 1).drop("_h", "_p", "_r", "_start")


@dataclass
class References:
    """rows: (position, ref_id, ref_text and, if asked for, ref_counts); shorter: (len, shorter) for all lengths up to ``longest`` + 1."""

    rows: DataFrame
    shorter: DataFrame
    total: int
    longest: int


def number_references(references: DataFrame, key: str, text: str, seed: int | str = 42, counts: bool = False) -> References:
    """References by length, those of one length in hash order.

    They are written once, ranked within a length and two digits of their hash; where such a part begins
    is known from its count. ``counts`` adds the letter counts.
    """
    refs = references.select(F.col(key).alias("ref_id"), F.col(text).alias("ref_text"), F.length(text).alias("len"))
    refs = refs.where(F.col("len").isNotNull()).withColumn("h", order_key("ref_id", seed)).withColumn("p", F.substring("h", 1, 2))
    more = [letter_counts("ref_text").alias("ref_counts")] if counts else []
    rank = F.row_number().over(W.partitionBy("len", "p").orderBy("h", "ref_id"))
    refs = materialize(refs.select("ref_id", "ref_text", "len", "p", rank.alias("r"), *more), "references")
    # One row per length and two digits; all further steps read this small table.
    parts = materialize(refs.groupBy("len", "p").agg(F.count("*").alias("n")), "reference-parts")
    size = parts.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.max("len").alias("longest")).first()
    total, longest = size["n"] or 0, size["longest"] or 0
    before = W.orderBy("len", "p").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("len", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("start"))
    names = ["ref_id", "ref_text", *(["ref_counts"] if counts else [])]
    rows = refs.join(_small(starts, size["rows"]), ["len", "p"]).select((F.col("start") + F.col("r") - 1).alias("position"), *names)
    lengths = refs.sparkSession.range(longest + 2).select(F.col("id").cast("int").alias("len"), F.lit(0).cast("bigint").alias("n"))
    sizes = lengths.unionByName(parts.select("len", "n")).groupBy("len").agg(F.sum("n").alias("n"))
    # One row per length up to the longest.
    below = W.orderBy("len").rowsBetween(W.unboundedPreceding, -1)
    shorter = sizes.select("len", F.coalesce(F.sum("n").over(below), F.lit(0)).cast("bigint").alias("shorter"))
    return References(rows, _small(shorter, longest + 2), total, longest)


def _small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """Broadcast a table of a few columns per length if it is as small as it should be."""
    return F.broadcast(df) if rows <= most else df


def length_range(length: Column, bin_size: int | None = None) -> tuple[Column, Column]:
    """Accepted lengths: 30 % below to 30 % above, at least 5; whole bins with ``bin_size``."""
    low = F.greatest(F.lit(5), (length * F.lit(0.7)).cast("int"))
    high = (length * F.lit(1.3)).cast("int")
    if bin_size:
        low = (F.floor(low / bin_size) * bin_size).cast("int")
        high = (F.floor(high / bin_size) * bin_size + bin_size - 1).cast("int")
    return low, high


def _numbered_copies(rows: DataFrame, seed: int | str) -> DataFrame:
    """``copy`` and ``copies`` of every input among those with the same text.

    Most texts occur once: only the rows of repeated ones are ranked.
    """
    repeated = rows.groupBy("input_key").agg(F.count("*").alias("copies")).where("copies > 1")
    ranked = _split_rank(rows.select("input_id", "input_key").join(repeated, "input_key", "left_semi"), ["input_key"], "input_id", 2, "copy", f"{seed}-copy", "copies")
    ranked = ranked.select("input_id", "copy", "copies")
    joined = rows.join(ranked, "input_id", "left")
    return joined.withColumn("copy", F.coalesce("copy", F.lit(0).cast("bigint"))).withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))


def _prepared(
    inputs: DataFrame, key: str, text: str, refs: References, bin_size: int | None, seed: int | str, keep_text: bool
) -> DataFrame:
    """Inputs with their copy number and their range of positions; text and letter counts where they are needed."""
    body = strip_ws(F.col(text))
    rows = inputs.select(F.col(key).alias("input_id"), F.coalesce(body, F.lit("")).alias("input_text"))
    low, high = length_range(F.length("input_text"), bin_size)
    rows = rows.withColumn("_low", F.least(low, F.lit(refs.longest + 1))).withColumn("_end", F.least(high + 1, F.lit(refs.longest + 1)))
    for length, out in (("_low", "first"), ("_end", "last")):
        rows = rows.join(refs.shorter.select(F.col("len").alias(length), F.col("shorter").alias(out)), length)
    rows = rows.withColumn("n", F.greatest(F.col("last") - F.col("first"), F.lit(0)))
    needed = []
    if keep_text:  # an input without candidates is not compared with anything
        needed = [F.when(F.col("n") > 0, c).alias(name) for c, name in ((F.col("input_text"), "input_text"), (letter_counts("input_text"), "input_counts"))]
    rows = materialize(rows.select("input_id", F.md5(F.lower("input_text")).alias("input_key"), "first", "last", "n", *needed), "inputs")
    return _numbered_copies(rows, seed)


def _candidate(step: Column, total: int, seed: int | str) -> Column:
    """Position to try at a step: the length range in permuted order, then the other
    references, then, once all are used, any."""
    n, first, last = F.col("n"), F.col("first"), F.col("last")
    start = hash_int("input_key", seed)
    stride = F.when(n % STRIDES[0] == 0, F.lit(STRIDES[1])).otherwise(F.lit(STRIDES[0]))
    size = F.greatest(n, F.lit(1))
    # A product of two 63-bit numbers needs a decimal.
    product = (step % size).cast("decimal(19,0)") * (stride % size).cast("decimal(10,0)")
    inside = first + ((start % size + product) % size).cast("bigint")
    outside = (last + (step - n)) % total
    anywhere = (start % total + step % total) % total
    return F.when(step < n, inside).when(step < total, outside).otherwise(anywhere)


def match_by_length(
    inputs: DataFrame, references: DataFrame, input_key: str, input_text: str, reference_key: str,
    reference_text: str, threshold: float | None = 0.9, bin_size: int | None = None,
    max_probes: int | None = None, seed: int | str = 42,
) -> DataFrame:
    """``(input_id, ref_id, ref_text)`` with one reference for every input; checked also ``probes`` and ``compared``.

    Copies of one text (whatever its case) take different references while there
    are any: copy c of m tries steps c, c+m, c+2m … of its permutation, so copies
    never meet. ``threshold`` skips references that are too similar to the input;
    ``None`` turns the check off. After the length range come the unused others,
    unchecked. ``bin_size`` takes whole length bins and ``max_probes`` gives up
    after that many similar ones and keeps the first. ``probes`` is the number of candidates looked at, ``compared`` the number
    of those that letter counts could not settle.
    """
    checked = threshold is not None
    refs = number_references(references, reference_key, reference_text, seed, checked)
    if not refs.total:
        raise ValueError("no reference texts")
    rows = _prepared(inputs, input_key, input_text, refs, bin_size, seed, checked)
    if not checked:
        wanted = rows.withColumn("position", _candidate(F.col("copy"), refs.total, seed))
        return wanted.join(refs.rows, "position").select("input_id", "ref_id", "ref_text")
    return _match_checked(rows, refs.rows, refs.total, threshold, max_probes, seed)


def _match_checked(
    rows: DataFrame, refs: DataFrame, total: int, threshold: float, max_probes: int | None, seed: int | str
) -> DataFrame:
    """Rounds of 1, 16, 64 … candidates for the inputs still open; few are left after the first."""
    too_similar = too_similar_udf(threshold)
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("probes", zero).withColumn("compared", zero)
    names, keep = rows.columns, ["input_id", "position", "probes", "compared"]
    open_rows, tried, width = rows, 0, 1
    done: list[DataFrame] = []
    spent: list[DataFrame] = []
    while True:
        # Steps tried, tried+1, ... of each row's own series; a step past the range ends the search.
        until = tried + width if max_probes is None else min(tried + width, max_probes)
        first = F.lit(tried).cast("bigint")
        last = F.least(
            F.lit(until - 1), F.floor((F.col("n") - 1 - F.col("copy")) / F.col("copies"))
        ).cast("bigint")
        turns = F.when(last >= first, F.sequence(first, last))
        probes = open_rows.withColumn("turn", F.explode(turns))
        step = F.col("copy") + F.col("turn") * F.col("copies")
        in_range = probes.withColumn("position", _candidate(step, total, seed))
        pairs = in_range.join(refs, "position").withColumn("unsure", ratio_bound("ref_counts", "input_counts") > threshold)
        texts = [F.when(F.col("unsure"), F.col(c)) for c in ("ref_text", "input_text")]
        judged = pairs.select("input_id", "position", "turn", "unsure", too_similar(*texts).alias("similar"))
        fine = judged.groupBy("input_id").agg(
            F.min(F.when(~F.col("similar"), F.struct("turn", "position"))).alias("m"),
            F.count("*").alias("met"), F.count_if("unsure").alias("sent"),
        )
        last_turn = F.col("copy") + F.lit(tried + width) * F.col("copies") >= F.col("n")
        if max_probes is not None:
            last_turn = last_turn | F.lit(tried + width >= max_probes)
        state = open_rows.join(fine, "input_id", "left").select(
            *[c for c in names if c not in ("probes", "compared")],
            (F.col("probes") + F.coalesce("met", zero)).alias("probes"),
            (F.col("compared") + F.coalesce("sent", zero)).alias("compared"),
            F.col("m.position").alias("position"), (F.col("m").isNull() & last_turn).alias("ended"),
        )
        state = materialize(state, "round")
        done.append(state.where(F.col("position").isNotNull()).select(*keep))
        spent.append(state.where("ended").drop("position", "ended"))
        open_rows = state.where(F.col("position").isNull() & ~F.col("ended")).drop("position", "ended")
        tried, width = tried + width, 16 if width == 1 else width * 4
        if open_rows.isEmpty():
            break
    left = reduce(DataFrame.unionByName, spent)
    if not left.isEmpty():
        done.append(_without_match(left, total, max_probes, seed))
    matched = reduce(DataFrame.unionByName, done)
    return matched.join(refs, "position").select("input_id", "ref_id", "ref_text", "probes", "compared")


def _without_match(rows: DataFrame, total: int, max_probes: int | None, seed: int | str) -> DataFrame:
    """Inputs whose candidates ran out: references outside the range that no other copy takes.

    Copies beyond the range take steps n..m-1, so those whose candidates were all
    too similar go on from step m. With a probe limit they keep their first candidate.
    """
    beyond = F.col("copy") >= F.col("n")
    ranked = _split_rank(rows.withColumn("beyond", beyond), ["input_key", "beyond"], "input_id", 2, "place", seed)
    first = F.col("copy") if max_probes is not None else F.greatest("copies", "n") + F.col("place")
    step = F.when(F.col("beyond"), F.col("copy")).otherwise(first)
    return ranked.select("input_id", _candidate(step, total, seed).alias("position"), "probes", "compared")
