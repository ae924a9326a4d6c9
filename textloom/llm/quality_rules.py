"""Quality rules, line first: clean line by line, then judge what is left of the document.

Every line is tested for end punctuation, navigation, boilerplate, symbols and shouting. Lines that
fail go. A document that loses more than ``max_lost`` per cent of its words this way is
rejected, as are documents that fail the base rules (too few words, too much repetition).
Everything is a built-in expression over one row: no shuffle, no Python.

Repetition within a document is found by sorting the (hash, position) pairs of its three-word
windows, which takes n log n steps however long the text is, and only for texts that repeat one.

Defined results: null or blank text has no words, fails the base rules and is not kept. Ties
and repeated rows are judged alike; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm.common import SPACE, documents, packed, unpacked, words

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_LOST = 50  # per cent of the words

# Phrases of page furniture.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service", "lorem ipsum", "enable javascript",
    "click here", "read more", "sign in", "log in", "sign up", "subscribe to our", "share this", "skip to content", "back to top",
)
END_MARK = r"[.!?…:;][\"')\]»”’]*$"
SYMBOLS = "[#*$%&|<>]"


def _count(text: Column, pattern: str) -> Column:
    """Characters that match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with words is punctuation-free, navigation, boilerplate, symbols or shouting."""
    n = F.size(F.split(F.btrim(line, F.lit(" \t\x0b\x0c\r")), SPACE))
    chars = F.length(F.regexp_replace(line, SPACE, ""))
    capitals = _count(line, r"\p{Lu}")
    letters = _count(line, r"\p{L}")
    unfinished = ~F.rtrim(line).rlike(END_MARK) & (n < 8)
    navigation = _count(line, "[|»•·>]") * 4 >= n
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    symbols = _count(line, SYMBOLS) * 10 > chars
    shouting = (letters >= 10) & (capitals * 10 > letters * 6)
    return (navigation & (n >= 2)) | symbols | shouting | boilerplate | unfinished


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    hashes = F.col("_win")
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(None)).otherwise(ordered)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _lost (words on failing lines)."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_lost"]
    base = docs.drop(*[c for c in docs.columns if c in added])
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = base.withColumns({"_w": words(text), "_lines": lines})
    triple = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    )
    none = F.array().cast("array<bigint>")
    second = first.withColumns(
        {
            "_win": F.when(F.size("_w") >= 3, triple).otherwise(none),
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
            "n_symbols": _count(whole, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_lost": F.aggregate(
                F.filter("_lines", line_fails), F.lit(0), lambda a, line: a + F.size(F.split(F.btrim(line, F.lit(" \t\x0b\x0c\r")), SPACE))
            ),
        }
    )
    third = second.withColumn("_sorted", _repeat_words(F.col("_w")))
    at = F.sequence(F.lit(0), F.size("_sorted") - 1)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.get("_sorted", a)["h"] == F.get("_sorted", b)["h"], F.lit(False))

    places = F.transform(F.filter(at, lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get("_sorted", i)["i"])
    fourth = third.withColumn("_at", F.when(F.col("_sorted").isNotNull(), places))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2)))))
    fifth = fourth.withColumn("n_repeat_words", F.when(F.col("_at").isNotNull(), covered).otherwise(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return fifth.withColumn("base_failed", failed).drop("_w", "_lines", "_win", "_sorted", "_at")


def keep_rule(max_lost: int = MAX_LOST) -> Column:
    return ~F.col("base_failed") & (F.col("_lost") * 100 <= F.col("n_words") * max_lost)


def cleaned_text(text: Column) -> Column:
    """The text without its failing lines; lines without words stay as they are."""
    bad = lambda line: line.rlike(r"[^\x20\x09-\x0D]") & line_fails(line)
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~bad(line)), "\n")


def clean(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST) -> DataFrame:
    """Kept documents with their failing lines removed, in the same columns."""
    kept = measured(packed(docs, text=F.col(text))).where(keep_rule(max_lost)).withColumn("text", cleaned_text(F.col("text")))
    return unpacked(kept, docs.columns, **{text: F.col("text")})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict for every document."""
    judged = measured(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", keep_rule().alias("kept"), F.col("_lost").cast("long").alias("n_lost_words")
    )


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
l AS (SELECT * FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT *, len(list_filter(string_split_regex(line, '{SPACE}'), lambda x: x <> '')) AS n, length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars,
    length(regexp_replace(line, '[^|»•·>]', '', 'g')) AS marks, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS capitals, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters FROM l),
f AS (SELECT *, (marks * 4 >= n AND n >= 2) OR symbols * 10 > chars OR (letters >= 10 AND capitals * 10 > letters * 6)
    OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}') OR (NOT regexp_matches(rtrim(line), '{END_MARK.replace("'", "''")}') AND n < 8) AS fails FROM m),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, coalesce(sum(n) FILTER (fails), 0) AS lost FROM f GROUP BY 1),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed FROM r)
SELECT *, NOT base_failed AND n_lost_words * 100 <= n_words * {MAX_LOST} AS kept FROM b
"""
