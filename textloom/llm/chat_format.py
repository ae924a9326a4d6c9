"""Chat formatting by a grammar round trip.

A conversation becomes one training text. The grammar of that text is

    conversation := turn*
    turn         := "### " role ":\\n" body "\\n</turn>\\n"

where an unescaped "### " or "</turn>" occurs nowhere else. ``role`` is percent-encoded, so it holds
no mark, colon or line end. ``body`` is the text at the lowest rung of ``RUNGS`` that survives: a turn is rendered,
reparsed by the deterministic parser and compared with its source; while they differ, the next
rung escapes more. Rung 0 leaves the text alone. Rung 1 puts one backslash before every mark and the backslashes in
front of it, which is a bijection, and line ends part the body from the marks around it; so the search ends. A mark
with a backslash before it is no mark to the parser. The whole conversation is parsed again after it was put together,
and its turns are compared with the source by digest (column ``identical``).

Everything is built-in expressions. Turns are rendered and repaired row by row, before any
shuffle; one shuffle brings the pieces of a conversation together, already rendered. A conversation is one training
text and its digest covers all of it, so it must fit into one cell (2 GB); nothing else is collected.

Defined results: null text and null role are empty. Turns are ordered by ``turn``, nulls first; equal
turns by their rendered text, so repeated rows all stay and neighbour each other. A null conv_id is a conversation of its own.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from textloom.llm.common import let

START, END = "### ", "</turn>"
_MARK = "(?:### |</turn>)"
_HEAD_END, _TAIL = ":\n", "\n</turn>\n"
TRAINED_ROLE = "assistant"
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    """One backslash before every mark and the backslashes that lead to it."""
    return F.regexp_replace(text, r"(\\*" + _MARK + ")", r"\\$1")


def unescaped(body: Column) -> Column:
    return F.regexp_replace(body, r"\\(\\*" + _MARK + ")", "$1")


# What may become of a text, from the least to the most intrusive; the last one always survives.
RUNGS = (lambda text: text, escaped)


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(role), F.lit(_HEAD_END), body, F.lit(_TAIL))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>; a piece that the grammar does not allow gives nulls."""

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, _HEAD_END, 1)
        start = F.length(head) + len(_HEAD_END) + 1
        body = F.substring(piece, start, F.length(piece) - len(_TAIL) - start + F.lit(1))
        whole = piece.endswith(_TAIL) & (F.length(piece) >= F.length(head) + len(_HEAD_END) + len(_TAIL)) & ~body.rlike(r"(?<!\\)" + END)
        return F.struct(
            F.when(whole, F.try_url_decode(head)).alias("role"),
            F.when(whole, unescaped(body)).alias("text"),
        )

    return let(
        F.split(formatted, r"(?<!\\)" + START),
        lambda pieces: F.when(pieces[0] == "", F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)).otherwise(
            F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
        ),
    )


def _settled(role: Column, text: Column, rung: int = 0) -> Column:
    """struct<piece, rung> of the first rung whose rendering reads back as the source."""

    def judged(piece: Column) -> Column:
        found = F.struct(piece.alias("piece"), F.lit(rung).alias("rung"))
        if rung == len(RUNGS) - 1:
            return found
        same = let(parse(piece), lambda t: (F.size(t) == 1) & t[0]["role"].eqNullSafe(role) & t[0]["text"].eqNullSafe(text))
        return F.when(same, found).otherwise(_settled(role, text, rung + 1))

    return let(render(role, RUNGS[rung](text)), judged)


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(role, F.lit("\n"), text), 256)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, n_escaped, identical.

    ``loss_spans`` holds the code points (start, end exclusive) of every trained body in ``formatted``;
    ``n_escaped`` counts the turns that did not survive as they were; ``identical`` says that the text reads back as the source.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.select(
        "conv_id", "turn", "role", _digest(F.col("role"), F.col("text")).alias("digest"), _settled(F.col("role"), F.col("text")).alias("s")
    ).select("conv_id", "turn", "role", "digest", "s.piece", "s.rung")
    before = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "piece", "digest").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("piece").cast("long")
    first = F.coalesce(F.sum(size).over(before), F.lit(0).cast("long"))
    placed = turns.withColumn("at", first)
    head = F.lit(len(START) + len(_HEAD_END)) + F.length(F.url_encode("role"))
    span = F.struct((F.col("at") + head).alias("start"), (F.col("at") + size - len(_TAIL)).alias("end"))
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "turn", "piece", "digest"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == TRAINED_ROLE, span))).alias("loss_spans"),
        F.count_if(F.col("rung") > 0).alias("n_escaped"),
    )
    formatted = F.array_join(F.col("turns.piece"), "")
    judged = grouped.withColumn(
        "s",
        let(
            formatted,
            lambda f: F.struct(
                f.alias("formatted"),
                (F.transform(parse(f), lambda t: _digest(t["role"], t["text"])) == F.col("turns.digest")).alias("identical"),
            ),
        ),
    )
    return judged.select("conv_id", "s.formatted", "loss_spans", "n_escaped", F.coalesce("s.identical", F.lit(False)).alias("identical"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, whose texts look like the template's own marks."""
    spark = conversations.sparkSession
    rows = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE).alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return rows.unionByName(probe)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, formatted; what is returned is read back from the formatted text."""
    done = format_conversations(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

    def facts(turns: Column) -> Column:
        source = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        trained = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == TRAINED_ROLE), lambda t: t["text"]), "")
        return F.struct(
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(source, 256).alias("turns_sha256"),
            let(trained, lambda t: F.struct(F.length(t).cast("long").alias("chars"), F.sha2(t, 256).alias("sha"))).alias("loss"),
        )

    read = done.withColumn("f", let(parse(F.col("formatted")), facts))
    return read.select(
        "conv_id", "f.n_turns", "f.turns_sha256", F.col("f.loss.chars").alias("loss_chars"), F.col("f.loss.sha").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped", "identical",
    )


# The figures of the source, and the length of the text by the rule of the escape.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS probe(i, r)
), pieces AS (
  SELECT *, regexp_matches(text, '### |</turn>') AS marked,
         '### ' || url_encode(role) || ':' || chr(10) || regexp_replace(text, '(\\*(?:### |</turn>))', '\\\1', 'g') || chr(10) || '</turn>' || chr(10) AS piece
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars, count_if(marked)::BIGINT AS n_escaped, true AS identical
FROM pieces GROUP BY conv_id
"""
