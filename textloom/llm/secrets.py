"""Secret scans: patterns, and a sliding window of Shannon entropy over candidate strings.

Base kinds are patterns. Where a pattern matches is found from the pieces between its
matches: the lengths of pieces and matches add up to positions in code points.

Entropy: base spans are blanked, and what is left of runs of the characters keys are written in are the candidates,
so a key next to a plain secret is judged too. Each is judged by its
character class (hexadecimal in either case, letters and digits, base64), which has its own window and threshold. The window moves one character
at a time: one count goes up, one goes down, and the sum of ``c log2 c`` is
mended by those two terms. Counts are kept of the characters the candidate has. A candidate with a window at
or above the threshold is a span as a whole. Allow-listed candidates are left out: those that begin or end with a placeholder or
with a run of the alphabet, UUIDs, and what reads as words, numbers and paths of them (see ``NOT_WORDS``). The lists look at both ends or at the shape of the whole, so a long key is not excused by what chance puts inside it.

Everything is a built-in expression over one row: no shuffle, no Python.

Defined results: null or empty text has no spans, counts of 0, the hash of the empty string
and an empty span list. Columns besides id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm.common import documents, let

# Kind, pattern, group that is measured, fewest characters, quick test.
BASE = (
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]",
    ),
    # A run that is long enough begins where the run of one or more begins, so the length can go into the pattern.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
# Class, window, least entropy in bits.
# No window is longer than the shortest candidate, so every candidate has a full one.
CLASSES = (("hex", 20, 3.0), ("alnum", 20, 3.6), ("base64", 20, 3.7))
# A run of key characters, its padding at the end only: "=" elsewhere stands between a name and its value.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}|[A-Za-z0-9+/_-]{18}==|[A-Za-z0-9+/_-]{19}="
CANDIDATE_QUICK = r"[A-Za-z0-9+/_=-]{20}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your|redacted"
ALLOWED = (
    rf"(?i)^(?:{_PLACEHOLDER})(?:[_-]|$)|(?:^|[_-])(?:{_PLACEHOLDER})$|example(?:key)?$|^(?:0?123456789|abcdefgh)|(?:123456789|stuvwxyz)$"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
# What words, numbers, paths and camel-case names do not have: a digit before a letter, a capital inside
# a word that does not begin one, capitals before one or two small letters, seven consonants in a row.
NOT_WORDS = r"[0-9][A-Za-z]|[a-z][A-Z](?![a-z]{2})|[A-Z]{2}[a-z]{1,2}(?![a-z])|(?i:[bcdfghjklmnpqrstvwxz]{7})"
_NONE = "array<struct<start:bigint,kind:int,end:bigint>>"


def _matched(df: DataFrame, out: str, pattern: str, kind: int, group: int, least: int, quick: str, source: str = "_text") -> DataFrame:
    """Add leftmost non-overlapping matches as (start, kind, end); matches whose group is too short are dropped.

    Lengths of pieces and matches are columns of their own first: an expression inside a fold
    would be computed anew for every element.
    """
    text, hit = F.col(source), F.col(source).rlike(quick)
    lengths = lambda strings: F.transform(strings, lambda x: F.length(x))
    found = lambda g: lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)))
    df = df.withColumns({"_gaps": F.when(hit, lengths(F.split(text, pattern, -1))), "_hits": F.when(hit, found(0)), "_own": F.when(hit, found(group)) if group else F.lit(None).cast("array<int>")})
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + x["_gaps"]
        end = begin + x["_hits"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("pos"), F.when(F.coalesce(x["_own"], x["_hits"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    own = F.coalesce("_own", F.col("_hits")).alias("_own")
    each = F.slice(F.arrays_zip("_gaps", "_hits", own), F.lit(1), F.size("_hits"))
    spans = F.when(F.size("_hits") > 0, F.aggregate(each, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_NONE))
    return df.withColumn(out, spans).drop("_gaps", "_hits", "_own")


def _log_term(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_window(chars: Column, window: Column, least: Column) -> Column:
    """(first, last): from the start of the first to the end of the last window at or above the entropy; null without one."""
    start = lambda codes: F.struct(
        F.array_repeat(F.lit(0), F.array_max(codes)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def step(codes: Column, acc: Column, i: Column) -> Column:
        enters = F.get(codes, i - 1)
        leaves = F.when(i > window, F.get(codes, i - window - 1)).otherwise(0)
        up, down = F.get(acc["counts"], enters - 1), F.coalesce(F.get(acc["counts"], leaves - 1), F.lit(0))
        change = _log_term(up + 1) - _log_term(up) + _log_term(down - 1) - _log_term(down)
        total = F.when(enters == leaves, acc["sum"]).otherwise(acc["sum"] + change)
        counts = F.transform(acc["counts"], lambda c, j: c + (j + 1 == enters).cast("int") - (j + 1 == leaves).cast("int"))
        hot = (i >= window) & (F.log2(window.cast("double")) - total / window >= least)
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(hot & acc["first"].isNull(), i - window).otherwise(acc["first"]).alias("first"),
            F.when(hot, i).otherwise(acc["last"]).alias("last"),
        )

    done = lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
    present = F.array_distinct(chars)
    coded = let(present, lambda own: F.transform(chars, lambda c: F.array_position(own, c).cast("int")))
    return let(coded, lambda codes: F.aggregate(F.sequence(F.lit(1), F.size(codes)), start(codes), lambda acc, i: step(codes, acc, i), done))


def _by_class(candidate: Column, place: int) -> Column:
    """Window or threshold of the candidate's character class."""
    hexes, alnum, other = (F.lit(c[place]) for c in CLASSES)
    return F.when(candidate.rlike("^[0-9A-Fa-f]+$"), hexes).when(candidate.rlike("^[A-Za-z0-9]+$"), alnum).otherwise(other)


def _blanked() -> Column:
    """The text with every base span replaced by as many spaces; places stay what they are."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    cut = lambda a, n: F.substring(F.col("_text"), (a + 1).cast("int"), n.cast("int"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["pos"])
        pieces = F.array(cut(acc["pos"], begin - acc["pos"]), F.repeat(F.lit(" "), F.greatest(s["end"] - begin, F.lit(0)).cast("int")))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], pieces).alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), cut(acc["pos"], F.length("_text") - acc["pos"]))
    return F.when(F.size("base") > 0, F.aggregate("base", start, step, done)).otherwise(F.col("_text"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (spans of the base kinds) and spans (all), each an array of (start, kind, end) in order."""
    none = F.array().cast(_NONE)
    # One expensive expression per projection: the optimizer keeps them apart, each is computed once.
    found = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind, (name, pattern, group, least, quick) in enumerate(BASE):
        found = _matched(found, f"_{name}", pattern, kind, group, least, quick)
    found = found.withColumn("base", F.sort_array(F.concat(*[F.col(f"_{b[0]}") for b in BASE])))
    found = found.withColumn("_blank", _blanked())
    found = _matched(found, "_cand", CANDIDATE, len(BASE), 0, 20, CANDIDATE_QUICK, "_blank")
    cut = F.transform("_cand", lambda s: F.struct(s.alias("span"), F.substring(F.col("_text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("c")))
    suspect = lambda x: x["c"].rlike(NOT_WORDS) & ~x["c"].rlike(ALLOWED)
    found = found.withColumn("_cut", F.when(F.size("_cand") > 0, cut)).withColumn("_cut", F.filter("_cut", suspect))
    ready = lambda x: F.struct(x["span"].alias("span"), F.split(x["c"], "").alias("chars"), _by_class(x["c"], 1).alias("window"), _by_class(x["c"], 2).alias("least"))
    found = found.withColumn("_ready", F.when(F.size("_cut") > 0, F.transform("_cut", ready)))
    judged = F.transform("_ready", lambda x: F.struct(x["span"].alias("span"), hot_window(x["chars"], x["window"], x["least"]).alias("w")))
    found = found.withColumn("_hot", judged)
    extra = F.transform(F.filter("_hot", lambda x: x["w"].isNotNull()), lambda x: x["span"])
    spans = F.sort_array(F.concat("base", F.coalesce(extra, none)))
    return found.select(key, "_text", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(b[0]) for b in BASE], F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """id and text with every span replaced; overlapping spans become one mark."""
    scanned = scan(docs, key, text)
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(F.col("_text"), (acc["pos"] + 1).cast("int"), F.greatest(s["start"] - acc["pos"], F.lit(0)).cast("int"))
        grown = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], piece, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), grown.alias("out"))

    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), (acc["pos"] + 1).cast("int"), F.length("_text"))))
    return scanned.select(key, whole.alias(text))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the digest of base spans and all spans of every document."""
    found = scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{b[0]}") for i, b in enumerate(BASE)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
