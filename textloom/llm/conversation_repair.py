"""Repair of the structure of conversations: Knuth's lightest derivations.

A sound conversation is an optional system turn and then one or more pairs of user and assistant turns, or nothing at all. Repair looks
for the cheapest edits that make one, as deductions in a weighted hypergraph. An item (i, state) says: the
first i rows are edited and what stays of them leaves the grammar in that state. An axiom is one edit of one row. A deduction
joins an item and an axiom, adds their costs and joins their audits (one initial per edit). It is superior and monotone
in (cost, audit): a conclusion is never lighter than its item, and two audits of one item and one cost are never a
prefix of one another, so what is appended keeps their order. The agenda therefore pops final items, and stops when the goal does.

Long conversations are cut into blocks. A block derives, from every state it may be entered in, its lightest way to
every state it may be left in; two neighbouring blocks combine through the state between them, which is a deduction with two items. Audits then
grow by joining halves, not letter by letter.

How it runs. Rows are range-partitioned by conversation and turn and sorted: one shuffle. A task solves every
conversation that lies inside its partition while it streams over it. The first and last conversation of a partition may
go on next door: their rows are handed on, tables of four by four states are computed per partition, and one
small step per conversation picks the way through. So a conversation with a third of all rows, even with one turn and one text, is spread
over many tasks, and no task holds more of it than its partition. What has to exist once per conversation is its audit, a letter a row;
the digest of a conversation that crosses partitions is a sequential sum, computed over sorted rows as a stream.

Defined results: rows are taken by ``turn``, nulls first; equal turns by the digest of role and text, so order in the table
does not matter. Null role or text is one space. A null conv_id is a conversation of its own. An empty role has no initial and
cannot be kept. Conversations without rows (all absent) cost nothing and have an empty audit. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from textloom.llm.common import SPACE, SPACE_CHARS, checkpointed

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
FINAL_MARKS = ".!?"
# The grammar (s?(ua)+)? as an automaton: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = range(4)
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GOALS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
BLOCK = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SOUND_PAIRS = {"su", "ua", "au"}

# A weight is (cost, audit); a span maps (state before, state after) to the lightest weight.
Weight = tuple[int, str]
Span = dict[tuple[int, int], Weight]


# --- deductions ----------------------------------------------------------------------------------


def _edits(state: int, initial: str, fault: str) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, state after) of every edit of a row."""
    yield DELETE, "D", state
    if fault in ("blank", "duplicate"):
        return
    extra = CUT_OFF if fault == "truncated" else 0
    if initial in STEPS[state]:
        yield KEEP + extra, "K", STEPS[state][initial]
    for other in ROLES:
        if other in STEPS[state]:
            yield REROLE + extra, "R", STEPS[state][other]


def derive(rows: list[tuple[str, str]], entry: int, goal: bool = False) -> dict[int, Weight]:
    """Lightest weight of every state after the rows (initial, fault); with ``goal`` only of the lightest sound ending, under -1."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    final, exits = set(), {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if state == -1:
            return {-1: (cost, audit)}
        if i == len(rows):
            exits[state] = (cost, audit)
            if goal and state in GOALS:
                heapq.heappush(agenda, (cost, audit, i, -1))
        else:
            for more, letter, after in _edits(state, *rows[i]):
                heapq.heappush(agenda, (cost + more, audit + letter, i + 1, after))
        for role in ROLES:
            if role in STEPS[state]:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, STEPS[state][role]))
    return exits


def block_span(rows: list[tuple[str, str]]) -> Span:
    return {(entry, after): weight for entry in STATES for after, weight in derive(rows, entry).items()}


def combine(left: Span, right: Span) -> Span:
    """Two neighbouring spans as one: their antecedents are final, so the lightest middle state is final too."""
    out: Span = {}
    for (entry, middle), (cost, audit) in left.items():
        for after in STATES:
            other = right.get((middle, after))
            if other is not None:
                weight = (cost + other[0], audit + other[1])
                if (entry, after) not in out or weight < out[entry, after]:
                    out[entry, after] = weight
    return out


def span_of(rows: list[tuple[str, str]]) -> Span:
    """The span of any number of rows: blocks, joined two by two."""
    spans = [block_span(rows[i : i + BLOCK]) for i in range(0, max(1, len(rows)), BLOCK)]
    while len(spans) > 1:
        spans = [combine(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def lightest(rows: list[tuple[str, str]]) -> Weight:
    if len(rows) <= BLOCK:
        return derive(rows, 0, goal=True)[-1]
    span = span_of(rows)
    return min(span[0, g] for g in GOALS if (0, g) in span)


def carried_out(audit: str, rows: list[tuple], state: int = 0) -> Iterator[tuple]:
    """(edit, role, text, turn) of what stays; rows are (turn, role, text)."""
    at = iter(rows)
    for edit in audit:
        turn, role, text = (None, None, "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit in "IR":
            role = next(ROLES[r] for r in ROLES if r in STEPS[state])
        yield edit, role, text, turn
        state = STEPS[state][role[:1]]


# --- rows of one partition -----------------------------------------------------------------------


def _fault(text: str, seen: bool) -> str:
    said = text.strip(SPACE_CHARS)
    return "blank" if not said else "duplicate" if seen else "" if said[-1] in FINAL_MARKS else "truncated"


class _Counts:
    """Figures of the rows of a conversation, or of a part of it, in order."""

    def __init__(self):
        self.n = self.turns = self.illegal = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.low = self.high = None
        self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.n:
            self.illegal += self.last + initial not in SOUND_PAIRS
        else:
            self.first = initial
        self.last = initial
        self.n += 1
        if fault:
            self.faults[fault] += 1

    def row(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.faults.values(), self.illegal]


ROW = "key string, part int, seq bigint, turn bigint, role string, text string, absent boolean, same string, fresh boolean"
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = "key string, " + ", ".join(f"{c} bigint" for c in FIGURES) + ", audit string, repaired_sha256 string"
TURNS = "key string, part int, place bigint, turn bigint, role string, text string, edit string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
OUT_ROWS, OUT_BYTES = 5000, 8 << 20


def _fields(schema: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.strip().split(" ") for f in schema.split(","))])


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded size."""
    fields, held, size = _fields(schema), [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), fields.types)], schema=fields)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _digest(lines: Iterator[str]) -> str:
    sha, first = hashlib.sha256(), True
    for line in lines:
        sha.update((line if first else "\n" + line).encode())
        first = False
    return sha.hexdigest()


def _report(key: str, rows: list[tuple]) -> Iterator[tuple]:
    """rows: (turn, role, text, same); one line per conversation."""
    counts, seen, items = _Counts(), set(), []
    for turn, role, text, same in rows:
        fault = _fault(text, same in seen)
        seen.add(same)
        counts.add(turn, role[:1], fault)
        items.append((role[:1], fault))
    cost, audit = lightest(items)
    kept = carried_out(audit, [r[:3] for r in rows])
    yield (key, *counts.row(), cost, audit, _digest(f"{role}:{text}" for _, role, text, _ in kept))


def _turns(key: str, rows: list[tuple]) -> Iterator[tuple]:
    """The turns that stay."""
    seen, items = set(), []
    for _, role, text, same in rows:
        items.append((role[:1], _fault(text, same in seen)))
        seen.add(same)
    for place, (edit, role, text, turn) in enumerate(carried_out(lightest(items)[1], [r[:3] for r in rows])):
        yield key, 0, place, turn, role, text, edit


def _solver(work: Callable, schema: str) -> Callable:
    """Streams over a sorted partition: conversations inside it are solved, rows of the first and the last are handed on."""
    n_out, n_row = len(_fields(schema)), len(_fields(ROW))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "absent", "same")])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, key, first, held, fresh, seq = TaskContext.get().partitionId(), None, True, [], set(), 0

        def handed_on(row: tuple) -> tuple:
            nonlocal seq
            seq += 1
            is_fresh = row[5] not in fresh
            fresh.add(row[5])
            return (True, *(None,) * n_out, row[0], part, seq, *row[1:], is_fresh)

        for row in rows_of(batches):
            if row[0] != key:
                if key is not None and not first:
                    kept = [(r[1], r[2], r[3], r[5]) for r in held if not r[4]]
                    for out in work(key, kept):
                        yield (False, *out, *(None,) * n_row)
                first = key is None
                key, held = row[0], []
            if first:
                yield handed_on(row)
            else:
                held.append(row)
        fresh.clear()
        for row in held:
            yield handed_on(row)

    out = f"border boolean, {', '.join('o_' + f.strip() for f in schema.split(','))}, {', '.join('r_' + f.strip() for f in ROW.split(','))}"
    return lambda batches: _batches(results(batches), out), out


# --- conversations that cross partitions ---------------------------------------------------------

SEGMENT = (
    "key string, part int, n bigint, turns bigint, illegal bigint, blank bigint, duplicate bigint, truncated bigint, low bigint, high bigint, "
    "first string, last string, span array<struct<a int, b int, cost bigint, audit string>>"
)
CHOICE = "key string, part int, state int, way string, " + ", ".join(f"{c} bigint" for c in FIGURES) + ", audit string"
_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _segment(table: pa.Table) -> pa.Table:
    """The rows of one conversation in one partition as one span; only initials and faults, no texts."""
    table = table.sort_by("seq")
    key, part = table.column("key")[0].as_py(), table.column("part")[0].as_py()
    counts, items = _Counts(), []
    for turn, initial, fault, absent in zip(*[table.column(c).to_pylist() for c in ("turn", "initial", "fault", "absent")]):
        if not absent:
            counts.add(turn, initial, fault)
            items.append((initial, fault))
    span = [{"a": a, "b": b, "cost": w[0], "audit": w[1]} for (a, b), w in span_of(items).items()]
    c = counts
    row = [key, part, c.n, c.turns, c.illegal, *c.faults.values(), c.low, c.high, c.first, c.last, span]
    names = ["key", "part", "n", "turns", "illegal", "blank", "duplicate", "truncated", "low", "high", "first", "last", "span"]
    types = [pa.string(), pa.int32(), *[pa.int64()] * 8, pa.string(), pa.string(), _SPAN]
    return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=names)


def _choose(table: pa.Table) -> pa.Table:
    """Per part of a conversation the state it is entered in and its share of the lightest audit; figures stand at the first part."""
    parts = table.sort_by("part").to_pylist()
    best: list[dict[int, tuple[int, str, int]]] = []  # per part: state after -> cost, audit so far, state before
    before = {0: (0, "")}
    spans = [{(s["a"], s["b"]): (s["cost"], s["audit"]) for s in p["span"]} for p in parts]
    for span in spans:
        after: dict[int, tuple[int, str, int]] = {}
        for (a, b), (cost, audit) in span.items():
            if a in before:
                weight = (before[a][0] + cost, before[a][1] + audit, a)
                if b not in after or weight[:2] < after[b][:2]:
                    after[b] = weight
        best.append(after)
        before = {s: w[:2] for s, w in after.items()}
    state = min((g for g in GOALS if g in before), key=before.__getitem__)
    cost, audit = before[state]
    ways = []
    for after, span in zip(reversed(best), reversed(spans)):
        entry = after[state][2]
        ways.append((entry, span[entry, state][1]))
        state = entry
    ways.reverse()
    turns, illegal, low, high, last = 0, 0, None, None, None
    for p in parts:
        turns += p["turns"] - (p["low"] is not None and p["low"] == high)
        low = p["low"] if low is None else low
        high = high if p["high"] is None else p["high"]
        illegal += p["illegal"] + (p["n"] > 0 and last is not None and last + p["first"] not in SOUND_PAIRS)
        last = p["last"] if p["n"] else last
    figures = [0 if low is None else high - low + 1 - turns, *[sum(p[f] for p in parts) for f in ("blank", "duplicate", "truncated")], illegal, cost]
    rows = [
        [p["key"], p["part"], entry, way, *(figures if i == 0 else [None] * len(figures)), audit if i == 0 else None]
        for i, (p, (entry, way)) in enumerate(zip(parts, ways))
    ]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * len(FIGURES), pa.string()]
    names = ["key", "part", "state", "way", *FIGURES, "audit"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _apply(rows: pa.Table, choice: pa.Table) -> pa.Table:
    """The turns that stay of one conversation in one partition."""
    out = []
    if rows.num_rows and choice.num_rows:
        rows = rows.sort_by("seq")
        present = [r for r in zip(*[rows.column(c).to_pylist() for c in ("turn", "role", "text", "absent")]) if not r[3]]
        key, part = rows.column("key")[0].as_py(), rows.column("part")[0].as_py()
        kept = carried_out(choice.column("way")[0].as_py(), [r[:3] for r in present], choice.column("state")[0].as_py())
        out = [(key, part, place, turn, role, text, edit) for place, (edit, role, text, turn) in enumerate(kept)]
    fields = _fields(TURNS)
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(fields.types)], schema=fields)


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per conversation over rows sorted by conversation and place."""

    def results() -> Iterator[tuple]:
        key, sha = None, None
        for batch in batches:
            for k, role, text in zip(*[batch.column(c).to_pylist() for c in ("key", "role", "text")]):
                if k != key:
                    if sha is not None:
                        yield key, sha.hexdigest()
                    key, sha = k, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    sha.update(f"\n{role}:{text}".encode())
        if sha is not None:
            yield key, sha.hexdigest()

    return _batches(results(), "key string, sha string")


def _crossing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(choices, repaired turns) of the conversations whose rows were handed on."""
    # Of the rows that are the first of their kind in their partition, at most one a partition, only one is the first of all.
    first = W.partitionBy("key", "same").orderBy("part")
    again = (
        rows.where("fresh AND NOT absent").select("key", "same", "part", "seq", F.row_number().over(first).alias("nth"))
        .where("nth > 1").select("key", "part", "seq", F.lit(True).alias("again"))
    )
    said = F.btrim("text", F.lit(SPACE_CHARS))
    fault = (
        F.when(said == "", "blank").when(~F.col("fresh") | F.col("again").isNotNull(), "duplicate")
        .when(~F.substring(said, -1, 1).isin(*FINAL_MARKS), "truncated").otherwise("")
    )
    light = rows.join(again, ["key", "part", "seq"], "left").select(
        "key", "part", "seq", "turn", "absent", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")
    )
    spans = light.groupBy("key", "part").applyInArrow(_segment, SEGMENT)
    choices = checkpointed(spans.groupBy("key").applyInArrow(_choose, CHOICE), "repair-choices")
    turns = rows.groupBy("key", "part").cogroup(choices.groupBy("key", "part")).applyInArrow(_apply, TURNS)
    return choices, turns


# --- the operator --------------------------------------------------------------------------------


def _solved(conversations: DataFrame, work: Callable, schema: str, absent: str | None, partitions: int | None) -> tuple[DataFrame, DataFrame]:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = F.lit(False) if absent is None else F.coalesce(F.col(absent), F.lit(False))
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), F.when(~gone, text).alias("text"), gone.alias("absent"),
    )
    # Copies of one row have nothing to tell them apart; a running number lets even them spread over partitions.
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = rows.select("*", same.alias("same"), F.monotonically_increasing_id().alias("copy"))
    order = [F.asc("key"), F.asc_nulls_first("turn"), F.asc("same")]
    spread = rows.repartitionByRange(*([partitions] if partitions else []), *order, F.asc("copy")).sortWithinPartitions(*order)
    solve, both = _solver(work, schema)
    done = checkpointed(spread.mapInArrow(solve, both), "repair")
    inside = done.where(~F.col("border")).select(*[F.col(f"o_{f.name}").alias(f.name) for f in _fields(schema)])
    return inside, done.where("border").select(*[F.col(f"r_{f.name}").alias(f.name) for f in _fields(ROW)])


def _with_id(df: DataFrame, conversations: DataFrame, *columns: str) -> DataFrame:
    plain = F.when(F.col("key") != "", F.substring(F.col("key"), F.lit(2), F.length("key")))
    return df.select(plain.cast(conversations.schema["conv_id"].dataType).alias("conv_id"), *columns)


def repair_report(conversations: DataFrame, absent: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``absent`` names a boolean column of rows that only say that their conversation exists.
    """
    inside, border = _solved(conversations, _report, REPORT, absent, partitions)
    choices, turns = _crossing(border)
    ordered = turns.select("key", "part", "place", "role", "text").repartition("key").sortWithinPartitions("key", "part", "place")
    shas = ordered.mapInArrow(_stream_digests, "key string, sha string")
    across = choices.where("audit IS NOT NULL").join(shas, "key", "left")
    across = across.select("key", *FIGURES, "audit", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
    return _with_id(inside.unionByName(across), conversations, *FIGURES, "audit", "repaired_sha256")


def repaired_turns(conversations: DataFrame, absent: str | None = None, partitions: int | None = None) -> DataFrame:
    """The repaired conversations: conv_id, part, place (their order), turn (null where inserted), role, text, edit (K, R or I)."""
    inside, border = _solved(conversations, _turns, TURNS, absent, partitions)
    turns = _crossing(border)[1]
    return _with_id(inside.unionByName(turns), conversations, "part", "place", "turn", "role", "text", "edit")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows lose, empty, cut or repeat their text or change their role by a checksum of conversation and turn; lost ones stay as ``absent``."""

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("absent"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage to every conversation, and its lightest repair."""
    return repair_report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), absent="absent")


def _sql() -> str:
    """The same automaton, row by row: per state the least text of cost and audit."""

    def plus(weight: str, cost: str, letter: str) -> str:
        return f"(lpad(({weight}[1:9]::INT + {cost})::VARCHAR, 9, '0') || {weight}[10:] || '{letter}')"

    def inserted(c0: str, c1: str, c2: str, c3: str) -> tuple[str, str, str, str]:
        return c0, c1, f"least({c2}, {plus(f'least({c0}, {c1}, {c3})', '5', 'I')})", f"least({c3}, {plus(c2, '5', 'I')})"

    free = "least(d.w0, d.w1, d.w3)"
    edited = ", ".join([
        f"{plus('d.w0', '2', 'D')} AS e0",
        f"least({plus('d.w1', '2', 'D')}, CASE WHEN r.free AND r.initial = 's' THEN {plus('d.w0', 'r.extra', 'K')} END) AS e1",
        f"least({plus('d.w2', '2', 'D')}, CASE WHEN r.free AND r.initial = 'u' THEN {plus(free, 'r.extra', 'K')} END, "
        f"CASE WHEN r.free THEN {plus(free, '1 + r.extra', 'R')} END) AS e2",
        f"least({plus('d.w3', '2', 'D')}, CASE WHEN r.free AND r.initial = 'a' THEN {plus('d.w2', 'r.extra', 'K')} END, "
        f"CASE WHEN r.free THEN {plus('d.w2', '1 + r.extra', 'R')} END) AS e3",
    ])
    once = ", ".join(f"{x} AS i{k}" for k, x in enumerate(inserted("e0", "e1", "e2", "e3")))
    twice = ", ".join(f"{x} AS w{k}" for k, x in enumerate(inserted("i0", "i1", "i2", "i3")))
    blank = SPACE.removeprefix("[").removesuffix("]+")
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id
  FROM conversations
), marked AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT),
            lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295)) % 20 AS kind FROM raw, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
), placed AS (
  SELECT *, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS i,
         regexp_replace(text, '[{blank}]+$', '') AS said
  FROM hurt
), judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
         CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN said[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), rows AS (
  SELECT *, fault IN ('', 'truncated') AS free, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged
), figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
         count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0 AS i, '000000000' AS w0, NULL::VARCHAR AS w1, '000000005I' AS w2, '000000010II' AS w3 FROM figures
  UNION ALL
  SELECT conv_id, i, {twice} FROM (SELECT conv_id, i, {once} FROM (
    SELECT r.conv_id, r.i, {edited} FROM ways d JOIN rows r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1))
), ends AS (
  SELECT f.*, least(w.w0, w.w3)[1:9]::BIGINT AS cost, least(w.w0, w.w3)[10:] AS audit
  FROM figures f JOIN ways w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n
), walk AS (
  SELECT conv_id, audit, 0 AS p, 0 AS i, 0 AS q, NULL::VARCHAR AS line FROM ends
  UNION ALL
  SELECT conv_id, audit, p, i, CASE WHEN said IS NULL THEN q WHEN left(said, 1) = 's' THEN 1 WHEN left(said, 1) = 'u' THEN 2 ELSE 3 END,
         CASE WHEN said IS NOT NULL THEN said || ':' || coalesce(text, '') END
  FROM (SELECT w.conv_id, w.audit, w.p + 1 AS p, w.i + (e <> 'I')::INT AS i, w.q, r.text,
               CASE e WHEN 'K' THEN r.role WHEN 'D' THEN NULL ELSE CASE WHEN w.q = 2 THEN 'assistant' ELSE 'user' END END AS said
        FROM (SELECT *, audit[p + 1] AS e FROM walk WHERE p < length(audit)) w
        LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND e <> 'I' AND r.i = w.i + 1)
), repaired AS (
  SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY p), '')) AS sha FROM walk GROUP BY conv_id
)
SELECT c.conv_id, coalesce(e.gaps, 0)::BIGINT AS gaps, coalesce(e.blank, 0)::BIGINT AS blank, coalesce(e.duplicate, 0)::BIGINT AS duplicate,
       coalesce(e.truncated, 0)::BIGINT AS truncated, coalesce(e.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
       coalesce(e.audit, '') AS audit, coalesce(r.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
