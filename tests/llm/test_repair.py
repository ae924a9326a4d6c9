import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from textloom.llm import conversation_repair as repair
from textloom.llm.chat_format import format_conversations, op12_chat_format, parse

TURNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def plain_rows(rows):
    """Rows of one conversation as the operator takes them: (turn, role, text) by turn, nulls first, then digest."""
    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(SPACES)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute_force(rows, most_inserts=3):
    """Every way to edit the rows, the (cost, audit, lines) that is least."""
    marks, best = faults(rows), None
    for edits in itertools.product("DKua", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, marks)):
            continue
        base = sum({"D": 2, "K": 0}.get(e, 1) + 5 * (e != "D" and f == "truncated") for e, f in zip(edits, marks))
        kept = []
        for e, (_, role, text) in zip(edits, rows):
            kept.append((e if e in "DK" else "R", None if e == "D" else role if e == "K" else {"u": "user", "a": "assistant"}[e], text))
        for n in range(most_inserts + 1):
            if best and base + 5 * n > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    new = list(kept)
                    for at, role in sorted(zip(places, roles), key=lambda x: x[0], reverse=True):
                        new.insert(at, ("I", role, ""))
                    initials = "".join((r[:1] or "-") for _, r, _ in new if r is not None)
                    if re.fullmatch("(s?(ua)+)?", initials):
                        found = (base + 5 * n, "".join(e for e, _, _ in new), [f"{r}:{t}" for _, r, t in new if r is not None])
                        best = min(best or found, found)
    return best


def random_conversation(draw, n):
    texts = ["yes.", "no", "", " \t", "yes.", "Wait!", "why?\n", "cut of"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(draw.choice([None, 0, 1, 2, 5, 9]), draw.choice(roles), draw.choice([*texts, None])) for _ in range(n)]


def test_repair_is_the_cheapest_and_the_first_of_equals(spark):
    draw = random.Random(5)
    talks = {i: random_conversation(draw, draw.randrange(0, 5)) for i in range(60)}
    df = spark.createDataFrame([(i, *r) for i, rows in talks.items() for r in rows], TURNS)
    expected = {i: plain_rows(rows) for i, rows in talks.items() if rows}
    for partitions in (None, 23):
        got = {r.conv_id: r for r in repair.repair_report(df, partitions=partitions).collect()}
        assert got.keys() == expected.keys()
        for i, rows in expected.items():
            cost, audit, lines = brute_force(rows)
            turns = [t for t, _, _ in rows if t is not None]
            initials = [r[:1] for _, r, _ in rows]
            marks = faults(rows)
            assert (got[i].cost, got[i].audit) == (cost, audit), (rows, got[i])
            assert got[i].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
            assert got[i].gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
            assert [got[i][f] for f in ("blank", "duplicate", "truncated")] == [marks.count(f) for f in ("blank", "duplicate", "truncated")]
            assert got[i].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def test_long_conversation_is_spread_and_comes_out_the_same(spark):
    """One conversation has most rows, some of them copies of one row, and crosses many partitions."""
    draw = random.Random(8)
    rows = [(1, *r) for r in random_conversation(draw, 700)] + [(1, 7, "user", "same row.")] * 500
    rows += [(i, 0, "user", "hi.") for i in range(2, 30)]
    df = spark.createDataFrame(rows, TURNS)
    own = plain_rows([r[1:] for r in rows if r[0] == 1])
    cost, audit = repair.lightest([(r[:1], f) for (_, r, _), f in zip(own, faults(own))])
    results = []
    for partitions in (1, 40):
        results.append(sorted(map(tuple, repair.repair_report(df, partitions=partitions).collect())))
        turns = repair.repaired_turns(df, partitions=partitions).where("conv_id = 1").orderBy("part", "place").collect()
        initials = "".join(t.role[:1] for t in turns)
        assert re.fullmatch("(s?(ua)+)?", initials)
        done = next(r for r in results[-1] if r[0] == 1)
        assert done[6:8] == (cost, audit)
        assert done[8] == hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest()
    assert results[0] == results[1]


def test_blocks_combine_to_what_one_agenda_finds():
    draw = random.Random(2)
    for _ in range(40):
        items = [(draw.choice("suuaaax"), draw.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(draw.randrange(1, 60))]
        whole = repair.derive(items, 0, goal=True)[-1]
        cut = draw.randrange(len(items))
        span = repair.combine(repair.block_span(items[:cut]), repair.block_span(items[cut:]))
        assert min(span[0, g] for g in repair.GOALS if (0, g) in span) == whole


def test_repair_edges(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert repair.repair_report(nothing).count() == 0 and repair.repaired_turns(nothing).count() == 0
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, 1, "user", "x" * 300_000), (1, 1, "user", "x" * 300_000), (2, 5, "user", "gone.")]
    df = spark.createDataFrame(rows, TURNS).withColumn("absent", F.col("conv_id").eqNullSafe(2))
    for name in ("key", "part", "seq", "same", "copy", "fresh", "border"):
        df = df.withColumn(name, F.lit(7))
    got = {r.conv_id: r for r in repair.repair_report(df, absent="absent").collect()}
    assert got.keys() == {None, 1, 2}
    assert (got[2].cost, got[2].audit, got[2].gaps, got[2].repaired_sha256) == (0, "", 0, repair.EMPTY_SHA)
    assert got[1].audit == "DD" and got[1].duplicate == 1
    assert got[None].audit == "DD" and got[None].blank == 1


# --- formatting ------------------------------------------------------------------------------------


ODD = [
    "", None, "plain", "### x", "#### x", r"\### x", r"a\\### </turn>", "</turn>", "\n</turn>\n### user:\nhi", "x\\", "\\", "### </turn>###", "### ### ",
    "é\U0001f600 </turn></turn>", "a" * 200_000 + "### ", ":\n", "%20+", "\\\\\\</turn>\\",
]
ROLES = ["user", "assistant", "a:b\n### x", None, "assistant", ""]


def test_formatted_conversations_read_back(spark):
    draw = random.Random(3)
    talks = {i: [(draw.choice([None, 1, 1, 2, 3]), draw.choice(ROLES), draw.choice(ODD)) for _ in range(draw.randrange(1, 7))] for i in range(40)}
    talks[None] = [(1, "user", "x"), (1, "user", "x")]
    df = spark.createDataFrame([(i, *r) for i, rows in talks.items() for r in rows], TURNS)
    for name in ("at", "piece", "digest", "s", "turns", "rung", "formatted"):
        df = df.withColumn(name, F.lit(1))
    done = format_conversations(df).withColumn("back", parse(F.col("formatted"))).collect()
    assert {r.conv_id for r in done} == talks.keys()
    for r in done:
        source = sorted((role or "", text or "") for _, role, text in talks[r.conv_id])
        assert r.identical and sorted((t.role, t.text) for t in r.back) == source
        trained = [t.text for t in r.back if t.role == "assistant"]
        bodies = [re.sub(r"\\(\\*(?:### |</turn>))", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert bodies == trained
        # Without what was escaped, the text has one mark of each kind a turn.
        assert len(re.findall(r"(?<!\\)### ", r.formatted)) == len(re.findall(r"(?<!\\)</turn>", r.formatted)) == len(source)


def test_texts_without_marks_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello \\ there"), (1, 1, "assistant", "<turn> ##")], TURNS)
    row = format_conversations(df).first()
    assert row.formatted == "### user:\nhello \\ there\n</turn>\n### assistant:\n<turn> ##\n</turn>\n" and row.n_escaped == 0


def test_format_edges(spark, tmp_path):
    assert format_conversations(spark.createDataFrame([], TURNS)).count() == 0
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = op12_chat_format(spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in rows] == [(-7, 2, 26)]
    assert rows[0].loss_sha256 == hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest()
    plan = op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
