import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import COLUMNS, prose, rows_of
from textloom.llm import secrets as s
from textloom.llm.decontamination import decontaminate, find_contained

KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_spans(text):
    out = [(x.start(), k, x.end()) for k, (_, p, g, n) in enumerate(KINDS) for x in p.finditer(text or "") if len(x.group(g)) >= n]
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_match_brute_force(spark):
    draw = random.Random(2)
    parts = ["token", "=", ": ", "'", '"', "secret", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "cafe", " ", "é", "api_key", "passwd=", "x", "\n", "token=token:abcdefgh"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(300)] + [None, "", "TOKEN = abc123", "AKIA" * 12]
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    for r in s.scan(df).select("doc_id", s.written(F.col("base")).alias("b")).collect():
        assert r.b == base_spans(texts[r.doc_id]), texts[r.doc_id]


def entropy_span(text, window, least):
    def entropy(x):
        return -sum(x.count(c) / len(x) * math.log2(x.count(c) / len(x)) for c in set(x))

    hot = [i for i in range(len(text) - window + 1) if entropy(text[i : i + window]) >= least - 1e-12]
    return (hot[0], hot[-1] + window) if hot else None


def test_hot_window_matches_brute_force(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("aab" if i % 3 else s.ALPHABET) for _ in range(draw.randrange(20, 90))) for i in range(40)]
    texts += ["a" * 30 + "".join(draw.sample(s.ALPHABET, 40)) + "b" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    window = s.hot_window(F.split("x", ""), F.lit(20), F.lit(3.6))
    for r in df.select("i", window.alias("w")).collect():
        assert (tuple(r.w) if r.w else None) == entropy_span(texts[r.i], 20, 3.6)


@pytest.mark.parametrize(
    "text,found",
    [
        ("key Zm9vYmFyUXV4MTIzNDU2Nzg5MEFCQ0RFRkdISg== end", True), ("id 3f2504e0-4f89-11d3-9a0c-0305e82c3301", False),
        ("averyveryveryverylongordinaryword", False), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", False), ("example_x9Kd72hQpLz81mNvBt45wRsYc0", False),
        ("x9Kd72hQpLz81mNvBt45wRsYc0", True), ("12345678901234567890123456", False),
    ],
)
def test_entropy_and_allow_list(spark, text, found):
    df = spark.createDataFrame(rows_of([text]), COLUMNS)
    assert ("entropy" in s.scan(df).select(s.written(F.col("spans"))).first()[0]) is found


def all_spans(text):
    """Base spans, and every hot candidate of what they leave, as plain Python."""
    base = [(x.start(), k, x.end()) for k, (_, p, g, n) in enumerate(KINDS) for x in p.finditer(text) if len(x.group(g)) >= n]
    left = list(text)
    for a, _, b in base:
        left[a:b] = " " * (b - a)
    out = list(base)
    for x in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", "".join(left)):
        c, words = x.group(), x.group().rstrip("=")
        if len(c) < 20 or len(words) < 18 or re.search(s.ALLOWED, c) or not re.search(s.NOT_WORDS, c):
            continue
        kind = 0 if re.fullmatch("[0-9A-Fa-f]+", c) else 1 if c.isalnum() else 2
        if entropy_span(c, *s.CLASSES[kind][1:]):
            out.append((x.start(), len(KINDS), x.end()))
    names = [k[0] for k in KINDS] + ["entropy"]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_all_spans_match_brute_force(spark):
    draw = random.Random(17)
    letters = s.ALPHABET[:52]

    def part():
        n = draw.choice((18, 19, 20, 22, 40, 60))
        return draw.choice([
            "".join(draw.choice(s.ALPHABET[:64]) for _ in range(n)), "".join(draw.choice("0123456789abcdef") for _ in range(n)),
            "".join(draw.choice("0123456789ABCDEF") for _ in range(n)), "".join(draw.choice(letters) for _ in range(n)),
            "token=abcdef12", "key=", "==", "=", " ", "é ", "\n", "AKIA" + "".join(draw.choice("ABCDEFGH2345") for _ in range(16)),
            "notes-from-the-long-meeting-3", "SomeCamelCaseFactoryBeanName", "/usr/share/doc/libraries/python3", "3f2504e0-4f89-11d3-9a0c-0305e82c3301",
            "example_" + "".join(draw.choice(letters) for _ in range(20)), "x" * 20, "averyveryveryverylongordinaryword",
        ])

    texts = ["".join(draw.choice(["", " ", " "]) + part() for _ in range(draw.randrange(1, 9))) for _ in range(400)]
    got = {r.doc_id: r.w for r in s.scan(spark.createDataFrame(rows_of(texts), COLUMNS)).select("doc_id", s.written(F.col("spans")).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == [all_spans(t) for t in texts]
    assert sum("entropy" in w for w in got.values()) > 150


def test_whole_keys_are_spans(spark):
    draw = random.Random(3)
    key = lambda n, a=s.ALPHABET[:64]: "".join(draw.choice(a) for _ in range(n))
    hexes, long_key, split = key(26, "0123456789abcdef"), key(100_000), (key(60), key(60))
    texts = [f"key {key(60)} end", f"{split[0]}/Z{hexes}Z/{split[1]}", long_key, f"at {key(40, s.ALPHABET[:52])} end", f"pass/ab/cd/{key(40)} q"]
    found = {r.doc_id: r.spans for r in s.scan(spark.createDataFrame(rows_of(texts), COLUMNS)).collect()}
    ends = {i: [(x.start, x.end) for x in found[i]] for i in found}
    assert ends[0] == [(4, 64)] and ends[2] == [(0, 100_000)] and ends[3] == [(3, 43)] and ends[4] == [(0, 51)]
    assert [x.kind for x in found[1]] == [3, 2, 3] and ends[1][0] == (0, 62) and ends[1][2][1] == len(texts[1])
    clean = [r.text for r in s.redact(spark.createDataFrame(rows_of(texts), COLUMNS)).orderBy("doc_id").collect()]
    assert clean[0] == "key [secret] end" and clean[1] == "[secret][secret][secret]"


def test_short_base64_and_upper_hex_keys_are_found(spark):
    draw = random.Random(11)
    base64 = ["".join(draw.sample(s.ALPHABET[:62], 18)) + "-_7q"[: n - 18] for n in (20, 21, 22) for _ in range(20)]
    upper = ["".join(draw.sample("0123456789ABCDEF" * 2, n)) for n in (20, 32) for _ in range(20)]
    base64 = [x for x in base64 if any(c.isdigit() for c in x)]
    upper = [u for u in upper if len(set(u[:20])) >= 11 and not u.isdigit() and not u.isalpha()]
    texts = [f"key {x} end" for x in base64 + upper]
    assert len(upper) > 25 and len(base64) > 50
    for r in s.scan(spark.createDataFrame(rows_of(texts), COLUMNS)).select("doc_id", s.written(F.col("spans")).alias("w")).collect():
        assert "entropy" in r.w, texts[r.doc_id]
    plain = ["see notes-from-the-meeting-3 now", "DEADBEEFDEADBEEFDEADBEEF00 x", "a 2024-03-11_2024-03-12_a b"]
    assert all("entropy" not in r.w for r in s.scan(spark.createDataFrame(rows_of(plain), COLUMNS)).select(s.written(F.col("spans")).alias("w")).collect())


def test_secret_edges(spark, nothing, messy):
    assert s.scan(nothing).count() == 0
    assert s.scan(messy).count() == messy.count()
    df = spark.createDataFrame(rows_of(["a token=abcdef1 é password: hunter22!", None]), COLUMNS)
    assert [r.text for r in s.redact(df).orderBy("doc_id").collect()] == ["a [secret] é [secret]!", ""]
    empty = hashlib.sha256(b"").hexdigest()
    assert s.scan(df).where("doc_id = 1").select(F.sha2(s.written(F.col("base")), 256)).first()[0] == empty


def contained(text, item):
    w, v = (re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower()) for x in (text, item))
    k = min(5, len(v))
    if not k:
        return None
    a = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    b = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
    return (len(b), len(a & b)) if 100 * len(a & b) >= 80 * len(b) else None


def test_containment_matches_brute_force(spark):
    items = [prose(1000 + i, n) for i, n in enumerate((3, 4, 5, 9, 12, 40, 41, 90))] + [None, " ", "one"]
    draw = random.Random(8)
    texts = []
    for i in range(60):
        w = prose(i, 150).split(" ")
        v = list((draw.choice(items) or "x").split(" "))
        if len(v) > 8 and i % 3 == 0:
            v[draw.randrange(len(v))] = "changed"
        at = draw.randrange(len(w))
        texts.append(" ".join(w[:at] + v + w[at:]))
    texts += [None, "", "one", prose(50, 20_000) + " " + items[5]]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, j): c for i, t in enumerate(texts) for j, x in enumerate(items) if (c := contained(t, x))}
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in find_contained(docs, bench).collect()}
    assert got == want and len(want) > 40
    clean = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want}


def test_leak_edges(spark, nothing, messy):
    bench = spark.createDataFrame([(1, prose(1, 80)), (None, prose(3, 80)), (2, None)], "item_id long, text string")
    assert find_contained(nothing, bench).count() == 0
    assert find_contained(messy, bench.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in find_contained(messy, bench).collect()} == {(1, 1), (4, 1), (None, None)}
    assert decontaminate(messy, bench).columns == messy.columns
