import random
from difflib import SequenceMatcher

import pytest

from textloom.operators import matching


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(50, 200))).strip().ljust(50, "x") for _ in range(n)]


def run(spark, inputs, refs, **options):
    left = spark.createDataFrame(list(enumerate(inputs)), "i long, t string")
    right = spark.createDataFrame(list(enumerate(refs)), "r long, s string")
    rows = matching.match_by_length(left, right, "i", "t", "r", "s", **options).collect()
    assert sorted(r["input_id"] for r in rows) == list(range(len(inputs)))  # nothing lost or doubled
    assert all(refs[r["ref_id"]] == r["ref_text"] for r in rows)
    return {r["input_id"]: r["ref_id"] for r in rows}


def bounds(text):
    n = len(text.strip())
    return max(5, int(n * 0.7)), int(n * 1.3)


def too_similar(a, b, threshold=0.9):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() > threshold


@pytest.mark.parametrize("threshold", [None, 0.9])
def test_lengths_and_similarity(spark, threshold):
    inputs, refs = texts(60, 1), texts(80, 2)
    inputs[:20] = refs[:20]  # copies of references must get another one
    got = run(spark, inputs, refs, threshold=threshold)
    for i, text in enumerate(inputs):
        low, high = bounds(text)
        eligible = [r for r in range(len(refs)) if low <= len(refs[r]) <= high
                    and (threshold is None or not too_similar(refs[r], text))]
        assert not eligible or got[i] in eligible


def test_many_similar_candidates(spark):
    """A third of the references are near copies of the input."""
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    near = [base[:-1] + c for c in "abcdefghijklmnopqrstuvwxyz"]
    refs = near + texts(52, 3)
    got = run(spark, [base, texts(1, 4)[0]], refs)
    low, high = bounds(base)
    assert any(low <= len(r) <= high for r in refs[26:])
    assert got[0] >= 26


def test_only_similar_candidates_fall_back(spark):
    base = "z" * 60
    refs = ["z" * 59 + c for c in "abcd"] + ["q" * 300]
    assert run(spark, [base], refs)[0] == 4  # the unused one outside the range


def test_copies_take_different_references(spark):
    refs = texts(30, 5)
    inputs = ["  Hello world this is one repeated comment of some length ok" + " " * (i % 3) for i in range(25)]
    inputs = [t.upper() if i % 2 else t for i, t in enumerate(inputs)]
    for threshold in (None, 0.9):
        got = run(spark, inputs, refs, threshold=threshold)
        assert len(set(got.values())) == 25
    more = run(spark, inputs * 2, refs, threshold=None)
    assert len(set(more.values())) == 30  # all used once before any is used again


def test_bins_and_probe_limit(spark):
    refs = texts(50, 6)
    got = run(spark, refs[:10], refs, bin_size=20, max_probes=30)
    for i, r in got.items():
        low, high = bounds(refs[i])
        assert low // 20 * 20 <= len(refs[r]) < high // 20 * 20 + 20
    near = ["z" * 59 + c for c in "abcd"]
    assert run(spark, ["z" * 60], near, bin_size=20, max_probes=2)[0] in range(4)


def test_needs_references(spark):
    with pytest.raises(ValueError, match="no reference"):
        run(spark, ["a"], [], threshold=None)


def test_ratio(spark):
    rows = [("abcd", "ABCE"), ("", ""), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(matching.similarity_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "abcd", "abce").ratio(), 1.0, None]


def test_letter_counts_bound_the_ratio(spark):
    rng = random.Random(9)
    alphabet = "aaaeeeinrst äéÖñß.,5\n\U0001f600xQ"
    rows = []
    for _ in range(300):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        b = "".join(c for c in a if rng.random() < 0.9) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 5)))
        rows.append((a, b if rng.random() < 0.7 else "".join(rng.sample(b, len(b)))))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("*", matching.ratio_bound(matching.letter_counts("a"), matching.letter_counts("b")).alias("bound")).collect():
        assert SequenceMatcher(None, r.a.lower(), r.b.lower()).ratio() <= r.bound + 1e-12 <= 1 + 2e-12


def test_only_undecided_pairs_are_compared(spark):
    """Unlike letters never reach Python; near copies do."""
    refs = ["b" * 60 + str(i) for i in range(8)] + ["a" * 60 + str(i) for i in range(3)]
    left = spark.createDataFrame([(0, "a" * 61), (1, "q" * 61)], "i long, t string")
    right = spark.createDataFrame(list(enumerate(refs)), "r long, s string")
    got = {r.input_id: r for r in matching.match_by_length(left, right, "i", "t", "r", "s").collect()}
    assert got[0].ref_id < 8 and got[0].compared <= 3 and got[0].probes >= 1
    assert got[1].compared == 0 and got[1].probes == 1


def test_checked_facts_carry_no_long_texts(spark, tmp_path, monkeypatch):
    """What a match is checked by: texts only of pairs that are compared, digests of all others; a wrong text is still found."""
    from textloom.catalog import sampling as catalog

    short, long = texts(60, 8), [t * 60 for t in texts(20, 9)]
    docs = spark.createDataFrame(list(enumerate([*short, *long, None, "", short[0]])), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stored = []
    keep = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, name="stage": stored.append(keep(df, name)) or stored[-1])
    got = catalog.v15_checked(spark, str(tmp_path)).collect()
    assert len(got) == 83 and all(r["exists"] and r["different"] and r["fresh"] and r["few_compared"] for r in got)
    held = [c for c, kind in stored[-1].dtypes if kind == "string"]
    assert max(len(r[c] or "") for r in stored[-1].collect() for c in held) < 1000

    rows = [(0, 1, short[1] + "!", 1, 1), (2, 2, short[2], 1, 1), (61, 3, short[3], 1, 0)]
    matched = spark.createDataFrame(rows, "input_id long, ref_id long, ref_text string, probes long, compared long")
    facts = {r["input_id"]: r for r in catalog._checked(spark, str(tmp_path), matched).collect()}
    assert [facts[i]["exists"] for i in (0, 2, 61)] == [False, True, True]
    assert [facts[i]["different"] for i in (2, 61)] == [False, True] and not facts[61]["inside"]
