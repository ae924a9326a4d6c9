import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """Text of n made-up words; other seeds give other words."""
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(400)) for _ in range(n)) + "."


def rows_of(texts, sources=None):
    sources = sources or ["a"] * len(texts)
    return [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources))]


@pytest.fixture(scope="session")
def corpus(spark):
    """Fifty texts with exact and near copies, nulls, empty and blank ones, one word, one very long text and repeated rows."""
    base = [prose(i, 60 + i) for i in range(30)]
    near = [b.replace(".", f" changed{i}.") for i, b in enumerate(base[:8])]
    odd = [None, "", " \t\n", "word", "word", "two words", "Zwölf Füße é\xa0x", prose(99, 20_000)]
    texts = base + base[:4] + near + odd
    rows = rows_of(texts, [["a", "b", None, "c"][i % 4] for i in range(len(texts))])
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, repeated ids and rows, and columns with names the operators use themselves."""
    rows = [
        (1, prose(1, 80), "en", "a", 10), (1, prose(1, 80), "en", "a", 10), (1, prose(2, 80), None, None, None), (None, prose(3, 80), "en", "a", 1),
        (None, None, None, None, None), (2, None, "de", "b", None), (3, "", "de", "b", 0), (4, prose(1, 80), "fr", "b", 5),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("size", "target", "src", "kept", "doc", "_w", "_row", "_id", "_gone", "_pieces", "n_words", "_start", "words", "item", "tokens"):
        df = df.withColumn(name, df.n_chars)
    return df
