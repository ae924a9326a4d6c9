"""Quality classifier from weak labels.

A document can be bad in four ways: markup, shouting, repetition, toxicity. For each of
these questions several overlapping heuristic labellers vote. Labellers of one question measure the same
thing in different ways, which is what lets expectation-maximisation tell how often each is right. It gives
the posterior of every pattern of votes and works on counts per pattern, which are exact over all
documents and at most 3 ** labellers rows, so it runs on the driver.

Two toxicity labellers look for words: a short English lexicon, and words mined from documents that
people labelled: those that occur in toxic ones far more often than chance allows and hardly in others. The mined
list comes from at most ``labelled`` drawn labels (a documented bound); all of it is sent to every task.

The posteriors then train one linear scorer per question over hashed words and votes by
full-batch gradient steps; each step sums partial gradients of the tasks. Training uses a seeded sample of
about ``train_rows`` documents (a documented bound); the label model and the scoring cover all.
A document is kept when no scorer finds it more likely bad than good.

Defined results: null, empty and blank texts get no votes and no words; all scores are those of
the prior, so they are kept while bad documents are the minority. A null id is an id like any other. Ties at 0.5 are rejected. Empty
tables give empty results. Other columns pass through in :func:`keep_good` and take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm.arrays import IS_SPACE, LOWER, Texts, hash_of, mix64, text_slices
from textloom.llm.common import checkpointed, documents

# English insults.
INSULTS = (
    "brainless", "clown", "despicable", "disgusting", "dumb", "garbage", "idiot", "imbecile", "loser", "moron",
    "pathetic", "repulsive", "scum", "stupid", "trash", "useless", "weirdo", "worthless",
)

QUESTIONS = {
    "markup": ("words with symbols", "bare punctuation", "share of letters"),
    "shouting": ("words in capitals", "letters in capitals", "exclamation marks"),
    "repetition": ("repeated pairs", "same word again", "same word nearby"),
    "toxic": ("English lexicon", "mined words", "several", "density"),
}
NEARBY = 6
BITS = 16
DIMENSIONS = 1 << BITS
TRAIN_ROWS = 20_000
LABELLED = 1_000_000  # labels of 9 bytes
CANDIDATES = 500_000  # words of 8 bytes
STEPS = 12
TRAIN_PARTS = 8
HEADS = len(QUESTIONS)
VOTE_WEIGHT = 1.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ONLY_LETTERS = np.where(_LETTER, LOWER, 0x20).astype(np.uint8)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=_@"]] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True


def _per_word(mask: np.ndarray, texts: Texts) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[texts.end] - sums[texts.start]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _vote(share: np.ndarray, bad_from: float, good_to: float, counts: np.ndarray, least: int = 1) -> np.ndarray:
    out = np.where(share >= bad_from, 1, np.where(share <= good_to, 0, -1))
    return np.where(counts >= least, out, -1)


def votes(data: np.ndarray, offsets: np.ndarray, mined: np.ndarray) -> tuple[list[np.ndarray], Texts]:
    """Votes per question, text x labeller (1 bad, 0 good, -1 none), and the letter words."""
    raw = Texts(data, offsets)
    n = raw.counts()
    some = np.maximum(n, 1)
    symbols = _per_text(_per_word(_SYMBOL[data], raw) > 0, raw.bounds) / some
    bare = _per_text(_per_word(_ALNUM[data], raw) == 0, raw.bounds) / some
    letters = _per_text(_LETTER[data], offsets)
    others = 1 - letters / np.maximum(_per_text(~IS_SPACE[data], offsets), 1)
    markup = [_vote(symbols, 0.3, 0.05, n), _vote(bare, 0.15, 0.03, n), _vote(others, 0.2, 0.1, n)]
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    caps = _per_text((_per_word(upper, raw) >= 2) & (_per_word(lower, raw) == 0), raw.bounds) / some
    capitals = _per_text(upper, offsets) / np.maximum(_per_text(upper | lower, offsets), 1)
    marks = _per_text(data == 0x21, offsets) / some
    shouting = [_vote(caps, 0.4, 0.1, n), _vote(capitals, 0.4, 0.15, n), _vote(marks, 0.4, 0.1, n)]
    # The same word again, nearby, and distinct pairs of neighbours.
    h, doc = raw.hashes(), raw.doc_of_word()
    equal = [np.concatenate([np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])]) for k in range(1, NEARBY)]
    again = _per_text(equal[0], raw.bounds) / some
    nearby = _per_text(np.logical_or.reduce(equal), raw.bounds) / some
    within = doc[1:] == doc[:-1]
    pairs, pair_doc = mix64(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])[within], doc[1:][within]
    order = np.argsort(pairs)
    order = order[np.argsort(pair_doc[order], kind="stable")]
    p, d = pairs[order], pair_doc[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    repeated = 1 - np.bincount(d[new], minlength=len(n)) / np.maximum(n - 1, 1)
    repetition = [_vote(repeated, 0.5, 0.3, n, 10), _vote(again, 0.3, 0.05, n, 10), _vote(nearby, 0.5, 0.2, n, 10)]
    words = Texts(_ONLY_LETTERS[data], offsets)
    hashes = words.hashes()
    english = np.isin(hashes, np.array([hash_of(w.encode()) for w in INSULTS], np.uint64))
    known = np.isin(hashes, mined)
    a, b, both = (_per_text(x, words.bounds) for x in (english, known, english | known))
    m = words.counts()
    seen = _vote(b, 2, 0, m) if len(mined) else np.full(len(m), -1)
    toxic = [_vote(a, 1, 0, m), seen, _vote(both, 3, 0, m), _vote(both * 1000 / np.maximum(m, 1), 3, 0, m)]
    return [np.stack(v, axis=1) for v in (markup, shouting, repetition, toxic)], words


def _code(votes_: np.ndarray) -> np.ndarray:
    """Pattern of votes as one number in base 3."""
    return ((votes_ + 1) * 3 ** np.arange(votes_.shape[1])).sum(axis=1)


def _decode(code: np.ndarray, labellers: int) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(labellers) % 3 - 1


def features(every: list[np.ndarray], words: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed feature and value. Distinct words weigh 1 / sqrt(distinct words); a vote weighs 1."""
    doc = words.doc_of_word()
    index = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(doc * DIMENSIONS + index)
    doc, index = both >> BITS, both & (DIMENSIONS - 1)
    counts = np.bincount(doc, minlength=len(words))
    value = 1 / np.sqrt(np.maximum(counts, 1))[doc]
    joined = np.concatenate(every, axis=1)
    r, c = np.nonzero(joined >= 0)
    named = mix64((c * 2 + joined[r, c] + 1).astype(np.uint64)) >> np.uint64(64 - BITS)
    return np.concatenate([doc, r]), np.concatenate([index, named.astype(np.int64)]), np.concatenate([value, np.full(len(r), VOTE_WEIGHT)])


def _label_rows(batches: Iterator[pa.RecordBatch], mined: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, sampled) to vote patterns, and features where sampled."""
    for batch in batches:
        sampled = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, data, offsets in text_slices(batch.column(1)):
            every, words = votes(data, offsets, mined)
            lists: list[list[int] | None] = [None] * (j - i)
            values: list[list[float] | None] = [None] * (j - i)
            if sampled[i:j].any():
                row, index, value = features(every, words)
                order = np.argsort(row, kind="stable")
                bounds = np.searchsorted(row[order], np.arange(j - i + 1))
                for r in np.flatnonzero(sampled[i:j]):
                    mine = order[bounds[r] : bounds[r + 1]]
                    lists[r], values[r] = index[mine], value[mine]
            yield pa.record_batch(
                [*[pa.array(_code(v), pa.int32()) for v in every], pa.array(lists, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                names=[*QUESTIONS, "index", "value"],
            )


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of bad per pattern, accuracies (labeller x [good, bad]) and prior.

    Two classes, labellers independent given the class, no vote is no evidence. It begins with
    labellers that are right four times in five and a minority of bad documents; pseudo-counts keep
    probabilities off 0 and 1.
    """
    m = patterns.shape[1]
    right = np.full((m, 2), 0.8)
    prior = 0.1
    for _ in range(rounds):
        logs = np.log(np.array([1 - prior, prior]))[None, :].repeat(len(patterns), axis=0)
        for k in range(m):
            for c in range(2):
                logs[:, c] += np.where(patterns[:, k] < 0, 0, np.where(patterns[:, k] == c, np.log(right[k, c]), np.log(1 - right[k, c])))
        logs -= logs.max(axis=1, keepdims=True)
        posterior = np.exp(logs[:, 1]) / np.exp(logs).sum(axis=1)
        total = counts.sum()
        prior = float(min(0.5, (counts @ posterior + 1) / (total + 10)))
        for k in range(m):
            for c, share in enumerate((1 - posterior, posterior)):
                cast = (counts * share)[patterns[:, k] >= 0].sum()
                agreed = (counts * share)[patterns[:, k] == c].sum()
                right[k, c] = (agreed + 8) / (cast + 10)
    return posterior, right, prior


def _gradient_rows(batches: Iterator[pa.RecordBatch], shared: Broadcast, tables: list[dict]) -> Iterator[pa.RecordBatch]:
    """Sum of gradients of the task's sampled documents, all heads; the last entry of a head is the bias."""
    weights = shared.value
    total = np.zeros((HEADS, DIMENSIONS + 1))
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        index, value = batch.column(HEADS), batch.column(HEADS + 1)
        flat = index.flatten().to_numpy().astype(np.int64)
        x = value.flatten().to_numpy().astype(np.float64)
        sizes = np.diff(index.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), sizes)
        rows += batch.num_rows
        for head in range(HEADS):
            target = np.array([tables[head][p] for p in batch.column(head).to_pylist()])
            margin = weights[head, -1] + np.bincount(row, x * weights[head, flat], minlength=batch.num_rows)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
            total[head, :-1] += np.bincount(flat, x * error[row], minlength=DIMENSIONS)
            total[head, -1] += error.sum()
    if rows:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([rows], pa.int64())], names=["gradient", "n"])


def train(sample: DataFrame, tables: list[dict], priors: list[float], steps: int = STEPS, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights per head by AdaGrad steps on the whole sample. A step returns one vector per task."""
    weights = np.zeros((HEADS, DIMENSIONS + 1))
    weights[:, -1] = [np.log(p / (1 - p)) for p in priors]
    seen = np.full_like(weights, 1e-6)
    # Written once in a few parts: a step is one narrow scan of the sample, without an exchange.
    parts = checkpointed(sample.repartition(TRAIN_PARTS), "sample")
    context = sample.sparkSession.sparkContext
    for _ in range(steps):
        shared = context.broadcast(weights)
        found = parts.mapInArrow(partial(_gradient_rows, shared=shared, tables=tables), "gradient binary, n long").toArrow()
        shared.destroy()
        n = sum(found.column("n").to_pylist())
        if not n:
            break
        gradient = decay * weights
        for part in found.column("gradient"):
            gradient += np.frombuffer(part.as_buffer()).reshape(weights.shape) / n
        seen += gradient**2
        weights = weights - rate * gradient / np.sqrt(seen)
    return weights


def _score_rows(batches: Iterator[pa.RecordBatch], weights: np.ndarray, mined: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column(1)):
            every, words = votes(data, offsets, mined)
            row, index, value = features(every, words)
            margins = [weights[h, -1] + np.bincount(row, value * weights[h, index], minlength=j - i) for h in range(HEADS)]
            scores = [1 / (1 + np.exp(-np.clip(m, -30, 30))) for m in margins]
            yield pa.record_batch(
                [batch.column(0).slice(i, j - i), *[pa.array(_code(v), pa.int32()) for v in every], *[pa.array(s) for s in scores]],
                names=["doc_id", *QUESTIONS, *[f"{q}_score" for q in QUESTIONS]],
            )


def _word_rows(batches: Iterator[pa.RecordBatch], only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (text) to distinct words with the number of texts of the slice that have them; ``only`` names the words that count."""
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            words = Texts(_ONLY_LETTERS[data], offsets)
            hashes, doc = words.hashes(), words.doc_of_word()
            if only is not None:
                there = np.isin(hashes, only)
                hashes, doc = hashes[there], doc[there]
            hashes, at = np.unique(hashes, return_inverse=True)
            pairs = np.unique(doc * max(len(hashes), 1) + at)
            counts = np.bincount(pairs % max(len(hashes), 1), minlength=len(hashes))
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], names=["word", "n"])


def _document_counts(texts: DataFrame, out: str, only: np.ndarray | None = None) -> DataFrame:
    return texts.select("text").mapInArrow(partial(_word_rows, only=only), "word long, n long").groupBy("word").agg(F.sum("n").alias(out))


def mined_words(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> np.ndarray:
    """Hashes of words that mark documents labelled toxic.

    A word counts when nine in ten of its labelled documents are toxic and so many would not
    come together by chance even once among all words (Bonferroni at 5 per cent). About ``labelled`` labels are
    used at most, drawn by hash, so that they can be sent to the scan of the texts.
    """
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic") == 1).alias("_bad"))
    n, bad = marks.agg(F.count("*"), F.count_if("_bad")).first()
    if not bad or bad == n:
        return np.zeros(0, np.uint64)
    drawn = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1_000_000)) < int(min(1.0, labelled / n) * 1_000_000)
    rows = docs.join(F.broadcast(marks.where(drawn)), docs["doc_id"] == F.col("_id"))
    toxic = checkpointed(_document_counts(rows.where("_bad"), "bad"), "toxic-words")
    least = np.log(20.0 * max(toxic.count(), 1)) / -np.log(bad / n)
    candidates = toxic.where(F.col("bad") >= least)
    only = None
    if candidates.count() <= CANDIDATES:
        only = np.array([r["word"] for r in candidates.select("word").collect()], np.int64).view(np.uint64)
    good = _document_counts(rows.where("not _bad"), "good", only)
    both = candidates.join(good, "word", "left").where(F.col("bad") >= 9 * F.coalesce("good", F.lit(0)))
    return np.sort(both.select("word").toArrow().column("word").to_numpy().astype(np.int64)).view(np.uint64)


def judged(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, kept, and per question the score and the label model's posterior, for every row."""
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    mined = mined_words(slim, labels) if labels is not None else np.zeros(0, np.uint64)
    n = slim.count()
    share = min(1.0, train_rows / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(42)), F.lit(1_000_000)) < int(share * 1_000_000)
    kinds = ", ".join(f"{q} int" for q in QUESTIONS)
    labelled = checkpointed(
        slim.select("doc_id", "text", drawn.alias("sampled")).mapInArrow(partial(_label_rows, mined=mined), f"{kinds}, index array<int>, value array<float>"), "votes"
    )
    tables, priors = [], []
    for question, labellers in QUESTIONS.items():
        # At most 3 ** labellers rows.
        rows = labelled.groupBy(question).count().collect()
        codes = np.array([r[0] for r in rows], np.int64)
        if len(codes):
            posterior, _, prior = fit_label_model(_decode(codes, len(labellers)), np.array([r[1] for r in rows], np.float64))
        else:
            posterior, prior = np.zeros(0), 0.1
        tables.append(dict(zip(codes.tolist(), posterior.tolist())))
        priors.append(prior)
    weights = train(labelled.where(F.col("index").isNotNull()), tables, priors)
    schema = f"doc_id long, {kinds}, " + ", ".join(f"{q}_score double" for q in QUESTIONS)
    scored = slim.mapInArrow(partial(_score_rows, weights=weights.astype(np.float32), mined=mined), schema)

    def lookup(table: dict, name: str) -> Column:
        pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
        return F.element_at(F.create_map(*pairs), F.col(name)) if pairs else F.lit(None).cast("double")

    kept = F.greatest(*[F.col(f"{q}_score") for q in QUESTIONS]) < 0.5
    posteriors = [lookup(t, q).alias(f"{q}_posterior") for t, q in zip(tables, QUESTIONS)]
    return scored.select("doc_id", kept.alias("kept"), *[f"{q}_score" for q in QUESTIONS], *posteriors)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Kept documents, columns unchanged. Rows that share an id share the worst verdict."""
    verdict = judged(docs, labels, key, text, **options)
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[key].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, scores and label posteriors of every document."""
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
