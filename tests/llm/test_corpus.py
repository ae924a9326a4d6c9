import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import COLUMNS, prose, rows_of
from textloom.llm.arrays import hash_of
from textloom.llm import language_model as lm, licenses, mixing, substring_dedup as sub, token_shards as shards


# --- language model ----------------------------------------------------------------------------


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_base_score_matches_brute_force(corpus):
    rows = corpus.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    count = collections.Counter(t for r in rows if not held[r.doc_id] for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    base = model = 0.0
    for r in lm.score(corpus).collect():
        own = tokens(next(x.text for x in rows if x.doc_id == r.doc_id))
        want = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(t in count for t in own), n)
        assert r.base_score == pytest.approx(want) and r.score < 0
        base, model = base + want * held[r.doc_id], model + r.score * held[r.doc_id]
    assert model > base


def test_score_matches_plain_sum(spark, corpus):
    """The same samplers fed with plain counts; every token looked up one by one."""
    texts = {r.doc_id: (tokens(r.text)[:-1], zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in corpus.collect()}
    signed = lambda w: int(np.array([hash_of(w.encode())], np.uint64).view(np.int64)[0])
    counts = collections.Counter(w for t, held in texts.values() if not held for w in t)
    top = sorted(counts, key=lambda w: (-counts[w], signed(w)))[: lm.CLASSES - 2]
    place = {w: i + 2 for i, w in enumerate(sorted(top, key=lambda w: hash_of(w.encode())))}
    assert len(counts) > len(top) > 1000

    def steps(t):
        c = [place.get(w, lm.RARE) for w in t] + [lm.STOP]
        return list(zip([lm.STOP, *c], c))

    pairs = collections.Counter(p for t, held in texts.values() if not held for p in steps(t))
    spectrum = sorted(collections.Counter(n for w, n in counts.items() if w not in place).items())
    grid, values = lm.sample_rare(np.array([c for c, _ in spectrum]), np.array([k for _, k in spectrum]), 42)
    base = np.zeros(lm.CLASSES)
    base[1 : 2 + len(top)] = 1.0
    base[lm.RARE] = len(counts) - len(top) + 1.0
    df = spark.createDataFrame([(u, w, n) for (u, w), n in pairs.items()], "u int, w int, n long")
    model = np.log10(lm.sample_contexts(df, base / base.sum(), 42))
    rare = lambda w: 0.0 if w in place else float(np.interp(np.log1p(counts[w]), np.log1p(grid), values))
    got = {r.doc_id: r.score for r in lm.score(corpus).collect()}
    for i, (t, _) in texts.items():
        assert got[i] == pytest.approx(sum(model[p] for p in steps(t)) + sum(rare(w) for w in t), rel=1e-4)


def test_rows_that_share_an_id_keep_their_own_score(spark, corpus):
    alone = {r.doc_id: r.score for r in lm.score(corpus).collect()}
    ids = [i for i in alone if zlib.crc32(str(i).encode()) % 10]
    texts = {r.doc_id: r.text for r in corpus.collect()}
    a, b, c = ids[:3]
    same = corpus.withColumn("doc_id", F.when(F.col("doc_id").isin(b, c), a).otherwise(F.col("doc_id")))
    assert len({texts[a], texts[b], texts[c]}) == 3
    got = sorted(r.score for r in lm.score(same).where(f"doc_id = {a}").collect())
    assert got == pytest.approx(sorted(alone[i] for i in (a, b, c)), rel=1e-6)


def test_sent_rows_are_linear(spark, corpus):
    rows = lambda n: n / lm.block_sizes(n)[0] * lm.block_sizes(n)[1]
    assert rows(64 << 30) < 70 * rows(1 << 30)
    few = corpus.where("length(text) < 100").select("doc_id", "text", F.lit(False).alias("held"), F.xxhash64("text").alias("a"), F.xxhash64("text").alias("b"))
    schema = "block long, range int, words binary, counts binary, ids binary, held binary, text binary, word binary, times binary"
    sent = few.coalesce(1).mapInArrow(lambda x: lm._block_rows(x, 100_000, lm.BLOCK_BYTES), schema).collect()
    own = [r for r in sent if r.range >= 0]
    assert 0 < len(own) <= sum(len(r.words) // 8 for r in own) and all(r.words for r in own)


def test_model_is_a_distribution():
    """Class probabilities after a context, and words inside the rare class, add up to 1."""
    counts, words = np.array([1, 2, 3, 10]), np.array([50, 20, 5, 1])
    grid, values = lm.sample_rare(counts, words, 1)
    share = 10 ** np.interp(np.log1p(np.array([0, *counts])), np.log1p(grid), values)
    assert (share * np.array([1, *words])).sum() == pytest.approx(1, abs=0.02)


def test_seating_keeps_between_one_and_all_tables():
    rng = np.random.Generator(np.random.PCG64(1))
    counts = np.array([1, 2, 5, 1000, 10**9])
    t = lm.seat(np.zeros(5, int), counts, np.full(5, 0.2), 0.75, 1.0, rng)
    assert (t >= 1).all() and (t <= counts).all() and t[0] == 1
    few = np.mean([lm.seat(np.zeros(1, int), np.array([3]), np.ones(1), 0.5, 1.0, np.random.Generator(np.random.PCG64(i)))[0] for i in range(4000)])
    # With a certain parent: second opens with (1 + .5) / 2, third with (1 + .5 t) / (3 .. ) by the same rule.
    second = 1.5 / (1.5 + 0.5)
    third = second * 2.0 / (2.0 + 1.0) + (1 - second) * 1.5 / (1.5 + 1.5)
    assert few == pytest.approx(1 + second + third, abs=0.03)


def test_model_edges(nothing, messy):
    assert lm.score(nothing).count() == 0
    rows = lm.score(messy.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4} and all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3))
    assert all(np.isfinite(r.score) for r in lm.score(messy).collect())


# --- substring dedup ----------------------------------------------------------------------------


def test_shared_passages_are_found_wherever_they_stand(spark):
    passage = prose(77, 55)
    texts = [prose(i, 100) for i in range(30)]
    for i in range(10, 20):
        w = texts[i].split(" ")
        texts[i] = " ".join([*w[: i * 3], passage, *w[i * 3 :]])
    texts += [None, "", passage[: len(passage) // 8], texts[3].replace("a", "a", 1) + " tail"]
    df = spark.createDataFrame(rows_of(texts), COLUMNS)
    rows = sub.repeated_spans(df).collect()
    assert {r.doc_id for r in rows} == {*range(10, 20), 3, 33}
    for r in rows:
        part = texts[r.doc_id][r.start : r.end]
        assert len(part.split()) == r.n_words and (part in passage or part in texts[3])
    left = {r.doc_id: r.text for r in sub.drop_repeats(df).collect()}
    assert left[10] == texts[10] and len(left[12]) < len(texts[12]) - len(passage) // 2 and left[30] is None


def pieces_of(text):
    """Texts of the chunks of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = sub.Texts(data, np.array([0, len(data)]))
    c = sub.chunks(words)
    return [text[words.start[a] : words.end[b]] for a, b in zip(c["first"], c["last"])]


def test_an_earlier_passage_goes_although_the_next_one_is_first_here(spark):
    pieces = pieces_of(prose(503, 160))[:-1]
    half = len(pieces) // 2
    early, late, border = " ".join(pieces[:half]), " ".join(pieces[half:]), " ".join(pieces[half - 3 : half])
    texts = [f"{prose(1, 40)} {early} {prose(2, 40)}", f"{prose(3, 40)} {early} {late} {prose(4, 40)}", f"{prose(5, 40)} {border} {late} {prose(6, 40)}"]
    left = {r.doc_id: r.text for r in sub.drop_repeats(spark.createDataFrame(rows_of(texts), COLUMNS)).collect()}
    assert left[0] == texts[0] and f"{late} {prose(4, 40)}" in left[1] and prose(3, 40) in left[1]
    assert all(p not in left[1] for p in pieces[5:half]) and late not in left[2]


def test_words_of_a_span_recur_together(spark):
    """Chunks of the first text recur with the six words before them, each in another document: no passage is shared."""
    words, pieces, at, texts = prose(503, 160).split(), pieces_of(prose(503, 160)), 0, [prose(503, 160)]
    for i, p in enumerate(pieces):
        part = words[max(at - 6, 0) : at + len(p.split())]
        at += len(p.split())
        if len(part) < sub.MIN_WORDS:
            texts.append(f"{prose(700 + i, 30)} {' '.join(part)} {prose(800 + i, 30)}")
    assert len(texts) > 10
    assert sub.repeated_spans(spark.createDataFrame(rows_of(texts), COLUMNS)).count() == 0


def test_chunks_resist_shifts():
    w = prose(5, 600)
    digests = []
    for text in (w, "Inserted words " + w, w[:1500] + " more " + w[1500:]):
        data = np.frombuffer(text.encode(), np.uint8)
        digests.append(set(sub.chunks(sub.Texts(data, np.array([0, len(data)])))["digest"].tolist()))
    assert all(len(digests[0] - d) <= 3 for d in digests[1:])


def test_gear_hash_depends_on_the_last_bytes_only():
    a, b = (np.frombuffer(x, np.uint8) for x in (b"x" * 50 + b"q" * 40, b"y" * 20 + b"q" * 40))
    assert sub.gear_hash(a, np.array([0, 90]))[-1] == sub.gear_hash(b, np.array([0, 60]))[-1]
    whole = np.concatenate([a, b])
    assert (sub.gear_hash(whole, np.array([0, 90, 150]))[90:] == sub.gear_hash(b, np.array([0, 60]))).all()


def test_substring_edges(nothing, messy):
    assert sub.repeated_spans(nothing).count() == 0
    assert {r.doc_id for r in sub.repeated_spans(messy).collect()} == {1, 4}
    assert sub.drop_repeats(messy).columns == messy.columns


# --- token shards --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 97, 1000, 4099])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(shards.feistel(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def rebuilt(rows):
    parts = collections.defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.tokens, "<u2")
        starts = [max(0, s) for s in r.starts] + [r.n_tokens]
        for doc, s, a, b in zip(r.doc_ids, r.starts, starts, starts[1:]):
            parts[doc][-min(s, 0)] = ids[a:b]
    whole = {d: np.concatenate([p[k] for k in sorted(p)]) for d, p in parts.items()}
    assert all(w[-1] == shards.END for w in whole.values())
    return {d: shards.encoder().decode(w[:-1].tolist()) for d, w in whole.items()}


def test_round_trip_and_files(corpus, tmp_path):
    ordered = shards.training_order(corpus, length=64, per_shard=100)
    rows = ordered.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 100 and r.offset == r.slot % 100 * 128 and len(r.tokens) == 128 for r in rows)
    assert rebuilt(rows) == {r.doc_id: r.text or "" for r in corpus.collect()}
    files = {r.shard: r for r in shards.write_shards(ordered, str(tmp_path)).collect()}
    assert sorted(files) == list(range(-(-len(rows) // 100)))
    for r in rows:
        with open(files[r.shard].path, "rb") as f:
            f.seek(r.offset)
            assert f.read(128) == r.tokens
    assert all(hashlib.sha256(open(f.path, "rb").read()).hexdigest() == f.sha256 for f in files.values())
    assert len(list(tmp_path.iterdir())) == len(files)


def test_token_edges(nothing, messy):
    assert shards.training_order(nothing).count() == 0
    rows = shards.training_order(messy).collect()
    assert sum(s >= 0 for r in rows for s in r.starts) == messy.count()


# --- mixing ---------------------------------------------------------------------------------------


def water_fill(sizes, budget=1.5, most=2.0):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), budget * sum(sizes), set(range(len(sizes)))
    while left > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        add = {i: left * weights[i] / total for i in open_}
        left = 0.0
        for i, x in add.items():
            target[i] += x
            if target[i] >= most * sizes[i]:
                left += target[i] - most * sizes[i]
                target[i] = most * sizes[i]
                open_.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[100], [10, 1000, 10], [500, 400, 300, 200, 100], [1, 1, 1000, 5, 7000, 3], [0, 5, 9]])
def test_targets_match_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i}" if i < len(sizes) - 1 else None, n) for i, n in enumerate(sizes)], "src string, source_size long")
    got = {r.src: r.target for r in mixing.source_targets(df).collect()}
    want = water_fill(sizes)
    assert [got[f"s{i}" if i < len(sizes) - 1 else None] for i in range(len(sizes))] == pytest.approx(want)


def test_sainte_lague_takes_the_highest_quotients():
    for targets, seats in (([5.0, 3.0, 1.0], 20), ([100.0, 0.0, 1.0], 7), ([3.3, 3.3, 3.4], 11), ([1.0], 4)):
        given = [0] * len(targets)
        for _ in range(seats):
            given[max(range(len(targets)), key=lambda i: (targets[i] / (2 * given[i] + 1), -i))] += 1
        assert mixing.sainte_lague(targets, seats) == given
    quotas = mixing.shard_quotas([500.0, 300.0, 100.0], 10, 7)
    assert [sum(q[i] for q in quotas) for i in range(3)] == mixing.sainte_lague([500.0, 300.0, 100.0], 90) and all(x >= 0 for q in quotas for x in q)


def test_sainte_lague_with_one_hot_and_a_thousand_tiny_sources():
    for targets, seats in (([64000.0] + [38.4] * 1000, 1600), ([64000.0] + [38.4] * 1000, 833), ([1.0, 1.0, 1.0], 2), ([7.0, 7.0, 3.5], 999)):
        quotients = sorted((-t / (2 * s + 1), i) for i, t in enumerate(targets) for s in range(seats))[:seats]
        given = collections.Counter(i for _, i in quotients)
        assert mixing.sainte_lague(targets, seats) == [given[i] for i in range(len(targets))]


def test_every_block_fills_the_quota_of_its_shard(corpus):
    rows = mixing.mix(corpus, block=16, shards=7).select("src", "target", "_start", "_pieces").collect()
    order = sorted({r.src for r in rows}, key=lambda s: (s is None, s or ""))
    targets = [next(r.target for r in rows if r.src == s) for s in order]
    blocks = {(r.src, (r._start + p.low) // 16): p for r in rows for p in r._pieces}
    assert all(len(p.shards) == p.times for p in blocks.values())
    got = collections.Counter((k, src) for (src, _), p in blocks.items() for k in p.shards)
    assert [[got[k, s] for s in order] for k in range(7)] == mixing.shard_quotas(targets, 16, 7)


def test_mix_meets_targets_and_repeats_itself(corpus):
    taken = mixing.words_taken().alias("taken")
    rows = mixing.mix(corpus).select("doc_id", "src", "size", "target", taken).collect()
    assert len(rows) == corpus.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    for src in {r.src for r in rows}:
        mine = [r for r in rows if r.src == src]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * mixing.BLOCK + 1
    again = mixing.mix(corpus.repartition(5)).select("doc_id", taken).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}
    made = mixing.mix_documents(corpus)
    words = collections.Counter()
    for r in made.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert {r.doc_id: r.taken for r in rows if r.taken} == dict(words) and made.columns == corpus.columns


def test_rows_that_share_an_id_take_their_own_words(spark):
    ids = [None, None, None, 7, 7, 8]
    lengths = [1000, 100, 333, 640, 64, 500]
    rows = [(i, prose(k, n), "en", "ab"[k % 2], 0) for k, (i, n) in enumerate(zip(ids, lengths))]
    docs = spark.createDataFrame(rows, COLUMNS)
    taken = collections.Counter()
    for r in mixing.mix(docs).select("doc_id", "size", mixing.words_taken().alias("taken")).collect():
        taken[r.size] += r.taken
    out = collections.Counter()
    size = {w: n for k, n in enumerate(lengths) for w in [prose(k, n).split(" ")[0]]}
    vocabulary = [(set(prose(k, n).split(" ")), n) for k, n in enumerate(lengths)]
    assert len(size) == len(lengths) and sum(taken.values()) > 1500
    for r in mixing.mix_documents(docs).collect():
        words = r.text.split()
        out[next(n for known, n in vocabulary if known.issuperset(words))] += len(words)
    assert {n: t for n, t in taken.items() if t} == dict(out)


def test_mix_edges(nothing, messy):
    assert mixing.mix(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0
    assert mixing.mix(messy).count() == messy.count() and mixing.mix_documents(messy).columns == messy.columns


# --- licences --------------------------------------------------------------------------------------


def test_headers_and_inheritance(spark, nothing):
    rows = [
        (1, "h/a/LICENSE", "Released under the MIT License."), (2, "h/a/x.txt", "Nothing here."), (3, "h/a/b/c/y.txt", "Nothing here either."),
        (4, "h/a/b/z.txt", "Prose.\nLicensed under the Apache License, Version 2.0.\nMore prose."), (5, "h/q/x.txt", "We talk about a license for dogs in this long line."),
        (6, "h/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, None, None), (8, "h/a/b/w", ""), (8, "h/a/b/w", ""),
        (9, "top", "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame(rows, "i long, p string, t string").withColumn("license", F.lit(1)).withColumn("path", F.lit(2))
    out = licenses.scan(df, "i", F.col("p"), F.split("t", "\n")).collect()
    assert len(out) == len(rows)
    got = {r.i: (r.license, r.found, r.from_directory) for r in out}
    assert got == {
        1: ("MIT", "header", None), 2: ("MIT", "directory", "h/a"), 3: ("GPL-3.0", "directory", "h/a/b"), 4: ("Apache-2.0", "header", None),
        5: (None, "none", None), 6: ("GPL-3.0", "header", None), 7: (None, "none", None), 8: ("GPL-3.0", "directory", "h/a/b"), 9: ("CC-BY-NC-4.0", "header", None),
    }
    assert licenses.scan(df.limit(0), "i", F.col("p"), F.split("t", "\n")).count() == 0


def test_pages_become_lines(spark):
    html = "<p>One<br>Two</p><script>x<y</script><!-- no --><b>Th</b>ree<div>Four</div>"
    df = spark.createDataFrame([(html, "https://h.org/a/b.html?x=1#y")], "h string, u string")
    lines, path = df.select(licenses.plain_lines(F.col("h")), licenses.url_path(F.col("u"))).first()
    assert [x.strip() for x in lines if x.strip()] == ["One", "Two", "Th ree", "Four"] and path == "h.org/a/b.html"


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, folder), "test")
        assert docs.columns == columns
        if name != "mixing":
            assert 0.5 * before < docs.count() < before, name
            before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r.slot for r in last) == list(range(len(last)))
    want = sorted((r.slot, bytes(r.tokens)) for r in corpus_pipeline.run(spark, folder).collect())
    assert len(want) == len(last)


def test_pipeline_on_nothing(spark, nothing, folder):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, folder), "test")
    assert docs.count() == 0
