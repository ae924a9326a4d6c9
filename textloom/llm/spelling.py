"""Spelling variants by a trie of letter-group counts.

A word is a vector: how many letters it has of every group (a letter and its accented forms). The trie
arranges words by successive counts, commonest group first. One edit adds at most one letter to a group (surplus) and
takes at most one from another (deficit), so a search that walks the trie depth first with a budget of
one surplus and one deficit meets every word one edit away. Near is symmetric: the search only follows
differences whose first step is a surplus, which meets every pair once, from one of its ends.
Words at a leaf are verified: those that become equal when the deciding letter is taken out are compared letter by letter.

How it runs. Words and counts come from one aggregation with map-side combine. The top of the trie
is the plan of the job: a node with more than ``cell_words`` words is split by its next count, so cells follow the data and a common
pattern of letters cannot fill a task. A word goes to its own cell and to the cells that the budget lets it reach (1 + d + d(d-1)/2 at
depth d at most). Each cell finishes the search in its task, for all its words at once: the stack of the depth-first search holds
blocks of node pairs, so memory stays bounded. No pairs leave a cell, only counts and the best partner of each word.
The plan holds at most a few thousand split nodes, because ``cell_words`` grows with the words beyond that; it is the only thing broadcast.
Only words with one and the same full vector cannot be split further; they need memory in proportion, and pairs among them are found by sorting.

Defined results: null and empty texts have no words, an empty table gives no rows. A null doc_id counts as an empty one in the
checksum. Repeated rows count each time. Ties between partners go to the smallest word in code-point order. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm.arrays import mix64
from textloom.llm.common import checkpointed, documents

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, DAMAGE = 5, 3, 97
CELL_WORDS = 20_000
MOST_NODES = 4096  # split nodes a level of the plan may have
BLOCK = 1 << 18  # node pairs or letters handled at once
# Fixed value: letters by how common they are, the order of the levels of the trie.
ORDER = "etaoinshrdlcumwfgypbvkjxqz"


def _groups() -> np.ndarray:
    """Group of each Latin-1 letter: its base letter, or one last group."""
    table = np.full(256, len(ORDER), np.int64)
    for code in range(256):
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        if base in ORDER:
            table[code] = ORDER.index(base)
    return table


GROUP = _groups()
N_GROUPS = len(ORDER) + 1


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters, lower-cased in A-Z, some of them with one letter lost by a checksum of document and run."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # A shorter run cannot give a word; a longer one is matched whole.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGE == 0, lost).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


# --- the plan: the top of the trie ---------------------------------------------------------------


def _level(level: int):
    """How many letters a word has of one group, as a column."""
    letters = "".join(chr(c) for c in range(256) if GROUP[c] == level and chr(c).isalpha() or level == len(ORDER) and chr(c) in "×÷")
    return F.length("word") - F.length(F.translate("word", letters, ""))


def plan_cells(words: DataFrame, cell_words: int = CELL_WORDS) -> dict[tuple[int, ...], int]:
    """Number of each cell by its first counts, in the order of the trie."""
    spark = words.sparkSession
    total = words.count()
    limit = max(cell_words, -(-total // MOST_NODES))
    cells: list[tuple[int, ...]] = []
    hot: list[tuple[int, ...]] = [()] if total else []
    for level in range(N_GROUPS):
        if not hot:
            break
        rows = words
        if level:
            at = spark.createDataFrame([(list(p),) for p in hot], "prefix array<int>")
            rows = words.withColumn("prefix", F.array(*[_level(i) for i in range(level)])).join(F.broadcast(at), "prefix", "left_semi")
        prefix = F.array(*[_level(i) for i in range(level + 1)])
        found = [(tuple(r.p), r.n) for r in rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()]
        last = level == N_GROUPS - 1
        hot = sorted(p for p, n in found if n > limit and not last)
        cells += [p for p, n in found if n <= limit or last]
    return {p: i for i, p in enumerate(sorted(cells))}


def _tree(cells: dict[tuple[int, ...], int]) -> dict:
    root: dict = {}
    for prefix, number in cells.items():
        node = root
        for count in prefix[:-1]:
            node = node.setdefault(count, {})
        node[prefix[-1]] = number
    return root


def _reach(node, vector: tuple[int, ...], level: int = 0, spent: int = 0) -> Iterator[int]:
    """Cells within the budget, the own one included. spent: 0 nothing, 1 a surplus, 2 a surplus and a deficit."""
    if not isinstance(node, dict):
        yield node
        return
    own = vector[level]
    steps = ((own, spent),) if spent == 2 else ((own, 0), (own + 1, 1)) if spent == 0 else ((own, 1), (own - 1, 2))
    for count, after in steps:
        if count in node:
            yield from _reach(node[count], vector, level + 1, after)


# --- words as arrays -----------------------------------------------------------------------------


class Words:
    """Words of a batch: their letters as one Latin-1 buffer, with borders."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if len(raw) else np.zeros(0, np.int64)

    def vectors(self) -> np.ndarray:
        n = len(self.size)
        owner = np.repeat(np.arange(n), self.size)
        return np.bincount(owner * N_GROUPS + GROUP[self.data], minlength=n * N_GROUPS).reshape(n, N_GROUPS).astype(np.int32)


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places start .. start + size of every entry, and the entry each belongs to."""
    owner = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    return np.arange(len(owner)) - first[owner] + start[owner], owner


class Gaps:
    """Hash of a word without the letter at a place, for all places at once.

    The hash is a polynomial over the letters, so taking one out is arithmetic on running sums.
    """

    def __init__(self, words: Words):
        longest = int(words.size.max()) if len(words.size) else 0
        powers = np.ones(longest + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
        self.words = words
        inside = np.arange(len(words.data)) - np.repeat(words.start, words.size)
        value = words.data.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(7)
        near = np.concatenate([[np.uint64(0)], np.cumsum(value * powers[inside])])
        end = words.start + words.size
        self.whole = mix64(near[end] - near[words.start])
        # Letters behind the gap move one place down: with the powers shifted by one.
        moved = np.where(inside > 0, value * powers[np.maximum(inside, 1) - 1], np.uint64(0))
        far = np.concatenate([[np.uint64(0)], np.cumsum(moved)])
        owner = np.repeat(np.arange(len(words.size)), words.size)
        place = np.arange(len(words.data))
        self.without = mix64((near[place] - near[words.start[owner]]) + (far[end[owner]] - far[place + 1]))
        self.inside = inside
        # The first letter of a run of equal ones stands for all: without any of them the word is the same.
        self.leads = np.ones(len(words.data), bool)
        self.leads[1:] = (words.data[1:] != words.data[:-1]) | (inside[1:] == 0)


# --- search inside a cell ------------------------------------------------------------------------


class Trie:
    """Sorted distinct vectors with the nodes of every level; words of a vector lie together."""

    def __init__(self, vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1]) if len(vectors) else np.zeros(0, np.int64)
        ranked = vectors[order]
        step = np.ones((len(ranked), N_GROUPS), bool)
        if len(ranked):
            step[1:] = np.logical_or.accumulate(ranked[1:] != ranked[:-1], axis=1)
        self.order = order
        # Per level: number of each child node, its count, the first child of every parent.
        self.first, self.count = [], []
        parent = np.zeros(len(ranked), np.int64)
        n_parents = 1 if len(ranked) else 0
        for level in range(N_GROUPS):
            new = step[:, level]
            node = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            self.count.append(ranked[heads, level].astype(np.int64))
            self.first.append(np.searchsorted(parent[heads], np.arange(n_parents + 1)))
            parent, n_parents = node, len(heads)
        self.bounds = np.concatenate([np.flatnonzero(step[:, -1]), [len(ranked)]]) if len(ranked) else np.zeros(1, np.int64)


def _leaf_pairs(queries: Trie, base: Trie) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (query leaf, base leaf, spent, surplus group, deficit group); -1 where a group is not spent."""
    if not len(queries.order) or not len(base.order):
        return
    key = [b.repeat(np.diff(f)) for b, f in ((np.arange(len(f) - 1), f) for f in base.first)]
    width = max(int(max(c.max() for c in queries.count)), int(max(c.max() for c in base.count))) + 3
    keys = [p * width + c + 1 for p, c in zip(key, base.count)]
    none = np.full(1, -1, np.int64)
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), none, none)]
    while stack:
        level, q, b, spent, plus, minus = stack.pop()
        if level == N_GROUPS:
            yield q, b, spent, plus, minus
            continue
        child, owner = _spread(queries.first[level][q], queries.first[level][q + 1] - queries.first[level][q])
        count = queries.count[level][child]
        parts = []
        for change, needs, after in ((0, None, None), (1, 0, 1), (-1, 1, 2)):
            pick = np.arange(len(owner)) if needs is None else np.flatnonzero(spent[owner] == needs)
            wanted = b[owner[pick]] * width + count[pick] + change + 1
            at = np.searchsorted(keys[level], wanted)
            hit = at < len(keys[level])
            hit[hit] = keys[level][at[hit]] == wanted[hit]
            pick, at = pick[hit], at[hit]
            from_ = owner[pick]
            parts.append((
                child[pick], at, spent[from_] if after is None else np.full(len(at), after),
                np.full(len(at), level) if change == 1 else plus[from_], np.full(len(at), level) if change == -1 else minus[from_],
            ))
        new = [np.concatenate(x) for x in zip(*parts)]
        for i in range(0, len(new[0]), BLOCK):
            stack.append((level + 1, *[x[i : i + BLOCK] for x in new]))


def _entries(trie: Trie, leaf: np.ndarray, words: Words, group: np.ndarray | None, letter_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, letter place) of the letters of a group in all words of a leaf, or of all letters where no group is given."""
    rank, pair = _spread(trie.bounds[leaf], trie.bounds[leaf + 1] - trie.bounds[leaf])
    word = trie.order[rank]
    place, of = _spread(words.start[word], words.size[word])
    pair = pair[of]
    if group is not None:
        keep = letter_group[place] == group[pair]
        pair, place = pair[keep], place[keep]
    return pair, place


def _matches(pair_a: np.ndarray, hash_a: np.ndarray, pair_b: np.ndarray, hash_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a and b that agree in pair and hash."""
    a, b = mix64(hash_a ^ mix64(pair_a.astype(np.uint64))), mix64(hash_b ^ mix64(pair_b.astype(np.uint64)))
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    place, owner = _spread(low, high - low)
    return owner, order[place]


def _same_but(words: Words, a: np.ndarray, gap_a: np.ndarray | None, b: np.ndarray, gap_b: np.ndarray) -> np.ndarray:
    """Do words a (without their letter at gap_a) and b (without theirs at gap_b) agree letter by letter?"""
    size = words.size[b] - 1
    ok = size == words.size[a] - (gap_a is not None)
    a, b, gap_b, size = a[ok], b[ok], gap_b[ok], size[ok]
    place, owner = _spread(np.zeros(len(size), np.int64), size)
    from_b = place + (place >= gap_b[owner])
    from_a = place if gap_a is None else place + (place >= gap_a[ok][owner])
    differ = words.data[words.start[a][owner] + from_a] != words.data[words.start[b][owner] + from_b]
    ok[np.flatnonzero(ok)[np.unique(owner[differ])]] = False
    return ok


def near_pairs(words: list[str], home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, partner) of words one edit apart; partners are at home, every pair comes once."""
    w = Words(words)
    if not len(w.size):
        return
    gaps, vectors = Gaps(w), w.vectors()
    letter_group, owner_of = GROUP[w.data], np.repeat(np.arange(len(w.size)), w.size)
    queries, inside = Trie(vectors), np.flatnonzero(home)
    base = Trie(vectors[inside])
    base.order = inside[base.order]
    for q, b, spent, plus, minus in _leaf_pairs(queries, base):
        # Another letter of the same group in the same place: only in words of one leaf.
        # A letter of one group becomes one of another, or one letter more.
        for kind in (0, 1, 2):
            pick = np.flatnonzero(spent == kind)
            sizes = (queries.bounds[q[pick] + 1] - queries.bounds[q[pick]]) + (base.bounds[b[pick] + 1] - base.bounds[b[pick]])
            if kind == 0:  # alone in its leaf, a word has no partner there
                pick, sizes = pick[sizes > 2], sizes[sizes > 2]
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(BLOCK, sizes.sum() + BLOCK, BLOCK), "right")
            for part in np.split(pick, np.unique(cuts[cuts < len(pick)])):
                if not len(part):
                    continue
                pair_b, place_b = _entries(base, b[part], w, None if kind == 0 else plus[part], letter_group)
                if kind == 1:
                    keep = gaps.leads[place_b]
                    pair_b, place_b = pair_b[keep], place_b[keep]
                    rank, pair_a = _spread(queries.bounds[q[part]], queries.bounds[q[part] + 1] - queries.bounds[q[part]])
                    word_a = queries.order[rank]
                    i, j = _matches(pair_a, gaps.whole[word_a], pair_b, gaps.without[place_b])
                    x, y, gap_x = word_a[i], owner_of[place_b[j]], None
                else:
                    pair_a, place_a = _entries(queries, q[part], w, None if kind == 0 else minus[part], letter_group)
                    # The gap must be at the same place of both words.
                    tag_a, tag_b = (mix64(gaps.inside[p].astype(np.uint64) + np.uint64(1)) for p in (place_a, place_b))
                    i, j = _matches(pair_a, gaps.without[place_a] ^ tag_a, pair_b, gaps.without[place_b] ^ tag_b)
                    x, y, gap_x = owner_of[place_a[i]], owner_of[place_b[j]], gaps.inside[place_a[i]]
                gap_y = gaps.inside[place_b[j]]
                ok = _same_but(w, x, gap_x, y, gap_y)
                if kind == 0:  # a pair of one leaf is met from both ends, and every word meets itself
                    ok &= (x < y) | ~home[x]
                    ok &= x != y
                if kind != 1:
                    ok &= gaps.inside[place_a[i]] == gap_y
                x, y = x[ok], y[ok]
                if len(x):
                    yield x, y


def _search(table: pa.Table) -> pa.Table:
    """All of one cell: per word its number of partners and the best of them."""
    words, n, home = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
    size = len(words)
    # Position in code-point order decides between partners of one count.
    by_name = np.empty(size, np.int64)
    by_name[np.array(sorted(range(size), key=words.__getitem__), np.int64)] = np.arange(size)
    found, best = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    rank = np.empty(size, np.int64)
    rank[np.lexsort((by_name, -n))] = np.arange(size)
    at_rank = np.argsort(rank)
    best_rank = np.full(size, size, np.int64)
    for x, y in near_pairs(words, home):
        for a, b in ((x, y), (y, x)):
            found += np.bincount(a, minlength=size)
            np.minimum.at(best_rank, a, rank[b])
    met = np.flatnonzero(found)
    best = at_rank[best_rank[met]]
    return pa.table(
        [pa.array([words[i] for i in met], pa.string()), pa.array(found[met]), pa.array(n[best]), pa.array([words[i] for i in best], pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has a word one edit away; ``words`` are distinct, with their count n."""
    cells = plan_cells(words, cell_words)
    tree = words.sparkSession.sparkContext.broadcast(_tree(cells))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            reached = [list(_reach(tree.value, tuple(v))) for v in Words(names).vectors().tolist()]
            owner = np.repeat(np.arange(len(names)), [len(r) for r in reached])
            cell = np.array([c for r in reached for c in r], np.int32)
            first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(first), batch.column("word").take(pa.array(owner)), batch.column("n").take(pa.array(owner))],
                names=["cell", "home", "word", "n"],
            )

    visits = words.select("word", "n").mapInArrow(visit, "cell int, home boolean, word string, n bigint")
    found = visits.groupBy("cell").applyInArrow(_search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.neg")).alias("best_n"), "b.best")


def with_roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the last word along the forms, by doubling the step each round.

    Counts at least double from a word to its form, so there are no circles and the number of rounds is the logarithm of a logarithm.
    """
    step = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    step = checkpointed(step, "spelling-roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = step.join(onward, "root", "left")
        moved = checkpointed(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def variants(words: DataFrame, ratio: float = 2, cell_words: int = CELL_WORDS) -> DataFrame:
    """Groups of spelling variants of (word, n): word, form, root, n, n_near, form_n."""
    words = checkpointed(words, "spelling-words")
    near = near_words(words, cell_words)
    rows = words.join(near, "word", "left").withColumn("takes", F.col("best_n") >= ratio * F.col("n"))
    forms = checkpointed(
        rows.select(
            "word", F.when(F.col("takes"), F.col("best")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("takes"), F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return forms.join(with_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of all words of all documents."""
    return variants(word_counts(documents(spark, sf_dir)))


# The checksum by its definition, bit by bit; near words by taking one letter out of both.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(0, strlen(doc || ':' || run)::BIGINT), lambda i: ('0x' || hex(encode(doc || ':' || run))[2 * i + 1 : 2 * i + 2])::BIGINT),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295)) AS h
  FROM runs, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gaps AS (
  SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, k.root FROM walk k JOIN forms f ON f.form = k.word
)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k USING (word)
"""
