"""Spelling variants of words, by blocked Gram matrices.

Words are counted by DataFrame functions.  The distinct ones are sorted by length and by how many letters they have of each of
``GROUPS`` groups, and packed into blocks of words of one length.  A word's letter counts are a vector of ``COLUMNS`` numbers (code
points modulo that); one inserted or deleted code point moves the vector by a squared distance of 1, a replaced one by 2 at most.
So two blocks of equal or adjacent lengths are laid beside each other if the boxes of their group counts are no farther apart, which
bounds the distance from below, and within them ``CELL`` words at a time meet the cells that are near: one NumPy
product gives all squared distances, pairs of at most two stay, and are verified code point by code point.

For every word a pair of blocks hands on the number of its near words and the best of them, no pairs; these are summed up
by Spark.  Blocks are bounded in words and bytes, whatever length or spelling most words have.

A word's form is its near word of largest count (the first in code-point order of equals) if that is ``RATIO`` times
its own or more; counts grow along forms, so they end, and roots are found by doubling the steps.

Defined cases: null and empty texts have no words; a null id counts as an empty one where a change of words asks for it;
words may have any length and letters; words of equal count have no form among each other; repeated rows count as
often as they occur; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.session import settle

#: A run of letters, as both Java and Python write it.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word; times a form's count must be a word's.
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Letter counts of a word, and groups of them that blocks are sorted by.
COLUMNS, GROUPS = 64, 6
#: Words and code points of a block, words of a cell, blocks laid beside each other by a task.
BLOCK, BLOCK_POINTS, CELL, PAIRS = 1 << 14, 1 << 22, 128, 8
_MEMBER = np.eye(GROUPS, dtype=np.float32)[np.arange(COLUMNS) % GROUPS]


def word_counts(docs: DataFrame, change: Callable[[Column, Column], Column] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all words (A-Z lower-cased) of whole texts; ``change`` makes a word of an id and a run of letters."""
    runs = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= LEAST_LENGTH)
    run = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = runs.select("doc_id", run.alias("run"))
    word = change(F.col("doc_id"), F.col("run")) if change else F.col("run")
    counted = words.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and the lengths of the words."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Matrix of the letter counts of words."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(owner * COLUMNS + points % COLUMNS, minlength=len(lengths) * COLUMNS).reshape(-1, COLUMNS)


def profile_column(word: Column) -> Column:
    """Group counts of a word as one number; equal words and many similar ones have equal numbers."""

    @F.arrow_udf("long")
    def profile(values: pa.Array) -> pa.Array:
        counts = letter_counts(*_points(values.to_pylist())) @ _MEMBER.astype(np.int64)
        return pa.array(np.minimum(counts, 1023) @ (1 << np.arange(10 * GROUPS - 10, -1, -10)))

    return profile(word)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of words of one length, from rows sorted by length and profile: id, length, box, words and counts."""
    part, made = TaskContext.get().partitionId(), 0

    def block(words: list[str], counts: list[int]) -> pa.RecordBatch:
        groups = letter_counts(*_points(words)) @ _MEMBER.astype(np.int64)
        boxes = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (groups.min(axis=0), groups.max(axis=0))]
        joined, numbers = "".join(words), np.array(counts, np.int64).tobytes()
        columns = [pa.array([(part << 32) + made]), pa.array([len(words[0])], pa.int64()), *boxes, pa.array([joined]), pa.array([numbers], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "length", "low", "high", "words", "counts"])

    words: list[str] = []
    counts: list[int] = []
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if words and (len(word) != len(words[0]) or len(words) == BLOCK or len(words) * len(word) >= BLOCK_POINTS):
                yield block(words, counts)
                words, counts, made = [], [], made + 1
            words.append(word)
            counts.append(n)
    if words:
        yield block(words, counts)


class Block:
    """Words of one length, with their letter counts."""

    def __init__(self, words: str, counts: bytes, length: int):
        self.length, self.n = length, np.frombuffer(counts, np.int64)
        points = np.frombuffer(words.encode("utf-32-le"), "<u4")
        self.points = points.reshape(-1, length)
        exact = letter_counts(points, np.full(len(self.n), length))
        # A float has 24 bits; the squares of longer words may need more.
        self.letters = exact.astype(np.float32 if length < 2048 else np.float64)
        self.squares = (self.letters * self.letters).sum(axis=1)
        groups, at = self.letters @ _MEMBER.astype(self.letters.dtype), np.arange(0, len(self.n), CELL)
        self.low, self.high = np.minimum.reduceat(groups, at, axis=0), np.maximum.reduceat(groups, at, axis=0)
        order = sorted(range(len(self.n)), key=lambda i: words[i * length : (i + 1) * length])
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))

    def word(self, i: int) -> str:
        return self.points[i].tobytes().decode("utf-32-le")


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (code points; ``b`` as long or one longer) are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    before, after = a == b[:, :-1], a == b[:, 1:]
    prefix = np.logical_and.accumulate(before, axis=1).sum(axis=1)
    suffix = np.logical_and.accumulate(after[:, ::-1], axis=1).sum(axis=1)
    return prefix + suffix >= a.shape[1]


def near_pairs(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of all words that are one edit apart, each pair once."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for cell in range(len(a.low)):
        apart = np.maximum(0, np.maximum(b.low - a.high[cell], a.low[cell] - b.high))
        cells = np.flatnonzero((apart * apart).sum(axis=1) <= 2)
        if same:
            cells = cells[cells >= cell]
        if not len(cells):
            continue
        own = np.arange(cell * CELL, min(len(a.n), (cell + 1) * CELL))
        other = (cells[:, None] * CELL + np.arange(CELL)).ravel()
        other = other[other < len(b.n)]
        product = a.letters[own] @ b.letters[other].T
        product *= -2
        product += a.squares[own][:, None]
        product += b.squares[other][None, :]
        i, j = np.nonzero(product <= 2)
        i, j = own[i], other[j]
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), max(1, BLOCK_POINTS // b.length)):
            some = slice(at, at + max(1, BLOCK_POINTS // b.length))
            good = _verified(a.points[i[some]], b.points[j[some]])
            found.append((i[some][good], j[some][good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every pair of blocks and every word with near words there: how many, and the best."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            a = Block(row["a_words"], row["a_counts"], row["a_length"])
            same = row["a_block"] == row["b_block"]
            b = a if same else Block(row["b_words"], row["b_counts"], row["b_length"])
            i, j = near_pairs(a, b, same)
            out: list[tuple] = []
            for x, y, own, other in [(a, b, i, j), (b, a, j, i)] if not same else [(a, a, np.concatenate([i, j]), np.concatenate([j, i]))]:
                order = np.lexsort((y.rank[other], -y.n[other], own))
                own, other = own[order], other[order]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                sizes = np.diff(np.append(first, len(own)))
                out += [(x.word(u), int(s), int(y.n[v]), y.word(v)) for u, v, s in zip(own[first].tolist(), other[first].tolist(), sizes.tolist(), strict=True)]
            if out:
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best and best_n of every word of ``words`` (distinct word, n) that has near words."""
    own = words.select("word", "n", F.char_length("word").alias("length"), profile_column(F.col("word")).alias("profile"))
    sort = ("length", "profile", "word")
    blocks = settle(own.repartitionByRange(*sort).sortWithinPartitions(*sort).select("word", "n").mapInArrow(_pack, "block long, length long, low array<long>, high array<long>, words string, counts binary"))
    a, b = (blocks.select(*[F.col(c).alias(f"{x}_{c}") for c in blocks.columns]) for x in "ab")
    box = lambda x: [f"{x}_block", f"{x}_length", f"{x}_low", f"{x}_high"]
    sides = a.select(*box("a"), F.explode(F.array(F.col("a_length"), F.col("a_length") + 1)).alias("b_length")).join(b.select(*box("b")), "b_length")
    once = (F.col("a_length") < F.col("b_length")) | (F.col("a_block") <= F.col("b_block"))
    apart = [F.greatest(F.lit(0), F.col("b_low")[g] - F.col("a_high")[g], F.col("a_low")[g] - F.col("b_high")[g]) for g in range(GROUPS)]
    pairs = settle(sides.where(once & (sum(x * x for x in apart) <= 2)).select("a_block", "b_block"))
    tasks = max(1, -(-pairs.count() // PAIRS))
    whole = pairs.join(a.drop("a_low", "a_high"), "a_block").join(b.drop("b_low", "b_high"), "b_block").repartition(tasks, "a_block", "b_block")
    found = whole.mapInArrow(_beside, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form), by doubling."""
    steps = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = settle(steps.join(further, "root", "left"))
        if not joined.where("_next is not null").limit(1).count():
            return steps
        steps = joined.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of ``words`` (distinct word, n)."""
    words = settle(words.select("word", "n"))
    near = near_words(words)
    has = F.col("best_n") >= RATIO * F.col("n")
    joined = settle(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    rooted = joined.join(_roots(joined.where("form is not null").select("word", "form")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
