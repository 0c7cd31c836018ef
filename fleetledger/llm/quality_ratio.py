"""Quality rules: counts of a text, and the likelihood ratio of its hashed n-grams between trusted texts and the corpus.

The n-grams are ``GRAM`` neighbouring bytes, hashed.  ``fit`` counts every n-gram of all documents (the raw corpus) and of trusted
ones in a table that grows with the corpus and stays distributed.  N-grams with at least 1 / ``COMMON_SHARE`` of all occurrences, of which there
are ``COMMON_SHARE`` at most, keep counts of their own in the model that travels with the tasks; all rarer ones are summed in ``POOLS`` buckets by hash, so none is
left out.  A text's score is the mean over its n-grams of log P(n-gram | trusted) - log P(n-gram | corpus), both smoothed: ``SMOOTHING``
trusted occurrences, and the same share of the corpus, are added to each, so what neither has seen often says little at any size of the
corpus.  A text is kept if its counts pass the base rules and its score is at least the threshold, one number for every document.

All labels are used.  By the order of the hashes of their ids, every second good document is trusted; the others, whose n-grams the model has
not learnt from, and all poor or toxic ones set the threshold: the one with the best balanced accuracy among those that keep at least
``KEEP`` of the good documents, found on sums by score that stay distributed.  Of rows
that repeat a labelled id, the lowest score counts.  Corpus counts cover every document; a task combines n-grams before it hands
them on, up to ``HELD`` distinct ones at a time.  Texts do not move to their labels: a map of ``MARKS`` bits by the hash of an id tells which
documents may be labelled, at any number of labels; only trusted texts (and the few others of equal bits) are shuffled, to be told apart exactly, and those
that set the threshold are scored where they lie, so that only their scores meet the labels.

Defined cases: a null text counts as empty; a text without n-grams scores 0; without good or poor labels the score
rejects nothing; several labels of one id count as the worst; a label without document is ignored; documents with a
null id are judged but are never labelled; repeated rows count as often as they occur; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetledger.operators.sequence import number_within
from fleetledger.session import shared_folder, stored

GRAM, SMOOTHING = 4, 0.1
#: At most so many n-grams have counts of their own in the model, buckets of all others, n-grams put together at once and held by a task.
COMMON_SHARE, POOLS, TOGETHER, HELD = 1 << 21, 1 << 20, 1 << 21, 1 << 20
KEEP = 0.99
#: Bits of the map of labelled ids, which travels with the tasks: 4 MB at most.  Where labels fill it, more texts are shuffled.
MARKS = 1 << 25
#: Stretches of scores that are summed up for themselves.
STRETCHES = 4096
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words of a window that counts as repeated, fewest words, largest percentage of repeated words.
WINDOW, FEWEST_WORDS, MOST_REPEATED = 8, 20, 30
_NONE = np.zeros(0, np.int64)


def grams(data: bytes) -> np.ndarray:
    """Hashes of all n-grams of a text."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n < 1:
        return _NONE
    gram = a[:n].copy()
    for k in range(1, GRAM):
        gram <<= np.uint64(8)
        gram |= a[k : n + k]
    gram *= np.uint64(0x9E3779B97F4A7C15)  # an odd constant near 2**64 / golden ratio spreads the values
    return gram.view(np.int64)


def pools(found: np.ndarray) -> np.ndarray:
    """Buckets of hashed n-grams that have no counts of their own: the upper bits."""
    return found.view(np.uint64) >> np.uint64(64 - POOLS.bit_length() + 1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = codes[:n].copy()
    for k in range(1, WINDOW):
        window *= np.uint64(0x9E3779B97F4A7C15)
        window += codes[k : n + k]
    order = np.argsort(window, kind="stable")
    equal = window[order[1:]] == window[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text and its bytes."""
    words = data.split()  # bytes split at the six ASCII spaces only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@dataclass(frozen=True)
class QualityModel:
    """Sorted common n-grams with their ratios, the ratios of the buckets of all others (both bounded), and the threshold."""

    common: np.ndarray
    ratio: np.ndarray
    pooled: np.ndarray
    threshold: float

    def score(self, data: bytes) -> float:
        found = grams(data)
        if not len(found):
            return 0.0
        ratio = self.pooled[pools(found)]
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
            ratio = np.where(self.common[at] == found, self.ratio[at], ratio)
        return float(ratio.mean())


def _labelled(labels: DataFrame, id_column: str) -> DataFrame:
    """All labelled ids: _id, _good (1 or 0) and _trusted (1 or 0)."""
    judged = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id"))
    judged = judged.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    poor = (F.col("quality") == 0) | (F.col("toxic") == 1)
    good = F.when(poor, F.lit(0)).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(1))
    known = judged.select("_id", good.alias("_good")).where("_good is not null")
    placed = number_within(known, ["_good"], [F.xxhash64("_id"), F.col("_id")], "_place")
    return stored(placed.select("_id", "_good", (F.col("_good") * (F.col("_place") % 2)).cast("int").alias("_trusted")), "quality-labels")


def _marked(ids: DataFrame, kind: str) -> Callable[[Column], Column]:
    """Whether an id of type ``kind`` may be one of ``_id`` in ``ids``: true for all of them, and for those that share a bit with one."""
    if ids.schema["_id"].dataType.simpleString() != kind:
        return lambda own: own.isNotNull()  # equal ids of other types have other hashes
    bit = lambda own: F.pmod(F.xxhash64(own), F.lit(MARKS))
    words = ids.select(bit(F.col("_id")).alias("_bit")).groupBy(F.shiftright("_bit", 5).alias("_word"))
    told = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 31 as int))")).alias("_bits")).toArrow()  # MARKS / 32 rows at most
    bits = np.zeros((MARKS + 31) // 32, np.uint32)
    bits[told["_word"].to_numpy()] = told["_bits"].to_numpy().astype(np.uint32)
    own_bits = ids.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((own_bits.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    return lambda own: own.isNotNull() & marked(bit(own))


def _ratio(raw: np.ndarray, trusted: np.ndarray, share: float) -> np.ndarray:
    """Log ratio of smoothed probabilities; ``share`` is that of trusted n-grams among all."""
    return np.log((trusted + SMOOTHING) / (raw * share + SMOOTHING))


def _combined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by n-gram."""
    keys, raw, trusted = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, place = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(place, x, len(found)).astype(np.int64) for x in (raw, trusted))


def _counted(new: list[np.ndarray], trusted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, raw = np.unique(np.concatenate([_NONE, *new]), return_counts=True)
    return found, raw, raw if trusted else np.zeros_like(raw)


def gram_counts(docs: DataFrame, together: int = TOGETHER, most: int = HELD) -> DataFrame:
    """gram, raw and trusted of every distinct n-gram in ``_text``, trusted where ``_trusted`` is 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(("gram", "raw", "trusted"), held, strict=True)))

        held, new, size = (_NONE, _NONE, _NONE), {0: [], 1: []}, 0
        for batch in batches:
            for value, trusted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = grams((value.as_py() or "").encode())
                new[int(trusted == 1)].append(found)
                size += len(found)
                if size > together:
                    held = _combined([held, _counted(new[0], False), _counted(new[1], True)])
                    new, size = {0: [], 1: []}, 0
                    if len(held[0]) > most:
                        yield out()
                        held = (_NONE, _NONE, _NONE)
        held = _combined([held, _counted(new[0], False), _counted(new[1], True)])
        yield out()

    found = docs.select("_text", "_trusted").mapInArrow(count, "gram long, raw long, trusted long")
    return found.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def _told(own: DataFrame, trusted: DataFrame, kind: str) -> DataFrame:
    """_text and _trusted of every document; texts of those that cannot be trusted, null ids among them, stay where they are."""
    near = _marked(trusted, kind)(F.col("_id"))
    found = own.where(near).join(trusted, "_id", "left").select("_text", "_trusted")
    return found.unionAll(own.where(~near).select("_text", F.lit(None).cast("int").alias("_trusted")))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> QualityModel:
    """Model and threshold from all documents and all labels."""
    known, spark = _labelled(labels, id_column), docs.sparkSession
    own = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    kind, folder = own.schema["_id"].dataType.simpleString(), shared_folder(spark, "quality-grams")
    gram_counts(_told(own, known.where("_trusted = 1"), kind)).write.parquet(folder)
    counts = spark.read.schema("gram long, raw long, trusted long").parquet(folder)
    total, trusted = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("trusted"), F.lit(0))).first()
    if not trusted:
        return QualityModel(_NONE, np.zeros(0), np.zeros(POOLS), -np.inf)
    is_common = F.col("raw") * COMMON_SHARE >= total
    common = counts.where(is_common).orderBy("gram").toArrow()  # COMMON_SHARE rows at most
    pool = F.shiftrightunsigned("gram", 64 - POOLS.bit_length() + 1).alias("pool")
    rest = counts.where(~is_common).groupBy(pool).agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()  # POOLS rows at most
    pooled = np.zeros((2, POOLS))
    pooled[:, rest["pool"].to_numpy()] = rest["raw"].to_numpy(), rest["trusted"].to_numpy()
    share = trusted / total
    ratio = _ratio(common["raw"].to_numpy(), common["trusted"].to_numpy(), share)
    model = QualityModel(common["gram"].to_numpy(), ratio, _ratio(*pooled, share), -np.inf)
    judging = known.where("_trusted = 0")
    near = own.where(_marked(judging, kind)(F.col("_id"))).select("_id", score(F.col("_text"), model).alias("_score"))
    judged = near.join(judging, "_id")
    scored = judged.groupBy("_id").agg(F.min("_good").alias("good"), F.min("_score").alias("score"))
    return replace(model, threshold=threshold_of(stored(scored.select("score", "good"), "quality-scores")))


def threshold_of(scored: DataFrame) -> float:
    """:func:`best_threshold` of any number of rows ``score`` and ``good``: sums by score, added up inside stretches of scores and over them."""
    n_good, n_poor, low, high = scored.agg(F.count_if(F.col("good") == 1), F.count_if(F.col("good") == 0), F.min("score"), F.max("score")).first()
    if not n_good or not n_poor:
        return -np.inf
    stretch = F.floor((F.col("score") - low) / F.lit((high - low) / STRETCHES or 1.0)).alias("_stretch")
    sums = scored.groupBy(stretch, "score").agg(F.count_if(F.col("good") == 1).alias("_good"), F.count_if(F.col("good") == 0).alias("_poor"))
    sums = stored(sums, "quality-sums")
    along = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    inside = Window.partitionBy("_stretch").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    stretches = sums.groupBy("_stretch").agg(F.sum("_good").alias("_g"), F.sum("_poor").alias("_p"))
    stretches = stretches.select("_stretch", total("_g", along).alias("_g"), total("_p", along).alias("_p"))
    here = sums.select("_stretch", "score", total("_good", inside).alias("_good"), total("_poor", inside).alias("_poor")).join(stretches, "_stretch")
    kept, cut = n_good - F.col("_good") - F.col("_g"), F.col("_poor") + F.col("_p")
    accuracy = F.when(kept >= F.lit(KEEP * n_good), kept / n_good + cut / n_poor).otherwise(F.lit(-1.0))
    best = here.agg(F.min_by("score", F.struct(-accuracy, "score"))).first()[0]
    below = sums.where(F.col("score") < F.lit(best)).agg(F.max("score")).first()[0]
    return best if below is None else (below + best) / 2


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """Midway below the lowest score of best balanced accuracy that keeps at least KEEP of the good; minus infinity if one kind is missing."""
    n_good, n_poor = int((good == 1).sum()), int((good == 0).sum())
    if not n_good or not n_poor:
        return -np.inf
    order = np.argsort(scores, kind="stable")
    values, firsts = np.unique(scores[order], return_index=True)
    kept_good = n_good - np.concatenate([[0], np.cumsum(good[order] == 1)])[firsts]
    cut_poor = np.concatenate([[0], np.cumsum(good[order] == 0)])[firsts]
    accuracy = np.where(kept_good >= KEEP * n_good, kept_good / n_good + cut_poor / n_poor, -1)
    best = int(np.argmax(accuracy))
    return float(values[best] if not best else (values[best - 1] + values[best]) / 2)


def score(text: Column, model: QualityModel) -> Column:
    """Score of a text column."""
    own = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(values: pa.Array) -> pa.Array:
        return pa.array([own.value.score((value.as_py() or "").encode()) for value in values], pa.float64())

    return scored(text)


def judge(text: Column, model: QualityModel) -> Column:
    """Struct of the base counts, score, base_failed and kept of a text column."""
    own = SparkSession.active().sparkContext.broadcast(model)
    fields = [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [("score", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]

    @F.arrow_udf(
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"
    )
    def judged(values: pa.Array) -> pa.Array:
        rows, model = [], own.value
        for value in values:  # one text at a time is made a Python string
            value = value.as_py() or ""
            data = value.encode()
            counts, score = base_counts(value, data), model.score(data)
            failed = counts[0] < FEWEST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
            rows.append((*counts, score, failed, not failed and score >= model.threshold))
        columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return judged(text)


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, score, base_failed and kept of every document."""
    model = fit(docs, labels, id_column, text)
    judged = docs.select(F.col(f"`{id_column}`").alias("doc_id"), judge(F.col(f"`{text}`"), model).alias("_judged"))
    return judged.select("doc_id", "_judged.*")
