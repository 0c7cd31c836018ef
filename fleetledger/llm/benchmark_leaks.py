"""Benchmark items inside documents, up to edits of words, by CGK embedding and bit-sampling LSH.

Texts are sequences of words (lower case, letters and digits).  The CGK embedding walks over a
sequence: at step j it gives the word under it and moves on if a random bit of (j, that word) is set.  Two sequences
that differ by few edits soon walk over the same words again, so most steps give the same word: edit distance
becomes Hamming distance.  An LSH key is the word at step 0 and at ``SAMPLES`` random steps; ``REPEATS`` walks with
random bits and steps of their own make a candidate likely to be found at least once.

Of each item, windows from ``ANCHORS`` places in its first half to its end are indexed, and others from the longest word of every
``STRETCH`` words up to the end, so that wherever the edits lie, some windows hold few.  Their walks are as long as
the largest power of two that fits, the latter's ``SHORT_WALK`` steps at most, so a passage without edits has the very same keys and is always found.
Of the documents, windows of those sizes at every word are looked up; a key begins with the word at step 0, so where
that word begins no indexed window the walk is not taken.  Candidates of one item that lie together are verified at once:
the least edit distance of the item to any part of that stretch decides (``edits <= EDITS * words``).  A part within k edits of an
item of n words holds n - k of its words, as often as it does, so stretches that hold fewer are left out first.

The index holds ``BLOCK`` items at most and travels with the tasks; a larger benchmark is looked up block by block, so nothing
grows with it or with the documents.  Documents are not shuffled.

Defined cases: null and empty texts have no hits; an item without words is never found; texts of any length are looked
up whole; one row for each document row and item, with the best passage (the first of equals); repeated items are items of
their own; empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of an item's words that may be edited.
EDITS = 0.2
ANCHORS, REPEATS, SAMPLES, LONGEST_WALK = 5, 5, 3, 64
#: Words of a stretch that has a window of its own, longest walk of such a window, and words it has to the item's end.
STRETCH, SHORT_WALK, LEAST_WALK = 10, 16, 4
#: Items in one index, words looked up at once.
BLOCK, TOGETHER = 20_000, 1 << 19
WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Lower case, code point by code point (the one letter whose lower case takes two becomes its base letter)."""
    return text.replace("\u0130", "i").lower()


def words_of(text: str | None) -> np.ndarray:
    """Hashed words of a text."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, WORD.findall(plain(text)))) if text else b"", "<u8")


@functools.cache
def _draws(size: int, repeat: int) -> tuple[np.uint64, tuple[int, ...]]:
    """Odd factor of the random bits and the sampled steps of one repeat of walks of ``size`` steps; the same everywhere."""
    draw = np.random.Generator(np.random.PCG64([size, repeat, 7]))
    factor = draw.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    steps = draw.choice(np.arange(1, size), min(SAMPLES, size - 1), replace=False) if size > 1 else []
    return factor, tuple(sorted(int(x) for x in steps))


def walk_keys(words: np.ndarray, at: np.ndarray, size: int, repeat: int) -> np.ndarray:
    """LSH keys of the windows that begin ``at`` these places; ``words`` ends with zeros for LONGEST_WALK steps."""
    factor, steps = _draws(size, repeat)
    place, keys = at.copy(), words[at] * _MIX + np.uint64(size * REPEATS + repeat)
    for j in range(steps[-1] if steps else 0):
        bits = words[place] * factor
        place += ((bits >> np.uint64(63 - j % 48)) & np.uint64(1)).astype(np.int64)
        if j + 1 in steps:
            keys = (keys ^ (keys >> np.uint64(29)) ^ words[place]) * _MIX
    return keys


class BenchmarkIndex:
    """LSH index of at most BLOCK items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items, self.bags, entries = [], [], {}
        for identity, text in items:
            found = WORD.findall(plain(text)) if text else []
            if not found:
                continue
            codes = words_of(text)
            padded = np.concatenate([codes, np.zeros(LONGEST_WALK, np.uint64)])
            longest = lambda o: (-len(found[min(o, len(found) - 1)]), o)
            windows = {(o, LONGEST_WALK) for o in sorted(range(len(found) // 2 + 1), key=longest)[:ANCHORS] if o < len(found)}
            last = max(1, len(found) - LEAST_WALK + 1)
            windows |= {(min(range(o, min(o + STRETCH, last)), key=longest), SHORT_WALK) for o in range(0, last, STRETCH)}
            for offset, size in sorted({(o, min(walk, 1 << (len(found) - o).bit_length() - 1)) for o, walk in windows}):
                for repeat in range(REPEATS):
                    key = int(walk_keys(padded, np.array([offset]), size, repeat)[0])
                    entries.setdefault(size, []).append((key, int(codes[offset]), repeat, len(self.items), offset))
            self.items.append((identity, codes.tolist()))
            self.bags.append(np.unique(codes, return_counts=True))
        self.sizes = {}
        for size, rows in entries.items():
            rows.sort()
            keys, firsts, _, numbers, offsets = (np.array(x, np.uint64) for x in zip(*rows, strict=True))
            likely = np.zeros(1 << 20, bool)
            likely[firsts >> np.uint64(44)] = True
            self.sizes[size] = (keys, likely, np.unique(firsts), numbers.astype(np.int64), offsets.astype(np.int64))

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers, where in ``words`` their windows begin and where they would begin themselves, by number and begin."""
        padded = np.concatenate([words, np.zeros(LONGEST_WALK + 1, np.uint64)])
        numbers, anchors, begins = [], [], []
        prefixes = words >> np.uint64(44)
        for size, (keys, likely, firsts, number, offset) in self.sizes.items():
            at = np.flatnonzero(likely[prefixes])
            found = np.searchsorted(firsts, words[at])
            at = at[firsts[np.minimum(found, len(firsts) - 1)] == words[at]]
            for repeat in range(REPEATS if len(at) else 0):
                sought = walk_keys(padded, at, size, repeat)
                low, high = np.searchsorted(keys, sought, "left"), np.searchsorted(keys, sought, "right")
                hit = np.flatnonzero(high > low)
                count = (high - low)[hit]
                entry = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                numbers.append(number[entry])
                anchors.append(np.repeat(at[hit], count))
                begins.append(anchors[-1] - offset[entry])
        if not numbers:
            return (np.zeros(0, np.int64),) * 3
        number, anchor, begin = (np.concatenate(x) for x in (numbers, anchors, begins))
        order = np.lexsort((anchor, begin, number))
        return number[order], anchor[order], begin[order]

    def may_hold(self, number: int, words: np.ndarray) -> bool:
        """Whether ``words`` holds as many of the item's words as a part within the bound of edits does."""
        own, counts = self.bags[number]
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        shared = np.bincount(at[own[at] == words], minlength=len(own))
        size = len(self.items[number][1])
        return int(np.minimum(shared, counts).sum()) >= size - int(EDITS * size)

    def hits(self, texts: list[str | None]) -> Iterator[list[tuple[object, int, int, int]]]:
        """(item, edits, start, end) of each text, by item; places are code points of the text."""
        low = 0
        while low < len(texts):
            own, size = [], 0
            while low + len(own) < len(texts) and (size < TOGETHER or not own):
                own.append(words_of(texts[low + len(own)]))
                size += len(own[-1])
            yield from self._verified(own, texts[low : low + len(own)])
            low += len(own)

    def _verified(self, own: list[np.ndarray], texts: list[str | None]) -> list[list[tuple[object, int, int, int]]]:
        ends = np.cumsum([len(x) for x in own])
        numbers, anchors, begins = self.candidates(np.concatenate(own))
        owners = np.searchsorted(ends, anchors, "right")
        out: list[list] = [[] for _ in own]
        stretches: dict[tuple[int, int], list[list[int]]] = {}
        for number, begin, k in zip(numbers.tolist(), begins.tolist(), owners.tolist(), strict=True):
            size = len(self.items[number][1])
            slack, first = int(EDITS * size) + 1, int(ends[k - 1]) if k else 0
            a, b = max(0, begin - slack - first), min(int(ends[k]), begin + size + slack) - first
            before = stretches.setdefault((k, number), [])
            if before and a <= before[-1][1]:
                before[-1][1] = max(b, before[-1][1])
            else:
                before.append([a, b])
        places: dict[int, list[tuple[int, int]]] = {}
        for (k, number), parts in sorted(stretches.items()):
            identity, item = self.items[number]
            tested = [(*nearest(item, own[k][a:b].tolist()), a) for a, b in parts if self.may_hold(number, own[k][a:b])]
            if not tested:
                continue
            edits, end, a = min(tested, key=lambda x: (x[0], x[2]))
            if edits > EDITS * len(item):
                continue
            back = nearest(item[::-1], own[k][a : a + end].tolist()[::-1], whole_start=True)[1]
            spans = places.get(k) or places.setdefault(k, [m.span() for m in WORD.finditer(plain(texts[k]))])
            out[k].append((identity, edits, spans[a + end - back][0], spans[a + end - 1][1]))
        return out


def nearest(item: list[int], words: list[int], whole_start: bool = False) -> tuple[int, int]:
    """Least number of edits from ``item`` to a part of ``words``, and the end of the first such part.

    ``whole_start``: only parts from the beginning.  Bit-parallel: an integer holds a column of the table.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, word in enumerate(words, 1):
        equal = masks.get(word, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus) & full, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 | whole_start
        down <<= 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, j
    return best, end


def leak_column(text: Column, index: BenchmarkIndex, id_type: str = "long") -> Column:
    """Array of (item_id, edits, start, end) of the items in a text column."""
    own = SparkSession.active().sparkContext.broadcast(index)

    @F.pandas_udf(f"array<struct<item_id {id_type}, edits long, start long, end long>>")
    def leaks(values: pd.Series) -> pd.Series:
        found = own.value.hits([v if isinstance(v, str) else None for v in values])
        return pd.Series([[{"item_id": i, "edits": e, "start": a, "end": b} for i, e, a, b in row] for row in found], dtype=object)

    return leaks(text)


def index_blocks(benchmark: DataFrame, id_column: str = "item_id", text: str = "text") -> Iterator[BenchmarkIndex]:
    """Indexes of BLOCK items at most, one after the other."""
    rows = benchmark.select(F.col(f"`{id_column}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    block: list = []
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == BLOCK:
            yield BenchmarkIndex(block)
            block = []
    if block:
        yield BenchmarkIndex(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id") -> DataFrame:
    """doc_id, item_id, edits, start and end of every item found in every document."""
    kind, found = benchmark.schema[item_column].dataType.simpleString(), None
    for index in [*index_blocks(benchmark, item_column)] or [BenchmarkIndex([])]:
        own = docs.select(F.col(f"`{id_column}`").alias("doc_id"), leak_column(F.col(f"`{text}`"), index, kind).alias("_leaks"))
        one = own.select("doc_id", F.explode("_leaks").alias("_leak")).select("doc_id", "_leak.*")
        found = one if found is None else found.unionAll(one)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    for index in index_blocks(benchmark):
        docs = docs.where(F.size(leak_column(F.col(f"`{text}`"), index)) == 0)
    return docs
