"""Documents packed into training sequences by large-item matching and best fit.

Every document is encoded and cut into pieces of at most ``capacity`` ids; all but the first piece are full.  A sequence holds at most
two pieces of more than a third of its capacity, so these are matched: from the longest on, each with the longest that fits
beside it.  The others, from the longest on, go where the least room is left that holds them, and open a
sequence where none does.

Which document a piece comes from does not matter for that, only how many pieces have each length.  So the
plan is made of counts (one for each length, ``capacity`` of them whatever the corpus): a step of it puts a run of pieces of one
length into a run of alike sequences, exactly as one by one would.  The steps are bounded by the capacity too: a
sequence takes small pieces of at most 36 different lengths (1 + 2 + ... + 37 > 682), alike sequences take the same steps, and each length
splits at most two runs.  Pieces get their number among those of their length from the counts of each part of the
stored pieces, and find their step, and so their place, by that number.

Pieces are stored once, with their ids (in two bytes each where the vocabulary allows), and shuffled once, to meet the
counts of their part.

Defined cases: null and empty texts hold only the end id; documents of null or equal ids are documents of their own;
texts of any length are cut into as many pieces as they need; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.llm.forced_boundary_bpe import coder
from fleetledger.session import settle, shared_folder

#: Pieces handed on together.
TOGETHER = 2048


class Step(NamedTuple):
    """Pieces of ``length`` from number ``rank`` on: ``each`` of them in every sequence from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[Step], int]:
    """The steps that place ``counts`` pieces of each length, and the number of sequences."""
    left, placed = Counter({n: c for n, c in counts.items() if c}), Counter()
    steps: list[Step] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, number)
    opened = 0

    def place(length: int, number: int, sequence: int, each: int, offset: int) -> None:
        steps.append(Step(length, placed[length], sequence, each, offset))
        placed[length] += number
        left[length] -= number

    def give(space: int, first: int, number: int) -> None:
        if number and space:
            room.setdefault(space, []).append((first, number))

    for long in range(capacity, capacity // 3, -1):
        while left[long]:
            partner = next((n for n in range(min(long, capacity - long), capacity // 3, -1) if left[n] > (n == long)), 0)
            number = min(left[long], left[partner]) if partner != long else left[long] // 2
            number = number if partner else left[long]
            place(long, number, opened, 1, 0)
            if partner:
                place(partner, number, opened, 1, long)
            give(capacity - long - partner, opened, number)
            opened += number
    for small in range(capacity // 3, 0, -1):
        while left[small]:
            space = next((s for s in range(small, capacity) if room.get(s)), 0)
            if space:
                first, number = room[space].pop()
            else:
                space, first, number = capacity, opened, -(-left[small] // (capacity // small))
                opened += number
            each = space // small
            full = min(number, left[small] // each)
            if full:
                place(small, full * each, first, each, capacity - space)
                give(space - each * small, first, full)
            if full < number and left[small]:
                rest = left[small]
                place(small, rest, first + full, rest, capacity - space)
                give(space - rest * small, first + full, 1)
                full += 1
            give(space, first + full, number - full)
    return steps, opened


def _cut(vocabulary: str, capacity: int, end: bytes):
    """Pieces of every document, each with its part and its number among the part's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, numbers = coder(vocabulary), TaskContext.get().partitionId(), Counter()
        narrow = len(own.texts) <= 1 << 16
        names = ["doc_id", "piece", "start", "length", "ids", "part", "number"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for identity, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = own.encode(value.as_py()) + end
                n, width = len(packed) // 4, 2 if narrow else 4
                if narrow:
                    packed = np.frombuffer(packed, "<u4").astype("<u2").tobytes()
                start, stop = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    length = stop - start
                    held.append((identity, piece, start, length, packed[width * start : width * stop], part, numbers[length]))
                    numbers[length] += 1
                    start, stop = stop, stop + capacity
                    if len(held) >= TOGETHER:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    return cut


def _place(steps: list[Step]):
    """Column function: sequence and offset of the piece of this length and number."""
    ordered = np.array(sorted(steps), np.int64).reshape(-1, 5)
    length, rank, sequence, each, offset = ordered.T
    begins = (length << 44) + rank

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        own, number = lengths.to_numpy(), ranks.to_numpy()
        at = np.searchsorted(begins, (own << 44) + number, "right") - 1
        within = number - rank[at]
        columns = [pa.array(sequence[at] + within // each[at]), pa.array(offset[at] + within % each[at] * own)]
        return pa.StructArray.from_arrays(columns, ["sequence_id", "offset"])

    return place


def widened(ids: Column, length: Column) -> Column:
    """Packed ids, ``length`` of them, in four bytes each, from two or four."""

    @F.arrow_udf("binary")
    def widen(values: pa.Array, lengths: pa.Array) -> pa.Array:
        counts = lengths.to_numpy()
        plain = b"".join(values.to_pylist())
        width = len(plain) // max(1, int(counts.sum()))
        data = np.frombuffer(plain, f"<u{width or 4}").astype("<u4")
        ends = np.concatenate([[0], np.cumsum(4 * counts)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    return widen(ids, length)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id and offset of every piece."""
    folder = shared_folder(docs.sparkSession, "pieces")
    own = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids binary, part long, number long"
    own.mapInArrow(_cut(vocabulary, capacity, end_id.to_bytes(4, "little")), schema).write.parquet(folder)
    pieces = docs.sparkSession.read.parquet(folder)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = settle(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    before = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    place = _place(packing_plan(counts, capacity)[0])
    ranked = pieces.join(before, ["part", "length"]).withColumn("place", place(F.col("length"), F.col("number") + F.col("before")))
    return ranked.select("doc_id", "piece", "start", "length", widened(F.col("ids"), F.col("length")).alias("ids"), "place.*")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, and the doc_id and length of the pieces of every sequence, in order (at most ``capacity`` pieces each)."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(inside.alias("in"))
    joined = F.aggregate("in", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.col("in.doc_id").alias("doc_ids"), F.col("in.length").alias("lengths"))
