"""SimHash near-duplicates by deletion variants.

The 64 bits of a fingerprint are cut into two halves.  Of two fingerprints that differ in three bits at
most, one half differs in one bit at most.  So each distinct fingerprint is indexed under the 64 keys "this half,
with this bit left out", and fingerprints under one key are verified by counting the bits in which they differ.

Fingerprints of one key are sorted together by Spark and looked at as a stream.  Up to ``RUN`` of them are compared with each
other, and only links from each to the smallest of its group are handed on, never all pairs.  Keys with more
are handed on to a second index: the 33 bits that their fingerprints do not share are cut and left out in the same
way, which leaves at most 2 ** 17 different fingerprints under a key.  Links are joined to components.

Documents of equal fingerprints are one entry throughout.  Fingerprints and links are stored in the shared folder and never collected.

Defined cases: null and empty texts have fingerprint zero and are linked like others; rows with a null id take part, and a
component's id is its smallest id that is not null (null if there is none); repeated rows and ids give a row each; an
empty table gives no rows; other columns are not read (``keep_one`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.llm.components import connected
from fleetledger.llm.names import free_name
from fleetledger.session import settle, shared_folder

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of one key that are compared at once.
RUN = 2048


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's shingles, each as often as it occurs."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: max(0, len(words) - SHINGLE)].tolist()]
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    hashes = b"".join(map(xxhash.xxh64_digest, map(joined.__getitem__, map(slice, begins, stops)), repeat(SEED)))
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(begins)).tobytes(), "big")


def fingerprint_column(text: Column) -> Column:
    """Fingerprint of a text column, as a signed long."""

    @F.pandas_udf("long")
    def simhash(values: pd.Series) -> pd.Series:
        found = np.array([fingerprint(v if isinstance(v, str) else None) for v in values], np.uint64)
        return pd.Series(found.view(np.int64))

    return simhash(text)


def _groups(prints: np.ndarray) -> np.ndarray:
    """For each of a key's fingerprints the position of the first of its group."""
    label = np.arange(len(prints))
    if len(prints) <= RUN:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= DISTANCE
        while True:
            least = np.where(near, label[None, :], len(prints)).min(axis=1)
            if (least == label).all():
                return label
            label = least
    for i in range(len(prints)):
        found = np.unique(label[: i + 1][np.bitwise_count(prints[: i + 1] ^ prints[i]) <= DISTANCE])
        if len(found) > 1:
            label[: i + 1][np.isin(label[: i + 1], found)] = found[0]
    return label


def _link(bounded: bool):
    """Links among the fingerprints of each key; rows of keys with more than RUN are handed on with their key unless ``bounded``."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, key: int | None = None) -> pa.RecordBatch:
            keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(np.full(len(a), key), pa.int64())
            return pa.RecordBatch.from_arrays([keys, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "a", "b"])

        def run(prints: np.ndarray) -> pa.RecordBatch:
            first = prints[_groups(prints)]
            apart = first != prints
            return out(prints[apart], first[apart])

        held_keys, held, crowded = np.zeros((0, 0), np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(batch.num_columns - 1)])
            prints = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            if len(held):
                keys, prints = np.concatenate([held_keys, keys]), np.concatenate([held, prints])
            if not len(keys):
                continue
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            last = int(starts[-1])
            if crowded is not None:
                if (keys[0] == crowded).all():
                    end = int(sizes[0])
                    yield out(prints[:end], prints[:end], int(crowded[0]))
                    if len(starts) == 1:
                        held_keys, held = keys[:0], prints[:0]
                        continue
                    starts, sizes = starts[1:], sizes[1:]
                crowded = None
            whole, size = starts[:-1], sizes[:-1]
            two = whole[size == 2]
            near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= DISTANCE]
            yield out(prints[near + 1], prints[near])
            for at, n in zip(whole[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if n > RUN and not bounded:
                    yield out(prints[at : at + n], prints[at : at + n], int(keys[at, 0]))
                else:
                    yield run(prints[at : at + n])
            held_keys, held = keys[last:], prints[last:]
            if len(held) > RUN and not bounded:
                crowded = held_keys[0]
                yield out(held, held, int(crowded[0]))
                held_keys, held = held_keys[:0], held[:0]
        if len(held) > 1:
            yield run(held)

    return links


def _without(value: Column, bit: Column) -> Column:
    """``value`` with one bit cleared."""
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``prints`` (distinct longs) that are joined by pairs of at most DISTANCE bits."""
    half = F.when(F.col("v") < 32, F.col("fingerprint")).otherwise(F.shiftrightunsigned("fingerprint", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    key = F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(_without(half, F.col("v") % 32))
    keyed = prints.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(key.alias("key"), "fingerprint")
    schema = "key long, a long, b long"
    first = settle(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link(False), schema))
    crowded = first.where("key is not null").select("key", F.col("a").alias("fingerprint"))
    # What fingerprints of a key do not share: the other half, and the bit left out of this one.
    v = F.shiftrightunsigned("key", 32).cast("int")
    other = F.when(v < 32, F.shiftrightunsigned("fingerprint", 32)).otherwise(F.col("fingerprint")).bitwiseAND(F.lit(0xFFFFFFFF))
    own = F.when(v < 32, F.col("fingerprint")).otherwise(F.shiftrightunsigned("fingerprint", 32))
    bit = F.call_function("shiftrightunsigned", own, v % 32).bitwiseAND(F.lit(1))
    rest = F.shiftleft(bit, 32).bitwiseOR(other)
    part = F.when(F.col("w") < 17, F.col("rest").bitwiseAND(F.lit(0x1FFFF))).otherwise(F.shiftrightunsigned("rest", 17))
    again = F.shiftleft(F.col("w").cast("long"), 17).bitwiseOR(_without(part, F.when(F.col("w") < 17, F.col("w")).otherwise(F.col("w") - 17)))
    finer = crowded.withColumn("rest", rest).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(32)))).select("key", again.alias("finer"), "fingerprint")
    second = finer.repartition("key", "finer").sortWithinPartitions("key", "finer").mapInArrow(_link(True), schema)
    return first.where("key is null").unionAll(second).select("a", "b").distinct()


def _stored(own: DataFrame) -> DataFrame:
    """``own`` written to the shared folder and read again."""
    folder = shared_folder(own.sparkSession, "fingerprints")
    own.write.parquet(folder)
    return own.sparkSession.read.parquet(folder)


def with_components(own: DataFrame) -> DataFrame:
    """``own`` (doc_id, fingerprint) with component_id and root, the fingerprint that stands for its component."""
    entries = settle(own.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = connected(links(entries.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    rooted = entries.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(rooted.join(named, "root").select("fingerprint", "component_id", "root"), "fingerprint", "left")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    own = docs.select(F.col(f"`{id_column}`").alias("doc_id"), fingerprint_column(F.col(f"`{text}`")).alias("fingerprint"))
    joined = with_components(_stored(own))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of near-duplicates the row with the smallest id (nulls last; of equal ids one), with all columns of ``docs``."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    a, b, n = (free_name(docs, x) for x in ("_mark_a", "_mark_b", "_copy"))
    mark = [F.xxhash64(*columns).alias(a), F.xxhash64(F.lit(1), *[c.isNull() for c in columns], *columns).alias(b)]
    own = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.struct(*mark).alias("row"), fingerprint_column(F.col(f"`{text}`")).alias("fingerprint"))
    joined = with_components(_stored(own))
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    winners = first.select("first.row.*").distinct()
    kept = docs.select("*", *mark).join(winners, [a, b], "left_semi")
    once = kept.withColumn(n, F.row_number().over(Window.partitionBy(a, b).orderBy(a)))
    return once.where(F.col(n) == 1).select(*columns)
