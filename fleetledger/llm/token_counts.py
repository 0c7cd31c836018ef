"""Token counts from counts of distinct pre-tokens; no document's ids are ever made.

A sentencepiece vocabulary whose pieces hold a space mark only at their start can never
merge across "something, then a space", so each text falls into pre-tokens of spaces
and what follows them up to the next space.  Three steps:

1. ``pre_token_counts``: distinct pre-tokens with their occurrences (combined in each task
   before the shuffle) and the number of vocabulary pieces of each, worked out once;
   written to the shared folder.
2. ``frequent``: pre-tokens with at least 1 / ``FREQUENT_SHARE`` of all occurrences.  No more than
   ``FREQUENT_SHARE`` can have that share, so this part is safe to broadcast, and no key that is
   left for the join can be hot.
3. ``count_tokens``: per document, the frequent ones are summed in place; of the others the
   frequencies go to a join with step 1 and are summed per document.

Defined cases: null and empty texts have no tokens; strings of special tokens are ordinary
text; texts may have any length; documents are told apart by their place in the input, so
repeated rows and null ids give a row each; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.session import shared_folder

#: At most so many pre-tokens are broadcast.
FREQUENT_SHARE = 2**21
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 300_000
SPACE_MARK = "▁"
_PRE_TOKEN = re.compile(" +[^ ]*")


@functools.lru_cache(maxsize=2)
def _model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, int]:
    """The model and the number of tokens of a lone space mark."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("a piece of this vocabulary spans a space; its texts can't be cut at spaces")
    return model, len(model.encode("a ")) - len(model.encode("a"))


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the one space before it that encoding puts back."""
    return [x[1:] for x in _PRE_TOKEN.findall(" " + text.replace(SPACE_MARK, " "))] if text else []


def piece_counts(names: list[str], path: str) -> list[int]:
    """Tokens of each pre-token."""
    model, lone = _model(path)
    return [len(ids) if name else lone for name, ids in zip(names, model.encode(names, num_threads=1), strict=True)]


def pre_token_counts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """pre_token, occurrences and n_pieces of every distinct pre-token."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pre_token", "n"])

        held: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                held.update(pre_tokens(value.as_py() or ""))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(piece_counts(batch.column("pre_token").to_pylist(), model), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], ["pre_token", "occurrences", "n_pieces"])

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(occurrences, "pre_token string, n long")
    every = found.groupBy("pre_token").agg(F.sum("n").alias("occurrences"))
    return every.mapInArrow(pieces, "pre_token string, occurrences long, n_pieces long")


def frequent(counts: DataFrame) -> dict[str, int]:
    """Pieces of the pre-tokens that have a share of 1 / FREQUENT_SHARE of all occurrences; at most FREQUENT_SHARE entries."""
    total = counts.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    common = counts.where(F.col("occurrences") * FREQUENT_SHARE >= total).select("pre_token", "n_pieces").toArrow()
    return dict(zip(common.column(0).to_pylist(), common.column(1).to_pylist(), strict=True))


def count_tokens(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "pre-tokens")
    pre_token_counts(docs, model, text).write.parquet(folder)
    counts = spark.read.parquet(folder)
    common = spark.sparkContext.broadcast(frequent(counts))
    kind = docs.schema[id_column].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with slot = its number, and one for each other pre-token in it, with slot -1."""
        number, known = TaskContext.get().partitionId() << 40, common.value
        for batch in batches:
            own, ids, sizes, names, slots, rows, n = batch.column(0).to_pylist(), [], [], [], [], [], []
            for identity, value in zip(own, batch.column(1), strict=True):
                value, rest, total = value.as_py() or "", [], 0
                for name in pre_tokens(value):
                    pieces = known.get(name)
                    if pieces is None:
                        rest.append(name)
                    else:
                        total += pieces
                others = Counter(rest)
                k = len(others)
                ids += [identity] + [None] * k
                sizes += [len(value.encode())] + [None] * k
                names += ["", *others]
                slots += [number] + [-1] * k
                rows += [number] * (k + 1)
                n += [total, *others.values()]
                number += 1
                if len(n) > HELD:
                    yield _rows(batch.schema.field(0).type, ids, sizes, names, slots, rows, n)
                    ids, sizes, names, slots, rows, n = [], [], [], [], [], []
            yield _rows(batch.schema.field(0).type, ids, sizes, names, slots, rows, n)

    split = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        frequencies, f"doc_id {kind}, n_bytes long, pre_token string, slot long, row long, n long"
    )
    pieces = counts.select("pre_token", F.lit(-1).cast("long").alias("slot"), "n_pieces")
    joined = split.join(pieces, ["pre_token", "slot"], "left")
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") * F.when(F.col("slot") < 0, F.col("n_pieces")).otherwise(1)).alias("n_tokens"),
        )
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def _rows(kind: pa.DataType, ids: list, sizes: list, names: list, slots: list, rows: list, n: list) -> pa.RecordBatch:
    columns = [pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(names, pa.string())]
    columns += [pa.array(x, pa.int64()) for x in (slots, rows, n)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "pre_token", "slot", "row", "n"])
