"""Hard negatives of anchor vectors, by STR-packed R-trees.

Vectors are made integers (``floor(SCALE * x)``), so scores are exact.  All rows are dealt out by range of (label, first
coordinate), and each part becomes one packed tree: rows are sorted by the widest coordinate of their tile, cut into slabs,
and so on (sort-tile-recursive), until a tile is a leaf of ``LEAF`` rows; ``FANOUT`` neighbouring nodes have one parent.
A node's bounding box gives every coordinate's part of an inner product as an interval, and so the least and the largest
score of any row below it.  A search takes nodes by their largest score from a queue, leaves out those whose scores
are all outside the windows it looks for, those all strictly below the k-th best row found so far, and those
without a label it looks for (the label is one more side of the box).

Anchors are packed in chunks.  Every chunk meets every tree (a stated query set against all rows, in blocks): once for the nearest
rows of the same label, once for the best rows of other labels in the windows that those give.  A tree hands on its best
few rows for each anchor and window, and the best of all trees are taken by rank.  Trees and chunks grow with the
tables only up to ``TREE_ROWS`` and ``CHUNK_ROWS``, so a task's memory is bounded; a label or vector that most rows share is spread like
any other, as the row's own number is part of the range.

Defined cases: rows with a null id, label or vector, with a null or non-finite component, or one of 2 ** 17 and more (whose scores
could leave a long) take no part; shorter vectors are filled up with zeros; rows of equal id are rows of their own (each an
anchor, each a positive of the other); ties of scores go by id; anchors without positives, and positives without
negatives in their window, give no rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.session import settle

#: Factor of the components, and the bound of a component.
SCALE, LARGEST = 256.0, float(1 << 17)
#: Rows of a leaf, nodes below a node.
LEAF, FANOUT = 256, 16
#: Rows of a tree and of a chunk of anchors: a share of all, within bounds.
TREE_ROWS, TREES, CHUNK_ROWS, CHUNKS = (4096, 1 << 17), 16, (64, 1 << 14), 8
_PACKED = "vec_id binary, row binary, label binary, vector binary"
_ALL = (-math.inf, math.inf)


def str_order(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Order of the rows in which every ``LEAF`` of them are a leaf."""

    def tiles(rows: np.ndarray) -> list[np.ndarray]:
        leaves = -(-len(rows) // LEAF)
        if leaves < 2:
            return [rows]
        own = labels[rows]
        if own.min() < own.max():
            by = own
        else:
            spread = vectors[rows].max(axis=0) - vectors[rows].min(axis=0)
            by = vectors[rows, int(spread.argmax())] if len(spread) else own
        rows = rows[np.argsort(by, kind="stable")]
        slabs = math.isqrt(leaves - 1) + 1
        size = LEAF * -(-leaves // slabs)
        return [t for at in range(0, len(rows), size) for t in tiles(rows[at : at + size])]

    return np.concatenate(tiles(np.arange(len(labels)))) if len(labels) else np.zeros(0, np.int64)


class PackedTree:
    """Rows in the order of ``str_order``, with the boxes of all nodes."""

    def __init__(self, vec_id: np.ndarray, row: np.ndarray, label: np.ndarray, vector: np.ndarray):
        self.vec_id, self.row, self.label, self.vector = vec_id, row, label, vector
        low = high = vector
        least = most = label
        step, self.levels = LEAF, []
        while not self.levels or len(low) > 1:
            at = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((low, high, least, most))
            step = FANOUT

    def search(self, vector: np.ndarray, label: int, same: bool, windows: list[tuple[float, float]], k: int, but: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the first ``k`` rows of each window, of this label or (not ``same``) of others; without row ``but``."""
        up, down = np.maximum(vector, 0), np.minimum(vector, 0)
        found = [(np.zeros(0, np.int64), np.zeros(0, vector.dtype)) for _ in windows]
        kth = [-math.inf] * len(windows)
        queue: list[tuple[float, int, int, float]] = []

        def offer(level: int, first: int, last: int) -> None:
            low, high, least, most = (x[first:last] for x in self.levels[level])
            fits = (least <= label) & (label <= most) if same else (least != label) | (most != label)
            at = np.flatnonzero(fits)
            upper, lower = high[at] @ up + low[at] @ down, low[at] @ up + high[at] @ down
            for node, a, b in zip((first + at).tolist(), lower.tolist(), upper.tolist(), strict=True):
                heapq.heappush(queue, (-b, level, node, a))

        offer(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue:
            upper, level, node, lower = heapq.heappop(queue)
            open_ = [w for w, (low, high) in enumerate(windows) if -upper >= max(low, kth[w]) and lower <= high]
            if not open_:
                if all(-upper < max(low, kth[w]) for w, (low, _) in enumerate(windows)):
                    break  # what is left has no larger scores
                continue
            if level:
                offer(level - 1, node * FANOUT, (node + 1) * FANOUT)
                continue
            leaf = slice(node * LEAF, (node + 1) * LEAF)
            scores = self.vector[leaf] @ vector
            of_label = (self.label[leaf] == label) == same
            if but >= 0:
                of_label &= self.row[leaf] != but
            for w in open_:
                low, high = windows[w]
                hit = np.flatnonzero(of_label & (scores >= max(low, kth[w])) & (scores <= high))
                if not len(hit):
                    continue
                ids, values = np.concatenate([found[w][0], self.vec_id[leaf][hit]]), np.concatenate([found[w][1], scores[hit]])
                first = np.lexsort((ids, -values))[:k]
                found[w] = ids[first], values[first]
                if len(first) == k:
                    kth[w] = values[first[-1]]
        return found


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """vec_id, row, label and the matrix of the vectors, filled up with zeros."""
    vec_id, row, label = (batch.column(k).to_numpy() for k in range(3))
    vectors = batch.column(3)
    sizes = vectors.value_lengths().to_numpy()
    matrix = np.zeros((batch.num_rows, width), np.int32)
    matrix[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
    return vec_id, row, label, matrix


def _pack(width: int, order, size: int | None = None):
    """Rows of a partition as one packed row, or one for every ``size`` of them; ``order`` gives the order within."""

    def packed(parts: list) -> pa.RecordBatch:
        vec_id, row, label, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = order(matrix, label)
        columns = [pa.array([x[at].tobytes()], pa.binary()) for x in (vec_id, row, label, matrix)]
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *columns], ["block", "vec_id", "row", "label", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for at in range(0, batch.num_rows, size or max(1, batch.num_rows)):
                held.append(_arrays(batch.slice(at, size or batch.num_rows), width))
                if size and sum(len(x[0]) for x in held) >= size:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return pack


def _unpacked(row: dict, prefix: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vec_id, key, label = (np.frombuffer(row[f"{prefix}{x}"], np.int64) for x in ("vec_id", "row", "label"))
    return vec_id, key, label, np.frombuffer(row[f"{prefix}vector"], np.int32).reshape(len(vec_id), width)


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices in a type in which their products are exact: doubles if they fit, which are faster."""
    largest = math.prod(int(np.abs(m.astype(np.int64)).max(initial=0)) for m in matrices)
    return [m.astype(np.float64 if largest * m.shape[1] < 1 << 52 else np.int64) for m in matrices]


def _search(width: int, same: bool, k: int, lower: int, upper: int):
    """Search every chunk of anchors in the tree it stands beside; gives anchor_row, positive_score, vec_id, score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                vec_id, key, label, matrix = _unpacked(row, "", width)
                _, own, labels, anchors = _unpacked(row, "a_", width)
                matrix, anchors = _exact(matrix, anchors)
                tree = PackedTree(vec_id, key, label, matrix)
                scores = np.frombuffer(row["a_scores"], np.int64) if not same else None
                ends = np.frombuffer(row["a_ends"], np.int64) if not same else None
                out: list[list] = [[], [], [], []]
                for i in range(len(own)):
                    if same:
                        sought, windows = [0], [_ALL]
                    else:
                        sought = sorted(set(scores[ends[i - 1] if i else 0 : ends[i]].tolist()))
                        windows = [(-(-lower * s // 100), upper * s // 100) for s in sought]
                    for s, (ids, values) in zip(sought, tree.search(anchors[i], int(labels[i]), same, windows, k, int(own[i]) if same else -1), strict=True):
                        out[0].append(np.full(len(ids), own[i]))
                        out[1].append(np.full(len(ids), s, np.int64))
                        out[2].append(ids)
                        out[3].append(values.astype(np.int64))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["anchor_row", "positive_score", "vec_id", "score"])

    return search


def _bounded(n: int, parts: int, bounds: tuple[int, int]) -> int:
    return min(bounds[1], max(bounds[0], -(-n // parts)))


def _against(chunks: DataFrame, trees: DataFrame, n_trees: int, width: int, same: bool, k: int, window: tuple[int, int]) -> DataFrame:
    """The best ``k`` rows of all trees for each anchor (and positive score)."""
    sent = chunks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))).alias("block"))
    beside = sent.join(trees, "block").repartition(max(1, n_trees * CHUNKS), "block", "a_block")
    hits = beside.drop("block", "a_block").mapInArrow(_search(width, same, k, *window), "anchor_row long, positive_score long, vec_id long, score long")
    best = Window.partitionBy("anchor_row", "positive_score").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
    id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchor`` is a condition on the id column.  A positive is one of the ``positives`` best other rows of the anchor's label; its
    negatives are the ``negatives`` best rows of other labels with scores in ``window`` (per cent of the positive's).
    """
    names = [F.col(f"`{c}`") for c in (id_column, label, vector)]
    whole = rows.select(names[0].cast("long").alias("vec_id"), names[1].cast("long").alias("label"), names[2].cast("array<double>").alias("vector"), anchor.alias("anchor"))
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    good = whole.where("vec_id is not null and label is not null and vector is not null").where(F.coalesce(fits, F.lit(False)))
    scaled = F.transform("vector", lambda x: F.floor(x * SCALE).cast("int"))
    stored = settle(good.select("vec_id", F.monotonically_increasing_id().alias("row"), "label", scaled.alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor")))
    n, n_anchors, width = stored.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("vector"))).first()
    width = max(1, width or 0)
    n_parts = max(1, -(-n // _bounded(n, TREES, TREE_ROWS)))
    ranged = stored.repartitionByRange(n_parts, "label", F.get("vector", F.lit(0)), "row").select("vec_id", "row", "label", "vector")
    trees = settle(ranged.mapInArrow(_pack(width, str_order), f"block long, {_PACKED}"))
    n_trees = 1 + (trees.agg(F.max("block")).first()[0] or 0)
    anchors = stored.where("anchor").select("vec_id", "row", "label", "vector")
    as_they_are = _pack(width, lambda matrix, _: np.arange(len(matrix)), _bounded(n_anchors, CHUNKS, CHUNK_ROWS))
    renamed = [F.col(c).alias(f"a_{c}") for c in ("block", "vec_id", "row", "label", "vector")]
    chunks = anchors.repartition(CHUNKS, "row").mapInArrow(as_they_are, f"block long, {_PACKED}").select(*renamed)
    near = _against(chunks, trees, n_trees, width, True, positives, window)
    pairs = settle(near.select("anchor_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = pairs.groupBy("anchor_row").agg(F.collect_set("positive_score").alias("scores"))  # at most ``positives``
    with_scores = anchors.join(scores, F.col("row") == F.col("anchor_row")).select("vec_id", "row", "label", "vector", "scores")
    chunks = with_scores.repartition(CHUNKS, "row").mapInArrow(_with_scores(as_they_are), f"block long, {_PACKED}, scores binary, ends binary")
    chunks = chunks.select(*renamed, F.col("scores").alias("a_scores"), F.col("ends").alias("a_ends"))
    found = _against(chunks, trees, n_trees, width, False, negatives, window)
    named = pairs.join(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("row").alias("anchor_row")), "anchor_row")
    return named.join(found, ["anchor_row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _with_scores(pack):
    """Chunks as by ``pack``, with the scores of each anchor's positives and where each anchor's end."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list[int]] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists.update(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], batch.schema.names[:4])

        for chunk in pack(noted()):
            own = [lists.pop(row) for row in np.frombuffer(chunk.column(2)[0].as_py(), np.int64).tolist()]
            scores, ends = np.array([s for x in own for s in x], np.int64), np.cumsum([len(x) for x in own])
            columns = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (scores, ends)]
            yield pa.RecordBatch.from_arrays([*chunk.columns, *columns], [*chunk.schema.names, "scores", "ends"])

    return packed
