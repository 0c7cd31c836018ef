"""Keep a table current from a stream of changes.

Every micro-batch is folded to the newest image per key and written as its own
delta, named by its checkpoint and the batch number.  A batch that is run again overwrites its own
delta, and an image older than the one already held loses the fold, so repeats
and late files change nothing.  Deleted keys stay as tombstones.

Keys are dealt to buckets, in deltas and in what they are merged to.  :func:`compact` folds new deltas into the buckets they
touch, while the stream runs, and then writes a manifest: the folder of each bucket and, for each run of the stream, the last batch
that is merged.  A manifest is one file, put in place at once; readers take the newest one and the deltas after it, so they see
all of a merge or nothing of it.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetledger.operators.changelog import fold_images, keyed_images, live_rows

BUCKETS = 16
_MANIFEST = "kind string, bucket int, folder string, run string, batch long"


@dataclass
class Manifest:
    """What the deltas up to ``merged`` (run to batch) are merged to: ``folders`` (bucket to folder)."""

    version: int
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    merged: dict[str, int] = field(default_factory=dict)


def _read_manifest(spark: SparkSession, state: str) -> Manifest:
    rows = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{state}/_manifest")
    rows = rows.where(F.col("version") == rows.agg(F.max("version")).scalar()).collect()  # a row for each bucket and run
    held = Manifest(rows[0].version, next(r.bucket for r in rows if r.kind == "buckets"))
    held.folders = {r.bucket: r.folder for r in rows if r.kind == "folder"}
    held.merged = {r.run: r.batch for r in rows if r.kind == "merged"}
    return held


def _write_manifest(spark: SparkSession, state: str, m: Manifest, mode: str = "error") -> None:
    rows = [("buckets", m.buckets, None, None, None)]
    rows += [("folder", b, f, None, None) for b, f in m.folders.items()]
    rows += [("merged", None, None, r, n) for r, n in m.merged.items()]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode(mode).parquet(f"{state}/_manifest/version={m.version}")


def start_replay(
    changes: DataFrame,
    keys: list[str],
    state: str,
    checkpoint: str,
    order: tuple[str, ...] | None = None,
    every: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Start folding a stream of typed changes into deltas below ``state``.

    Deltas carry the name of their checkpoint, so a stream that begins anew on another checkpoint adds deltas
    of its own and never overwrites those of an earlier one.  ``buckets`` holds for a new state; one that is there keeps its own.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    spark = changes.sparkSession
    _write_manifest(spark, state, Manifest(0, buckets), "ignore")
    buckets = _read_manifest(spark, state).buckets

    def write_delta(batch: DataFrame, number: int) -> None:
        _write(fold_images(keyed_images(batch, keys, order), keys), keys, buckets, f"{state}/delta={run}-{number}")

    writer = changes.writeStream.foreachBatch(write_delta).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _write(images: DataFrame, keys: list[str], buckets: int, folder: str) -> None:
    dealt = images.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)  # one file a bucket, not one a task and bucket


def _after(merged: dict[str, int]) -> Column:
    """Deltas that no manifest has taken in."""
    run, batch = F.substring_index("delta", "-", 1), F.substring_index("delta", "-", -1).cast("long")
    upto = F.lit(None).cast("long")
    for name, number in merged.items():
        upto = F.when(run == name, F.lit(number)).otherwise(upto)
    return batch > F.coalesce(upto, F.lit(-1))


def _deltas(spark: SparkSession, state: str, base: DataFrame | None) -> DataFrame:
    reader = spark.read
    if base is not None:  # all deltas may be merged and removed
        reader = reader.schema(T.StructType([*base.schema.fields, T.StructField("delta", T.StringType())]))
    return reader.parquet(state)


def _merged_images(spark: SparkSession, state: str, held: Manifest, buckets: list[int] | None = None) -> DataFrame | None:
    folders = [f for b, f in held.folders.items() if buckets is None or b in buckets]
    return spark.read.option("basePath", f"{state}/_base").parquet(*[f"{state}/_base/{f}" for f in folders]).drop("part") if folders else None


def state_images(spark: SparkSession, state: str, keys: list[str]) -> DataFrame:
    """Newest image per key over what is merged and all deltas after it, tombstones included."""
    held = _read_manifest(spark, state)
    base = _merged_images(spark, state, held)
    images = _deltas(spark, state, base).where(_after(held.merged)).drop("delta")
    return fold_images((images if base is None else images.unionByName(base)).drop("bucket"), keys)


def current_table(spark: SparkSession, state: str, keys: list[str]) -> DataFrame:
    """The table as of the last finished micro-batch."""
    return live_rows(state_images(spark, state, keys))


def _without_old_tombstones(images: DataFrame, keep_deleted_after: dict | None) -> DataFrame:
    if not keep_deleted_after:
        return images
    bound = F.struct(*[(F.lit(v) if isinstance(v, str) else F.lit(v).cast("long")).alias(k) for k, v in keep_deleted_after.items()])
    position = F.struct(*[F.col("at")[k].alias(k) for k in keep_deleted_after])
    live = F.col("live") if "live" in images.columns else F.col("row").isNotNull()
    return images.where(live | (position >= bound))


def merge_input(spark: SparkSession, state: str, running: bool = True) -> tuple[DataFrame | None, Manifest, list[int]]:
    """What :func:`compact` folds (None if there is nothing new), the manifest that it leads to but for folders, and the buckets touched."""
    held = _read_manifest(spark, state)
    some = _merged_images(spark, state, held, list(held.folders)[:1])
    deltas = _deltas(spark, state, some).where(_after(held.merged))
    # Partition values only, the number of micro-batches since the last merge times the buckets.
    found = deltas.select("delta", "bucket").distinct().collect()
    upto: dict[str, int] = {}
    for row in found:
        run, number = row.delta.rsplit("-", 1)
        upto[run] = max(upto.get(run, -1), int(number))
    if running:  # the newest batch of a run may still be written, or be written again
        upto = {run: number - 1 for run, number in upto.items()}
    taken = [r for r in found if int(r.delta.rsplit("-", 1)[1]) <= upto[r.delta.rsplit("-", 1)[0]]]
    buckets = sorted({r.bucket for r in taken})
    nxt = Manifest(held.version + 1, held.buckets, dict(held.folders), held.merged | {run: n for run, n in upto.items() if n >= 0})
    if not taken:
        return None, held, []
    new = deltas.where(F.col("delta").isin(sorted({r.delta for r in taken})) & F.col("bucket").isin(buckets)).drop("delta")
    base = _merged_images(spark, state, held, buckets)
    return new if base is None else new.unionByName(base), nxt, buckets


def compact(spark: SparkSession, state: str, keys: list[str], keep_deleted_after: dict | None = None, running: bool = True) -> int:
    """Merge new deltas into the buckets they touch and switch readers to the result; the version of the manifest after that.

    May run beside the stream; then the newest batch is left for the next time (``running=False`` takes it as well, once the stream has
    ended).  Of two merges at once the second fails at the manifest and changes nothing.  Tombstones are kept unless their log
    position is below ``keep_deleted_after`` (field name to value, compared in field order): dropping one is safe once
    no older change can arrive any more.
    """
    images, after, buckets = merge_input(spark, state, running)
    if images is None:
        return after.version
    part = f"part={uuid.uuid4().hex}"
    folded = _without_old_tombstones(fold_images(images.drop("bucket"), keys), keep_deleted_after)
    _write(folded, keys, after.buckets, f"{state}/_base/{part}")
    kinds = T.StructType([*folded.schema.fields, T.StructField("bucket", T.IntegerType())])
    there = [r.bucket for r in spark.read.schema(kinds).parquet(f"{state}/_base/{part}").select("bucket").distinct().collect()]
    after.folders = {b: f for b, f in after.folders.items() if b not in buckets} | {b: f"{part}/bucket={b}" for b in there}
    _write_manifest(spark, state, after)
    return after.version


def unused_folders(spark: SparkSession, state: str) -> list[str]:
    """Folders below ``state`` that the newest manifest does not need: merged deltas and replaced buckets.

    Remove them once no reader works on an older manifest.
    """
    held = _read_manifest(spark, state)
    if not held.folders:
        return []
    base = _merged_images(spark, state, held)
    old = [f"delta={r.delta}" for r in _deltas(spark, state, base).where(~_after(held.merged)).select("delta").distinct().collect()]
    parts = spark.read.parquet(f"{state}/_base").select(F.concat(F.lit("part="), "part", F.lit("/bucket="), "bucket").alias("f")).distinct().collect()
    return sorted(old + [f"_base/{r.f}" for r in parts if r.f not in held.folders.values()])


def compact_state(spark: SparkSession, state: str, target: str, keys: list[str], keep_deleted_after: dict | None = None) -> None:
    """Write the folded state to ``target`` as the only delta of a new state folder; tombstones as in :func:`compact`."""
    buckets = _read_manifest(spark, state).buckets
    images = _without_old_tombstones(state_images(spark, state, keys), keep_deleted_after)
    _write_manifest(spark, target, Manifest(0, buckets), "overwrite")
    _write(images, keys, buckets, f"{target}/delta=base-0")
