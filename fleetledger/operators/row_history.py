"""The versions of every row along a log, and the table as it was at any position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetledger.operators.changelog import keyed_images, log_order
from fleetledger.operators.log_scan import SLICE
from fleetledger.session import settle, stored

#: Changes in a slice of a stored history, about; no fewer than there are rows that change.  A row that changes is stored once more for every slice it lives through.
SLICE_ROWS = 10_000_000
#: The slice of rows that no change touches.
ALWAYS = -1


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def _slices(images: DataFrame, place: list[str], slice_rows: int, slice_bytes: int) -> DataFrame:
    """``place``, ``_cut`` and ``_slice``: stretches of ``slice_bytes``, put together while they have fewer than ``slice_rows`` changes.

    A row for each stretch, so the one window over all of them stays small (1.6 million rows for 100 TB of log).
    """
    counted = images.groupBy(*[F.col("at")[p].alias(f"_{p}") for p in place], F.floor(F.col("at.pos") / slice_bytes).alias("_cut")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(*[F.col(f"_{p}").asc_nulls_first() for p in place], "_cut").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_slice", F.floor(F.coalesce(F.sum("_rows").over(before), F.lit(0)) / slice_rows)).drop("_rows")


def _base_images(base: DataFrame, keys: list[str], names: list[str], kind) -> DataFrame:
    """Rows of a base table as images that stand before the whole log."""
    at = F.struct(*[F.lit({"rank": 0, "step": 1}.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.fields])
    cells = F.struct(*[F.struct(at.alias("at"), F.col(c).alias("v")).alias(c) for c in names])
    return base.select(*keys, at.alias("at"), F.lit(True).alias("live"), cells.alias("cells"), F.lit(0).cast("long").alias("_slice"))


def _versions(base: DataFrame | None, changes: DataFrame, keys: list[str], slice_rows: int, slice_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions with the slices they begin and end in, the slices, and the images of all changes."""
    order = log_order(changes)
    place, names = list(order[: order.index("pos")]), changes.schema["after"].dataType.names
    if "have" not in changes.columns:
        changes = changes.withColumn("have", F.array_repeat(F.lit(True), len(names)))
    images = stored(keyed_images(changes, keys, order), "images")  # the log is read once
    slices = settle(_slices(images, place, slice_rows, slice_bytes))
    stretch = _same([F.col("at")[p] for p in place], [F.col(f"_{p}") for p in place]) & (F.floor(F.col("at.pos") / slice_bytes) == F.col("_cut"))
    every = images.join(slices, stretch).select(*keys, "at", "live", "cells", "_slice")
    if base is not None:
        touched = images.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = _same([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys])
        first = _base_images(base.join(touched, same, "left_semi"), keys, names, images.schema["at"].dataType)
        every = every.unionByName(first)

    # A prefix scan: what each slice leaves of a key is carried over to its next ones; windows over events stay inside a slice.
    ends = every.groupBy(*keys, "_slice").agg(F.min("at").alias("_first"), *[F.max_by(F.col("cells")[c], F.col("cells")[c]["at"]).alias(f"_{i}") for i, c in enumerate(names)])
    along = Window.partitionBy(*keys).orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_part"),
        *[F.last(f"_{i}", ignorenulls=True).over(before).alias(f"_carry{i}") for i in range(len(names))],
        F.lead("_first").over(along).alias("_next"), F.lead("_slice").over(along).alias("_next_slice"),
    )
    same = _same([*map(F.col, keys), F.col("_slice")], [*[F.col(f"_k{i}") for i in range(len(keys))], F.col("_part")])
    inside = Window.partitionBy(*keys, "_slice").orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    later = F.lead("at").over(inside)
    cells = [F.coalesce(F.last(F.col("cells")[c], ignorenulls=True).over(so_far), F.col(f"_carry{i}")).alias(f"_c{i}") for i, c in enumerate(names)]
    seen = every.join(carried, same).select(
        "at", "live", "_slice", *cells, F.coalesce(later, F.col("_next")).alias("to_at"),
        F.when(later.isNotNull(), F.col("_slice")).otherwise(F.col("_next_slice")).alias("_to_slice"),
    )
    # A column that nothing tells, or that a tombstone told last, makes a version incomplete.
    known = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_c{i}")["at"]["step"] == 1, F.lit(False)) for i in range(len(names))])
    logged = F.when(F.col("at.rank") == 1, F.col("at"))
    values = [F.col(f"_c{i}")["v"].alias(c) for i, c in enumerate(names)]
    found = seen.where(F.col("live") & known).select(*values, logged.alias("from_at"), "to_at", "_slice", "_to_slice")
    if base is not None:
        ends_of = [F.lit(None).cast(images.schema["at"].dataType).alias(n) for n in ("from_at", "to_at")]
        rest = base.join(touched, _same([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys]), "left_anti")
        always = F.lit(ALWAYS).cast("long")
        found = found.unionByName(rest.select(*names, *ends_of, always.alias("_slice"), always.alias("_to_slice")))
    return found, slices, images


def row_history(base: DataFrame | None, changes: DataFrame, keys: list[str], slice_rows: int = SLICE_ROWS, slice_bytes: int = SLICE) -> DataFrame:
    """Every version of every row: its columns, ``from_at`` (NULL: held before the log) and ``to_at`` (NULL: held at its end).

    ``changes`` are typed changes with whole or partial images; a column that a change does not name keeps its value.  Versions
    with a column that nobody tells are left out, as are key changes that do not name all columns.  A key of any
    share of the changes is cut into slices of the log, so no task holds more than a slice of it.
    """
    return _versions(base, changes, keys, slice_rows, slice_bytes)[0].drop("_slice", "_to_slice")


def write_history(base: DataFrame | None, changes: DataFrame, keys: list[str], path: str, slice_rows: int = SLICE_ROWS, slice_bytes: int = SLICE) -> None:
    """Store the history below ``path`` for :func:`as_of`: a folder for each slice of the log with the versions that hold in it.

    Rows that never change are stored once.  Slices are put together until they have as many changes as there are rows that
    change, so what lives on into slices is never more than there are changes: the others take up to twice the room of their versions.
    """
    found, slices, images = _versions(base, changes, keys, slice_rows, slice_bytes)
    together = -(-images.select(*keys).distinct().count() // slice_rows) or 1
    whole = lambda slice: F.when(slice < 0, slice).otherwise(F.floor(slice / together))
    slices = slices.withColumn("_slice", whole(F.col("_slice")))
    last = slices.agg(F.coalesce(F.max("_slice"), F.lit(0))).scalar()
    begin, end = (whole(F.col(c)) for c in ("_slice", "_to_slice"))
    spread = F.when(F.col("_slice") == ALWAYS, F.array("_slice")).otherwise(F.sequence(begin, F.coalesce(end, last)))
    rows = found.withColumn("slice", F.explode(spread)).drop("_slice", "_to_slice")
    rows.write.partitionBy("slice").parquet(f"{path}/versions")
    slices.withColumn("_bytes", F.lit(slice_bytes)).coalesce(1).write.parquet(f"{path}/slices")


def as_of(spark: SparkSession, path: str, pos: int, file_no: int | None = None, file: str | None = None) -> DataFrame:
    """The table after all events up to and including the one at ``pos`` of a file; only the versions of its slice are read."""
    slices = spark.read.parquet(f"{path}/slices")
    given = {"file_no": F.lit(file_no).cast("long"), "file": F.lit(file).cast("string")}
    place = [c[1:] for c in slices.columns if c not in ("_cut", "_slice", "_bytes")]
    begun = F.struct(*[F.col(f"_{p}").alias(p) for p in place], F.col("_cut").alias("cut"))
    sought = F.struct(*[given[p].alias(p) for p in place], F.floor(F.lit(pos) / F.col("_bytes")).alias("cut"))
    number = slices.where(begun <= sought).agg(F.coalesce(F.max("_slice"), F.lit(0))).first()[0]
    versions = spark.read.parquet(f"{path}/versions")
    here = {"rank": F.lit(1), **given, "pos": F.lit(pos), "row_no": F.lit((1 << 63) - 1), "step": F.lit(1)}
    at = F.struct(*[here[f.name].cast(f.dataType).alias(f.name) for f in versions.schema["to_at"].dataType.fields])
    held = (F.col("from_at").isNull() | (F.col("from_at") <= at)) & (F.col("to_at").isNull() | (F.col("to_at") > at))
    return versions.where(F.col("slice").isin(ALWAYS, number)).where(held).drop("slice", "from_at", "to_at")
