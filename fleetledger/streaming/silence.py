"""Hosts that fall silent and come back, told by a stream while they do."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetledger.streaming.heartbeats import TIMEOUT

SILENT, BACK = "silent", "back"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """While a query is started that needs timers: the state store that has them, then what was set before."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class Watch(StatefulProcessor):
    """Of one key: the last second that beat, whether its silence was told, and the seconds the watermark has not passed.

    Beats count in the order of their time, whatever order they come in, as each waits for the watermark.  A timer stands
    at the next second that waits and at the end of the patience after the last beat, so silence is told
    without another beat of the key.
    """

    def __init__(self, timeout: int, keys: list[str]):
        self.timeout, self.keys = timeout, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "last long, told boolean, waiting array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._on(key, {int(r["_second"]) for r in rows}, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._on(key, set(), timerValues)

    def close(self) -> None:
        pass

    def _on(self, key, new: set[int], times) -> Iterator[Row]:
        passed = times.getCurrentWatermarkInMs() // 1000
        last, told, waiting = self.state.get() if self.state.exists() else (None, False, [])
        waiting = sorted(new.union(waiting))
        for second in [s for s in waiting if s <= passed and (last is None or s > last)]:
            if last is not None and second - last > self.timeout:
                if not told:
                    yield self._row(key, SILENT, last, last + self.timeout)
                yield self._row(key, BACK, last, second)
            last, told = second, False
        if last is not None and not told and passed > last + self.timeout:
            yield self._row(key, SILENT, last, last + self.timeout)
            told = True
        waiting = [s for s in waiting if s > passed]
        self.state.update((last, told, waiting))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if waiting:
            self.handle.registerTimer(waiting[0] * 1000)
        if last is not None and not told:
            self.handle.registerTimer((last + self.timeout + 1) * 1000)

    def _row(self, key, kind: str, last: int, at: int) -> Row:
        return Row(**dict(zip(self.keys, key)), kind=kind, last_beat=last, at=at)


def silence_alerts(
    beats: DataFrame, timeout: int = TIMEOUT, keys: tuple[str, ...] = ("connectionName", "host"), ts: str = "ts", lateness: str = "10 minutes"
) -> DataFrame:
    """Keys, ``kind``, ``last_beat`` and ``at`` of a stream of beats: ``silent`` once more than ``timeout`` whole seconds have passed without a
    beat, ``back`` with the first beat after that.

    Time is that of the stream: it passes with anybody's beats, less ``lateness``; later ones are not counted.
    Start the query inside :func:`timers`.  A key holds the seconds of ``lateness`` at most, whatever its number of beats.
    """
    kinds = dict(zip(beats.columns, beats.schema.fields))
    late = beats.withWatermark(ts, lateness)
    own = late.select(*keys, ts, F.unix_timestamp(F.date_trunc("second", F.col(ts))).alias("_second"))
    out = T.StructType([T.StructField(k, kinds[k].dataType) for k in keys] + [T.StructField("kind", T.StringType()), T.StructField("last_beat", T.LongType()), T.StructField("at", T.LongType())])
    told = own.groupBy(*keys).transformWithState(statefulProcessor=Watch(timeout, list(keys)), outputStructType=out, outputMode="append", timeMode="eventTime")
    return told.select(*keys, "kind", *[F.timestamp_seconds(c).alias(c) for c in ("last_beat", "at")])
