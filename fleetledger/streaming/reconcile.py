"""Link states kept over a stream of reports, snapshot by snapshot.

Every micro-batch stores the reports that are still open, by their time.  A time is judged once a report that is more than
``lateness`` seconds newer has come: all its reports make one snapshot, which :func:`~fleetledger.plans.reconcile.reconcile` judges
against the states that the snapshot before left.  A host's load counts its links over all connections, so a snapshot is judged as a
whole, not by connection.  What a batch judged stands in a log entry that is written last; a batch that is run again begins at
the entry of the batch before and overwrites its own folders, and readers see only what the log has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetledger.operators.links import DISTRIBUTE, LINK_VALUES, REPL_COLUMNS, TIMEOUT
from fleetledger.plans.reconcile import next_snapshot, reconcile

#: What one host says of one of its links at one time; without a link, ``connectionName`` and what follows are NULL.
REPORT = (
    "at timestamp, cluster string, host string, localIndex int, sane boolean, connectionName string, "
    "Master_Host string, Slave_IO_State string, Slave_IO_Running string, Slave_SQL_Running string, reachable boolean"
)
#: The states before the first snapshot have this for their second.
BEFORE_ALL = -1
_COLUMNS = [c.split()[0] for c in REPORT.split(", ")]
_NODE, _LINK = ["cluster", "host", "localIndex", "sane"], ["host", "connectionName"]
_LOG = "before long, judged long, newest long"


def start_reconcile(
    reports: DataFrame,
    repl: DataFrame,
    link: DataFrame,
    weight: DataFrame,
    state: str,
    checkpoint: str,
    timeout: int = TIMEOUT,
    distribute: int = DISTRIBUTE,
    lateness: int = 0,
    every: str | None = None,
) -> StreamingQuery:
    """Start judging a stream of :data:`REPORT` rows; ``repl`` are the states it begins with.

    ``state`` belongs to one checkpoint; one that is there goes on from its own states.  Times count in whole seconds from 1970
    on.  Reports of a time that is judged already, or without a time, change nothing (:func:`late_reports`).  ``link`` and
    ``weight`` are read anew for each snapshot.
    """
    spark = reports.sparkSession
    first = repl.select(
        *REPL_COLUMNS, *[F.lit(None).cast("string").alias(c) for c in ("previous", "rule")], F.lit(None).cast("int").alias("hits"),
        F.lit(None).cast("string").alias("action"), F.lit(None).cast("array<struct<subject:string,body:string>>").alias("alerts"),
    )
    first.write.mode("ignore").parquet(_snapshot(state, BEFORE_ALL))
    _tell(spark, state, -1, BEFORE_ALL, BEFORE_ALL, BEFORE_ALL, "ignore")

    def take(batch: DataFrame, number: int) -> None:
        last = spark.read.schema(_LOG).parquet(f"{state}/log/batch={number - 1}").first()
        rows = batch.select(*_COLUMNS, F.unix_timestamp("at").alias("second"))
        if number:
            rows = rows.unionByName(_open(spark, state, number - 1, last.judged))
        rows.write.mode("overwrite").partitionBy("second").parquet(f"{state}/reports/batch={number}")
        waiting = _times(_open(spark, state, number, last.judged))
        newest = max([last.newest, *waiting])
        due = [s for s in waiting if s < newest - lateness]
        _judge(spark, state, number, last.judged, due, link, weight, timeout, distribute)
        _tell(spark, state, number, last.judged, max([last.judged, *due]), newest, "overwrite")

    writer = reports.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def judge_open(
    spark: SparkSession, state: str, link: DataFrame, weight: DataFrame, timeout: int = TIMEOUT, distribute: int = DISTRIBUTE
) -> None:
    """Judge the times that still wait for a newer report.  For a stream that has stopped; later reports of them are late."""
    number = spark.read.schema(f"{_LOG}, batch int").parquet(f"{state}/log").agg(F.max("batch")).first()[0]
    if number < 0:
        return
    last = spark.read.schema(_LOG).parquet(f"{state}/log/batch={number}").first()
    due = _times(_open(spark, state, number, last.judged))
    _judge(spark, state, number, last.judged, due, link, weight, timeout, distribute)
    _tell(spark, state, number, last.before, max([last.judged, *due]), last.newest, "overwrite")


def snapshots(spark: SparkSession, state: str) -> DataFrame:
    """``at`` and the rows of :func:`reconcile` of every snapshot that is judged."""
    rows = spark.read.parquet(f"{state}/snapshot").where(F.col("second").between(0, _judged(spark, state)))
    return rows.select(F.timestamp_seconds("second").alias("at"), *[c for c in rows.columns if c != "second"])


def current_links(spark: SparkSession, state: str) -> DataFrame:
    """The state table after the newest snapshot."""
    return next_snapshot(spark.read.parquet(_snapshot(state, _judged(spark, state))))


def alert_feed(spark: SparkSession, state: str) -> DataFrame:
    """``at, connectionName, host, subject, body`` of every alert so far."""
    told = snapshots(spark, state)
    return told.select("at", "connectionName", "host", F.explode("alerts").alias("a")).select("at", "connectionName", "host", "a.subject", "a.body")


def late_reports(spark: SparkSession, state: str) -> DataFrame:
    """Reports that came after their time was judged, or have no time."""
    log = spark.read.schema(f"{_LOG}, batch int").parquet(f"{state}/log").where("batch >= 0").select("batch", "before")
    rows = spark.read.schema(f"{REPORT}, batch int, second long").parquet(f"{state}/reports")
    late = F.col("second").isNull() | (F.col("second") <= F.col("before"))
    return rows.join(log, "batch").where(late).select(*_COLUMNS)


def _snapshot(state: str, second: int) -> str:
    return f"{state}/snapshot/second={second}"


def _open(spark: SparkSession, state: str, number: int, judged: int) -> DataFrame:
    """Stored reports of a batch whose time is not judged."""
    rows = spark.read.schema(f"{REPORT}, second long").parquet(f"{state}/reports/batch={number}")
    return rows.where(F.col("second") > judged)


def _times(rows: DataFrame) -> list[int]:
    """Times of snapshots, a few for each batch, in order."""
    return sorted(r.second for r in rows.select("second").distinct().collect())


def _judged(spark: SparkSession, state: str) -> int:
    return spark.read.schema(_LOG).parquet(f"{state}/log").agg(F.max("judged")).first()[0]


def _judge(spark, state, number, judged, due, link, weight, timeout, distribute) -> None:
    """Snapshots one after the other: each needs the states that the one before left."""
    for second in due:
        before = spark.read.parquet(_snapshot(state, judged))
        rows = _open(spark, state, number, judged).where(F.col("second") == second)
        rows = rows.where(F.col("host").isNotNull() & F.col("cluster").isNotNull())
        told = rows.where(F.col("connectionName").isNotNull())
        out = reconcile(
            next_snapshot(before), rows.select(*_NODE), told.select(*_LINK, *LINK_VALUES), link, weight,
            told.where("reachable").select(*_LINK), F.timestamp_seconds(F.lit(second)), timeout, distribute,
        )
        kinds = dict(before.dtypes)
        out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in before.columns]).write.mode("overwrite").parquet(_snapshot(state, second))
        judged = second


def _tell(spark: SparkSession, state: str, number: int, before: int, judged: int, newest: int, mode: str) -> None:
    row = spark.createDataFrame([(before, judged, newest)], _LOG)
    row.coalesce(1).write.mode(mode).parquet(f"{state}/log/batch={number}")
