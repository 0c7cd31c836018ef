"""Schema versions over a fleet of shards: lookups, plans and new snapshots.

Operators that change rows return the whole new ``shards`` or ``oplog`` table
and leave untouched rows as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.functions.literals import quote_name
from fleetledger.functions.clock import instant, is_stale
from fleetledger.operators.sequence import number_within
from fleetledger.session import settle

# Command kinds, and the texts of the outcome trail.
DIRECT = "sql"
ONLINE = "pt-osc"
ONLINE_TOOL = "pt-online-schema-change"
STARTED_PREFIX = "starting"
COMPLETED_PREFIX = "Completed OK"
ERROR_PREFIX = "Error"
DSN = r"^([^:@/]*)(?::(.*))?@([A-Za-z0-9]+)\(([^()]+)\)(?:/([^?/]*))?(?:\?.*)?$"

# Versions are below 2^32.  Cut into blocks of 2^16, no window over one block,
# and none over all blocks, ever holds more than 65,536 versions.
_BLOCK_BITS = 16

# Copies of the steps of a version in a migration plan, and the bits of a block of ranks whose steps travel together.
_COPIES = 8
_STEP_BITS = 6


def max_version(versions: DataFrame) -> DataFrame:
    """One row ``version``: the highest version, 0 when there is none."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def version_ranks(versions: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where versions, and any other version numbers, stand in the apply order.

    First result: ``version, rank`` with rank 1 for the first version to apply.
    Second result: for each distinct ``version`` of ``points``, ``passed``: how many
    versions are at or below it.
    """
    marks = (
        versions.select(F.col("version").cast("long").alias("version"), F.lit(1).alias("_real"))
        .unionByName(points.select(F.col("version").cast("long").alias("version")).distinct().withColumn("_real", F.lit(0)))
        .groupBy("version")
        .agg(F.max("_real").alias("_real"), F.min("_real").alias("_all_real"))
        .withColumn("_block", F.shiftright("version", _BLOCK_BITS))
    )
    before_block = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        marks.groupBy("_block")
        .agg(F.sum("_real").alias("_count"))
        .select("_block", F.coalesce(F.sum("_count").over(before_block), F.lit(0)).alias("_earlier"))
    )
    in_block = Window.partitionBy("_block").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("_here", F.sum("_real").over(in_block)).join(blocks, "_block")
    standing = counted.withColumn("passed", F.col("_here") + F.col("_earlier"))
    ranks = standing.where(F.col("_real") == 1).select("version", F.col("passed").alias("rank"))
    return ranks, standing.where(F.col("_all_real") == 0).select("version", "passed")


def next_version(shards: DataFrame, versions: DataFrame) -> DataFrame:
    """``shardId, version, nextVersion``: the lowest version above each shard's own, NULL at the end.

    Only the distinct current versions are looked up; shards join by equality.
    """
    ranks, passed = version_ranks(versions, shards.select("version"))
    following = ranks.select(F.col("version").alias("nextVersion"), (F.col("rank") - 1).alias("passed"))
    steps = passed.join(following, "passed", "left").select("version", "nextVersion")
    current = shards.select("shardId", F.col("version").cast("long").alias("version"))
    return current.join(steps, "version", "left").select("shardId", "version", "nextVersion")


def get_versions(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """Version rows whose number is listed in ``keys`` (column ``version``)."""
    return versions.join(keys.select("version").distinct(), "version", "left_semi")


def get_shards(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """Shard rows whose id is listed in ``keys`` (column ``shardId``)."""
    return shards.join(keys.select("shardId").distinct(), "shardId", "left_semi")


def shards_to_upgrade(shards: DataFrame, versions: DataFrame, k: int) -> DataFrame:
    """The ``k`` shards that wait longest: behind the highest version, and not taken by a task."""
    behind = F.col("version") < max_version(versions).scalar()
    return (
        shards.where(behind & F.col("taskName").isNull())
        .orderBy(F.col("lastUpdate").asc_nulls_first(), F.col("shardId"))
        .limit(k)
    )


def free_slots(limit, workers: int, running: Column) -> Column:
    """Claims still allowed: the limit, held within 0 and ``workers``, less what runs.

    A limit that is not a number counts as 0, which pauses the rollout.
    """
    wanted = F.coalesce(F.lit(limit).cast("string").try_cast("int"), F.lit(0))
    return F.least(F.greatest(wanted, F.lit(0)), F.lit(workers)) - running


def claim(
    shards: DataFrame, versions: DataFrame, task: str, now, limit, workers: int, ongoing: DataFrame | None = None
) -> DataFrame:
    """New ``shards``: free slots of ``task`` are filled with the shards that wait longest.

    ``ongoing`` (column ``shardId``) lists the task's claims that have not ended;
    by default these are the shards that carry its name.
    """
    held = ongoing if ongoing is not None else shards.where(F.col("taskName") == task)
    running = held.agg(F.count(F.lit(1)).alias("n")).scalar()
    # At most ``workers`` rows are numbered and broadcast.
    order = Window.orderBy(F.col("lastUpdate").asc_nulls_first(), F.col("shardId"))
    chosen = (
        shards_to_upgrade(shards.select("shardId", "version", "taskName", "lastUpdate"), versions, workers)
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= free_slots(limit, workers, running))
        .select("shardId", F.lit(True).alias("_chosen"))
    )
    taken = F.col("_chosen").isNotNull()
    return _rewrite(
        shards.join(F.broadcast(chosen), "shardId", "left"),
        shards.columns,
        {"taskName": F.lit(task), "lastTaskHb": instant(now), "lastUpdate": instant(now)},
        taken,
    )


def claim_many(shards: DataFrame, versions: DataFrame, tasks: DataFrame, now) -> DataFrame:
    """New ``shards``: the free slots of many tasks are filled at once, no shard twice.

    ``tasks`` (``taskName, limit, workers``, one row for each) may take as many shards as :func:`free_slots` tells of its own
    numbers; tasks are served in order of their names, with the shards that wait longest first.  Slots are numbered on by prefix
    sums of what the tasks may take, shards by how long they wait, and an equality join of the two numbers makes the claims.
    Only as many shards are sorted as there are slots, which the workers of all tasks bound; a NULL limit counts as 0, NULL
    workers too.
    """
    running = shards.where(F.col("taskName").isNotNull()).groupBy("taskName").agg(F.count(F.lit(1)).alias("_running"))
    wanted = F.coalesce(F.col("limit").cast("string").try_cast("int"), F.lit(0))
    free = F.greatest(F.least(F.greatest(wanted, F.lit(0)), F.coalesce("workers", F.lit(0))) - F.coalesce("_running", F.lit(0)), F.lit(0))
    may = settle(tasks.join(running, "taskName", "left").select("taskName", free.alias("_free")).where("_free > 0"))
    slots = may.agg(F.coalesce(F.sum("_free"), F.lit(0)).cast("int")).first()[0]
    # A row for each task that has slots; at most ``slots``.
    until = F.sum("_free").over(Window.orderBy("taskName"))
    numbered = may.withColumn("_until", until).select(F.col("taskName").alias("_task"), F.explode(F.sequence((F.col("_until") - F.col("_free") + 1).cast("int"), F.col("_until").cast("int"))).alias("_n"))
    order = Window.orderBy(F.col("lastUpdate").asc_nulls_first(), F.col("shardId"))
    waiting = shards_to_upgrade(shards.select("shardId", "version", "taskName", "lastUpdate"), versions, slots)
    chosen = waiting.withColumn("_n", F.row_number().over(order)).join(numbered, "_n").select("shardId", "_task")
    return _rewrite(
        shards.join(chosen, "shardId", "left"),
        shards.columns,
        {"taskName": F.col("_task"), "lastTaskHb": instant(now), "lastUpdate": instant(now)},
        F.col("_task").isNotNull(),
    )


def apply_heartbeats(shards: DataFrame, beats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ``shards`` with refreshed task heartbeats, and the beats that matched no owner.

    ``beats``: ``shardId, taskName, ts``.  A beat counts only while its task owns the
    shard, and never moves a heartbeat backwards.
    """
    newest = beats.groupBy("shardId", "taskName").agg(F.max("ts").alias("_beat"))
    later = F.col("_beat") > F.coalesce(F.col("lastTaskHb"), F.lit("0001-01-01").cast("timestamp"))
    touched = {"lastTaskHb": F.col("_beat"), "lastUpdate": F.greatest("lastUpdate", "_beat")}
    snapshot = _rewrite(
        shards.join(newest, ["shardId", "taskName"], "left"), shards.columns, touched, F.coalesce(later, F.lit(False))
    )
    owners = shards.where(F.col("taskName").isNotNull()).select("shardId", "taskName")
    return snapshot, beats.join(owners, ["shardId", "taskName"], "left_anti").select(*beats.columns)


def apply_completions(shards: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ``shards`` with finished versions set and their tasks cleared, and the completions that cannot count.

    ``done``: ``shardId, taskName, version, ts``.  A completion counts if its task owns the shard, its
    version is above the shard's and it is not older than the task's last heartbeat; the newest of
    these is applied.  All others are returned.
    """
    owned = shards.where(F.col("taskName").isNotNull()).select(
        "shardId", "taskName", F.col("version").alias("_at"), F.coalesce("lastTaskHb", F.lit("0001-01-01").cast("timestamp")).alias("_beat")
    )
    judged = done.join(owned, ["shardId", "taskName"], "left").withColumn(
        "_counts", F.coalesce((F.col("version") > F.col("_at")) & (F.col("ts") >= F.col("_beat")), F.lit(False))
    )
    newest = judged.where("_counts").groupBy("shardId", "taskName").agg(F.max(F.struct("ts", "version")).alias("_done"))
    version_type = shards.schema["version"].dataType
    touched = {
        "version": F.col("_done.version").cast(version_type),
        "taskName": F.lit(None).cast("string"),
        "lastTaskHb": F.col("_done.ts"),
        "lastUpdate": F.greatest("lastUpdate", "_done.ts"),
    }
    snapshot = _rewrite(
        shards.join(newest, ["shardId", "taskName"], "left"), shards.columns, touched, F.col("_done").isNotNull()
    )
    return snapshot, judged.where(~F.col("_counts")).select(*done.columns)


def _rewrite(rows: DataFrame, columns: list[str], values: dict[str, Column], where: Column) -> DataFrame:
    return rows.select(
        *[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in columns]
    )


def append_oplog(oplog: DataFrame, entries: DataFrame, arrival: list[Column], slice_by: Column | None = None) -> DataFrame:
    """``oplog`` plus ``entries``, which go on numbering ``seq`` per (shardId, version) in ``arrival`` order.

    ``slice_by`` (a value that never decreases along ``arrival``, such as the hour)
    keeps even one very busy pair spread over tasks; see :func:`number_within`.
    """
    last = oplog.groupBy(F.col("shardId").alias("_shard"), F.col("version").alias("_of")).agg(F.max("seq").alias("_last"))
    numbered = number_within(entries, ["shardId", "version"], arrival, "_n", slice_by)
    same = F.col("shardId").eqNullSafe(F.col("_shard")) & F.col("version").eqNullSafe(F.col("_of"))
    added = numbered.join(last, same, "left").withColumn(
        "seq", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast(oplog.schema["seq"].dataType)
    )
    return oplog.unionByName(added.select(*oplog.columns))


def last_outcome(oplog: DataFrame) -> DataFrame:
    """Newest entry of every (shardId, version), with its status."""
    newest = F.max_by(F.struct("taskName", "message", "err", "seq"), "seq")
    message = F.col("last.message")
    status = (
        F.when(message.startswith(STARTED_PREFIX), F.lit("running"))
        .when(message.startswith(COMPLETED_PREFIX), F.lit("done"))
        .when(message.startswith(ERROR_PREFIX), F.lit("failed"))
        .otherwise(F.lit("unknown"))
    )
    return (
        oplog.groupBy("shardId", "version")
        .agg(newest.alias("last"))
        .select("shardId", "version", "last.seq", "last.taskName", status.alias("status"), "last.message", "last.err")
    )


def _shell_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def render_command(user: Column, schema: Column) -> Column:
    """Command text of a plan row: a statement, or the argument line of the online-change tool.

    The password is left to the tool's own configuration.
    """
    direct = F.concat(F.lit("alter table "), quote_name(F.col("tableName")), F.lit(" "), F.col("command"))
    where = F.concat(F.lit("u="), F.coalesce(user, F.lit("")), F.lit(",D="), schema, F.lit(",t="), F.col("tableName"))
    plain = where.rlike("^[A-Za-z0-9_.,=-]*$")
    online = F.concat(
        F.lit(f"{ONLINE_TOOL} --execute --alter "), _shell_quoted(F.col("command")), F.lit(" "),
        F.when(plain, where).otherwise(_shell_quoted(where)),
    )
    return F.when(F.col("cmdType") == DIRECT, direct).when(F.col("cmdType") == ONLINE, online)


def migration_plan(shards: DataFrame, versions: DataFrame) -> DataFrame:
    """Every missing version of every shard in apply order: ``shardId, step, version, cmdType, command``.

    Versions travel as blocks of up to 64 neighbouring ranks.  A shard meets the blocks after the ranks it has passed, and
    result rows are only made after that, in the tasks that hand them on: no side of a join grows with the plan.
    Neither side is broadcast, as nothing tells in advance how many blocks all shards need.  Most shards stand at one version, and that one
    key makes most of the plan: ranks passed and blocks are copied ``_COPIES`` times and shards dealt out over the copies.  Shards whose DSN cannot be
    read get no commands; :func:`split_dsn` lists them with the reason.
    """
    ranks, passed = version_ranks(versions, shards.select("version"))
    known = versions.select(F.col("version").cast("long").alias("version"), "command", "cmdType", "tableName")
    ranked = known.join(ranks, "version").withColumnRenamed("version", "_to")
    last = F.coalesce(ranks.agg(F.max("rank").alias("rank")).scalar(), F.lit(0))
    copies = F.explode(F.sequence(F.lit(0), F.lit(_COPIES - 1))).alias("_copy")
    todo = passed.where(F.col("passed") < last).select(F.col("version").alias("_from"), "passed", copies)
    step = F.struct("rank", "_to", "command", "cmdType", "tableName")
    blocks = ranked.groupBy(F.shiftright("rank", _STEP_BITS).alias("_block")).agg(F.collect_list(step).alias("_steps")).select("*", copies)
    user = F.nullif(F.regexp_extract("shardDSN", DSN, 1), F.lit(""))
    behind = shards.where(F.coalesce(F.col("shardDSN").rlike(DSN), F.lit(False))).select("shardId", "schemaName", user.alias("_user"), F.col("version").cast("long").alias("_from"))
    dealt = behind.withColumn("_copy", F.pmod(F.xxhash64("shardId"), F.lit(_COPIES)).cast("int"))
    needed = F.explode(F.sequence(F.shiftright(F.col("passed") + 1, _STEP_BITS), F.shiftright(last, _STEP_BITS)))
    needs = dealt.join(todo.hint("merge"), ["_from", "_copy"]).select("shardId", "schemaName", "_user", "passed", "_copy", needed.alias("_block"))
    steps = needs.join(blocks.hint("merge"), ["_block", "_copy"]).select("shardId", "schemaName", "_user", "passed", F.inline("_steps")).where("rank > passed")
    return steps.select(
        "shardId", (F.col("rank") - F.col("passed")).cast("int").alias("step"), F.col("_to").alias("version"), "cmdType",
        render_command(F.col("_user"), F.col("schemaName")).alias("command"),
    )


def stalled(shards: DataFrame, now, timeout: int) -> DataFrame:
    """Taken shards whose task heartbeat is older than ``timeout`` seconds."""
    return shards.where(F.col("taskName").isNotNull() & is_stale(F.col("lastTaskHb"), now, timeout))


def split_dsn(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connection parts of every well-formed DSN (``user:pass@net(addr)/schema``), and the other shards.

    The password is matched but never kept, and rejects carry no DSN text.
    """
    dsn = F.col("shardDSN")
    good = F.coalesce(dsn.rlike(DSN), F.lit(False))

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(dsn, DSN, group), F.lit(""))

    parts = shards.where(good).select(
        "shardId", part(1).alias("user"), part(3).alias("net"), part(4).alias("addr"),
        F.coalesce(part(5), F.col("schemaName")).alias("schema"),
    )
    reason = F.when(dsn.isNull() | (dsn == ""), F.lit("no DSN")).otherwise(F.lit("malformed DSN"))
    return parts, shards.where(~good).select("shardId", reason.alias("reason"))
