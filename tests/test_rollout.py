import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetledger.operators import rollout as R

T0 = datetime(2017, 9, 21, 18, 42, 56)
NOW = datetime(2017, 9, 22)
SHARDS = "shardId long, schemaName string, shardDSN string, version int, taskName string, lastTaskHb timestamp, lastUpdate timestamp"
VERSIONS = "version int, command string, cmdType string, lastUpdate timestamp, tableName string"
OPLOG = "shardId long, version int, seq int, taskName string, message string, output string, err string, lastUpdate timestamp"


def shards_of(spark, rows):
    return spark.createDataFrame([(i, f"shard_{i}", "user:pass@tcp(10.2.2.1:3306)", v, t, hb, up) for i, v, t, hb, up in rows], SHARDS)


@pytest.fixture(scope="module")
def one(spark):
    shard = spark.createDataFrame([(1, "shard_1", "user:pass@(tcp:10.2.2.1:3306)", 0, None, T0, T0)], SHARDS)
    versions = spark.createDataFrame([(1, "add c int", "pt-osc", NOW, "t1"), (2, "SELECT 1", "sql", NOW, "t2")], VERSIONS)
    return shard, versions


def test_read_side_goldens(spark, one):
    shard, versions = one
    assert R.max_version(versions).first().version == 2
    assert R.max_version(versions.limit(0)).first().version == 0
    got = {}
    for v in (0, 1, 2):
        got[v] = R.next_version(shard.withColumn("version", F.lit(v)), versions).first().nextVersion
    assert got == {0: 1, 1: 2, 2: None}
    keys = spark.createDataFrame([(1,), (1,), (7,)], "shardId long")
    assert [r.taskName for r in R.get_shards(shard, keys).collect()] == [None]
    assert [r.tableName for r in R.get_versions(versions, spark.createDataFrame([(2,)], "version int")).collect()] == ["t2"]
    assert [r.shardId for r in R.shards_to_upgrade(shard, versions, 5).collect()] == [1]


def test_plan_golden(one):
    shards, versions = one
    assert R.migration_plan(shards, versions).count() == 0  # its DSN cannot be read
    assert [tuple(r) for r in R.split_dsn(shards)[1].collect()] == [(1, "malformed DSN")]
    readable = shards.withColumn("shardDSN", F.lit("user:pass@tcp(10.2.2.1:3306)"))
    rows = [tuple(r) for r in R.migration_plan(readable, versions).orderBy("step").collect()]
    assert rows == [
        (1, 1, 1, "pt-osc", "pt-online-schema-change --execute --alter 'add c int' u=user,D=shard_1,t=t1"),
        (1, 2, 2, "sql", "alter table `t2` SELECT 1"),
    ]
    assert not any("pass" in r[4] for r in rows)


def test_next_and_plan_match_brute_force_across_blocks(spark):
    rng = random.Random(3)
    numbers = sorted(rng.sample(range(1, 400000), 60)) + [4294967295]
    versions = spark.createDataFrame([(v, f"c{v}", "sql", NOW, "t") for v in numbers], VERSIONS.replace("version int", "version long"))
    rows = [(i, rng.choice(numbers) if i % 3 else rng.randrange(400000), None, None, T0) for i in range(80)]
    shards = shards_of(spark, [])
    shards = spark.createDataFrame([(i, "s", "u@tcp(d)", v, None, None, T0) for i, v, *_ in rows], SHARDS.replace("version int", "version long"))
    nxt = {r.shardId: r.nextVersion for r in R.next_version(shards, versions).collect()}
    assert nxt == {i: min((n for n in numbers if n > v), default=None) for i, v, *_ in rows}
    plan = sorted((r.shardId, r.step, r.version) for r in R.migration_plan(shards, versions).collect())
    expected = sorted((i, k, n) for i, v, *_ in rows for k, n in enumerate([n for n in numbers if n > v], 1))
    assert plan == expected


def test_pick_order(spark, one):
    rows = [(1, 0, None, None, T0), (2, 0, None, None, None), (3, 2, None, None, None), (4, 1, "x", T0, None), (5, 1, None, None, T0)]
    assert [r.shardId for r in R.shards_to_upgrade(shards_of(spark, rows), one[1], 3).collect()] == [2, 1, 5]


@pytest.mark.parametrize(
    "limit, workers, busy, taken", [(2, 2, 0, 2), (9, 2, 0, 2), (-4, 2, 0, 0), ("junk", 2, 0, 0), ("1", 2, 0, 1), (3, 3, 2, 1), (1, 3, 2, 0)]
)
def test_claim_slots(spark, one, limit, workers, busy, taken):
    rows = [(i, 0, None, None, T0) for i in range(1, 6)] + [(10 + i, 0, "me", T0, T0) for i in range(busy)]
    before = shards_of(spark, rows)
    after = R.claim(before, one[1], "me", NOW, limit, workers)
    assert after.columns == before.columns and after.count() == before.count()
    changed = after.exceptAll(before).collect()
    assert sorted(r.shardId for r in changed) == list(range(1, taken + 1))
    assert all(r.taskName == "me" and r.lastTaskHb == NOW and r.lastUpdate == NOW for r in changed)
    ended = R.claim(before, one[1], "me", NOW, limit, workers, ongoing=before.limit(0))
    assert ended.exceptAll(before).count() == min(max(int(limit), 0) if limit != "junk" else 0, workers)


def test_heartbeats_and_completions_only_for_the_owner(spark):
    later = datetime(2017, 9, 21, 19)
    before = shards_of(spark, [(1, 3, "me", T0, T0), (2, 3, "you", T0, T0), (3, 3, None, T0, T0)])
    beats = spark.createDataFrame([(1, "me", later), (1, "me", T0), (2, "me", later), (3, "me", later), (9, "me", later)], "shardId long, taskName string, ts timestamp")
    after, lost = R.apply_heartbeats(before, beats)
    rows = {r.shardId: r for r in after.collect()}
    assert rows[1].lastTaskHb == later and rows[2].lastTaskHb == T0 and rows[3].lastTaskHb == T0
    assert sorted(r.shardId for r in lost.collect()) == [2, 3, 9]
    done = spark.createDataFrame([(1, "me", 4, later), (2, "me", 9, later)], "shardId long, taskName string, version int, ts timestamp")
    after, lost = R.apply_completions(before, done)
    rows = {r.shardId: r for r in after.collect()}
    assert (rows[1].version, rows[1].taskName, rows[1].lastTaskHb) == (4, None, later)
    assert after.where("shardId <> 1").exceptAll(before).count() == 0
    assert [r.shardId for r in lost.collect()] == [2]
    assert after.schema == before.schema


def test_oplog_sequence_per_shard_and_version(spark):
    oplog = spark.createDataFrame([(1, 1, 1, None, None, None, None, T0), (1, 1, 2, None, None, None, None, T0)], OPLOG)
    entries = spark.createDataFrame(
        [(100, 100, 0, "t", "starting SQL command", "", "", T0), (1, 1, 0, "t", "Completed OK", "o", "", T0), (1, 1, 0, "t", "Error: failed", "o", "e", NOW)],
        OPLOG,
    )
    out = R.append_oplog(oplog, entries, [F.col("lastUpdate"), F.col("message")])
    assert sorted((r.shardId, r.version, r.seq) for r in out.collect()) == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 1, 4), (100, 100, 1)]
    sliced = R.append_oplog(oplog, entries, [F.col("lastUpdate"), F.col("message")], F.unix_timestamp("lastUpdate"))
    assert out.exceptAll(sliced).count() == 0 and sliced.exceptAll(out).count() == 0
    last = {(r.shardId, r.version): (r.seq, r.status, r.err) for r in R.last_outcome(out).collect()}
    assert last == {(1, 1): (4, "failed", "e"), (100, 100): (1, "running", "")}


def test_stalled_is_strict(spark):
    shards = shards_of(spark, [(1, 0, "t", datetime(2017, 9, 21, 23, 50), T0), (2, 0, "t", datetime(2017, 9, 21, 23, 49, 59), T0), (3, 0, None, T0, T0)])
    assert [r.shardId for r in R.stalled(shards, NOW, 600).collect()] == [2]


def test_dsn(spark):
    rows = ["user:pass@(tcp:10.2.2.1:3306)", "u:p@x:y@tcp(10.0.3.87:3306)/app?parseTime=true", "u@unix(/tmp/s.sock)", "", None, "u:p@tcp(1.2.3.4"]
    shards = spark.createDataFrame([(i, f"s{i}", d, 0, None, None, None) for i, d in enumerate(rows)], SHARDS)
    ok, bad = R.split_dsn(shards)
    assert {r.shardId: (r.user, r.net, r.addr, r.schema) for r in ok.collect()} == {
        1: ("u", "tcp", "10.0.3.87:3306", "app"),
        2: ("u", "unix", "/tmp/s.sock", "s2"),
    }
    assert sorted((r.shardId, r.reason) for r in bad.collect()) == [(0, "malformed DSN"), (3, "no DSN"), (4, "no DSN"), (5, "malformed DSN")]


def test_no_shard_is_lost_or_goes_back(spark, one):
    before = shards_of(spark, [(i, i % 3, "me" if i % 2 else None, T0, T0) for i in range(30)])
    done = before.where("taskName is not null").selectExpr("shardId", "taskName", "version + 1 as version", "timestamp'2017-09-22' as ts")
    after, _ = R.apply_completions(R.claim(before, one[1], "me", NOW, 2, 2), done)
    joined = after.alias("a").join(before.alias("b"), "shardId")
    assert joined.count() == 30 and joined.where("a.version < b.version").count() == 0


def test_commands_are_quoted(spark, one):
    shards = one[0].withColumns({"shardDSN": F.lit("u@tcp(d)"), "schemaName": F.lit("my 'shard'")})
    versions = one[1].withColumn("tableName", F.lit("a`b"))
    commands = [r.command for r in R.migration_plan(shards, versions).orderBy("step").collect()]
    assert commands[1].startswith("alter table `a``b` ")
    assert commands[0].endswith(" 'u=u,D=my '\\''shard'\\'',t=a`b'")


def test_late_completions_do_not_move_a_shard_back(spark):
    beat = datetime(2017, 9, 21, 19)
    before = shards_of(spark, [(1, 9, "me", beat, beat), (2, 3, "me", beat, beat)])
    done = spark.createDataFrame([(1, "me", 4, beat), (2, "me", 5, T0), (2, "me", 4, beat)], "shardId long, taskName string, version int, ts timestamp")
    after, lost = R.apply_completions(before, done)
    rows = {r.shardId: r for r in after.collect()}
    assert (rows[1].version, rows[1].taskName, rows[1].lastUpdate) == (9, "me", beat) and (rows[2].version, rows[2].taskName) == (4, None)
    assert sorted((r.shardId, r.version) for r in lost.collect()) == [(1, 4), (2, 5)]


def test_oplog_keeps_entries_with_nulls(spark):
    entries = spark.createDataFrame([(1, None, 0, "t", "a", "", "", T0), (1, None, 0, "t", "b", "", "", T0), (1, 1, 0, "t", "c", "", "", None)], OPLOG)
    for slices in (None, F.date_trunc("hour", "lastUpdate")):
        out = R.append_oplog(entries.limit(0), entries, [F.col("lastUpdate"), F.col("message")], slices)
        assert sorted((r.message, r.seq) for r in out.collect()) == [("a", 1), ("b", 2), ("c", 1)]
        again = R.append_oplog(out, entries, [F.col("lastUpdate"), F.col("message")], slices)
        assert sorted(r.seq for r in again.where("version is null").collect()) == [1, 2, 3, 4]


def test_steps_of_a_plan_are_made_after_its_joins(spark):
    """What a join broadcasts or shuffles does not grow with the plan, over several blocks of versions."""
    versions = spark.range(1, 400).where("id % 3 <> 0").selectExpr("id as version", "'c' as command", "'sql' as cmdType", "'t' as tableName")
    shards = spark.range(150).selectExpr("id as shardId", "'s' as schemaName", "'u:p@tcp(h:1)' as shardDSN", "cast(id * 3 as int) as version")
    plan = R.migration_plan(shards, versions)
    got = {(r.shardId, r.step, r.version) for r in plan.collect()}
    listed = [v for v in range(1, 400) if v % 3]
    expected = {(i, n + 1, v) for i in range(150) for n, v in enumerate(x for x in listed if x > 3 * i)}
    assert got == expected and plan.count() == len(expected)
    joins = [line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [_" in line and "_copy" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
