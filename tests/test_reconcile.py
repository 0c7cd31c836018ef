"""Every rule of the state table, all cases judged in one job: case n plays on connection Xn-Y."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetledger.operators.links import duplicate_leaders
from fleetledger.plans.reconcile import alerts, next_snapshot, reconcile
from fleetledger.streaming import reconcile as S

NOW = datetime(2024, 1, 31)
REPL = "host string, weight int, localIndex int, isSlave string, lastUpdate timestamp, lastHeartbeat timestamp, connectionName string"
NODES = "cluster string, host string, localIndex int, sane boolean"
STATUS = "host string, connectionName string, Master_Host string, Slave_IO_State string, Slave_IO_Running string, Slave_SQL_Running string"

IDLE, GOOD = None, ("Yes", "Yes")

# name: (a's row, b's row, a's io/sql, b's io/sql or "off", a's probe, a sane) -> (a after, b after, rule of a, action of a, alert subjects a, b)
# a row is (state, heartbeat age, lastUpdate age, index).
CASES = {
    "T1+E2": ((None, None, IDLE, "off", False, True), ("Proposed", None, "T1+E2", None, [], [])),
    "T5": ((("Proposed", 29, 29, 1), ("Yes", 29, 29, 0), IDLE, "off", False, True), ("No", "Yes", "T5", None, [], [])),
    "T5 edge": ((("No", 29, 29, 1), ("Yes", 179, 179, 0), IDLE, "off", False, True), ("No", "Yes", "T5", None, [], [])),
    "T4+E2": ((("No", 29, 29, 1), ("Yes", 180, 180, 0), IDLE, "off", False, True), ("Proposed", "No", "E2", None, [], ["Slave node timeout"])),
    "E1 ok": ((("Proposed", 29, 29, 1), None, IDLE, "off", True, True), ("Yes", None, "E1", "start", ["New slave"], [])),
    "E1 fail": ((("Proposed", 29, 29, 1), None, IDLE, "off", False, True), ("Failed", None, "E1", None, ["Failed slave"], [])),
    "E3 peer": ((("Failed", 29, 60, 1), ("Proposed", 29, 29, 0), IDLE, "off", False, True), ("No", "Proposed", "E3", None, [], [])),
    "E3 alone": ((("Failed", 29, 60, 1), None, IDLE, "off", False, True), ("No", None, "E3", None, [], [])),
    "T2+E2": ((("Failed", 359, 359, 1), None, IDLE, "off", False, True), ("Proposed", None, "T2+E2", None, [], [])),
    "T2 edge": ((("Failed", 358, 358, 1), None, IDLE, "off", False, True), ("No", None, "E3", None, [], [])),
    "E4": ((("Yes", 29, 29, 1), ("Yes", 500, 500, 0), IDLE, "off", False, True), ("Yes", "No", "E4", None, [], ["Slave node timeout"])),
    "P1": ((None, None, GOOD, "off", False, True), ("Yes", None, "P1", None, [], [])),
    "P2": ((None, ("Yes", 29, 29, 0), GOOD, "off", False, True), (None, "Yes", "P2", "stop", [], [])),
    "P3": ((("Yes", 29, 29, 1), None, GOOD, "off", False, True), ("Yes", None, "P3", None, [], [])),
    "P4": ((("Yes", 29, 29, 1), None, ("Yes", "No"), "off", False, True), ("Failed", None, "P4", "stop", ["Failed slave"], [])),
    "P5 ok": ((("Yes", 29, 29, 1), None, ("Connecting", "Yes"), "off", True, True), ("Yes", None, "P5", "start", [], [])),
    "P5 fail": ((("Yes", 29, 29, 1), None, ("Connecting", "Yes"), "off", False, True), ("Failed", None, "P5", "stop", ["Failed slave"], [])),
    "P0": ((("Yes", 29, 29, 1), None, ("Yes", "Connecting"), "off", False, True), ("Yes", None, "P0", None, [], [])),
    "P6": ((("Yes", 29, 29, 0), ("Yes", 29, 29, 1), GOOD, GOOD, False, True), ("Yes", "No", "P3", None, [], ["Two slaves"])),
    "P7": ((("No", 29, 29, 1), None, GOOD, "off", False, True), ("No", None, "P7", "stop", [], [])),
    "P8": ((("Failed", 29, 29, 1), None, GOOD, "off", False, True), ("No", None, "P8", "stop", [], [])),
    "P9": ((("Proposed", 29, 29, 1), None, GOOD, "off", False, True), ("Yes", None, "P9", None, [], [])),
    "N1": ((("Yes", 29, 29, 1), None, GOOD, "off", False, False), ("No", None, "N1", "stop", ["Failed slave"], [])),
    "none": ((("Yes", 29, 29, 1), None, IDLE, "off", False, False), ("Yes", None, None, None, [], [])),
}
UNTOUCHED_BEAT = {"E4", "P0", "none"}


@pytest.fixture(scope="module")
def outcome(spark):
    repl, nodes, status, masters, link = [], [], [], [], []
    for n, (name, ((a, b, a_run, b_run, probe, sane), _)) in enumerate(CASES.items()):
        conn = f"X{n}-Y"
        link.append((f"X{n}", "Y"))
        for host, row in ((f"a{n}", a), (f"b{n}", b)):
            if row:
                repl.append((host, 0, row[3], row[0], NOW - timedelta(seconds=row[2]), NOW - timedelta(seconds=row[1]), conn))
        nodes.append((f"X{n}", f"a{n}", 1 if not a else a[3], sane))
        if b_run != "off":
            nodes.append((f"X{n}", f"b{n}", b[3], True))
        for host, run in ((f"a{n}", a_run), (f"b{n}", b_run)):
            if run and run != "off":
                status.append((host, conn, "m", "Waiting", *run))
        if probe:
            masters.append((f"a{n}", conn))
    out = reconcile(
        spark.createDataFrame(repl, REPL), spark.createDataFrame(nodes, NODES), spark.createDataFrame(status, STATUS),
        spark.createDataFrame(link, "clusterSlave string, clusterMaster string"),
        spark.createDataFrame([("X0", "a0", 5)], "cluster string, nodename string, weight int"),
        spark.createDataFrame(masters, "host string, connectionName string"), NOW,
    )
    return out, {r.host: r for r in out.collect()}


@pytest.mark.parametrize("n, name", list(enumerate(CASES)))
def test_rule(outcome, n, name):
    rows = outcome[1]
    (before_a, *_), (a, b, rule, action, subjects_a, subjects_b) = CASES[name]
    row = rows[f"a{n}"]
    assert (row.isSlave, row.rule, row.action) == (a, rule, action)
    assert [x.subject for x in row.alerts] == subjects_a
    assert row.hits <= 1
    if a is not None:
        if name in UNTOUCHED_BEAT:
            assert row.lastHeartbeat == NOW - timedelta(seconds=before_a[1])
            assert row.lastUpdate == NOW - timedelta(seconds=before_a[2])
        else:
            assert row.lastHeartbeat == NOW and row.lastUpdate == NOW
    if f"b{n}" in rows:
        other = rows[f"b{n}"]
        assert other.isSlave == b and [x.subject for x in other.alerts] == subjects_b
        if name == "P6":
            assert other.action == "stop"
    else:
        assert b is None


def test_snapshot_weight_and_alert_feed(outcome):
    out, rows = outcome
    assert rows["a0"].weight == 5
    assert next_snapshot(out).count() == sum(r.isSlave is not None for r in rows.values())
    feed = {(r.host, r.subject): r.body for r in alerts(out).collect()}
    assert feed["a4", "New slave"] == "Node a4 is the new slave for the connectionName 'X4-Y'"
    assert feed["b18", "Two slaves"] == "Two nodes were slaves for the cluster X18, stopping slave on node b18"
    assert len(feed) == sum(len(r.alerts) for r in rows.values()) == 8


def test_random_fleets_keep_at_most_one_fresh_leader(spark):
    rng = random.Random(11)
    repl, nodes, status, masters = [], [], [], []
    for c in range(60):
        for h in range(4):
            host, conn = f"c{c}h{h}", f"C{c}-Z"
            nodes.append((f"C{c}", host, h, True))
            if rng.random() < 0.9:
                beat = NOW - timedelta(seconds=rng.choice([10, 178, 179, 180, 400]))
                repl.append((host, rng.randrange(2), h, rng.choice(["No", "Yes", "Proposed", "Failed"]), beat, beat, conn))
            if rng.random() < 0.5:
                status.append((host, conn, "m", "Waiting", rng.choice(["Yes", "No"]), rng.choice(["Yes", "No", "Connecting"])))
            if rng.random() < 0.5:
                masters.append((host, conn))
    link = spark.createDataFrame([(f"C{c}", "Z") for c in range(60)], "clusterSlave string, clusterMaster string")
    out = reconcile(
        spark.createDataFrame(repl, REPL), spark.createDataFrame(nodes, NODES), spark.createDataFrame(status, STATUS), link,
        spark.createDataFrame([], "cluster string, nodename string, weight int"),
        spark.createDataFrame(masters, "host string, connectionName string"), NOW,
    )
    assert out.where("hits <> 1").count() == 0
    assert out.count() == 240
    assert duplicate_leaders(next_snapshot(out), NOW).count() == 0


def test_the_registered_fleet_fires_the_rules(spark):
    from fleetledger.plans.registry import registered

    rules = {r.rule for r in registered()["links_reconcile"][0](spark, "/root/testdata/sf0.01").select("rule").distinct().collect() if r.rule}
    steps = {s for r in rules for s in r.split("+")}
    assert {"T1", "T2", "T4", "T5", "E1", "E2", "E3", "E4", "P0", "P1", "P2", "P3", "P4", "P6", "P7", "P8", "P9", "N1"} <= steps


def test_repeated_reports_give_one_row(spark):
    from fleetledger.plans.queries_links import _fleet

    fleet = _fleet(spark, "/root/testdata/sf0.001")
    twice = {k: v.unionAll(v) if k in ("repl", "nodes", "link_status", "weight", "masters") else v for k, v in fleet.items()}
    one, two = (reconcile(**f) for f in (fleet, twice))
    assert one.count() == two.count() > 0 and one.exceptAll(two).count() == 0


def _report(minute, host, conn="X-Y", master=None, io=None, sql=None, reachable=False, index=0):
    at = None if minute is None else NOW + timedelta(minutes=minute)
    return (at, "X", host, index, True, conn, master, "Waiting", io, sql, reachable)


def _inputs(spark):
    return (
        spark.createDataFrame([], REPL), spark.createDataFrame([("X", "Y")], "clusterSlave string, clusterMaster string"),
        spark.createDataFrame([("X", "a", 5)], "cluster string, nodename string, weight int"),
    )


def _feed(spark, folder, name, rows):
    spark.createDataFrame(rows, S.REPORT).coalesce(1).write.parquet(f"{folder}/in/{name}")


def _run(spark, folder, inputs, **more):
    stream = spark.readStream.schema(S.REPORT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    S.start_reconcile(stream, *inputs, f"{folder}/state", f"{folder}/mark", **more).awaitTermination()


def _told(spark, folder):
    minute = (F.unix_timestamp("at") - F.unix_timestamp(F.lit(NOW))) / 60
    return sorted((int(r.m), r.host, r.isSlave, r.rule) for r in S.snapshots(spark, f"{folder}/state").select("*", minute.alias("m")).collect())


def test_a_stream_elects_a_leader_over_snapshots_and_restarts(spark, tmp_path):
    folder, inputs = str(tmp_path), _inputs(spark)
    _feed(spark, folder, 1, [_report(0, "a"), _report(0, "c", conn=None, index=2)])
    _feed(spark, folder, 2, [_report(0, "b", index=1), _report(1, "a", reachable=True), _report(None, "x")])  # the minute before ends here
    _run(spark, folder, inputs)
    assert {r[:3] for r in _told(spark, folder)} == {(0, "a", "Proposed"), (0, "b", "No"), (0, "c", "No")}
    # A restart: minute 1 gets its second node, minute 2 ends it; a report of minute 0 is late.
    _feed(spark, folder, 3, [_report(1, "b", index=1), _report(0, "late")])
    _feed(spark, folder, 4, [_report(2, "a", master="m", io="Yes", sql="Yes"), _report(2, "b", index=1), _report(2, "a", master="m", io="Yes", sql="Yes")])
    _run(spark, folder, inputs)
    assert [r for r in _told(spark, folder) if r[0] == 1] == [(1, "a", "Yes", "E1"), (1, "b", "No", "E3"), (1, "c", "No", None)]
    assert max(r[0] for r in _told(spark, folder)) == 1
    S.judge_open(spark, f"{folder}/state", *inputs[1:])
    assert [r for r in _told(spark, folder) if r[0] == 2] == [(2, "a", "Yes", "P3"), (2, "b", "No", "T5"), (2, "c", "No", None)]
    assert sorted(r.host for r in S.late_reports(spark, f"{folder}/state").collect()) == ["late", "x"]
    assert [(r.host, r.subject) for r in S.alert_feed(spark, f"{folder}/state").collect()] == [("a", "New slave")]
    assert {(r.host, r.isSlave, r.weight) for r in S.current_links(spark, f"{folder}/state").collect()} == {("a", "Yes", 5), ("b", "No", 0), ("c", "No", 0)}


def test_a_batch_that_is_run_again_judges_the_same(spark, tmp_path):
    folder, inputs = str(tmp_path), _inputs(spark)
    _feed(spark, folder, 1, [_report(0, "a"), _report(1, "a", reachable=True)])
    _feed(spark, folder, 2, [_report(2, "a", master="m", io="Yes", sql="No"), _report(3, "a")])
    _run(spark, folder, inputs)
    told, alerted = _told(spark, folder), S.alert_feed(spark, f"{folder}/state").count()
    assert [r[:3] for r in told] == [(0, "a", "Proposed"), (1, "a", "Yes"), (2, "a", "Failed")]
    # The end of the second batch is lost, so the stream runs it again on its own output.
    (tmp_path / "mark" / "commits" / "1").unlink()
    (tmp_path / "mark" / "commits" / ".1.crc").unlink(missing_ok=True)
    _run(spark, folder, inputs)
    assert _told(spark, folder) == told and S.alert_feed(spark, f"{folder}/state").count() == alerted == 2


def test_lateness_keeps_a_time_open_and_an_empty_stream_judges_nothing(spark, tmp_path):
    folder, inputs = str(tmp_path), _inputs(spark)
    _feed(spark, folder, 0, [])
    _run(spark, folder, inputs, lateness=60)
    S.judge_open(spark, f"{folder}/state", *inputs[1:])
    assert S.snapshots(spark, f"{folder}/state").count() == S.late_reports(spark, f"{folder}/state").count() == 0
    _feed(spark, folder, 1, [_report(0, "a"), _report(1, "a")])
    _feed(spark, folder, 2, [_report(0, "b", index=1), _report(2, "a")])
    _run(spark, folder, inputs, lateness=60)
    assert {r[:2] for r in _told(spark, folder)} == {(0, "a"), (0, "b")}
