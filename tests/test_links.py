import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetledger.operators import links as L
from fleetledger.functions.clock import is_fresh, is_stale

NOW = datetime(2017, 6, 30, 13, 13, 30)
BEAT = datetime(2017, 6, 30, 13, 13, 1)
REPL = "host string, weight int, localIndex int, isSlave string, lastUpdate timestamp, lastHeartbeat timestamp, connectionName string"
ROWS = [
    ("DC1-1", 10, 1, "Yes", BEAT, "DC1-DC2"),
    ("DC1-2", 11, 2, "No", BEAT, "DC1-DC2"),
    ("DC1-3", 9, 0, "No", BEAT, "DC1-DC2"),
    ("DC1-1", 11, 1, "Yes", BEAT, "DC1-DC3"),
    ("DC1-2", 12, 2, "No", BEAT, "DC1-DC3"),
    ("DC1-3", 0, 0, "No", BEAT, "DC1-DC3"),
    ("DC2-1", 0, 1, "Yes", BEAT, "DC2-DC1"),
    ("DC2-2", 0, 0, "No", BEAT, "DC2-DC1"),
    ("DC2-3", 0, 2, "No", datetime(2017, 6, 19, 15, 58, 1), "DC2-DC1"),
    ("DC3-1", 0, 1, "Yes", BEAT, "DC3-DC1"),
    ("DC3-2", 0, 2, "No", BEAT, "DC3-DC1"),
    ("DC3-3", 0, 0, "No", BEAT, "DC3-DC1"),
]


@pytest.fixture(scope="module")
def repl(spark):
    return spark.createDataFrame([(h, w, i, s, b, b, c) for h, w, i, s, b, c in ROWS], REPL)


def ranking(df):
    out = {}
    for r in df.orderBy("connectionName", "rank").collect():
        out.setdefault(r.connectionName, []).append(r.host)
    return out


def test_ranking(repl):
    common = {"DC1-DC2": ["DC1-2", "DC1-1", "DC1-3"], "DC1-DC3": ["DC1-2", "DC1-1", "DC1-3"], "DC2-DC1": ["DC2-2", "DC2-1"]}
    assert ranking(L.rank_candidates(repl, NOW)) == {**common, "DC3-DC1": ["DC3-3", "DC3-2", "DC3-1"]}
    assert ranking(L.rank_candidates(repl, NOW, distribute=0)) == {**common, "DC3-DC1": ["DC3-3", "DC3-1", "DC3-2"]}
    best = {r.connectionName: r.best for r in L.best_candidates(repl, NOW).collect()}
    assert best == {c: hosts[0] for c, hosts in ranking(L.rank_candidates(repl, NOW)).items()}


def test_ranking_of_a_large_connection(spark):
    rng = random.Random(5)
    rows = [
        (f"h{i:04d}", rng.randrange(3), rng.choice([None, 0, 1, 2]), rng.choice(["No", "Yes", "Failed", "Proposed"]), BEAT, BEAT, "BIG" if i % 3 else f"C{i % 7}")
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, REPL)
    got = ranking(L.rank_candidates(df, NOW, slices=9))
    led = {}
    for h, _, _, s, _, _, _ in rows:
        led[h] = led.get(h, 0) + (s == "Yes")
    expected = {}
    usable = [r for r in rows if r[3] != "Failed"]
    for h, w, i, s, _, _, c in sorted(usable, key=lambda r: (-r[1], -1 if r[2] is None else r[2] + led[r[0]] * 3, r[0])):
        expected.setdefault(c, []).append(h)
    assert got == expected
    assert {r.connectionName: r.best for r in L.best_candidates(df, NOW).collect()} == {c: h[0] for c, h in expected.items()}


def test_leaders(repl):
    assert {r.connectionName: (r.leader, r.age) for r in L.current_leader(repl, NOW).collect()} == {
        "DC1-DC2": ("DC1-1", 29), "DC1-DC3": ("DC1-1", 29), "DC2-DC1": ("DC2-1", 29), "DC3-DC1": ("DC3-1", 29)
    }
    assert {r.host: r.links for r in L.links_led(repl).collect() if r.links} == {"DC1-1": 2, "DC2-1": 1, "DC3-1": 1}
    assert L.duplicate_leaders(repl, NOW).count() == 0 and L.stale_leaders(repl, NOW).count() == 0
    two = repl.withColumn("isSlave", F.when(F.col("host") == "DC2-2", "Yes").otherwise(F.col("isSlave")))
    assert [tuple(r) for r in L.duplicate_leaders(two, NOW).collect()] == [("DC2-DC1", 2)]
    late = BEAT + timedelta(seconds=180)
    assert L.stale_leaders(repl, late).count() == 4 and L.stale_leaders(repl, late - timedelta(seconds=1)).count() == 0
    after = L.demote_stale(repl, late)
    assert after.where("isSlave = 'Yes'").count() == 0 and after.where(F.col("lastUpdate") == late).count() == 4


@pytest.mark.parametrize("age, fresh, stale", [(178, True, False), (179, False, False), (180, False, True), (178.9, True, False), (179.5, False, False)])
def test_boundary(spark, age, fresh, stale):
    df = spark.createDataFrame([(NOW - timedelta(seconds=int(age)) + timedelta(seconds=int(age) - age + (1 if age % 1 else 0)),)], "t timestamp")
    # fractions: a beat inside second s has the age of s
    df = spark.createDataFrame([(NOW - timedelta(seconds=int(age)) + timedelta(milliseconds=round(age % 1 * 1000)),)], "t timestamp")
    row = df.select(is_fresh(F.col("t"), NOW, 179).alias("f"), is_stale(F.col("t"), NOW, 179).alias("s")).first()
    assert (row.f, row.s) == (fresh, stale)


def test_topology_and_weight(spark):
    link = spark.createDataFrame([("DC1", "DC2"), ("DC1", "DC3"), ("DC2", "DC1"), ("DC3", "DC1")], "clusterSlave string, clusterMaster string")
    nodes = spark.createDataFrame([(f"DC{c}", f"DC{c}-1", 0, True) for c in (1, 2, 3)], "cluster string, host string, localIndex int, sane boolean")
    pairs = L.connections(nodes, link)
    assert sorted(r.connectionName for r in pairs.collect()) == ["DC1-DC2", "DC1-DC3", "DC2-DC1", "DC3-DC1"]
    weight = spark.createDataFrame([("DC1", "DC1-1", 10), ("DC1", "DC1-2", 11)], "cluster string, nodename string, weight int")
    assert {r.host: r.weight for r in L.with_weight(nodes, weight).collect()} == {"DC1-1": 10, "DC2-1": 0, "DC3-1": 0}


def test_status_pivot_parse_and_health(spark):
    kv = spark.createDataFrame(
        [("h1", "wsrep_local_state", "4"), ("h1", "wsrep_cluster_status", "Primary"), ("h1", "wsrep_local_index", "2"), ("h1", "other", "x"),
         ("h2", "wsrep_local_state", "3"), ("h2", "wsrep_cluster_status", "Primary")],
        "host string, name string, value string",
    ).withColumn("n", F.lit(1)).drop("n")
    named = kv.unionByName(kv.select("host", F.lit("wsrep_node_name").alias("name"), F.col("host").alias("value")).distinct())
    nodes = {r.host: r for r in L.nodes_from_status(L.pivot_status(named)).collect()}
    assert nodes["h1"].sane and nodes["h1"].localIndex == 2 and not nodes["h2"].sane
    text = (
        "*** 1. row ***\n   Slave_IO_State: Waiting for master to send event\n      Master_Host: 10.0.0.1\n"
        " Slave_IO_Running: Yes\nSlave_SQL_Running: Yes\n       Last_IO_Error: bad: worse\nMaster_SSL: a: b\n"
    )
    rows = [("h1", "A-B", text), ("h2", "A-B", text.replace("Waiting for master to send event", "Connecting to master")), ("h3", "A-B", "")]
    status = L.with_health(L.parse_link_status(spark.createDataFrame(rows, "host string, connectionName string, text string")))
    got = {r.host: r for r in status.collect()}
    assert got["h1"].healthy and got["h1"].replicating and got["h1"].Master_Host == "10.0.0.1"
    assert not got["h2"].healthy and got["h2"].replicating
    assert not got["h3"].healthy and not got["h3"].replicating
    asked = spark.createDataFrame([("h1", "A-B"), ("h1", "A-B2"), ("h9", "A-B")], "host string, connectionName string")
    assert [tuple(r) for r in L.channel_exists(status, asked).collect()] == [("h1", "A-B")]


def test_guard_and_clearing(spark, repl):
    changed = repl.withColumn("isSlave", F.when(F.col("host").isin("DC1-2", "DC2-3"), "Proposed").when(F.col("host") == "DC3-3", "Failed").otherwise(F.col("isSlave")))
    guard = {(r.connectionName, r.host): r.proposed for r in L.live_proposal(changed, NOW).collect()}
    assert guard["DC1-DC2", "DC1-1"] == "DC1-2" and guard["DC2-DC1", "DC2-1"] is None and len(guard) == 12
    edge = L.clear_failed(changed, BEAT + timedelta(seconds=358)).where("host = 'DC3-3'").first()
    over = L.clear_failed(changed, BEAT + timedelta(seconds=359)).where("host = 'DC3-3'").first()
    assert edge.isSlave == "Failed" and over.isSlave == "No" and over.lastUpdate == BEAT + timedelta(seconds=359)


def test_choose_master(spark):
    cluster = spark.createDataFrame([("B", " m1  m2 m3 "), ("C", "x1")], "cluster string, masterCandidates string")
    ok, bad = ("Yes", "Yes", "Waiting"), ("Yes", "Yes", "Reconnecting")
    probes = spark.createDataFrame(
        [("h1", "B", "m1", *bad), ("h1", "B", "m2", *ok), ("h1", "B", "m3", *ok), ("h2", "B", "m3", *ok), ("h1", "C", "x1", *bad)],
        "host string, cluster string, candidate string, Slave_IO_Running string, Slave_SQL_Running string, Slave_IO_State string",
    )
    assert sorted((r.host, r.cluster, r.master) for r in L.choose_master(cluster, probes).collect()) == [("h1", "B", "m2"), ("h2", "B", "m3")]
    assert [(r.cluster, r.master) for r in L.choose_master(cluster, probes.drop("host")).collect()] == [("B", "m2")]


def test_register(spark, repl):
    pairs = spark.createDataFrame(
        [("DC1", "DC1-1", 1, True, "DC2", "DC1-DC2"), ("DC1", "DC1-9", 5, True, "DC2", "DC1-DC2"), ("DC1", "DC1-8", 4, False, "DC2", "DC1-DC2"),
         ("DC1", "DC1-7", 3, True, "DC2", "DC1-DC2"), ("DC9", "DC9-1", 0, True, "DC1", "DC9-DC1")],
        "cluster string, host string, localIndex int, sane boolean, clusterMaster string, connectionName string",
    )
    status = spark.createDataFrame([("DC1-7", "DC1-DC2", "m"), ("DC9-1", "DC9-DC1", "m")], "host string, connectionName string, Master_Host string")
    weight = spark.createDataFrame([("DC1", "DC1-9", 7)], "cluster string, nodename string, weight int")
    out = L.register(pairs, repl, status, weight, NOW)
    added = sorted((r.host, r.weight, r.localIndex, r.isSlave, r.connectionName) for r in out.exceptAll(repl).collect())
    assert added == [("DC1-9", 7, 5, "No", "DC1-DC2"), ("DC9-1", 0, 0, "Yes", "DC9-DC1")]
