import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetledger.operators.changelog import apply_changes
from fleetledger.streaming.heartbeats import heartbeat_gaps, silent_now
from fleetledger.streaming.ids import start_bulk_ids
from fleetledger.streaming.replay import compact, compact_state, current_table, merge_input, start_replay, unused_folders
from fleetledger.streaming.silence import silence_alerts, timers

START = datetime(2024, 1, 1)


def beats(spark, offsets):
    rows = [("A-B", "h", START + timedelta(seconds=s)) for s in offsets]
    return spark.createDataFrame(rows, "connectionName string, host string, ts timestamp")


@pytest.mark.parametrize("gap, sessions", [(178, 1), (179, 1), (180, 2)])
def test_gap_boundary(spark, gap, sessions):
    assert heartbeat_gaps(beats(spark, [0, gap])).count() == sessions
    assert heartbeat_gaps(beats(spark, [0.9, gap + 0.1])).count() == sessions


def test_stream_equals_batch(spark, tmp_path):
    table = beats(spark, [0, 0.5, 60, 179 + 60, 500, 680, 2000])
    table.write.parquet(str(tmp_path / "in"))
    late = beats(spark, [20000]).withColumn("host", F.lit("closer"))
    late.write.mode("append").parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in*"))
    query = (
        heartbeat_gaps(stream, lateness="1 second")
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = heartbeat_gaps(table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert expected.count() == 4


def test_silent_now(spark):
    table = beats(spark, [0, 100])
    assert silent_now(table, START + timedelta(seconds=279)).count() == 0
    assert [r.age for r in silent_now(table, START + timedelta(seconds=280)).collect()] == [180]


ROW = "struct<id:long,v:string>"
CHANGES = f"file_no long, pos long, row_no int, op string, before {ROW}, after {ROW}"


def test_replay_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    rows = []
    for i in range(200):
        key = i % 23
        op = "INSERT" if i < 23 else ("DELETE" if i % 7 == 0 else "UPDATE")
        old, new = (key, f"v{i - 23}"), (key, f"v{i}")
        rows.append((1 + i // 50, i, 0, op, None if op == "INSERT" else old, None if op == "DELETE" else new))
    table = spark.createDataFrame(rows, CHANGES)
    for part, chosen in enumerate([table.where("file_no in (1,3)"), table.where("file_no in (2,4)"), table.where("file_no = 1")]):
        chosen.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    )
    start_replay(stream, ["id"], str(tmp_path / "state"), str(tmp_path / "mark")).awaitTermination()
    got = sorted(map(tuple, current_table(spark, str(tmp_path / "state"), ["id"]).collect()))
    assert got == sorted(map(tuple, apply_changes(None, table, ["id"]).collect()))
    assert 0 < len(got) < 23
    compact_state(spark, str(tmp_path / "state"), str(tmp_path / "state2"), ["id"])
    assert sorted(map(tuple, current_table(spark, str(tmp_path / "state2"), ["id"]).collect())) == got
    compact_state(spark, str(tmp_path / "state"), str(tmp_path / "state3"), ["id"], {"file_no": 99})
    assert spark.read.parquet(str(tmp_path / "state3")).count() == len(got)


@pytest.mark.parametrize("timeout", [179, 86400, 200000])
def test_sessions_over_midnight_match_a_loop(spark, timeout):
    rng = random.Random(timeout)
    offsets = sorted(rng.choice([rng.uniform(0, 5 * 86400), 86400 * rng.randint(1, 4) + rng.uniform(-200, 200)]) for _ in range(400))
    expected, seconds = [], [int(o) for o in offsets]
    for s in seconds:
        if expected and s - expected[-1][1] <= timeout:
            expected[-1][1:] = [s, expected[-1][2] + 1]
        else:
            expected.append([s, s, 1])
    rows = heartbeat_gaps(beats(spark, offsets), timeout).collect()
    got = sorted([int((r.started - START).total_seconds()), int((r.last_beat - START).total_seconds()), r.beats] for r in rows)
    assert got == expected and all(r.silent_from - r.last_beat == timedelta(seconds=timeout) for r in rows)


def told_by_loop(offsets, passed, timeout=179):
    out, before = [], None
    for s in sorted({int(o) for o in offsets if int(o) <= passed}):
        if before is not None and s - before > timeout:
            out += [("silent", before, before + timeout), ("back", before, s)]
        before = s
    if before is not None and passed > before + timeout:
        out.append(("silent", before, before + timeout))
    return sorted(out)


def test_silence_is_told_by_timers_and_survives_a_restart(spark, tmp_path):
    hosts = {"a": [0, 178], "b": [0, 179, 358.5], "c": [0, 180, 1000, 1001], "d": [5], "e": [4000]}
    later = {"a": [300, 3900], "c": [700, 990], "d": [2000]}  # some between beats that came earlier
    last = {"a": [9000], "e": [8000], "f": [8500]}

    def put(part, given):
        rows = [("A-B", h, START + timedelta(seconds=s)) for h, offsets in given.items() for s in offsets]
        spark.createDataFrame(rows, "connectionName string, host string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / part))

    def run():
        stream = spark.readStream.schema("connectionName string, host string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        writer = silence_alerts(stream, lateness="4000 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        with timers(spark):
            query = writer.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
        seconds = lambda t: int((t - START).total_seconds())
        return {h: sorted((r.kind, seconds(r.last_beat), seconds(r.at)) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.host == h) for h in "abcdef"}

    put("p1", hosts)
    put("p2", later)
    first = run()
    every = {h: hosts.get(h, []) + later.get(h, []) for h in "abcdef"}
    assert first == {h: told_by_loop(o, 0) for h, o in every.items()}
    put("p3", last)
    every = {h: every[h] + last.get(h, []) for h in "abcdef"}
    done = run()
    assert done == {h: told_by_loop(o, 5000) for h, o in every.items()}
    assert done["a"] == [("back", 300, 3900), ("silent", 300, 479), ("silent", 3900, 4079)] and ("silent", 0, 179) in done["c"] and ("silent", 179, 358) not in done["b"]


def test_replay_state_is_merged_while_the_stream_runs(spark, tmp_path):
    source, state, mark = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "mark")
    rng, rows = random.Random(3), []
    total = lambda: spark.createDataFrame(rows, CHANGES)
    stream = lambda: spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(source))

    def put(keys, n=30):
        new = []
        for _ in range(n):
            key, at = rng.choice(keys), len(rows) + len(new)
            new.append((1, at, 0, "DELETE", (key, "x"), None) if rng.random() < 0.2 else (1, at, 0, "INSERT", None, (key, f"v{at}")))
        rows.extend(new)
        spark.createDataFrame(new, CHANGES).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        start_replay(stream(), ["id"], state, mark, buckets=8).awaitTermination()
        return table()

    def table():
        return sorted(map(tuple, current_table(spark, state, ["id"]).collect()))

    def expected():
        return sorted(map(tuple, apply_changes(None, total(), ["id"]).collect()))

    put(range(40))
    assert run() == expected()
    assert compact(spark, state, ["id"]) == 0 and unused_folders(spark, state) == []  # the newest batch may still be written
    put(range(40))
    put(range(40))
    assert run() == expected()
    assert compact(spark, state, ["id"]) == 1 and table() == expected()
    old = unused_folders(spark, state)
    assert len(old) == 2 and all(f.startswith("delta=") for f in old)
    assert compact(spark, state, ["id"], running=False) == 2 and table() == expected()
    # One key: one bucket is read, merged and replaced, the others stay.
    put([7])
    assert run() == expected()
    images, _, buckets = merge_input(spark, state, running=False)
    read = {r.f.split("bucket=")[1].split("/")[0] for r in images.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(buckets) == 1 and read == {str(buckets[0])}
    scans = images._jdf.queryExecution().executedPlan().toString().split("FileScan")[1:]
    assert any("bucket" in scan.split("PartitionFilters: [")[1].split("]")[0] for scan in scans)
    assert compact(spark, state, ["id"], running=False) == 3 and table() == expected()
    assert compact(spark, state, ["id"], running=False) == 3  # nothing new
    # Tombstones go where no older change can come; other folders are not needed any more.
    put([7])
    run()
    compact(spark, state, ["id"], {"file_no": 99}, running=False)
    assert table() == expected()
    for folder in unused_folders(spark, state):
        shutil.rmtree(f"{state}/{folder}")
    assert table() == expected() and unused_folders(spark, state) == []
    put(range(40))
    assert run() == expected()


def test_bulk_ids_of_a_stream(spark, tmp_path):
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")

    def run(low, high):
        spark.range(low, high).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        start_bulk_ids(stream, target, mark, 1_700_000_000_000, "number").awaitTermination()
        rows = spark.read.parquet(target)
        assert rows.count() == rows.select("number").distinct().count() == high
        ends = rows.groupBy("batch").agg(F.min("number").alias("low"), F.max("number").alias("high")).orderBy("batch").collect()
        assert all(a.high < b.low for a, b in zip(ends, ends[1:]))
        return {r.id: (r.number, r.batch) for r in rows.collect()}

    first = run(0, 9_000)
    second = run(9_000, 20_000)
    assert all(second[i] == n for i, n in first.items())
    # The last batch was not marked as done: it is run again, over the same range.
    last = max(b for _, b in second.values())
    (tmp_path / "mark" / "commits" / str(last)).unlink()
    (tmp_path / "mark" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    third = run(20_000, 20_001)
    assert all(third[i] == n for i, n in second.items())
