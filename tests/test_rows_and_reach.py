"""Versions of rows along a log against a replay one by one; topologies against plain graph searches; events put back on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from fleetledger.operators.reach import reach
from fleetledger.operators.row_history import ALWAYS, as_of, row_history, write_history
from fleetledger.streaming.events import start_events, written_events

SCHEMA = "file_no long, file string, pos long, row_no int, op string, before struct<id:string,a:long,b:string>, after struct<id:string,a:long,b:string>, have array<boolean>"
BASE = [("k0", 0, "x"), (None, 1, None), ("still", 2, "y"), ("other", None, "z")]


def made_log(seed: int, n: int = 150):
    """Changes in order; k0 has a third of them, some keys are NULL, some updates move a key or name part of the columns."""
    rng, out, pos = random.Random(seed), [], 0
    for i in range(n):
        if i % 50 == 0:
            pos = 0
        pos += rng.randint(1, 30)
        file_no = (None, 1, 2)[i // 50]
        key = rng.choice(["k0"] * 4 + ["k1", "k2", "k3", None])
        row = (key, i, rng.choice(["p", "q", None]))
        op, have, before, after = rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), [True] * 3, None, row
        if op == "DELETE":
            before, after = row, None
        elif op == "UPDATE":
            moves = rng.random() < 0.2
            have = [True] * 3 if rng.random() < 0.5 else [True, rng.random() < 0.5, False]
            before = (rng.choice(["k1", "k2"]) if moves else key, 0, "o")
        out.append((file_no, f"bin.{file_no}", pos, rng.choice([0, 0, 1]), op, before, after, have))
    return out


def replay(base, changes):
    """The table after each change: key to row; None for what nobody told."""
    held = {r[0]: list(r) for r in base}
    yield None, dict(held)
    for file_no, file, pos, row_no, op, before, after, have in changes:
        if op == "UPDATE" and before[0] != after[0]:
            if not all(have):
                yield (file_no, file, pos, row_no), dict(held)
                continue
            held.pop(before[0], None)
        if op == "DELETE":
            held.pop(before[0], None)
        else:
            old = held.get(after[0], ["?"] * 3)
            held[after[0]] = [after[i] if have[i] else old[i] for i in range(3)]
        yield (file_no, file, pos, row_no), {k: list(v) for k, v in held.items()}


def whole(table):
    return sorted((tuple(r) for r in table.values() if "?" not in r), key=repr)


@pytest.mark.parametrize("seed, slice_rows, slice_bytes", [(1, 10, 50), (2, 1, 1), (3, 10**6, 1 << 26), (4, 25, 400)])
def test_table_at_any_position(spark, tmp_path, seed, slice_rows, slice_bytes):
    log = made_log(seed)
    changes = spark.createDataFrame(log, SCHEMA).repartition(3)
    base = spark.createDataFrame(BASE, "id string, a long, b string")
    write_history(base, changes, ["id"], str(tmp_path / "h"), slice_rows, slice_bytes)
    versions = row_history(base, changes, ["id"], slice_rows, slice_bytes).cache()
    states = list(replay(BASE, log))
    rng = random.Random(seed)
    for place, table in [states[0], states[-1], *rng.sample(states[1:], 5)]:
        file_no, file, pos, _ = place or (None, "", 0, 0)
        got = as_of(spark, str(tmp_path / "h"), pos, file_no, file)
        assert got.columns == ["id", "a", "b"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == whole(table), place
    # One by one: a version begins where the row becomes other than it was.
    assert versions.where("to_at is null").count() == len(whole(states[-1][1]))
    assert versions.where("from_at is null").count() == len(BASE)
    parts = {int(p.name.split("=")[1]) for p in (tmp_path / "h" / "versions").glob("slice=*")}
    assert ALWAYS in parts and (len(parts) > 3) == (slice_rows < 10**6)


def test_only_one_slice_is_read(spark, tmp_path):
    log = made_log(5)
    write_history(None, spark.createDataFrame(log, SCHEMA), ["id"], str(tmp_path / "h"), 10, 50)
    plan = as_of(spark, str(tmp_path / "h"), 40, 2, "bin.2")._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "slice" in read and "IN (-1," in read
    files = as_of(spark, str(tmp_path / "h"), 40, 2, "bin.2").select(F.input_file_name().alias("f")).distinct()
    assert len({r.f.split("slice=")[1].split("/")[0] for r in files.collect()}) == 1


def test_history_of_odd_input(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    base = spark.createDataFrame(BASE, "id string, a long, b string")
    assert row_history(None, none, ["id"]).count() == 0
    assert sorted(map(tuple, row_history(base, none, ["id"]).select("id", "a", "b").collect()), key=repr) == sorted(BASE, key=repr)
    write_history(base, none, ["id"], str(tmp_path / "h"))
    assert as_of(spark, str(tmp_path / "h"), 9).count() == len(BASE)
    log = made_log(6, 40)
    again = spark.createDataFrame(log + log, SCHEMA)  # an event that is read twice changes nothing
    bare = spark.createDataFrame(log, SCHEMA)
    ends = lambda df: sorted(map(tuple, row_history(None, df, ["id"]).where("to_at is null").select("id", "a", "b").collect()), key=repr)
    assert ends(again) == ends(bare) and ends(bare)


def plain_reach(links):
    masters = {}
    for slave, master in links:
        masters.setdefault(slave, set()).add(master)
        masters.setdefault(master, set())
    out = {}
    for node in masters:
        depth, level, seen, heads = 0, {node}, {node}, {n for n in [node] if not masters[n]}
        while level and not heads:
            level = {m for n in level for m in masters[n]} - seen
            seen |= level
            depth += 1
            heads = {n for n in level if not masters[n]}
        after, todo = set(), list(masters[node])
        while todo:
            if (n := todo.pop()) not in after:
                after.add(n)
                todo += masters[n]
        out[node] = (depth if heads else None, min(heads) if heads else None, node in after)
    return out


@pytest.mark.parametrize("seed, nodes, links", [(1, 12, 10), (2, 10, 14), (3, 14, 30)])
def test_topology(spark, seed, nodes, links):
    rng = random.Random(seed)
    pairs = [(f"c{rng.randrange(nodes)}", f"c{rng.randrange(nodes)}") for _ in range(links)]
    frame = spark.createDataFrame([*pairs, pairs[0], (None, "c0"), ("c0", None)], "clusterSlave string, clusterMaster string")
    got = {r.cluster: (r.depth, r["head"], r.in_cycle) for r in reach(frame).collect()}
    assert got == plain_reach(pairs)


def test_topology_without_links(spark):
    assert reach(spark.createDataFrame([], "clusterSlave string, clusterMaster string")).collect() == []


def test_events_are_put_back_on_a_stream_and_after_a_restart(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    head = "\n#170921 20:28:37 server id 1  end_log_pos 9 \tQuery\n"

    def put(number: int):
        text = "".join(f"# at {100 * i + 4}{head}say {i}\n" + ("# at 7\nand on\n# at all\n" if i % 3 == number % 3 else "") for i in range(20))
        (source / f"bin.00000{number}").write_text("# preamble\n" + text)

    def run():
        start_events(spark, str(source), target, mark, max_files=1).awaitTermination()
        return {(r.file_no, r.pos): r.record for r in written_events(spark, target).collect()}

    put(1)
    put(2)
    assert len(run()) == 2 * 21
    put(3)
    got = run()
    assert len(got) == written_events(spark, target).count() == 3 * 21
    for number in (1, 2, 3):
        for i in range(20):
            assert ("and on\n# at all" in got[number, 100 * i + 4]) == (i % 3 == number % 3)


def test_small_slices_do_not_store_rows_over_and_over(spark, tmp_path):
    """300 rows that change twice, in slices of two changes: the store has at most twice the versions."""
    changes = [(1, "bin.1", 10 * i, 0, "INSERT", None, (f"k{i % 300}", i, "x"), [True] * 3) for i in range(600)]
    frame = spark.createDataFrame(changes, SCHEMA)
    write_history(None, frame, ["id"], str(tmp_path / "h"), 2, 20)
    assert spark.read.parquet(str(tmp_path / "h" / "versions")).count() <= 1200
    for last in (0, 150, 299, 450, 599):
        got = {(r.id, r.a) for r in as_of(spark, str(tmp_path / "h"), 10 * last, 1, "bin.1").collect()}
        assert got == {(f"k{k}", max(i for i in range(last + 1) if i % 300 == k)) for k in range(min(300, last + 1))}
