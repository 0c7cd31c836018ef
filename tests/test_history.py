"""What holds along a log: definitions by position, transactions, what stood last."""

import random

import pytest
from pyspark.sql import functions as F

from fleetledger.operators import changelog as C
from fleetledger.operators import schema_history as H
from fleetledger.operators import transactions as X
from fleetledger.operators.log_scan import last_before
from fleetledger.sources.event_text import events_from

HEADER = "#170921 20:28:37 server id 1  end_log_pos 9 \tQuery\n"


def log(spark, *events, header=HEADER):
    """Events of (file, pos, text)."""
    rows = [(file, f"{pos}\n{header}{text}") for file, pos, text in events]
    return events_from(spark.createDataFrame(rows, "file string, value string")).repartition(3)


def test_last_value_before_each_event(spark):
    rng = random.Random(1)
    rows = [(f, p, rng.choice([None, None, None, p])) for f in ("a.000001", "b", None) for p in rng.sample(range(1000), 120)]
    frame = spark.createDataFrame([(*r, "s", 7) for r in rows], "file string, pos long, v long, _slice string, _carry int").repartition(4)
    for size in (1, 10, 100_000):
        got = last_before(frame, F.col("v"), "last", slice_bytes=size)
        assert got.columns == [*frame.columns, "last"]
        for r in got.collect():
            earlier = [v for f, p, v in rows if f == r.file and p < r.pos and v is not None]
            assert r["last"] == (max(earlier) if earlier else None) and r["_slice"] == "s"
    assert last_before(frame.limit(0), F.col("v"), "last").count() == 0


def test_no_window_over_a_file(spark):
    events = log(spark, ("bin.000001", 4, "BEGIN\n/*!*/;\n"))
    plan = X.with_transactions(events)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # One inside the slices; the other runs over the sums of the slices.
    assert len(windows) == 2 and sum("_slice" in line.rsplit("], [", 2)[-2] for line in windows) == 1
    over_file = next(i for i, line in enumerate(plan.splitlines()) if "Window [" in line and "_slice" not in line.rsplit("], [", 2)[-2])
    assert "Aggregate" in plan.splitlines()[over_file + 1] or "Aggregate" in plan.splitlines()[over_file + 2]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_transactions(spark, size):
    begin, commit, back = "SET TIMESTAMP=1/*!*/;\nBEGIN\n/*!*/;\n", "COMMIT/*!*/;\n", "ROLLBACK\n/*!*/;\n"
    row = "### INSERT INTO `s`.`t`\n### SET\n###   @1='COMMIT'\n"
    events = log(
        spark,
        ("a.000001", 4, back), ("a.000001", 10, begin), ("a.000001", 20, row), ("a.000001", 30, row * 3), ("a.000001", 40, commit), ("a.000001", 50, "create table x (a int)\n/*!*/;\n"),
        ("a.000001", 60, "start transaction/*!*/;\n"), ("a.000001", 61, "START TRANSACTION\n/*!*/;\n"), ("a.000001", 70, row), ("a.000001", 80, back), ("a.000001", 90, begin), ("a.000001", 95, row),
        ("a.000002", 5, row), ("a.000002", 9, begin), ("a.000002", 12, "insert into t values ('\nCOMMIT\n');\n/*!*/;\n"), ("a.000002", 15, begin), ("a.000002", 20, commit),
        ("a.000002", 30, row), ("a.000002", 35, begin), ("a.000002", 36, "SAVEPOINT s/*!*/;\nROLLBACK TO s/*!*/;\n"), ("a.000002", 37, commit),
    )
    got = sorted((r.file_no, r.begin_pos, r.end_pos, r.n_events, r.n_rows, r.outcome) for r in X.transactions(events, size).collect())
    assert got == [
        (1, 10, 40, 4, 4, "committed"), (1, 61, 80, 3, 1, "rolled back"), (1, 90, 95, 2, 1, "unfinished"),
        (2, 9, 12, 2, 0, "unfinished"), (2, 15, 20, 2, 0, "committed"), (2, 35, 37, 3, 0, "committed"),
    ]
    where = lambda df: sorted((r.file_no, r.pos) for r in df.collect())
    assert where(X.held_back(events, size)) == [(1, 90), (1, 95), (2, 9), (2, 12)]
    gone = {(1, 61), (1, 70), (1, 80), (1, 90), (1, 95), (2, 9), (2, 12)}
    assert where(X.finished(events, size)) == sorted({(r.file_no, r.pos) for r in events.collect()} - gone)
    assert X.finished(events.limit(0)).count() == 0 and X.transactions(events.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("statement", "expected"),
    [
        ("CREATE TABLE t (`a` int, b decimal(10,2) DEFAULT '(,', KEY `k` (`a`,b), PRIMARY KEY (a)) ENGINE=InnoDB", [("create", "`d`.`t`", ["a", "b"])]),
        ("create table if not exists `x`.`a``b` (`key` int /* , */, `c,d` enum('p,q','r)') COMMENT \"y, ' z\", CHECK (b > (1)))", [("create new", "`x`.`a``b`", ["key", "c,d"])]),
        ("CREATE TABLE t AS SELECT 1", [("create", "`d`.`t`", None)]),
        ("CREATE TABLE t (a int) PARTITION BY HASH (a)", [("create", "`d`.`t`", ["a"])]),
        ("CREATE TABLE a LIKE x . b", [("like", "`d`.`a`", "`x`.`b`")]),
        ("CREATE TABLE a (LIKE b)", [("like", "`d`.`a`", "`d`.`b`")]),
        ("CREATE TEMPORARY TABLE t (a int)", []),
        ("ALTER TABLE t ADD a int", [("add", "a", None)]),
        ("ALTER TABLE t ADD COLUMN a varchar(3) AFTER `b`, ADD c int FIRST;", [("add", "a", "b"), ("add", "c", "")]),
        ("ALTER TABLE t ADD INDEX i (a), ADD UNIQUE (b), ADD `index` int, ENGINE=InnoDB", [("add", "index", None)]),
        ("ALTER TABLE t ADD COLUMN (a int, b int)", [("lost",)]),
        ("ALTER TABLE t DROP a, DROP COLUMN `b`, DROP PRIMARY KEY, DROP INDEX i", [("cut", "a"), ("cut", "b")]),
        ("ALTER TABLE t CHANGE a b int AFTER c, MODIFY COLUMN d int, RENAME COLUMN e TO f, RENAME INDEX g TO h", [("change", "a", "b", "c"), ("change", "d", "d", None), ("change", "e", "f", None)]),
        ("ALTER TABLE t RENAME TO y.z", [("rename", "`y`.`z`", "`d`.`t`")]),
        ("ALTER TABLE t RENAME z, ADD a int", [("rename", "`d`.`z`", "`d`.`t`"), ("add", "a", None)]),
        ("RENAME TABLE a TO b, `x`.`c` TO a", [("rename", "`d`.`b`", "`d`.`a`"), ("rename", "`d`.`a`", "`x`.`c`")]),
        ("DROP TABLE IF EXISTS a, x.b CASCADE", [("drop", "`d`.`a`"), ("drop", "`x`.`b`")]),
        ("DROP DATABASE `x`", [("drop all", "`x`.")]),
        ("TRUNCATE TABLE t", []),
        ("", []),
    ],
)
def test_statements(statement, expected):
    shown = {"create": ("table", "columns"), "create new": ("table", "columns"), "like": ("table", "source"), "add": ("renamed", "place"), "lost": (), "cut": ("column",), "change": ("column", "renamed", "place"), "rename": ("table", "source"), "drop": ("table",), "drop all": ("table",)}
    got = [(x["op"], *[x.get(n) for n in shown[x["op"]]]) for x in H.statement_actions(statement, "d")]
    assert got == expected


def test_versions_along_a_log(spark):
    say = lambda *s: "".join(x + "\n/*!*/;\n" for x in s)
    events = log(
        spark,
        ("f.000002", 4, say("use `d`", "ALTER TABLE t ADD x int AFTER a")),
        ("f.000001", 10, say("use d", "ALTER TABLE t ADD b int, DROP a, ADD `c` int FIRST")),
        ("f.000001", 20, say("ALTER TABLE t CHANGE B `bb` int")),
        ("f.000001", 30, say("CREATE TABLE _t LIKE t", "ALTER TABLE _t MODIFY bb int FIRST", "RENAME TABLE t TO _o, _t TO t", "DROP TABLE _o")),
        ("f.000001", 40, say("CREATE TABLE IF NOT EXISTS t (z int)", "ALTER TABLE t DROP nothing")),
        ("f.000001", 50, say("ALTER TABLE t ADD COLUMN (q int)")),
        ("f.000001", 60, say("DROP TABLE t", "CREATE TABLE t (a int, e int)")),
        ("f.000001", 70, say("use other", "ALTER TABLE d.u ADD v int", "CREATE TABLE d.w (a int)", "DROP DATABASE d", "CREATE TABLE d.t (a int)")),
        ("f.000001", 80, "### INSERT INTO `d`.`t`\n### SET\n###   @1='\nDROP TABLE t\n/*!*/;\n'\n"),
    )
    catalog = spark.createDataFrame([("d", "t", 1, "a"), ("d", "u", 1, "a"), ("d", "u", 3, "c"), ("e", "t", 1, "n")], "db string, `table` string, ordinal int, `column` string")
    got = {}
    for size in (1, 1 << 26):
        history = H.schema_history(events, catalog, size)
        got[size] = sorted((r.db, r.table, r.at.rank, r.at.file_no or 0, r.at.pos or 0, r.names) for r in history.collect())
    t = lambda pos, names, no=1: ("d", "t", 1, no, pos, names)
    expected = [
        ("d", "t", 0, 0, 0, ["a"]), t(10, ["c", "b"]), t(20, ["c", "bb"]), t(30, ["bb", "c"]), t(40, ["bb", "c"]), t(50, None), t(60, ["a", "e"]), t(70, ["a"]), t(4, ["a", "x"], 2),
        ("d", "_t", 1, 1, 30, None), ("d", "_o", 1, 1, 30, None), ("d", "u", 0, 0, 0, ["a", None, "c"]), ("d", "u", 1, 1, 70, None), ("d", "w", 1, 1, 70, None), ("e", "t", 0, 0, 0, ["n"]),
    ]
    assert sorted((x for x in got[1]), key=str) == sorted(expected, key=str) and got[1] == got[1 << 26]
    rows = log(
        spark,
        *[("f.000001", p, "### INSERT INTO `d`.`t`\n### SET\n###   @1=1\n###   @2=2\n") for p in (9, 10, 25, 55, 65, 75)],
        ("f.000002", 5, "### DELETE FROM `d`.`t`\n### WHERE\n###   @2=2\n"), ("f.000001", 9, "### INSERT INTO `no`.`t`\n### SET\n###   @1=1\n"), ("f.000001", 71, "### DELETE FROM `d`.`u`\n### WHERE\n###   @1=2\n"),
    )
    named = H.resolve_columns_at(C.row_images(C.row_statements(rows)), history)
    shown = {(r.file_no, r.pos, r.db, r.table): r.rejected or [x.column for x in (r.after or r.before)] for r in named.collect()}
    assert shown == {
        (1, 9, "d", "t"): "unknown column", (1, 10, "d", "t"): "unknown column", (1, 25, "d", "t"): ["c", "bb"], (1, 55, "d", "t"): "unknown column",
        (1, 65, "d", "t"): ["a", "e"], (1, 75, "d", "t"): "unknown column", (2, 5, "d", "t"): ["x"], (1, 9, "no", "t"): "unknown column", (1, 71, "d", "u"): "unknown column",
    }


def test_user_columns_stay(spark):
    from datetime import datetime

    from fleetledger.operators.ids import with_bulk_snowflake_id, with_snowflake_id
    from fleetledger.operators.sequence import number_within

    names = ("_ms", "_slot", "_n", "_mono", "_slice", "_inside", "_rows", "_shift", "_part", "_key0")
    rows = [(i, datetime(2024, 1, 1), *[f"{n}{i}" for n in names]) for i in range(5)]
    frame = spark.createDataFrame(rows, ", ".join(["k long", "ts timestamp", *[f"{n} string" for n in names]])).repartition(2)
    kept = lambda df: sorted(tuple(r[c] for c in frame.columns) for r in df.collect())
    assert kept(with_snowflake_id(frame, F.col("ts"), F.col("k"), [F.col("k")])) == rows
    assert kept(with_bulk_snowflake_id(frame, 1_700_000_000_000)) == rows
    assert with_snowflake_id(frame, F.col("ts"), F.col("k"), [F.col("k")], name="_n").columns == frame.columns
    for cut in (None, F.col("k") % 2):
        done = number_within(frame, ["ts"], [F.col("k") % 2, F.col("k")], "no", cut, 3)
        assert kept(done) == rows and sorted(r["no"] for r in done.collect()) == [1, 2, 3, 4, 5]
    crowd = spark.range(4097).select(F.lit(1).alias("k"), F.lit(datetime(2024, 1, 1)).alias("ts"), "id")
    with pytest.raises(Exception, match="more than 4096 rows"):
        with_snowflake_id(crowd, F.col("ts"), F.col("k"), [F.col("id")], name="x").count()


def test_partial_images_of_rows_that_nobody_holds(spark):
    schema = "file_no long, pos long, row_no int, op string, before struct<id:long,a:string,b:string>, after struct<id:long,a:string,b:string>, have array<boolean>"
    everything, part = [True, True, True], [True, True, False]
    rows = [
        (1, 1, 0, "UPDATE", (7, None, None), (7, "n", None), part),  # nobody holds it
        (1, 2, 0, "UPDATE", (1, None, None), (1, "n", None), part),  # the table does
        (1, 3, 0, "DELETE", (2, None, None), None, part),
        (1, 4, 0, "UPDATE", (2, None, None), (2, "n", None), part),  # gone by then
        (1, 5, 0, "INSERT", None, (8, "i", "j"), everything),
        (1, 6, 0, "UPDATE", (8, None, None), (8, "n", None), part),
        (1, 7, 0, "UPDATE", (3, None, None), (9, None, None), [True, False, False]),  # a move without the row
        (1, 8, 0, "UPDATE", (8, "n", "j"), (10, "m", "j"), everything),
    ]
    changes = spark.createDataFrame(rows, schema)
    base = spark.createDataFrame([(1, "x", "y"), (2, "x", "y"), (3, "x", "y")], "id long, a string, b string")
    assert sorted(map(tuple, C.apply_changes(base, changes, ["id"]).collect())) == [(1, "n", "y"), (3, "x", "y"), (10, "m", "j")]
    assert sorted((r.id, r.columns) for r in C.incomplete_rows(base, changes, ["id"]).collect()) == [(2, ["b"]), (7, ["b"])]
    assert [(r.pos, r.old_key.id, r.new_key.id) for r in C.key_rejects(changes, ["id"]).collect()] == [(7, 3, 9)]
    assert sorted(map(tuple, C.apply_changes(None, changes, ["id"]).collect())) == [(10, "m", "j")]
