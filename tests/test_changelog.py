from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetledger.functions.literals import clean_literals, is_literal, literal_value, sql_literals
from fleetledger.operators import changelog as C
from fleetledger.plans.event_rendering import order_log, write_order_log
from fleetledger.sources.ddl_text import read_ddl, schema_catalog
from fleetledger.sources.event_text import events_from, read_events

SAMPLE = r"""/*!50530 SET @@SESSION.PSEUDO_SLAVE_MODE=1*/;
DELIMITER /*!*/;
# at 200
#170921 20:28:37 server id 1  end_log_pos 260 CRC32 0xaa 	Table_map: `shop`.`t` mapped to number 70
# at 260
#170921  9:28:37 server id 1  end_log_pos 320 CRC32 0xaa 	Update_rows: table id 70 flags: STMT_END_F
### UPDATE `shop`.`t`
### WHERE
###   @1=1 /* INT meta=0 nullable=0 is_null=0 */
###   @2='a b=c' /* VARSTRING(20) meta=20 nullable=1 is_null=0 */
### SET
###   @1=1 /* INT meta=0 nullable=0 is_null=0 */
###   @2=NULL /* VARSTRING(20) meta=20 nullable=1 is_null=1 */
### UPDATE `shop`.`t`
### WHERE
###   @1=2
###   @2='x'
### SET
###   @1=2
###   @2='it\'s'
# at 320
#170921 20:28:38 server id 1  end_log_pos 400 CRC32 0xaa 	Write_rows: table id 70 flags: STMT_END_F
### INSERT INTO `shop`.`t`
### SET
###   @1=-1 (4294967295)
###   @2='q /* no comment */ \x27w\x27 \\x41' /* VARSTRING(20) meta=20 nullable=1 is_null=0 */
### INSERT INTO `work`.`t`
### SET
###   @1=9
# at 400
#170921 20:28:39 server id 1  end_log_pos 450 CRC32 0xaa 	Query	thread_id=5	exec_time=0	error_code=0
SET TIMESTAMP=1506025719/*!*/;
CREATE TABLE x (a int)
/*!*/;
# at 450
#170921 20:28:39 server id 1  end_log_pos 500 CRC32 0xaa 	Delete_rows: table id 70 flags: STMT_END_F
### DELETE FROM `shop`.`wide`
### WHERE
###   @1=5
###   @10=2017-09-21 20:28:37
### DELETE FROM `shop`.`t`
### WHERE
###   @1=7
###   @3='no such column'
COMMIT/*!*/;
"""

DUMP = (
    "-- dump\nUSE `shop`;\nCREATE TABLE `t` (\n  `id` int NOT NULL,\n  `name` varchar(20) DEFAULT NULL,\n"
    "  PRIMARY KEY (`id`),\n  KEY `idx` (`name`)\n) ENGINE=InnoDB;\n\nCREATE TABLE `wide` (\n"
    + "".join(f"  `c{i}` int,\n" for i in range(1, 11))
    + "  PRIMARY KEY (`c1`)\n) ENGINE=InnoDB;\nUSE work;\nCREATE TABLE `t` (\n  `a``b` int\n) ENGINE=InnoDB;\n"
)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    (folder / "bin.000003").write_text(SAMPLE)
    dump = tmp_path_factory.mktemp("ddl") / "dump.sql"
    dump.write_text(DUMP)
    return read_events(spark, str(folder)), schema_catalog(read_ddl(spark, str(dump)))


def resolved(log):
    events, catalog = log
    return C.resolve_columns(C.row_images(C.row_statements(events)), catalog)


def test_events_and_headers(log):
    rows = {r.pos: r for r in C.parse_headers(log[0]).collect()}
    assert sorted(rows) == [0, 200, 260, 320, 400, 450]
    assert rows[200].kind == "Table_map" and (rows[200].map_db, rows[200].map_table) == ("shop", "t")
    assert rows[260].event_time.isoformat() == "2017-09-21T09:28:37"
    assert (rows[260].server_id, rows[260].end_pos, rows[260].kind, rows[260].file_no) == (1, 320, "Update_rows", 3)
    assert rows[0].kind is None and C.broken_events(log[0]).count() == 0


def test_files_split_by_block_keep_whole_events(spark, tmp_path):
    text = "".join(f"# at {i}\n#170921 20:28:37 server id 1  end_log_pos {i} \tX\nline {i}\n" for i in range(1, 3000))
    (tmp_path / "bin.000001").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        events = read_events(spark, str(tmp_path))
        assert events.rdd.getNumPartitions() > 10
        got = events.select("pos", F.regexp_extract("record", r"line (\d+)", 1).cast("long").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.pos, r.n) for r in got) == [(i, i) for i in range(1, 3000)]


def test_mark_inside_text_is_reported(spark, tmp_path):
    (tmp_path / "bin.000001").write_text("# at 4\n#170921 20:28:37 server id 1  end_log_pos 9 \tQuery\nselect '\n# at 5\n'\n")
    events = read_events(spark, str(tmp_path), rejoin=False)
    assert [r.pos for r in C.broken_events(events).collect()] == [5]
    assert [r.pos for r in C.pass_through(events).collect()] == [4]
    whole = read_events(spark, str(tmp_path))
    assert C.broken_events(whole).count() == 0 and [(r.pos, r.sql) for r in C.pass_through(whole).collect()] == [(4, "select '\n'")]


def test_catalog(log):
    rows = {(r.db, r.table, r.ordinal): r.column for r in log[1].collect()}
    assert len(rows) == 2 + 10 + 1
    assert rows["shop", "t", 2] == "name" and rows["shop", "wide", 10] == "c10" and rows["work", "t", 1] == "a`b"


def test_row_images(log):
    rows = {(r.pos, r.row_no): r for r in C.row_images(C.row_statements(log[0])).collect()}
    first = rows[260, 0]
    assert first.op == "UPDATE"
    assert [tuple(x) for x in first.before] == [(1, "1"), (2, "'a b=c'")]
    assert [tuple(x) for x in first.after] == [(1, "1"), (2, "NULL")]
    assert [tuple(x) for x in rows[260, 1].after] == [(1, "2"), (2, r"'it\'s'")]
    assert rows[320, 0].op == "INSERT" and rows[320, 0].before == []
    assert rows[320, 0].after[0].literal == "-1"
    assert rows[450, 0].op == "DELETE" and rows[450, 0].after == [] and rows[450, 0].before[1].ordinal == 10


def test_sql_and_rejects(log):
    changes = C.exclude_schemas(resolved(log), ["work"])
    sql = {(r.pos, r.row_no): r.sql for r in C.to_sql(changes).collect()}
    assert sql == {
        (260, 0): "UPDATE `shop`.`t` SET `id`=1,`name`=NULL WHERE `id`<=>1 AND `name`<=>'a b=c'",
        (260, 1): r"UPDATE `shop`.`t` SET `id`=2,`name`='it\'s' WHERE `id`<=>2 AND `name`<=>'x'",
        (320, 0): r"INSERT INTO `shop`.`t` SET `id`=-1,`name`='q /* no comment */ \'w\' \\x41'",
        (450, 0): "DELETE FROM `shop`.`wide` WHERE `c1`<=>5 AND `c10`<=>'2017-09-21 20:28:37'",
    }
    bad = C.rejects(changes).collect()
    assert [(r.pos, r.row_no, r.reason, r.ordinals) for r in bad] == [(450, 1, "unknown column", [3])]


def test_malformed_values_are_kept_and_rejected(spark, log):
    block = "INSERT INTO `shop`.`t`\n### SET\n###   @1=5 /* INT */\n###   @2=?? what /* X */"
    tricky = "INSERT INTO `shop`.`t`\n### SET\n###   @1=5\n###   @2='a ###   @9=1 /* INT */ (7)' /* X */"
    rows = [("bin.000001", 1, 9, 0, "INSERT", "shop", "t", block), ("bin.000001", 1, 9, 1, "INSERT", "shop", "t", tricky)]
    df = spark.createDataFrame(rows, "file string, file_no long, pos long, row_no int, op string, db string, `table` string, block string")
    out = {r.row_no: r for r in C.resolve_columns(C.row_images(df), log[1]).collect()}
    assert [x.literal for x in out[0].after] == ["5", "?? what"] and out[0].rejected == "malformed value"
    assert [x.literal for x in out[1].after] == ["5", "'a ###   @9=1 /* INT */ (7)'"] and out[1].rejected is None


def test_exclusion_by_table(spark, log):
    names = spark.createDataFrame([("work",), ("work",)], "db string")
    assert C.exclude_schemas(resolved(log), names).where("db = 'work'").count() == 0
    assert C.exclude_schemas(resolved(log), []).where("db = 'work'").count() == 1


def test_pass_through_and_script(spark, log, tmp_path):
    script = C.statements(*log)
    C.write_script(script, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.startswith("/*!50530 SET @@SESSION.PSEUDO_SLAVE_MODE=1*/;\nDELIMITER /*!*/;\nUPDATE ")
    assert text.index("CREATE TABLE x") < text.index("DELETE FROM `shop`.`wide`") < text.index("COMMIT/*!*/;")
    assert C.statements(*log, include_ddl=False).count() == 5
    once = C.to_sql(resolved(log)).unionByName(C.pass_through(log[0]))
    assert once.exceptAll(script).count() == 0 and script.exceptAll(once).count() == 0
    assert C.statements(*log, exclude=["work"]).exceptAll(script).count() == 0
    assert C.statements(*log, exclude=["work"]).count() == script.count() - 1


@pytest.mark.parametrize(
    "raw, clean, value, sql",
    [
        ("1 /* INT meta=0 */", "1", "1", "1"),
        ("NULL /* X */", "NULL", None, "NULL"),
        ("''", "''", "", "''"),
        (r"'a\\' /* X */", r"'a\\'", "a\\", r"'a\\'"),
        (r"'a\x0ab\\n'", r"'a\x0ab\\n'", "a\nb\\n", r"'a\nb\\n'"),
        (r"'\\x27 \\\x27 \x41'", r"'\\x27 \\\x27 \x41'", "\\x27 \\' A", r"'\\x27 \\\' A'"),
        (r"'\\x27 \\\x27'", r"'\\x27 \\\x27'", "\\x27 \\'", r"'\\x27 \\\''"),
        ("b'0101'", "b'0101'", "5", "b'0101'"),
        ("-1 (18446744073709551615)", "-1", "-1", "-1"),
        ("12.50", "12.50", "12.50", "12.50"),
        ("2017:09:21", "2017:09:21", "2017:09:21", "'2017:09:21'"),
        ("'/* X */'", "'/* X */'", "/* X */", "'/* X */'"),
        ("'(12)'", "'(12)'", "(12)", "'(12)'"),
    ],
)
def test_literals(spark, raw, clean, value, sql):
    df = spark.createDataFrame([(raw,)], "raw string").select(clean_literals(F.col("raw")).alias("c"))
    row = df.select("c", is_literal(F.col("c")).alias("ok"), literal_value(F.col("c")).alias("v"), sql_literals(F.col("c")).alias("s")).first()
    assert (row.c, row.ok, row.v, row.s) == (clean, True, value, sql)


def test_malformed_and_long_literals(spark):
    rows = [("'open",), ("'a'b'",), ("x",), ("",), ("!! unknown",), ("'" + "a\\\\" * 50000 + "'",)]
    ok = [r.ok for r in spark.createDataFrame(rows, "c string").coalesce(1).select(is_literal(F.col("c")).alias("ok")).collect()]
    assert ok == [False] * 5 + [True]


def test_typed_replay(spark, log):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    changes = C.typed_changes(resolved(log), "shop", "t", schema)
    base = spark.createDataFrame([(1, "a b=c"), (2, "x"), (50, "kept")], schema)
    rows = {r.id: r.name for r in C.apply_changes(base, changes, ["id"]).collect()}
    assert rows == {1: None, 2: "it's", 50: "kept", -1: r"q /* no comment */ 'w' \x41"}


def test_key_change_moves_the_row(spark):
    row = "struct<id:long,v:string>"
    changes = spark.createDataFrame(
        [
            (1, 10, 0, "INSERT", None, (1, "a")),
            (1, 20, 0, "UPDATE", (1, "a"), (2, "a")),
            (1, 20, 1, "UPDATE", (2, "a"), (3, "b")),
            (1, 30, 0, "DELETE", (9, "z"), None),
            (2, 5, 0, "UPDATE", (4, "old"), (4, "new")),
        ],
        f"file_no long, pos long, row_no int, op string, before {row}, after {row}",
    )
    base = spark.createDataFrame([(9, "z"), (4, "old"), (8, "idle")], "id long, v string")
    assert sorted(tuple(r) for r in C.apply_changes(base, changes, ["id"]).collect()) == [(3, "b"), (4, "new"), (8, "idle")]


# ---- replay on logs as they are


ACCOUNT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("note", T.StringType())])


def _replayed(spark, files, base=None, schema=ACCOUNT):
    rows = [(name, piece) for name, pieces in files.items() for piece in pieces]
    events = events_from(spark.createDataFrame(rows, "file string, value string"))
    catalog = spark.createDataFrame([("d", "t", i + 1, f.name) for i, f in enumerate(schema.fields)], "db string, `table` string, ordinal int, `column` string")
    changes = C.resolve_columns(C.row_images(C.row_statements(events)), catalog)
    held = spark.createDataFrame(base, schema) if base else None
    table = C.apply_changes(held, C.typed_changes(changes, "d", "t", schema), [schema.names[0]])
    return sorted(map(tuple, table.collect())), C.value_rejects(changes, "d", "t", schema), changes


def _event(pos, kind, where, new):
    head = f"{pos}\n#170921 20:28:37 server id 1  end_log_pos 9 \tRows\n### {kind} `d`.`t`"
    lines = lambda mark, values: f"\n### {mark}" + "".join(f"\n###   @{n}={v}" for n, v in values.items()) if values else ""
    return head + lines("WHERE", where) + lines("SET", new)


@pytest.mark.parametrize("where, new", [({1: 1, 2: 42, 3: "'old'"}, {1: 1, 2: 42, 3: "'new'"}), ({1: 1}, {3: "'new'"}), ({1: 1, 2: 42}, {1: 1, 2: 42, 3: "'new'"})])
def test_update_images_full_minimal_and_without_text(spark, where, new):
    assert _replayed(spark, {"bin.000001": [_event(4, "UPDATE", where, new)]}, [(1, 42, "old")])[0] == [(1, 42, "new")]


def test_columns_of_several_partial_updates_come_together(spark):
    log = [_event(4, "INSERT INTO", {}, {1: 1, 2: 2, 3: "'a'"}), _event(5, "UPDATE", {1: 1}, {2: 3}), _event(6, "UPDATE", {1: 1}, {3: "NULL"}), _event(7, "UPDATE", {1: 1}, {2: 4})]
    assert _replayed(spark, {"bin.000001": log})[0] == [(1, 4, None)]
    moved = _event(8, "UPDATE", {1: 1}, {1: 2, 2: 5})
    table, _, changes = _replayed(spark, {"bin.000001": [*log, moved]})
    assert table == [(1, 4, None)]  # the move is left out, and told
    assert [(r.pos, r.new_key.id) for r in C.key_rejects(C.typed_changes(changes, "d", "t", ACCOUNT), ["id"]).collect()] == [(8, 2)]


def test_files_without_number_win_over_the_base_and_do_not_mix(spark):
    first, second = [_event(100, "UPDATE", {1: 1}, {3: "'a'"})], [_event(4, "UPDATE", {1: 1}, {3: "'b'"})]
    assert _replayed(spark, {"a.txt": first, "b.txt": second}, [(1, 0, "old")])[0] == [(1, 0, "b")]
    assert _replayed(spark, {"b.txt": first, "bin.000001": second}, [(1, 0, "old")])[0] == [(1, 0, "b")]


def test_values_by_their_type_and_their_rejects(spark):
    schema = T.StructType([T.StructField(n, k) for n, k in (("id", T.LongType()), ("at", T.TimestampType()), ("day", T.DateType()), ("raw", T.BinaryType()), ("txt", T.StringType()))])
    good = _event(4, "INSERT INTO", {}, {1: 1, 2: "1505939317", 3: "'2017:09:20'", 4: r"'\xff\xfe\x80'", 5: r"'\xc3\xa9'"})
    bad = [_event(5, "INSERT INTO", {}, {1: 2, 2: "'soon'", 3: "'2017:13:41'", 4: "NULL", 5: "NULL"}), _event(6, "INSERT INTO", {}, {1: 3, 2: "NULL", 3: "NULL", 4: "NULL", 5: r"'\xff'"})]
    rows, rejected, _ = _replayed(spark, {"bin.000001": [good, *bad]}, schema=schema)
    assert len(rows) == 1 and rows[0][0] == 1 and str(rows[0][2]) == "2017-09-20" and bytes(rows[0][3]) == b"\xff\xfe\x80" and rows[0][4] == "é"
    assert rows[0][1].timestamp() == 1505939317
    assert sorted((r.pos, r["columns"]) for r in rejected.collect()) == [(5, ["at", "day"]), (6, ["txt"])]


def test_bytes_that_are_no_text_are_rejected(spark):
    piece = _event(4, "INSERT INTO", {}, {1: 1, 2: 2, 3: "'Q'"}).encode().replace(b"Q", b"\xff\xfe\x80")
    raw = spark.createDataFrame([("bin.000001", bytearray(piece))], "file string, b binary").select("file", F.col("b").cast("string").alias("value"))
    catalog = spark.createDataFrame([("d", "t", i + 1, n) for i, n in enumerate(ACCOUNT.names)], "db string, `table` string, ordinal int, `column` string")
    changes = C.resolve_columns(C.row_images(C.row_statements(events_from(raw))), catalog)
    assert [r.reason for r in C.rejects(changes).collect()] == ["bytes that are no text"] and C.to_sql(changes).count() == 0


@pytest.mark.parametrize("split", ["64", "200", "1m"])
def test_false_marks_are_rejoined_wherever_files_are_cut(spark, tmp_path, split):
    said = ["plain", "x\n# at 99\ny", "# at the end\n# at 5\n# at 6\nz" + "w" * 300, "last\n# at 7"]
    body = "preamble\n" + "".join(f"# at {i * 10 + 4}\n#170921 20:28:37 server id 1  end_log_pos 9 \tQuery\n{t}\n" for i, t in enumerate(said))
    (tmp_path / "bin.000001").write_text(body)
    (tmp_path / "bin.000002").write_text(body[len("preamble\n"):])
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        rows = read_events(spark, str(tmp_path), rejoin=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    for name in ("bin.000001", "bin.000002"):
        got = {r.pos: r.record.rstrip("\n").split("\tQuery\n", 1)[1] for r in rows if r.file == name and r.pos}
        assert got == {i * 10 + 4: t for i, t in enumerate(said)}
    assert len(rows) == 9


def test_a_written_log_is_compressed_parts(spark, monkeypatch):
    """Event text takes a part of its size on disk, and many parts of a file are read as one."""
    from pathlib import Path

    from fleetledger.plans import event_rendering
    from fleetledger.sources.event_text import read_events

    monkeypatch.setattr(event_rendering, "EVENTS_PER_FILE", 100)
    head = "concat(id * 10 + 4, '\n#170921 20:28:37 server id 1  end_log_pos 9 \tQuery\n', 'x', id, repeat(' y', 200), '\n')"
    events = spark.range(1000).coalesce(1).selectExpr("concat('bin.00000', id % 2) as file", f"{head} as value")
    path = event_rendering.write_log(spark, events)
    parts = [p for p in Path(path.removeprefix("file:")).glob("file=*/*") if not p.name.startswith((".", "_"))]
    assert len(parts) == 10 and sum(p.stat().st_size for p in parts) < 50_000
    found = {(r.file, r.pos) for r in read_events(spark, path).collect()}
    assert found == {(f"bin.00000{i % 2}", i * 10 + 4) for i in range(1000)}


def test_event_text_is_made_by_many_tasks(spark, tmp_path):
    """Orders of one row group, which one task reads, are rendered by several; the log has the same events."""
    columns = "id as o_orderkey, id % 9 as o_custkey, 'F' as o_orderstatus, cast(id as double) as o_totalprice, date'1995-01-01' as o_orderdate, '1-URGENT' as o_orderpriority"
    spark.range(500).selectExpr(*columns.split(", ")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    path = Path(write_order_log(spark, str(tmp_path)).removeprefix("file:"))
    assert len({p.name.split("-")[1] for p in path.rglob("part-*")}) == 4
    found, made = read_events(spark, str(path)), order_log(spark, str(tmp_path))
    assert found.count() == 1500
    columns = ["file", "file_no", "pos", F.rtrim("record", F.lit("\n")).alias("record")]
    assert found.select(*columns).exceptAll(made.select(*columns)).count() == 0


def test_value_numbers_are_those_of_the_marks(spark):
    """Numbers in any order; one bad value has its image read leniently, the other image keeps the checked values."""
    block = "UPDATE `d`.`t`\n### WHERE\n###   @3='a \\n###   @9=1' /* x */\n###   @1=-2 (4) /* x */\n### SET\n###   @2=oops\n###   @1=NULL"
    rows = spark.createDataFrame([("UPDATE", block)], "op string, block string")
    row = C.row_images(rows).first()
    assert [tuple(x) for x in row.before] == [(3, "'a \\n###   @9=1'"), (1, "-2")]
    assert [tuple(x) for x in row.after] == [(2, "oops"), (1, "NULL")] and not row.well_formed
