"""Whole paths over a log: random values survive, and a stream of text keeps a table current."""

import random

import pytest
from pyspark.sql import types as T

from fleetledger.operators import changelog as C
from fleetledger.sources.event_text import read_events, stream_events
from fleetledger.streaming.replay import current_table, start_replay

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([("d", "t", 1, "id"), ("d", "t", 2, "v")], "db string, `table` string, ordinal int, `column` string")


def printed(value):
    """A value as the log prints it."""
    if value is None:
        return "NULL"
    out = []
    for ch in value:
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'" or ord(ch) < 32:
            out.append(f"\\x{ord(ch):02x}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def unquoted(sql):
    """What a server reads in a quoted string."""
    named = {"n": "\n", "r": "\r", "0": "\0", "Z": "\x1a", "t": "\t"}
    out, i = [], 1
    while sql[i] != "'":
        if sql[i] == "\\":
            i += 1
            out.append(named.get(sql[i], sql[i]))
        else:
            out.append(sql[i])
        i += 1
    assert i == len(sql) - 1
    return "".join(out)


def event(pos, *blocks):
    head = f"# at {pos}\n#170921 20:28:37 server id 1  end_log_pos {pos + 1} CRC32 0x1 \tUpdate_rows: table id 7\n"
    return head + "".join(blocks)


def image(mark, row):
    return f"### {mark}\n###   @1={row[0]} /* INT meta=0 nullable=0 is_null=0 */\n###   @2={printed(row[1])} /* VARSTRING(9) meta=9 nullable=1 is_null=0 */\n"


def insert(row):
    return "### INSERT INTO `d`.`t`\n" + image("SET", row)


def update(old, new):
    return "### UPDATE `d`.`t`\n" + image("WHERE", old) + image("SET", new)


def delete(row):
    return "### DELETE FROM `d`.`t`\n" + image("WHERE", row)


def changes_of(events, catalog):
    return C.typed_changes(C.resolve_columns(C.row_images(C.row_statements(events)), catalog), "d", "t", SCHEMA)


def test_random_values_survive(spark, catalog, tmp_path):
    rng = random.Random(1)
    alphabet = "ab \\'\"`=@#/*(),;x27n0é漢\t\n\r\0\x1a\x01" + "\\'" * 3
    values = [None, "", "\\", "'", "\\x27", "\\\\x27", "NULL", "/* X */", " (7)", "2017-01-01 00:00:00", "\n### SET\n"]
    values += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 24))) for _ in range(800)]
    (tmp_path / "bin.000001").write_text("".join(event(10 + i, insert((i, v))) for i, v in enumerate(values)), newline="")
    events = read_events(spark, str(tmp_path))
    got = {r.after.id: r.after.v for r in changes_of(events, catalog).collect()}
    assert got == dict(enumerate(values))
    for r in C.statements(events, catalog, include_ddl=False).collect():
        start = "INSERT INTO `d`.`t` SET `id`="
        assert r.sql.startswith(start)
        number, literal = r.sql[len(start) :].split(",`v`=", 1)
        expected = values[int(number)]
        assert (literal == "NULL") if expected is None else (unquoted(literal) == expected)


def random_history(rng, n):
    """Events of random changes, and the table they leave."""
    rows, out = {}, []
    for i in range(n):
        blocks = []
        for _ in range(rng.randrange(1, 4)):
            key = rng.randrange(40)
            if key not in rows:
                rows[key] = f"v{i}"
                blocks.append(insert((key, rows[key])))
            elif rng.random() < 0.3:
                blocks.append(delete((key, rows.pop(key))))
            else:
                new = rng.choice([key, rng.randrange(40)])
                if new != key and new in rows:
                    new = key
                old = rows.pop(key)
                rows[new] = f"it's {i}"
                blocks.append(update((key, old), (new, rows[new])))
        out.append(event(4 + i, *blocks))
    return out, rows


def test_text_stream_keeps_the_table_current(spark, catalog, tmp_path):
    events, rows = random_history(random.Random(2), 300)
    source = tmp_path / "in"
    source.mkdir()
    state, mark = str(tmp_path / "state"), str(tmp_path / "mark")
    for part in range(3):
        (source / f"bin.{part + 8:06d}").write_text("".join(events[part * 100 : part * 100 + 100]))
        stream = changes_of(stream_events(spark, str(source), max_files=1), catalog)
        start_replay(stream, ["id"], state, mark).awaitTermination()
    expected = sorted(rows.items())
    assert sorted(tuple(r) for r in current_table(spark, state, ["id"]).collect()) == expected
    batch = C.apply_changes(None, changes_of(read_events(spark, str(source)), catalog), ["id"])
    assert sorted(tuple(r) for r in batch.collect()) == expected
