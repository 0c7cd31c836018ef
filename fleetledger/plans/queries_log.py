"""Registered queries on change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetledger.operators import changelog as C
from fleetledger.plans.event_rendering import order_dump, order_log, text, write_order_log, write_supplier_dump
from fleetledger.plans.tables import table
from fleetledger.session import shared_folder
from fleetledger.sources.ddl_text import read_ddl, schema_catalog
from fleetledger.sources.event_text import events_from, read_events
from fleetledger.streaming.events import start_events, written_events
from fleetledger.streaming.replay import compact, current_table, start_replay

EXCLUDED = ["shop_7", "shop_11"]


def _catalog(spark, folder) -> DataFrame:
    return schema_catalog(order_dump(spark, folder))


def _resolved(spark, folder, events: DataFrame) -> DataFrame:
    return C.resolve_columns(C.row_images(C.row_statements(events)), _catalog(spark, folder))


def _entries(image: str) -> Column:
    return F.array_join(F.transform(image, lambda x: F.concat_ws("=", x["column"], x["literal"])), ";")


def log_events(spark, folder) -> DataFrame:
    events = read_events(spark, write_order_log(spark, folder))
    return events.select("file_no", "pos", F.length(F.rtrim("record", F.lit("\n"))).cast("long").alias("n_chars"))


def log_headers(spark, folder) -> DataFrame:
    heads = C.parse_headers(order_log(spark, folder))
    return heads.select("file_no", "pos", F.unix_timestamp("event_time").alias("event_s"), "server_id", "end_pos", "kind", "map_db", "map_table")


def log_catalog(spark, folder) -> DataFrame:
    catalog = schema_catalog(read_ddl(spark, write_supplier_dump(spark, folder)))
    return catalog.select("db", "table", F.col("ordinal").cast("long").alias("ordinal"), "column")


def log_statements(spark, folder) -> DataFrame:
    rows = C.row_statements(order_log(spark, folder))
    return rows.select("file_no", "pos", F.col("row_no").cast("long").alias("row_no"), "op", "db", "table")


def log_exclude(spark, folder) -> DataFrame:
    kept = C.exclude_schemas(C.row_statements(order_log(spark, folder)), EXCLUDED)
    return kept.groupBy("db", "op").agg(F.count(F.lit(1)).alias("n"))


def log_images(spark, folder) -> DataFrame:
    images = C.row_images(C.row_statements(order_log(spark, folder)))

    def entries(image: str) -> Column:
        return F.array_join(F.transform(image, lambda x: F.concat_ws("=", x["ordinal"].cast("string"), x["literal"])), ";")

    return images.select(
        "file_no", "pos", F.col("row_no").cast("long").alias("row_no"), "op", entries("before").alias("before_text"), entries("after").alias("after_text")
    )


def log_parse(spark, folder) -> DataFrame:
    changes = _resolved(spark, folder, read_events(spark, write_order_log(spark, folder)))
    return changes.where("rejected is null").select(
        "file_no", "pos", F.col("row_no").cast("long").alias("row_no"), "op", "db", "table",
        _entries("before").alias("before_text"), _entries("after").alias("after_text"),
    )


def log_rejects(spark, folder) -> DataFrame:
    bad = C.rejects(_resolved(spark, folder, order_log(spark, folder)))
    return bad.select("file_no", "pos", F.col("row_no").cast("long").alias("row_no"), "db", "reason", F.array_join(F.col("ordinals").cast("array<string>"), ",").alias("ordinals"))


def log_sql(spark, folder) -> DataFrame:
    events = read_events(spark, write_order_log(spark, folder))
    script = C.statements(events, _catalog(spark, folder), EXCLUDED)
    return script.select("file_no", "pos", F.col("row_no").cast("long").alias("row_no"), "sql")


def log_script(spark, folder) -> DataFrame:
    """The written script, read back line by line in the order of its files."""
    path = shared_folder(spark, "script")
    C.write_log_script(read_events(spark, write_order_log(spark, folder)), _catalog(spark, folder), path, tuple(EXCLUDED))
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
    )
    counts = lines.groupBy("part", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("first"))
    # A row for each split of a file.
    before = F.coalesce(F.sum("lines").over(Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("part", "block", "first", before.alias("before"))
    return lines.join(shifts, ["part", "block"]).select((F.col("before") + F.col("n") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def log_pass_through(spark, folder) -> DataFrame:
    lines = C.pass_through(order_log(spark, folder))
    return lines.select("file_no", "pos", "sql")


def log_broken(spark, folder) -> DataFrame:
    """Document texts as event pieces: only pieces with an event header are whole."""
    header = F.lit("\n#170921 20:28:37 server id 1  end_log_pos 9 \tQuery\n")
    piece = F.concat(F.col("doc_id") + 4, F.when(F.col("doc_id") % 2 == 0, header).otherwise(F.lit("\n")), F.col("text"))
    docs = table(spark, folder, "documents", "doc_id", "text").select(F.lit("bin.000001").alias("file"), piece.alias("value"))
    return C.broken_events(events_from(docs)).select("pos")


def _marked_log(spark, folder) -> str:
    """Where document texts stand as events; in every third a line looks like the mark of an event."""
    key, path = F.col("doc_id"), shared_folder(spark, "marked")
    false_mark = F.when(key % 3 == 0, text("\n# at ", key % 5, "\nand on")).when(key % 3 == 1, F.lit("\n# at the end")).otherwise(F.lit(""))
    body = text("# at ", key + 4, "\n#170921 20:28:37 server id 1  end_log_pos 9 \tQuery\n", F.col("text"), false_mark)
    name = text("bin.00000", key % 3 + 1)
    table(spark, folder, "documents", "doc_id", "text").select(name.alias("file"), body.alias("value")).write.partitionBy("file").text(path)
    return path


def _said(events: DataFrame) -> DataFrame:
    said = F.expr("substring(record, instr(record, '\tQuery\n') + 7)")
    return events.select("file_no", "pos", F.sha2(F.rtrim(said, F.lit("\n")), 256).alias("text_sha256"))


def log_rejoin(spark, folder) -> DataFrame:
    """Texts with lines that look like marks, read whole."""
    return _said(read_events(spark, _marked_log(spark, folder), rejoin=True))


def log_rejoin_stream(spark, folder) -> DataFrame:
    """The same as a stream of two files a batch."""
    target, mark = shared_folder(spark, "events"), shared_folder(spark, "mark")
    start_events(spark, _marked_log(spark, folder), target, mark, max_files=2).awaitTermination()
    return _said(written_events(spark, target))


def _order_changes(spark, folder) -> DataFrame:
    """Orders as changes of their customer's row: the order key is the log position, status F deletes."""
    row = F.struct(
        F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("state"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderkey").alias("orderkey"),
    )
    gone = F.col("o_orderstatus") == "F"
    nothing = F.lit(None)
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").select(
        F.lit(1).cast("long").alias("file_no"), F.col("o_orderkey").alias("pos"), F.lit(0).alias("row_no"),
        F.when(gone, F.lit("DELETE")).otherwise(F.lit("UPDATE")).alias("op"), row.alias("before"), F.when(gone, nothing).otherwise(row).alias("after"),
    )


def log_replay(spark, folder) -> DataFrame:
    base = table(spark, folder, "customer", "c_custkey").select(
        F.col("c_custkey").alias("customer"), F.lit("N").alias("state"), F.lit(0).cast("long").alias("cents"), F.lit(-1).cast("long").alias("orderkey")
    )
    return C.apply_changes(base, _order_changes(spark, folder), ["customer"])


def log_replay_moves(spark, folder) -> DataFrame:
    """Updates that change the key: each order moves a row from its customer's slot to the next slot."""

    def row(slot: Column) -> Column:
        return F.struct(slot.alias("slot"), F.col("o_orderpriority").alias("note"))

    changes = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select(
        F.lit(1).cast("long").alias("file_no"), F.col("o_orderkey").alias("pos"), F.lit(0).alias("row_no"), F.lit("UPDATE").alias("op"),
        row(F.col("o_custkey")).alias("before"), row(F.col("o_custkey") + 1).alias("after"),
    )
    return C.apply_changes(None, changes, ["slot"])


def log_replay_stream(spark, folder) -> DataFrame:
    """The changes of ``log_replay`` as a stream, folded batch by batch."""
    source, state, mark = (shared_folder(spark, p) for p in ("changes", "state", "mark"))
    _order_changes(spark, folder).write.parquet(source)
    schema = spark.read.parquet(source).schema
    start_replay(spark.readStream.schema(schema).parquet(source), ["customer"], state, mark).awaitTermination()
    return current_table(spark, state, ["customer"])


def log_replay_merge_stream(spark, folder) -> DataFrame:
    """The same in three batches; the first two are merged before the stream goes on, the third after it."""
    source, state, mark = (shared_folder(spark, p) for p in ("changes", "state", "mark"))
    changes = _order_changes(spark, folder)

    def run(third: int) -> None:
        changes.where(F.col("pos") % 3 == third).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_replay(stream, ["customer"], state, mark, buckets=4).awaitTermination()

    run(2)
    run(0)
    compact(spark, state, ["customer"])
    run(1)
    compact(spark, state, ["customer"], running=False)
    return current_table(spark, state, ["customer"])


ACCOUNT = T.StructType(
    [T.StructField(n, k) for n, k in (("id", T.LongType()), ("note", T.BinaryType()), ("state", T.StringType()), ("cents", T.LongType()), ("day", T.DateType()), ("seen", T.TimestampType()))]
)


def _account_changes(spark, folder) -> DataFrame:
    """Updates of customers' rows read from text in a file without a number; images are full or name what changed.

    By order key modulo 4: all columns, the state, the amount and the day, the time.  Every 97th day is no date.
    """
    key, status, path = F.col("o_orderkey"), F.col("o_orderstatus"), shared_folder(spark, "accounts")
    day = F.when(key % 97 == 0, F.lit("0000:00:00")).otherwise(F.date_format("o_orderdate", "yyyy:MM:dd"))

    def line(n: int, value) -> Column:
        return text(f"###   @{n}=", value, " /* meta=0 nullable=1 is_null=0 */\n")

    state, cents = line(3, text("'", status, "'")), line(4, F.round(F.col("o_totalprice") * 100).cast("long"))
    days, seen = line(5, text("'", day, "'")), line(6, F.unix_timestamp("o_orderdate"))
    who, note = line(1, F.col("o_custkey")), line(2, text("'\\xff\\xc3\\xa9", status, "'"))
    new = F.when(key % 4 == 0, F.concat(who, note, state, cents, days, seen)).when(key % 4 == 1, state).when(key % 4 == 2, F.concat(cents, days)).otherwise(seen)
    body = text("# at ", key + 4, "\n#170921 20:28:37 server id 1  end_log_pos 9 \tUpdate_rows: table id 70\n### UPDATE `shop`.`account`\n### WHERE\n", who, "### SET\n", new)
    orders = table(spark, folder, "orders")
    whole = orders.select(body.alias("body")).select(F.lit("decoded").alias("file"), F.col("body").substr(F.lit(1), F.length("body") - 1).alias("value"))
    whole.write.partitionBy("file").text(path)
    columns = [("shop", "account", i + 1, n) for i, n in enumerate(ACCOUNT.names)]
    catalog = spark.createDataFrame(columns, "db string, `table` string, ordinal int, `column` string")
    return C.resolve_columns(C.row_images(C.row_statements(read_events(spark, path))), catalog, small=True)


def _accounts(spark, folder) -> DataFrame:
    """Rows before the log; every tenth is missing."""
    return table(spark, folder, "customer", "c_custkey").where("c_custkey % 10 <> 3").select(
        F.col("c_custkey").alias("id"), F.lit("old").cast("binary").alias("note"), F.lit("N").alias("state"), F.lit(0).cast("long").alias("cents"),
        F.lit(None).cast("date").alias("day"), F.lit(None).cast("timestamp").alias("seen"),
    )


def log_replay_text(spark, folder) -> DataFrame:
    """Log text to current table."""
    now = C.apply_changes(_accounts(spark, folder), C.typed_changes(_account_changes(spark, folder), "shop", "account", ACCOUNT), ["id"])
    return now.select("id", F.hex("note").alias("note"), "state", "cents", F.date_format("day", "yyyy-MM-dd").alias("day"), F.unix_timestamp("seen").alias("seen"))


def log_incomplete(spark, folder) -> DataFrame:
    """Rows that the log changes but nothing holds, with what is not known of them."""
    changes = C.typed_changes(_account_changes(spark, folder), "shop", "account", ACCOUNT)
    return C.incomplete_rows(_accounts(spark, folder), changes, ["id"]).select("id", F.array_join("columns", ",").alias("columns"))


def log_key_rejects(spark, folder) -> DataFrame:
    """Updates that name the old and the new key, and every fifth all columns."""
    key = F.col("o_orderkey")
    row = lambda at: F.struct(at.alias("id"), F.col("o_orderstatus").alias("state"))
    changes = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
        F.lit(1).cast("long").alias("file_no"), key.alias("pos"), F.lit(0).alias("row_no"), F.lit("UPDATE").alias("op"),
        row(F.col("o_custkey")).alias("before"), row(F.col("o_custkey") + key % 2).alias("after"), F.array(F.lit(True), key % 5 == 0).alias("have"),
    )
    return C.key_rejects(changes, ["id"]).select("pos", F.col("old_key.id").alias("old_id"), F.col("new_key.id").alias("new_id"))


def log_value_rejects(spark, folder) -> DataFrame:
    bad = C.value_rejects(_account_changes(spark, folder), "shop", "account", ACCOUNT)
    return bad.select("pos", F.array_join("columns", ",").alias("columns"))


_CTE = """
WITH o AS (
  SELECT *, o_orderkey // 5000000 + 1 AS file_no, o_orderkey % 5000000 * 10 + 4 AS mark, 'shop_' || (o_custkey % 25) AS db,
         round(o_totalprice * 100)::BIGINT AS cents, o_orderdate + INTERVAL 7305 DAY AS placed,
         CASE WHEN o_orderkey % 4 = 0 THEN 'NULL'
              ELSE '''it\\x27s = ' || o_orderpriority || ' /* ' || (o_orderkey % 7) || ' */''' END AS note,
         CASE WHEN o_orderkey % 4 = 0 THEN 'NULL'
              ELSE '''it\\''s = ' || o_orderpriority || ' /* ' || (o_orderkey % 7) || ' */''' END AS sql_note
  FROM orders),
pick AS (
  SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'INSERT' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'INSERT' ELSE 'UPDATE' END AS op, 0 AS row_no FROM o
  UNION ALL SELECT *, 'UPDATE', 1 FROM o WHERE o_orderkey % 5 = 4),
change AS (
  SELECT *, mark + 1 AS pos, CASE WHEN op = 'DELETE' THEN o_orderstatus ELSE 'N' END AS old_state,
         CASE WHEN op = 'INSERT' THEN 'N' ELSE o_orderstatus END AS new_state, strftime(placed, '%Y-%m-%d %H:%M:%S') AS placed_text,
         (o_custkey % 25) % 9 <> 4 AS resolved
  FROM pick)
"""


def _image_sql(state: str, names: tuple[str, ...]) -> str:
    values = ["o_orderkey", "o_custkey", f"'''' || {state} || ''''", "cents", "note", "placed_text"]
    return " || ';' || ".join(f"'{n}=' || {v}" for n, v in zip(names, values))


def _both_images(names: tuple[str, ...]) -> str:
    return (
        f"CASE WHEN op = 'INSERT' THEN '' ELSE {_image_sql('old_state', names)} END AS before_text, "
        f"CASE WHEN op = 'DELETE' THEN '' ELSE {_image_sql('new_state', names)} END AS after_text"
    )


_ORDINALS = ("1", "2", "3", "4", "5", "6")
_NAMES = ("id", "customer", "state", "cents", "note", "placed")


def _list_sql(state: str, mark: str, between: str) -> str:
    values = ["o_orderkey", "o_custkey", f"'''' || {state} || ''''", "cents", "sql_note", "'''' || placed_text || ''''"]
    return f" || '{between}' || ".join(f"'`{n}`{mark}' || {v}" for n, v in zip(_NAMES, values))


_SETS, _WHERES = _list_sql("new_state", "=", ","), _list_sql("old_state", "<=>", " AND ")

_ACCOUNTS = """WITH c AS (SELECT *, o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS v FROM orders WHERE NOT (o_orderkey % 97 = 0 AND o_orderkey % 4 IN (0, 2))),
           f AS (SELECT o_custkey AS id, max_by('FFC3A9' || hex(o_orderstatus), k) FILTER (k % 4 = 0) AS note, max_by(o_orderstatus, k) FILTER (k % 4 IN (0, 1)) AS state,
                   max_by(v, k) FILTER (k % 4 IN (0, 2)) AS cents, max_by(strftime(o_orderdate, '%Y-%m-%d'), k) FILTER (k % 4 IN (0, 2)) AS day,
                   max_by(epoch_us(o_orderdate) // 1000000, k) FILTER (k % 4 IN (0, 3)) AS seen FROM c GROUP BY 1),
           h AS (SELECT c_custkey AS id, hex('old') AS note, 'N' AS state, 0 AS cents FROM customer WHERE c_custkey % 10 <> 3)
"""

_NEWEST = "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"

_REJOINED = """SELECT doc_id % 3 + 1 AS file_no, doc_id + 4 AS pos, sha256(rtrim(text || CASE doc_id % 3
       WHEN 0 THEN chr(10) || '# at ' || (doc_id % 5) || chr(10) || 'and on' WHEN 1 THEN chr(10) || '# at the end' ELSE '' END, chr(10))) AS text_sha256
FROM documents"""

QUERIES = {
    "log_events": (
        log_events,
        _CTE
        + """, target AS (SELECT *, length('`' || db || '`.`orders`') AS t,
               length(strftime(placed, '%y%m%d') || ' 0:00:00') AS d FROM o),
             image AS (
               SELECT *,
                 6 * 10 + length(o_orderkey::VARCHAR) + length(o_custkey::VARCHAR) + 3 + length(cents::VARCHAR) + length(note) + 19
                 + length(' /* LONGINT meta=0 nullable=1 is_null=0 */') * 3 + length(' /* STRING(1) meta=0 nullable=1 is_null=0 */')
                 + length(' /* VARSTRING(60) meta=0 nullable=1 is_null=0 */') + length(' /* DATETIME meta=0 nullable=1 is_null=0 */') AS body
               FROM target),
             sized AS (
               SELECT *, length('### SET') + 1 + body AS set_part, length('### WHERE') + 1 + body AS where_part,
                 length('### INSERT INTO ') + t + 1 AS ins, length('### UPDATE ') + t + 1 AS upd, length('### DELETE FROM ') + t + 1 AS del FROM image),
             e AS (
               SELECT file_no, mark + 0 AS pos, 'Table_map:  mapped to number 70' AS tail, t AS extra, d FROM sized
               UNION ALL
               SELECT file_no, mark + 1, CASE o_orderkey % 5 WHEN 0 THEN 'Write_rows' WHEN 3 THEN 'Delete_rows' ELSE 'Update_rows' END
                      || ': table id 70 flags: STMT_END_F',
                 CASE o_orderkey % 5 WHEN 0 THEN ins + set_part WHEN 3 THEN del + where_part
                      WHEN 4 THEN ins + set_part + upd + where_part + set_part ELSE upd + where_part + set_part END, d FROM sized
               UNION ALL SELECT file_no, mark + 2, 'Xid = ' || o_orderkey || 'COMMIT/*!*/;' || chr(10), 0, d FROM sized)
             SELECT file_no, pos, length(pos::VARCHAR) + 2 + d + length(' server id 1  end_log_pos ') + length((pos + 1)::VARCHAR)
                    + length(' CRC32 0x1f ') + 1 + length(tail) + extra + 1 - 1 AS n_chars FROM e""",
    ),
    "log_headers": (
        log_headers,
        _CTE
        + """, e AS (
               SELECT *, mark AS pos, 'Table_map' AS kind, db AS map_db, 'orders' AS map_table FROM o
               UNION ALL SELECT *, mark + 1, CASE o_orderkey % 5 WHEN 0 THEN 'Write_rows' WHEN 3 THEN 'Delete_rows' ELSE 'Update_rows' END, NULL, NULL FROM o
               UNION ALL SELECT *, mark + 2, 'Xid', NULL, NULL FROM o)
             SELECT file_no, pos, epoch_us(placed) // 1000000 AS event_s, o_orderkey % 3 + 1 AS server_id, pos + 1 AS end_pos, kind, map_db, map_table FROM e""",
    ),
    "log_catalog": (
        log_catalog,
        """SELECT 'shop_' || s_nationkey AS db, 't' || s_suppkey AS "table", n AS ordinal, 'c' || n AS "column"
           FROM supplier JOIN range(1, 13) AS r(n) ON n <= s_suppkey % 12 + 1""",
    ),
    "log_statements": (log_statements, _CTE + "SELECT file_no, pos, row_no, op, db, 'orders' AS \"table\" FROM change"),
    "log_exclude": (
        log_exclude,
        _CTE + "SELECT db, op, count(*) AS n FROM change WHERE db NOT IN ('shop_7', 'shop_11') GROUP BY db, op",
    ),
    "log_images": (log_images, _CTE + f"SELECT file_no, pos, row_no, op, {_both_images(_ORDINALS)} FROM change"),
    "log_parse": (
        log_parse,
        _CTE + f"SELECT file_no, pos, row_no, op, db, 'orders' AS \"table\", {_both_images(_NAMES)} FROM change WHERE resolved",
    ),
    "log_rejects": (
        log_rejects,
        _CTE + "SELECT file_no, pos, row_no, db, 'unknown column' AS reason, '6' AS ordinals FROM change WHERE NOT resolved",
    ),
    "log_sql": (
        log_sql,
        _CTE
        + f"""SELECT file_no, pos, row_no, CASE op
                 WHEN 'INSERT' THEN 'INSERT INTO `' || db || '`.`orders` SET ' || {_SETS}
                 WHEN 'DELETE' THEN 'DELETE FROM `' || db || '`.`orders` WHERE ' || {_WHERES}
                 ELSE 'UPDATE `' || db || '`.`orders` SET ' || {_SETS} || ' WHERE ' || {_WHERES} END AS sql
              FROM change WHERE resolved AND db NOT IN ('shop_7', 'shop_11')
              UNION ALL SELECT file_no, mark + 2, -1, 'COMMIT/*!*/;' FROM o""",
    ),
    "log_script": (
        log_script,
        _CTE
        + f"""SELECT row_number() OVER (ORDER BY file_no, pos, row_no, part) AS line, text FROM (
                SELECT file_no, pos, row_no, unnest([0, 1]) AS part, unnest([CASE op
                   WHEN 'INSERT' THEN 'INSERT INTO `' || db || '`.`orders` SET ' || {_SETS}
                   WHEN 'DELETE' THEN 'DELETE FROM `' || db || '`.`orders` WHERE ' || {_WHERES}
                   ELSE 'UPDATE `' || db || '`.`orders` SET ' || {_SETS} || ' WHERE ' || {_WHERES} END, '/*!*/;']) AS text
                FROM change WHERE resolved AND db NOT IN ('shop_7', 'shop_11')
                UNION ALL SELECT file_no, mark + 2, -1, 0, 'COMMIT/*!*/;' FROM o)""",
    ),
    "log_pass_through": (log_pass_through, _CTE + "SELECT file_no, mark + 2 AS pos, 'COMMIT/*!*/;' AS sql FROM o"),
    "log_broken": (log_broken, "SELECT doc_id + 4 AS pos FROM documents WHERE doc_id % 2 = 1"),
    "log_rejoin": (log_rejoin, _REJOINED),
    "log_rejoin_stream": (log_rejoin_stream, _REJOINED),
    "log_replay": (
        log_replay,
        f"""WITH newest AS (SELECT * FROM orders {_NEWEST})
            SELECT c_custkey AS customer, coalesce(o_orderstatus, 'N') AS state, coalesce(round(o_totalprice * 100)::BIGINT, 0) AS cents,
                   coalesce(o_orderkey, -1) AS orderkey
            FROM customer LEFT JOIN newest ON o_custkey = c_custkey WHERE o_orderstatus IS DISTINCT FROM 'F'
            UNION ALL SELECT o_custkey, o_orderstatus, round(o_totalprice * 100)::BIGINT, o_orderkey FROM newest
            WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    ),
    "log_replay_text": (
        log_replay_text,
        _ACCOUNTS
        + """SELECT coalesce(f.id, h.id) AS id, coalesce(f.note, h.note) AS note, coalesce(f.state, h.state) AS state, coalesce(f.cents, h.cents) AS cents, day, seen
           FROM f FULL JOIN h ON f.id = h.id WHERE h.id IS NOT NULL OR f.note IS NOT NULL""",
    ),
    "log_incomplete": (
        log_incomplete,
        _ACCOUNTS
        + """SELECT f.id, concat_ws(',', 'note', CASE WHEN state IS NULL THEN 'state' END, CASE WHEN cents IS NULL THEN 'cents' END,
                    CASE WHEN day IS NULL THEN 'day' END, CASE WHEN seen IS NULL THEN 'seen' END) AS columns
             FROM f WHERE id NOT IN (SELECT id FROM h) AND note IS NULL""",
    ),
    "log_key_rejects": (
        log_key_rejects,
        "SELECT o_orderkey AS pos, o_custkey AS old_id, o_custkey + 1 AS new_id FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0",
    ),
    "log_value_rejects": (log_value_rejects, "SELECT o_orderkey + 4 AS pos, 'day' AS columns FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 4 IN (0, 2)"),
    "log_replay_moves": (
        log_replay_moves,
        """SELECT slot, note FROM (
             SELECT o_custkey AS slot, o_orderkey, o_orderpriority AS note, 0 AS live FROM orders
             UNION ALL SELECT o_custkey + 1, o_orderkey, o_orderpriority, 1 FROM orders)
           QUALIFY row_number() OVER (PARTITION BY slot ORDER BY o_orderkey DESC) = 1 AND live = 1""",
    ),
    "log_replay_stream": (
        log_replay_stream,
        f"""WITH newest AS (SELECT * FROM orders {_NEWEST})
            SELECT o_custkey AS customer, o_orderstatus AS state, round(o_totalprice * 100)::BIGINT AS cents, o_orderkey AS orderkey
            FROM newest WHERE o_orderstatus <> 'F'""",
    ),
    "log_replay_merge_stream": (
        log_replay_merge_stream,
        f"""WITH newest AS (SELECT * FROM orders {_NEWEST})
            SELECT o_custkey AS customer, o_orderstatus AS state, round(o_totalprice * 100)::BIGINT AS cents, o_orderkey AS orderkey
            FROM newest WHERE o_orderstatus <> 'F'""",
    ),
}
