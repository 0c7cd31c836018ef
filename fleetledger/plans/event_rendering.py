"""Event text made from ``orders``, and schema dumps: inputs of the registered log queries.

Every order gives three events: the table map, the row event and a commit.  Row
events are, by order key modulo 5: an insert, an update of the status, an update, a
delete, and an insert with an update in one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.plans.tables import table
from fleetledger.session import shared_folder
from fleetledger.sources.event_text import EVENT_MARK, events_from

COLUMNS = ("id", "customer", "state", "cents", "note", "placed")
TYPES = ("LONGINT", "LONGINT", "STRING(1)", "LONGINT", "VARSTRING(60)", "DATETIME")
ORDERS_PER_SEGMENT = 5_000_000
#: Events of a written file; a compressed file is read by one task.
EVENTS_PER_FILE = 50_000


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _line(n: int, value) -> Column:
    return text(f"###   @{n}=", value, f" /* {TYPES[n - 1]} meta=0 nullable=1 is_null=0 */\n")


def _image(mark: str, state: Column) -> Column:
    return text(f"### {mark}\n", F.col("first_lines"), _line(3, text("'", state, "'")), F.col("last_lines"))


def order_events(spark, folder: str, spread: bool = False) -> DataFrame:
    """``file`` and ``value``: the text of each event without its event mark.

    With ``spread`` the orders are dealt out before their text is made: it is many times as large as they are, and a
    compressed table of a few row groups would be rendered by as few tasks.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    if spread:
        orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    note = text("'it\\x27s = ", F.col("o_orderpriority"), " /* ", key % 7, " */'")
    base = (
        orders.select(
            "*",
            F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 7305 * 86400).alias("placed"),
            (key % ORDERS_PER_SEGMENT * 10 + 4).alias("at"),
            text("bin.", F.lpad((F.floor(key / ORDERS_PER_SEGMENT) + 1).cast("string"), 6, "0")).alias("file"),
            text("`shop_", F.col("o_custkey") % 25, "`.`orders`").alias("target"),
        )
        .select(
            "o_orderkey", "o_orderstatus", "at", "file", "target",
            text("\n#", F.date_format("placed", "yyMMdd H:mm:ss"), " server id ", key % 3 + 1, "  end_log_pos ").alias("header"),
            text(_line(1, key), _line(2, F.col("o_custkey"))).alias("first_lines"),
            text(
                _line(4, F.round(F.col("o_totalprice") * 100).cast("long")),
                _line(5, F.when(key % 4 == 0, F.lit("NULL")).otherwise(note)),
                _line(6, F.date_format("placed", "yyyy-MM-dd HH:mm:ss")),
            ).alias("last_lines"),
        )
    )
    insert = text("### INSERT INTO ", F.col("target"), "\n", _image("SET", F.lit("N")))
    update = text("### UPDATE ", F.col("target"), "\n", _image("WHERE", F.lit("N")), _image("SET", status))
    delete = text("### DELETE FROM ", F.col("target"), "\n", _image("WHERE", status))
    kind = F.when(key % 5 == 3, F.lit("Delete_rows")).when(key % 5 == 0, F.lit("Write_rows")).otherwise(F.lit("Update_rows"))
    rows = (
        F.when(key % 5 == 0, insert).when(key % 5 == 3, delete).when(key % 5 == 4, F.concat(insert, update)).otherwise(update)
    )

    def event(step: int, what, body) -> Column:
        return text(F.col("at") + step, F.col("header"), F.col("at") + step + 1, " CRC32 0x1f \t", what, "\n", body)

    events = F.array(
        event(0, text("Table_map: ", F.col("target"), " mapped to number 70"), F.lit("")),
        event(1, text(kind, ": table id 70 flags: STMT_END_F"), rows),
        event(2, text("Xid = ", key), F.lit("COMMIT/*!*/;\n")),
    )
    return base.select("file", F.explode(events).alias("value"))


def order_log(spark, folder: str) -> DataFrame:
    """The events as the reader gives them, without a detour through files."""
    return events_from(order_events(spark, folder))


def write_order_log(spark, folder: str) -> str:
    """Write the event text, one folder per segment, and return where."""
    return write_log(spark, order_events(spark, folder, spread=True))


def write_log(spark, events: DataFrame) -> str:
    """Write event text (``file``, ``value`` without its mark, with its last line break), a folder of compressed parts per file, and return where."""
    path = shared_folder(spark, "log")
    mark = EVENT_MARK.lstrip("\n")
    body = F.col("value").substr(F.lit(1), F.length("value") - 1)
    lines = events.select("file", F.concat(F.lit(mark), body).alias("value")).write.partitionBy("file")
    lines.option("maxRecordsPerFile", EVENTS_PER_FILE).text(path, compression="gzip")
    return path


def _table_text(name: Column, columns: Column) -> Column:
    listed = F.array_join(F.transform(columns, lambda c: F.concat(F.lit("  `"), c, F.lit("` int NOT NULL,\n"))), "")
    first = F.element_at(columns, 1)
    return text(
        "CREATE TABLE `", name, "` (\n", listed, "  PRIMARY KEY (`", first, "`),\n  KEY `idx_first` (`", first, "`)\n) ENGINE=InnoDB DEFAULT CHARSET=utf8;\n"
    )


def order_dump(spark, folder: str) -> DataFrame:
    """``section`` per nation: the ``orders`` table of its database; each ninth dump misses the last column."""
    n = F.col("n_nationkey")
    known = F.when(n % 9 == 4, F.array(*map(F.lit, COLUMNS[:-1]))).otherwise(F.array(*map(F.lit, COLUMNS)))
    return table(spark, folder, "nation", "n_nationkey").select(
        text("`shop_", n, "`;\n\n", _table_text(F.lit("orders"), known)).alias("section")
    )


def write_supplier_dump(spark, folder: str) -> str:
    """Write a dump with a table per supplier, of 1 to 12 columns, and return where."""
    key = F.col("s_suppkey")
    columns = F.transform(F.sequence(F.lit(1), (key % 12 + 1).cast("int")), lambda i: F.concat(F.lit("c"), i))
    database = F.when(key % 2 == 0, text("`shop_", F.col("s_nationkey"), "`")).otherwise(text("shop_", F.col("s_nationkey")))
    path = shared_folder(spark, "dump")
    table(spark, folder, "supplier", "s_suppkey", "s_nationkey").select(
        text("USE ", database, ";\n\n", _table_text(text("t", key), columns)).alias("value")
    ).write.text(path)
    return path
