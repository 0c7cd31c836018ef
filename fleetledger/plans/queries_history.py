"""Registered queries on what holds along a log: schema versions, transactions and the versions of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.operators import changelog as C
from fleetledger.operators import transactions as X
from fleetledger.operators.continuity import log_gaps
from fleetledger.operators.row_history import as_of, row_history, write_history
from fleetledger.operators.schema_history import resolve_columns_at, schema_history
from fleetledger.plans.event_rendering import text, write_log
from fleetledger.plans.tables import table
from fleetledger.session import shared_folder
from fleetledger.sources.event_text import read_events

HEADER = "\n#170921 20:28:37 server id 1  end_log_pos 9 \t"
#: Columns of ``orders`` in four stages of its database; a fifth is unknown.
STAGES = (("id", "customer", "state", "cents"), ("id", "note", "customer", "state", "amount"), ("id", "note", "customer", "amount"), ("id", "amount"))


def _changing_log(spark, folder) -> tuple[DataFrame, DataFrame]:
    """A log of inserts in 25 databases whose table changes on the way, and the catalog before it."""
    key, n = F.col("o_orderkey"), F.col("o_custkey") % 25
    at = key * 1000 + 500
    last = F.when(n % 5 == 0, F.lit(3)).when(n % 7 == 3, F.lit(4)).otherwise(F.lit(2))
    stage = F.when(at < (n + 1) * 40_000, F.lit(0)).when(at < (n + 1) * 50_000, F.lit(1)).when(at < (n + 1) * 52_000, F.lit(2)).otherwise(last)
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    values = {"id": key.cast("string"), "customer": F.col("o_custkey").cast("string"), "state": text("'", F.col("o_orderstatus"), "'"), "cents": cents, "amount": cents, "note": text("'n", key % 7, "'")}

    def lines(names: tuple[str, ...]) -> Column:
        return text(*[p for i, c in enumerate(names, 1) for p in (f"###   @{i}=", values[c], "\n")])

    body = F.when(stage == 0, lines(STAGES[0])).when(stage == 1, lines(STAGES[1])).when(stage == 2, lines(STAGES[2])).otherwise(lines(STAGES[3]))
    inserts = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").select(
        text(at, HEADER, "Write_rows: table id 70\n### INSERT INTO `shop_", n, "`.`orders`\n### SET\n", body).alias("value")
    )
    k = F.col("n_nationkey")
    query = lambda shift, step, *said: text((k + 1) * shift * 1000 + 3 * k + step, HEADER, "Query\n", *said, "\n/*!*/;\n")
    use = text("use `shop_", k, "`/*!*/;\n")
    # The second and third statement rely on the default database of the first.
    changes = F.array(
        query(40, 0, use, "ALTER TABLE `orders` ADD COLUMN `note` varchar(20) DEFAULT 'a,(b' AFTER `id`,\n  CHANGE `cents` `amount` decimal(10,2), ADD KEY `k` (`id`,`amount`)"),
        query(50, 0, use, "CREATE TABLE `_orders_new` LIKE `orders`"),
        query(50, 1, "alter table _orders_new drop column `STATE`, modify `amount` decimal(12,2) not null"),
        query(50, 2, "RENAME TABLE `orders` TO `_orders_old`, `_orders_new` TO `orders`"),
        F.when(k % 5 == 0, query(52, 0, use, "DROP TABLE IF EXISTS `orders`\n/*!*/;\nCREATE TABLE `orders` (\n  `id` int, /* , */ `amount` decimal(10,2) COMMENT 'x, y',\n  PRIMARY KEY (`id`)\n) ENGINE=InnoDB")),
        F.when((k % 5 != 0) & (k % 7 == 3), query(52, 0, text("CREATE OR REPLACE TABLE `shop_", k, "`.orders SELECT 1 AS x"))),
    )
    made = table(spark, folder, "nation", "n_nationkey").select(F.explode(F.array_compact(changes)).alias("value"))
    events = read_events(spark, write_log(spark, inserts.unionAll(made).select(F.lit("bin.000001").alias("file"), "value")))
    names = F.array(*map(F.lit, STAGES[0]))
    catalog = table(spark, folder, "nation", "n_nationkey").select(text("shop_", k).alias("db"), F.lit("orders").alias("table"), F.posexplode(names).alias("at", "column"))
    return events, catalog.select("db", "table", (F.col("at") + 1).alias("ordinal"), "column")


def log_catalog_at(spark, folder) -> DataFrame:
    """Images named by the definitions that hold at their position."""
    events, catalog = _changing_log(spark, folder)
    found = resolve_columns_at(C.row_images(C.row_statements(events)), schema_history(events, catalog))
    entries = F.array_join(F.transform("after", lambda x: F.concat_ws("=", x["column"], x["literal"])), ";")
    return found.select("pos", "db", "rejected", F.when(F.col("rejected").isNull(), entries).alias("after_text"))


def log_schema_history(spark, folder) -> DataFrame:
    """All versions of all tables."""
    versions = schema_history(*_changing_log(spark, folder))
    return versions.select("db", "table", F.coalesce("at.pos", F.lit(-1)).alias("from_pos"), F.array_join("names", ",").alias("names"))


def _transaction_log(spark, folder) -> DataFrame:
    """Seven orders a transaction in three files; some are rolled back, some never end, and some statements stand between them."""
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders", "o_orderkey").select(
        key, (key % 3 + 1).alias("f"), F.floor(key / 21).alias("t"), (F.floor(key / 3) * 100_000 + 1000).alias("at")
    )
    rows = F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.lit("### DELETE FROM `s`.`t`\n### WHERE\n###   @1=1\n")).otherwise(F.lit("### INSERT INTO `s`.`t`\n### SET\n###   @1='COMMIT\\nBEGIN'\n" * 2))
    changes = orders.select("f", text(F.col("at"), HEADER, "Write_rows: table id 70\n", rows).alias("value"))
    of = orders.groupBy("f", "t").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    t, ends = F.col("t"), F.col("last") + 500
    end = F.when(t % 11 == 5, text(ends, HEADER, "Query\nSET TIMESTAMP=1/*!*/;\nROLLBACK\n/*!*/;\n")).when(t % 11 != 7, text(ends, HEADER, "Xid = 7\nCOMMIT/*!*/;\n"))
    more = F.array_compact(
        F.array(
            text(F.col("first") - 500, HEADER, "Query\nSET TIMESTAMP=1/*!*/;\nBEGIN\n/*!*/;\n"),
            end,
            F.when(t % 4 == 0, text(F.col("last") + 700, HEADER, "Query\nupdate t set x = 'BEGIN\n/*!*/;\n")),
        )
    )
    every = changes.unionAll(of.select("f", F.explode(more).alias("value")))
    return read_events(spark, write_log(spark, every.select(text("bin.00000", F.col("f")).alias("file"), "value")))


def log_transactions(spark, folder) -> DataFrame:
    return X.transactions(_transaction_log(spark, folder)).select("file_no", "begin_pos", "end_pos", "n_events", "n_rows", "outcome")


def log_finished(spark, folder) -> DataFrame:
    """Events that took effect."""
    return X.finished(_transaction_log(spark, folder)).select("file_no", "pos")


def log_held_back(spark, folder) -> DataFrame:
    """Events of transactions without an end."""
    return X.held_back(_transaction_log(spark, folder)).select("file_no", "pos")


def log_continuity(spark, folder) -> DataFrame:
    """200 orders a segment; events, ends of segments and whole segments are missing, some events reach into the next."""
    key = F.col("o_orderkey")
    number, place = F.floor(key / 200) + 1, key % 200
    pos = place * 100 + 4
    end = pos + F.when(key % 41 == 7, F.lit(150)).otherwise(F.lit(100))
    kind = F.when((place == 199) & (number % 5 != 2), F.lit("Rotate to bin")).otherwise(F.lit("Xid = 1"))
    record = text(pos, "\n#170921 20:28:37 server id 1  end_log_pos ", end, " CRC32 0x1f \t", kind, "\n")
    there = table(spark, folder, "orders", "o_orderkey").where((number % 7 != 3) & (key % 37 != 5))
    log = there.select(text("bin.", F.lpad(number.cast("string"), 6, "0")).alias("file"), record.alias("value"))
    return log_gaps(read_events(spark, write_log(spark, log))).select("file_no", "kind", "from_pos", "to_pos")


def _customer_changes(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Every second customer's row, and orders as changes of them: status F deletes, every fourth names all columns, the others not the amount."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    row = F.struct(F.col("o_custkey").alias("customer"), status.alias("state"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), key.alias("orderkey"))
    op = F.when(status == "F", F.lit("DELETE")).when(key % 4 == 0, F.lit("INSERT")).otherwise(F.lit("UPDATE"))
    yes = F.lit(True)
    changes = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").select(
        (F.floor(key / 5000) + 1).alias("file_no"), key.alias("pos"), F.lit(0).alias("row_no"), op.alias("op"),
        F.when(op != "INSERT", row).alias("before"), F.when(op != "DELETE", row).alias("after"), F.array(yes, yes, key % 4 == 0, yes).alias("have"),
    )
    base = table(spark, folder, "customer", "c_custkey").where("c_custkey % 2 = 0")
    return base.select(F.col("c_custkey").alias("customer"), F.lit("N").alias("state"), F.lit(0).cast("long").alias("cents"), F.lit(-1).cast("long").alias("orderkey")), changes


def log_history(spark, folder) -> DataFrame:
    """Every version of every customer's row."""
    found = row_history(*_customer_changes(spark, folder), ["customer"], slice_rows=700, slice_bytes=100)
    return found.select("customer", "state", "cents", "orderkey", F.col("from_at.pos").alias("from_pos"), F.col("to_at.pos").alias("to_pos"))


def log_as_of(spark, folder) -> DataFrame:
    """Customers' rows as they were at a quarter of the log, at half of it and at its end."""
    path = shared_folder(spark, "history")
    write_history(*_customer_changes(spark, folder), ["customer"], path, slice_rows=700, slice_bytes=100)
    end = table(spark, folder, "orders", "o_orderkey").agg(F.max("o_orderkey")).first()[0]
    places = [end // 4, end // 2, end]
    found = [as_of(spark, path, p, file_no=p // 5000 + 1).select("customer", "state", "cents", "orderkey", F.lit(p).alias("pos")) for p in places]
    return found[0].unionAll(found[1]).unionAll(found[2])


_VERSION_SQL = """
WITH i AS (SELECT o_custkey AS customer, o_orderkey AS k, o_orderstatus AS state,
                  CASE WHEN o_orderstatus = 'F' THEN 'gone' WHEN o_orderkey % 4 = 0 THEN round(o_totalprice * 100)::BIGINT::VARCHAR END AS told FROM orders
           UNION ALL SELECT c_custkey, -1, 'N', '0' FROM customer WHERE c_custkey % 2 = 0),
h AS (SELECT *, last_value(told IGNORE NULLS) OVER (PARTITION BY customer ORDER BY k) AS held, lead(k) OVER (PARTITION BY customer ORDER BY k) AS to_pos FROM i),
v AS (SELECT customer, state, TRY_CAST(held AS BIGINT) AS cents, k AS orderkey, to_pos FROM h WHERE state <> 'F' AND held <> 'gone')
"""

_STAGE_SQL = """
WITH o AS (SELECT *, o_orderkey * 1000 + 500 AS pos, o_custkey % 25 AS n, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
s AS (SELECT *, CASE WHEN pos < (n + 1) * 40000 THEN 0 WHEN pos < (n + 1) * 50000 THEN 1 WHEN pos < (n + 1) * 52000 THEN 2
                     WHEN n % 5 = 0 THEN 3 WHEN n % 7 = 3 THEN 4 ELSE 2 END AS stage FROM o)
"""

_TRANSACTION_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS file_no, o_orderkey // 21 AS t, o_orderkey // 3 * 100000 + 1000 AS place FROM orders),
t AS (SELECT file_no, t, min(place) - 500 AS begin_pos, max(place) AS last, count(*) AS n, sum(k % 3)::BIGINT AS n_rows FROM o GROUP BY ALL),
x AS (SELECT *, CASE WHEN t % 11 = 5 THEN 'rolled back' WHEN t % 11 = 7 THEN 'unfinished' ELSE 'committed' END AS outcome,
             t % 11 = 7 AND t % 4 = 0 AS more FROM t),
e AS (SELECT o.file_no, place AS pos, outcome FROM o JOIN x USING (file_no, t)
      UNION ALL SELECT file_no, begin_pos, outcome FROM x UNION ALL SELECT file_no, last + 500, outcome FROM x WHERE outcome <> 'unfinished'
      UNION ALL SELECT file_no, last + 700, CASE WHEN more THEN outcome ELSE 'committed' END FROM x WHERE t % 4 = 0)
"""

QUERIES = {
    "log_catalog_at": (
        log_catalog_at,
        _STAGE_SQL
        + """SELECT pos, 'shop_' || n AS db, CASE WHEN stage = 4 THEN 'unknown column' END AS rejected,
               CASE stage WHEN 0 THEN 'id=' || o_orderkey || ';customer=' || o_custkey || ';state=''' || o_orderstatus || ''';cents=' || cents
                 WHEN 1 THEN 'id=' || o_orderkey || ';note=''n' || (o_orderkey % 7) || ''';customer=' || o_custkey || ';state=''' || o_orderstatus || ''';amount=' || cents
                 WHEN 2 THEN 'id=' || o_orderkey || ';note=''n' || (o_orderkey % 7) || ''';customer=' || o_custkey || ';amount=' || cents
                 WHEN 3 THEN 'id=' || o_orderkey || ';amount=' || cents END AS after_text FROM s""",
    ),
    "log_schema_history": (
        log_schema_history,
        """WITH n AS (SELECT n_nationkey AS k, 'shop_' || n_nationkey AS db FROM nation)
           SELECT db, 'orders' AS "table", -1 AS from_pos, 'id,customer,state,cents' AS names FROM n
           UNION ALL SELECT db, 'orders', (k + 1) * 40000 + 3 * k, 'id,note,customer,state,amount' FROM n
           UNION ALL SELECT db, '_orders_new', (k + 1) * 50000 + 3 * k, 'id,note,customer,state,amount' FROM n
           UNION ALL SELECT db, '_orders_new', (k + 1) * 50000 + 3 * k + 1, 'id,note,customer,amount' FROM n
           UNION ALL SELECT db, '_orders_new', (k + 1) * 50000 + 3 * k + 2, NULL FROM n
           UNION ALL SELECT db, '_orders_old', (k + 1) * 50000 + 3 * k + 2, 'id,note,customer,state,amount' FROM n
           UNION ALL SELECT db, 'orders', (k + 1) * 50000 + 3 * k + 2, 'id,note,customer,amount' FROM n
           UNION ALL SELECT db, 'orders', (k + 1) * 52000 + 3 * k, CASE WHEN k % 5 = 0 THEN 'id,amount' END FROM n WHERE k % 5 = 0 OR k % 7 = 3""",
    ),
    "log_history": (log_history, _VERSION_SQL + "SELECT customer, state, cents, orderkey, nullif(orderkey, -1) AS from_pos, to_pos FROM v"),
    "log_as_of": (
        log_as_of,
        _VERSION_SQL
        + """SELECT customer, state, cents, orderkey, pos FROM v JOIN (SELECT unnest([max(o_orderkey) // 4, max(o_orderkey) // 2, max(o_orderkey)]) AS pos FROM orders)
               ON orderkey <= pos AND (to_pos IS NULL OR to_pos > pos)""",
    ),
    "log_transactions": (
        log_transactions,
        _TRANSACTION_SQL
        + """SELECT file_no, begin_pos, last + CASE WHEN more THEN 700 WHEN outcome = 'unfinished' THEN 0 ELSE 500 END AS end_pos,
               n + 1 + (outcome <> 'unfinished')::BIGINT + more::BIGINT AS n_events, n_rows, outcome FROM x""",
    ),
    "log_finished": (log_finished, _TRANSACTION_SQL + "SELECT file_no, pos FROM e WHERE outcome = 'committed'"),
    "log_continuity": (
        log_continuity,
        """WITH e AS (SELECT o_orderkey // 200 + 1 AS file_no, o_orderkey % 200 * 100 + 4 AS pos,
                        o_orderkey % 200 * 100 + 4 + CASE WHEN o_orderkey % 41 = 7 THEN 150 ELSE 100 END AS end_pos,
                        o_orderkey % 200 = 199 AND (o_orderkey // 200 + 1) % 5 <> 2 AS rotates
                      FROM orders WHERE (o_orderkey // 200 + 1) % 7 <> 3 AND o_orderkey % 37 <> 5),
           b AS (SELECT *, lag(end_pos) OVER (PARTITION BY file_no ORDER BY pos) AS before FROM e),
           s AS (SELECT file_no, min(pos) AS first, max_by(end_pos, pos) AS ends, max_by(rotates, pos) AS rotates FROM e GROUP BY 1),
           n AS (SELECT *, lag(file_no) OVER (ORDER BY file_no) AS number, lead(file_no) OVER (ORDER BY file_no) IS NULL AS newest FROM s)
           SELECT file_no, CASE WHEN before < pos THEN 'gap' ELSE 'overlap' END AS kind, before AS from_pos, pos AS to_pos FROM b WHERE before <> pos
           UNION ALL SELECT file_no, 'head', 4, first FROM n WHERE first > 4
           UNION ALL SELECT file_no, 'tail', ends, NULL FROM n WHERE NOT newest AND NOT rotates
           UNION ALL SELECT file_no, 'segments', number + 1, file_no - 1 FROM n WHERE file_no > number + 1""",
    ),
    "log_held_back": (log_held_back, _TRANSACTION_SQL + "SELECT file_no, pos FROM e WHERE outcome = 'unfinished'"),
}
