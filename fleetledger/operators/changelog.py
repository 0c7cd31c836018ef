"""From event text to typed row changes, SQL statements and current tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetledger.functions.literals import (
    LITERAL,
    TRAILER,
    clean_literals,
    count_of,
    literal_value,
    quote_name,
    sql_literals,
    unquote_name,
)
from fleetledger.session import stored
from fleetledger.sources.event_text import WHOLE_EVENT

# Fixed values of the text format.
HEADER = r"^#[0-9]{6} +[0-9]+:[0-9]{2}:[0-9]{2} +server id +[0-9]+ "
HEADER_TIME = "yyMMdd H:mm:ss"
STATEMENT = r"\n### (?=INSERT INTO|UPDATE |DELETE FROM)"
TARGET = r"^(?:INSERT INTO|UPDATE|DELETE FROM) (?:`((?:[^`]|``)+)`\.)?`((?:[^`]|``)+)`"
BEFORE_MARK = "\n### WHERE\n"
AFTER_MARK = "\n### SET\n"
ANY_LINE = r"\n###   @([0-9]+)=([^\n]*)"
VALUE_LINE = rf"\n###   @([0-9]+)=({LITERAL}){TRAILER}(?=\n|\z)"
VALUE_MARK = "\n###   @"
VALUE_NUMBER = VALUE_MARK + "([0-9]+)="

TEXT = "TEXT"

# Pass-through text of an event stands before or after all its row statements.
LEADING = -1
TRAILING = 2147483647

ORDER = ("file_no", "pos", "row_no")

# Copies of the names of a table: its changes are dealt out over them, as most may be of one table.
_COPIES = 32


def _header_line() -> Column:
    return F.regexp_extract("record", r"^[0-9]+\n([^\n]*)", 1)


def parse_headers(events: DataFrame) -> DataFrame:
    """Add time, server id, end position, kind and mapped table of each event's header line."""
    head = F.col("_head")
    time = F.concat_ws(
        " ", F.substring(head, 2, 6), F.regexp_extract(head, r"^#[0-9]{6} +([0-9]+:[0-9]{2}:[0-9]{2})", 1)
    )
    mapped = r"Table_map: `((?:[^`]|``)+)`\.`((?:[^`]|``)+)` mapped"
    blank = F.lit("")
    return (
        events.withColumn("_head", _header_line())
        .withColumns(
            {
                "event_time": F.when(head.rlike(HEADER), F.try_to_timestamp(time, F.lit(HEADER_TIME))),
                "server_id": F.nullif(F.regexp_extract(head, r" server id +([0-9]+)", 1), blank).cast("long"),
                "end_pos": F.nullif(F.regexp_extract(head, r" end_log_pos ([0-9]+)", 1), blank).cast("long"),
                "kind": F.nullif(F.regexp_extract(head, r"\t([A-Za-z_]+)", 1), blank),
                "map_db": unquote_name(F.nullif(F.regexp_extract(head, mapped, 1), blank)),
                "map_table": unquote_name(F.nullif(F.regexp_extract(head, mapped, 2), blank)),
            }
        )
        .drop("_head")
    )


def _is_whole() -> Column:
    # The header is within two lines; the others need not be looked at.
    return (F.col("pos") == 0) | F.substring_index("record", "\n", 2).rlike(WHOLE_EVENT)


def broken_events(events: DataFrame) -> DataFrame:
    """Pieces whose second line is not an event header: an event mark stood inside other text.

    The operators below leave them out, so either read with ``rejoin``, which puts them back, or check
    that there are none before a script or a replay is used.
    """
    return events.where(~_is_whole())


def row_statements(events: DataFrame, include_text: bool = False) -> DataFrame:
    """One row per row statement: ``file, file_no, pos, row_no, op, db, table, block, valid`` (whether its event is UTF-8).

    With ``include_text`` the pass-through text of an event comes along as rows of
    operation ``TEXT``, so that a script needs to read the events only once.
    """
    blocks = F.slice(F.split("record", STATEMENT), 2, 1 << 30)
    block = F.col("block")
    if include_text:
        numbered = F.transform(blocks, lambda b, i: F.struct(i.alias("row_no"), b.alias("block")))

        def text_piece(row_no: int, name: str) -> Column:
            piece = F.array(F.struct(F.lit(row_no).alias("row_no"), F.col(name).alias("block")))
            return F.when(F.col(name) != "", piece).otherwise(F.slice("_rows", 1, 0))

        # In the order of row_no, which an ordered script relies on.
        pieces = F.concat(text_piece(LEADING, "_lead"), F.col("_rows"), text_piece(TRAILING, "_tail"))
        cut = (
            _with_plain_text(events)
            .withColumn("_rows", numbered)
            .select("file", "file_no", "pos", F.is_valid_utf8("record").alias("valid"), F.explode(pieces).alias("p"))
            .select("file", "file_no", "pos", "valid", "p.row_no", "p.block")
        )
        is_text = ~F.col("row_no").between(0, TRAILING - 1)
    else:
        cut = events.where(F.col("record").contains("\n### ") & _is_whole()).select(
            "file", "file_no", "pos", F.is_valid_utf8("record").alias("valid"), F.posexplode(blocks).alias("row_no", "block")
        )
        is_text = F.lit(False)
    return cut.select(
        "file",
        "file_no",
        "pos",
        "row_no",
        F.when(is_text, F.lit(TEXT)).otherwise(F.substring_index(block, " ", 1)).alias("op"),
        F.when(~is_text, unquote_name(F.regexp_extract(block, TARGET, 1))).alias("db"),
        F.when(~is_text, unquote_name(F.regexp_extract(block, TARGET, 2))).alias("table"),
        "block",
        "valid",
    )


def exclude_schemas(changes: DataFrame, schemas: list[str] | DataFrame) -> DataFrame:
    """Leave out changes of the given databases: a list of names, or a table with a ``db`` column."""
    if isinstance(schemas, DataFrame):
        return changes.join(schemas.select("db").distinct(), "db", "left_anti").select(*changes.columns)
    return changes.where(F.col("db").isNull() | ~F.col("db").isin(*schemas)) if schemas else changes


def row_images(statements: DataFrame) -> DataFrame:
    """Replace ``block`` by ``before`` and ``after``, arrays of (ordinal, literal), ``well_formed`` and ``text``.

    Values are cut out together with the check of their form; only an image with a
    value that fails it is cut again without the check.  If all pass, every mark has its value, so the
    numbers are read off the marks.
    """
    if "valid" not in statements.columns:
        statements = statements.withColumn("valid", F.is_valid_utf8("block"))
    block = F.when(F.col("op") != TEXT, F.col("block")).otherwise(F.lit(""))
    before_set = F.split_part(block, F.lit(AFTER_MARK), F.lit(1))
    parts = statements.withColumns(
        {
            "_before": F.concat(F.lit("\n"), F.split_part(before_set, F.lit(BEFORE_MARK), F.lit(2))),
            "_after": F.concat(F.lit("\n"), F.split_part(block, F.lit(AFTER_MARK), F.lit(2))),
        }
    ).withColumns(
        {
            "_good_before": F.regexp_extract_all("_before", F.lit(VALUE_LINE), 2),
            "_good_after": F.regexp_extract_all("_after", F.lit(VALUE_LINE), 2),
        }
    )

    def is_good(name: str) -> Column:
        marks = count_of(F.col(f"_{name}"), VALUE_MARK)
        return F.size(f"_good_{name}") == marks

    def image(name: str) -> Column:
        lenient = _values(f"_{name}", ANY_LINE, F.regexp_extract_all(clean_literals(F.col(f"_{name}")), F.lit(ANY_LINE), 2))
        return F.when(is_good(name), _values(f"_{name}", VALUE_NUMBER, F.col(f"_good_{name}"))).otherwise(lenient)

    return (
        parts.withColumns({"before": image("before"), "after": image("after"), "well_formed": is_good("before") & is_good("after")})
        .withColumn("text", F.when(F.col("op") == TEXT, F.col("block")))
        .drop("block", "_before", "_after", "_good_before", "_good_after")
    )


def _values(part: str, number: str, literals: Column) -> Column:
    return F.arrays_zip(F.regexp_extract_all(part, F.lit(number), 1).cast("array<int>").alias("ordinal"), literals.alias("literal"))


def resolve_columns(images: DataFrame, catalog: DataFrame, small: bool = False) -> DataFrame:
    """Add column names to both images, and ``rejected``: why a change cannot be used, else NULL.

    The names of one table travel as one array, so this is one join on the table
    and neither image is taken apart.  Whether that join broadcasts is left to
    the measured size of the catalog, unless it is known to be ``small``.
    """
    names = (
        catalog.groupBy("db", "table")
        .agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "column"))).alias("_map"), F.max("ordinal").alias("_last"))
        .select(
            F.struct("db", "table").alias("_db"),
            F.sequence(F.lit(1), "_last").alias("_ordinals"),
            F.transform(F.sequence(F.lit(1), "_last"), lambda i: F.col("_map")[i]).alias("_names"),
        )
        .withColumn("_gaps", F.exists("_names", lambda n: n.isNull()))
    )
    return name_images(images, F.broadcast(names) if small else names)


def name_images(images: DataFrame, names: DataFrame, pick: Callable[[DataFrame], DataFrame] = lambda joined: joined) -> DataFrame:
    """Join ``names`` (``_db``: database and table) to both images and name their values.

    ``pick`` leaves ``_names``, ``_ordinals`` and ``_gaps`` of the version that holds for each change.
    """
    names = names.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(_COPIES - 1))))
    copy = F.pmod(F.xxhash64("pos", "row_no"), F.lit(_COPIES)).cast("int")
    # Pass-through text has no table: its rows would all meet in one task.
    spread = F.struct(F.coalesce("db", F.concat(F.lit("\0"), F.col("pos").cast("string"))), F.coalesce("table", F.lit("")))

    def complete(image: str) -> Column:
        """The image has all columns of the table, so their names apply as they stand."""
        return F.coalesce(~F.col("_gaps") & (F.col(image)["ordinal"] == F.col("_ordinals")), F.lit(False))

    def named(image: str) -> Column:
        picked = F.transform(F.col(image)["ordinal"], lambda n: F.get("_names", n - 1))
        names = F.when(complete(image), F.col("_names")).otherwise(picked)
        return F.arrays_zip(
            F.col(image)["ordinal"].alias("ordinal"), names.alias("column"), F.col(image)["literal"].alias("literal")
        )

    def unnamed(image: str) -> Column:
        return ~F.col(f"_all_{image}") & F.exists(F.col(image)["column"], lambda n: n.isNull())

    rejected = (
        F.when(F.col("op") == TEXT, F.lit(None).cast("string"))
        .when(unnamed("before") | unnamed("after"), F.lit("unknown column"))
        .when(~F.col("well_formed"), F.lit("malformed value"))
        .when(~F.col("valid"), F.lit("bytes that are no text"))
        .when((F.col("op") != "INSERT") & (F.size("before") == 0), F.lit("missing image"))
        .when((F.col("op") != "DELETE") & (F.size("after") == 0), F.lit("missing image"))
    )
    return (
        pick(images.join(names, (spread == F.col("_db")) & (copy == F.col("_copy")), "left"))
        .withColumns({"_all_before": complete("before"), "_all_after": complete("after")})
        .withColumns({"before": named("before"), "after": named("after")})
        .withColumn("rejected", rejected)
        .select("file", "file_no", "pos", "row_no", "op", "db", "table", "before", "after", "rejected", "text")
    )


def rejects(resolved: DataFrame) -> DataFrame:
    """Changes that cannot be used, one row per change, with the ordinals that have no name."""
    unnamed = F.filter(F.concat("before", "after"), lambda x: x["column"].isNull())
    return resolved.where(F.col("rejected").isNotNull()).select(
        "file", "file_no", "pos", "row_no", "op", "db", "table", F.col("rejected").alias("reason"),
        F.array_sort(F.array_distinct(F.transform(unnamed, lambda x: x["ordinal"]))).alias("ordinals"),
    )


def to_sql(resolved: DataFrame) -> DataFrame:
    """One complete statement per usable change: ``file, file_no, pos, row_no, sql``."""
    table = F.concat_ws(".", F.when(F.col("db") != "", quote_name(F.col("db"))), quote_name(F.col("table")))

    def listed(image: str, lines: str, mark: str, between: str) -> Column:
        values = F.split(sql_literals(F.col(lines)), "\n")
        return F.array_join(
            F.zip_with(F.col(image)["column"], values, lambda name, value: F.concat(quote_name(name), F.lit(mark), value)),
            between,
        )

    nothing = F.lit("")
    verb = (
        F.when(F.col("op") == "INSERT", F.lit("INSERT INTO "))
        .when(F.col("op") == "UPDATE", F.lit("UPDATE "))
        .otherwise(F.lit("DELETE FROM "))
    )
    sets = F.when(F.col("op") == "DELETE", nothing).otherwise(F.concat(F.lit(" SET "), listed("after", "_new", "=", ",")))
    wheres = F.when(F.col("op") == "INSERT", nothing).otherwise(
        F.concat(F.lit(" WHERE "), listed("before", "_old", "<=>", " AND "))
    )
    sql = F.when(F.col("op") == TEXT, F.col("text")).otherwise(F.concat(verb, table, sets, wheres))
    return (
        resolved.where(F.col("rejected").isNull())
        .withColumns({f"_{age}": F.array_join(F.col(image)["literal"], "\n") for age, image in (("old", "before"), ("new", "after"))})
        .select("file", "file_no", "pos", "row_no", sql.alias("sql"))
    )


def _with_plain_text(events: DataFrame) -> DataFrame:
    """Whole events with ``_lead`` and ``_tail``: lines that are not comments, before and after the row statements."""
    head = F.substring_index("record", "\n### ", 1)
    # The first line of an event is its position.
    first_break = F.instr("_head", "\n")
    body = F.when(F.col("pos") == 0, F.col("_head")).when(first_break > 0, F.substring("_head", first_break + 1, F.length("_head")))
    rest = F.when(F.length("_head") < F.length("record"), F.substring("record", F.length("_head") + 2, F.length("record")))

    def plain(name: str) -> Column:
        lines = F.col(name)
        kept = F.regexp_replace(lines, r"(?m)^#[^\n]*(?:\n|$)", "")
        comments = count_of(lines, "\n#") + lines.startswith("#").cast("int")
        only_comments = comments == count_of(lines, "\n") + 1
        return F.when(lines.isNull() | only_comments, F.lit("")).otherwise(
            F.regexp_replace(kept, r"\n+$|(?<=\n)\n+|^\n+", "")
        )

    return (
        events.where(_is_whole())
        .withColumn("_head", head)
        .withColumns({"_body": F.coalesce(body, F.lit("")), "_rest": rest})
        .withColumns({"_lead": plain("_body"), "_tail": plain("_rest")})
        .drop("_head", "_body", "_rest")
    )


def pass_through(events: DataFrame) -> DataFrame:
    """Lines that are not comments (definitions, BEGIN/COMMIT, delimiters), in statement form."""
    parts = F.array(
        F.struct(F.lit(LEADING).alias("row_no"), F.col("_lead").alias("sql")),
        F.struct(F.lit(TRAILING).alias("row_no"), F.col("_tail").alias("sql")),
    )
    return (
        _with_plain_text(events)
        .select("file", "file_no", "pos", F.explode(parts).alias("p"))
        .select("file", "file_no", "pos", "p.row_no", "p.sql")
        .where(F.col("sql") != "")
    )


def statements(events: DataFrame, catalog: DataFrame, exclude=(), include_ddl: bool = True, small_catalog: bool = False) -> DataFrame:
    """Row statements and, if wanted, pass-through text, from one pass over the events."""
    changes = exclude_schemas(row_statements(events, include_text=include_ddl), exclude)
    return to_sql(resolve_columns(row_images(changes), catalog, small_catalog))


#: Columns of a catalog (under 200 bytes each) that are broadcast for a script.
SMALL_CATALOG = 200_000


def write_log_script(events: DataFrame, catalog: DataFrame, path: str, exclude: tuple[str, ...] = (), include_ddl: bool = True) -> None:
    """Write the script of a log as text in log order; part files follow each other in name order.

    The raw events are sorted, so only their places are sampled, and every event is parsed once, where it lies.
    That needs a catalog that can be broadcast; with a larger one the finished statements are sorted.
    """
    if catalog.limit(SMALL_CATALOG + 1).count() > SMALL_CATALOG:
        return write_script(statements(events, catalog, exclude, include_ddl), path, include_ddl)
    place = ("file_no", "file", "pos")
    ordered = events.repartitionByRange(*place).sortWithinPartitions(*place)
    _script_text(statements(ordered, catalog, exclude, include_ddl, small_catalog=True), include_ddl).write.text(path)


def write_script(script: DataFrame, path: str, include_ddl: bool = True) -> None:
    """Write finished statements in log order as text; part files follow each other in name order."""
    _script_text(script.orderBy("file_no", "file", "pos", "row_no"), include_ddl).write.text(path)


def _script_text(script: DataFrame, include_ddl: bool) -> DataFrame:
    end = F.lit("\n/*!*/;" if include_ddl else ";")
    is_row = F.col("row_no").between(0, TRAILING - 1)
    text = F.when(is_row, F.concat("sql", end)).otherwise(F.col("sql"))
    return script.select(text.alias("value"))


def _converted(text: Column, kind: T.DataType) -> Column:
    """The value of a literal's text as ``kind``; NULL where it is none."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # A TIMESTAMP is printed as seconds since 1970.
        seconds = F.timestamp_micros((text.try_cast("decimal(20,6)") * 1000000).cast("long"))
        return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), seconds.cast(kind)).otherwise(text.try_cast(kind))
    if isinstance(kind, T.DateType):
        return F.replace(text, F.lit(":"), F.lit("-")).try_cast(kind)  # printed with colons
    if isinstance(kind, T.BinaryType):
        return text.cast(kind)
    if isinstance(kind, T.StringType):
        return F.when(F.is_valid_utf8(text), text)
    return text.try_cast(kind)


def _typed(resolved: DataFrame, db: str, table: str, schema: T.StructType) -> DataFrame:
    """Changes of one table with typed images, ``have`` and the columns whose value does not fit (``wrong``)."""
    rows = resolved.where((F.col("db") == db) & (F.col("table") == table) & F.col("rejected").isNull())

    def texts(image: str) -> Column:
        return F.map_from_entries(F.transform(image, lambda x: F.struct(x["column"], literal_value(x["literal"])))).alias(f"_{image}")

    # Texts are made once: what a generator gives is not written out again for every column that uses it.
    rows = rows.select("*", F.explode(F.array(F.struct(texts("before"), texts("after")))).alias("_texts")).select("*", "_texts.*")

    def text(image: str, name: str) -> Column:
        return F.try_element_at(f"_{image}", F.lit(name))

    def has(image: str, name: str) -> Column:
        return F.map_contains_key(f"_{image}", F.lit(name))

    update, fields = F.col("op") == "UPDATE", schema.fields
    before = F.struct(*[_converted(text("before", f.name), f.dataType).alias(f.name) for f in fields])
    # What an update's new image does not name has the value of the old image.
    new = [F.when(has("after", f.name) | ~update, text("after", f.name)).otherwise(text("before", f.name)) for f in fields]
    after = F.struct(*[_converted(t, f.dataType).alias(f.name) for t, f in zip(new, fields)])
    have = F.array(*[~update | has("after", f.name) | has("before", f.name) for f in fields])

    def wrong(f: T.StructField, t: Column) -> Column:
        return F.when(t.isNotNull() & _converted(t, f.dataType).isNull(), F.lit(f.name))

    bad = F.array_compact(F.array_distinct(F.array(*[wrong(f, text(i, f.name)) for f in fields for i in ("before", "after")])))
    return rows.withColumns(
        {"_old": F.when(F.size("before") > 0, before), "_new": F.when(F.size("after") > 0, after), "have": have, "wrong": bad}
    )


def typed_changes(resolved: DataFrame, db: str, table: str, schema: T.StructType) -> DataFrame:
    """Changes of one table with ``before`` and ``after`` as typed rows (NULL where an image is absent).

    ``have`` tells for each column of ``schema`` whether an update's images name it: the others keep what the
    row holds.  Changes with a value that does not fit its column are left out; :func:`value_rejects` has them.
    """
    good = _typed(resolved, db, table, schema).where(F.size("wrong") == 0)
    return good.select("file", *ORDER, "op", F.col("_old").alias("before"), F.col("_new").alias("after"), "have")


def value_rejects(resolved: DataFrame, db: str, table: str, schema: T.StructType) -> DataFrame:
    """Changes that :func:`typed_changes` leaves out, with the columns whose value does not fit."""
    return _typed(resolved, db, table, schema).where(F.size("wrong") > 0).select("file", *ORDER, "op", F.col("wrong").alias("columns"))


def log_order(changes: DataFrame) -> tuple[str, ...]:
    """Columns that order changes: files without a number come first, in order of their names."""
    return ("file_no", "file", "pos", "row_no") if "file" in changes.columns else ORDER


def _position(changes: DataFrame, order: tuple[str, ...], step: int) -> Column:
    kinds = dict(changes.dtypes)
    parts = [(F.col(o) if kinds[o] == "string" else F.col(o).cast("long")).alias(o) for o in order]
    return F.struct(F.lit(1).alias("rank"), *parts, F.lit(step).alias("step"))


def _same_key(keys: list[str]) -> Column:
    same = reduce(lambda a, b: a & b, [F.col("before")[k].eqNullSafe(F.col("after")[k]) for k in keys])
    return same | F.col("before").isNull()


def _moves_unnamed(keys: list[str]) -> Column:
    """Updates that change the key and do not name all columns."""
    return (F.col("op") == "UPDATE") & ~_same_key(keys) & ~F.forall("have", lambda h: h)


def key_rejects(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Key changes that cannot be applied, as they do not name all columns, with the old and the new key."""
    bad = changes.where(_moves_unnamed(keys))
    ends = [F.struct(*[F.col(i)[k].alias(k) for k in keys]).alias(n) for i, n in (("before", "old_key"), ("after", "new_key"))]
    return bad.select(*log_order(changes), *ends)


def keyed_images(changes: DataFrame, keys: list[str], order: tuple[str, ...] | None = None) -> DataFrame:
    """Per change: the key it leaves behind as a tombstone and the key it writes.

    Result: the key columns, ``at`` (log position) and ``row`` (NULL for a tombstone); where changes have ``have``,
    ``live`` and ``cells`` instead of ``row``: each column's value with the position it is from.  A key-changing
    update gives both, the tombstone first; one that does not name all columns is left out (:func:`key_rejects` has
    it), as the row it moves is held under another key.
    """
    order = order or log_order(changes)
    partial, names = "have" in changes.columns, changes.schema["after"].dataType.names
    if partial:
        changes = changes.where(~_moves_unnamed(keys))

    def version(image: str, live: bool, step: int) -> Column:
        at = _position(changes, order, step)
        held = [F.col(image)[k].alias(k) for k in keys] + [at.alias("at")]
        if not partial:
            row = F.col(image) if live else F.when(F.lit(False), F.col(image))
            return F.struct(*held, row.alias("row"))
        cells = [
            F.when(F.col("have")[i] | F.lit(not live), F.struct(at.alias("at"), (F.col(image)[c] if live else F.when(F.lit(False), F.col(image)[c])).alias("v"))).alias(c)
            for i, c in enumerate(names)
        ]
        return F.struct(*held, F.lit(live).alias("live"), F.struct(*cells).alias("cells"))

    moved = F.array(version("before", False, 0), version("after", True, 1))
    versions = (
        F.when(F.col("op") == "DELETE", F.array(version("before", False, 0)))
        .when((F.col("op") == "INSERT") | _same_key(keys), F.array(version("after", True, 1)))
        .otherwise(moved)
    )
    return changes.select(F.explode(versions).alias("v")).select("v.*")


def fold_images(images: DataFrame, keys: list[str]) -> DataFrame:
    """Newest image of every key, tombstones included.

    ``max_by`` combines on the map side, so a key with many changes sends one row
    per task.  Where images are cells, the newest of every column counts.
    """
    if "cells" not in images.columns:
        return images.groupBy(*keys).agg(F.max_by(F.struct("at", "row"), "at").alias("v")).select(*keys, "v.at", "v.row")
    names = images.schema["cells"].dataType.names
    newest = [F.max_by(F.col("cells")[c], F.col("cells")[c]["at"]).alias(f"_{i}") for i, c in enumerate(names)]
    folded = images.groupBy(*keys).agg(F.max_by(F.struct("at", "live"), "at").alias("v"), *newest)
    return folded.select(*keys, "v.at", "v.live", F.struct(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)]).alias("cells"))


def live_rows(images: DataFrame) -> DataFrame:
    """Rows of folded images that are not tombstones."""
    if "cells" not in images.columns:
        return images.where(F.col("row").isNotNull()).select("row.*")
    names = images.schema["cells"].dataType.names
    return images.where("live").select(*[F.col("cells")[c]["v"].alias(c) for c in names])


def apply_changes(
    base: DataFrame | None, changes: DataFrame, keys: list[str], order: tuple[str, ...] | None = None
) -> DataFrame:
    """The table after all changes: the last image of each key wins, deleted keys drop out.

    The changes alone are folded; rows of ``base`` that none of them touches are kept by an anti-join, and
    only where images name part of the columns is the row that ``base`` holds looked up.  Then the folded changes are
    stored first, so the log is read once; rows with a column that neither a change nor ``base`` tells are left out,
    :func:`incomplete_rows` has them.
    """
    folded = fold_images(keyed_images(changes, keys, order), keys)
    if "cells" not in folded.columns:
        if base is None:
            return live_rows(folded)
        touched = folded.select(*[F.col(k).alias(f"_{k}") for k in keys])
        rows = live_rows(folded)
        return base.join(touched, _same_names(keys), "left_anti").select(*rows.columns).unionByName(rows)
    folded = stored(folded, "folded")
    merged, names = _merged(base, folded, keys), folded.schema["cells"].dataType.names
    now = merged.where("_known").select(*names)
    if base is None:
        return now
    touched = folded.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return base.join(touched, _same_names(keys), "left_anti").select(*names).unionByName(now)


def incomplete_rows(base: DataFrame | None, changes: DataFrame, keys: list[str], order: tuple[str, ...] | None = None) -> DataFrame:
    """Keys of rows that :func:`apply_changes` leaves out: changes name part of a row that nothing holds, with the columns nobody tells."""
    folded = stored(fold_images(keyed_images(changes, keys, order), keys), "folded")
    return _merged(base, folded, keys).where("not _known").select(*keys, F.col("_unknown").alias("columns"))


def _same_names(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def _merged(base: DataFrame | None, folded: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows of folded cells over the rows of ``base``, ``_unknown`` columns and whether there are none (``_known``)."""
    names = folded.schema["cells"].dataType.names
    live = folded.where("live").select(*[F.col(k).alias(f"_{k}") for k in keys], "cells")
    if base is None:
        joined = live.select("*", *[F.lit(None).alias(c) for c in names], F.lit(None).cast("boolean").alias("_held"))
    else:
        joined = live.join(base.select(*names).withColumn("_held", F.lit(True)), _same_names(keys), "left")
    held = F.coalesce("_held", F.lit(False))
    # A tombstone ends what was held before; what a later change does not name is not told by anybody.
    told = lambda c: F.when(F.col("cells")[c].isNull(), held).otherwise(F.col("cells")[c]["at"]["step"] == 1)
    unknown = F.array_compact(F.array(*[F.when(~told(c), F.lit(c)) for c in names]))
    value = lambda c: F.when(F.col("cells")[c].isNotNull(), F.col("cells")[c]["v"]).otherwise(F.col(c)).alias(c)
    keyed = {k: F.col(f"_{k}").alias(k) for k in keys}
    return joined.select(*[keyed.get(c, value(c)) for c in names], unknown.alias("_unknown"), (F.size(unknown) == 0).alias("_known"))
