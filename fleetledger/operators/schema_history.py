"""The schema catalog by log position: definitions inside the log change what the columns of later events are.

Statements that define tables are few beside the row events.  They are cut out of the log's text, taken apart into actions
(a table made, copied, renamed or dropped; a column added, dropped, renamed or moved), and folded in log order into
versions of each table.  Both take small Python functions, over those few statements alone.  Tables that took each
other's place (renamed or copied, as online schema changes do) are folded together; others are independent of each other.  Row events find their names by one join on the table, whose
versions travel as one array; no window goes over the log.

A statement whose effect on the columns is not known (``CREATE TABLE … SELECT``, a list of columns added in brackets) makes the table's
columns unknown from there on: its changes become rejects until the table is defined anew, they are never named wrongly.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.functions.literals import quote_name, unquote_name
from fleetledger.operators.changelog import name_images, pass_through
from fleetledger.operators.log_scan import last_before
from fleetledger.session import settle

# Fixed values of the statement grammar.
NAME = r"(?:`(?:[^`]|``)+`|[^\s`.,();=]+)"
TABLE_NAME = rf"{NAME}(?:\s*\.\s*{NAME})?"
DELIMITER = r"/\*!\*/;"
_DEFINES = r"(?im)^\s*(?:/\*.*?\*/\s*)?(?:use|create|alter|drop|rename)\s"
_IN = re.IGNORECASE | re.DOTALL
_LITERAL = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\"""", re.DOTALL)
_COMMENT = re.compile(r"/\*.*?\*/", re.DOTALL)
_BRACKETS = re.compile(r"\((?:[^()`]|`[^`]*`)*\)")
_COMMA = re.compile(r",(?=(?:[^`]*`[^`]*`)*[^`]*$)")
_NO_COLUMN = re.compile(r"(?:PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|FOREIGN|CHECK|FULLTEXT|SPATIAL|PERIOD|PARTITION|SYSTEM)\b", _IN)
_CREATE = re.compile(rf"CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?({TABLE_NAME})\s*(.*)", _IN)
_LIKE = re.compile(rf"\(?\s*LIKE\s+({TABLE_NAME})", _IN)
_SELECT = re.compile(r"\bSELECT\b", _IN)
_ALTER = re.compile(rf"ALTER\s+(?:ONLINE\s+|OFFLINE\s+|IGNORE\s+)*TABLE\s+({TABLE_NAME})\s*(.*)", _IN)
_DROP = re.compile(r"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(.*?)(?:\s+(?:RESTRICT|CASCADE))?", _IN)
_DROP_ALL = re.compile(rf"DROP\s+(?:DATABASE|SCHEMA)\s+(?:IF\s+EXISTS\s+)?({NAME})", _IN)
_RENAMES, _RENAMED = re.compile(r"RENAME\s+TABLES?\s+(.*)", _IN), re.compile(rf"({TABLE_NAME})\s+TO\s+({TABLE_NAME})", _IN)
_ADD = re.compile(r"ADD\b(?:\s+COLUMN\b)?(?:\s+IF\s+NOT\s+EXISTS\b)?\s*(.*)", _IN)
_CUT = re.compile(r"DROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?(.*)", _IN)
_CHANGE = re.compile(rf"CHANGE\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?({NAME})\s+({NAME})", _IN)
_MODIFY = re.compile(rf"MODIFY\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?({NAME})", _IN)
_RENAME_COLUMN = re.compile(rf"RENAME\s+COLUMN\s+({NAME})\s+TO\s+({NAME})", _IN)
_RENAME_KEY = re.compile(r"RENAME\s+(?:INDEX|KEY)\b", _IN)
_RENAME = re.compile(rf"RENAME\s+(?:TO\s+|AS\s+|=\s*)?({TABLE_NAME})", _IN)
_PLACE = re.compile(rf"\s(?:FIRST|AFTER\s+({NAME}))\s*$", _IN)
_FIRST = re.compile(NAME)

_FIELDS = ("op", "table", "source", "column", "renamed", "place", "columns")
_ACTION = "struct<op:string,`table`:string,source:string,`column`:string,renamed:string,place:string,columns:array<string>>"
_ACTION_ARROW = pa.struct([*[(n, pa.string()) for n in _FIELDS[:-1]], (_FIELDS[-1], pa.list_(pa.string()))])
_VERSION = pa.schema([("table", pa.string()), ("rank", pa.int32()), ("file_no", pa.int64()), ("file", pa.string()), ("pos", pa.int64()), ("names", pa.list_(pa.string()))])
_VERSION_DDL = "`table` string, rank int, file_no long, file string, pos long, names array<string>"


def _flat(text: str) -> str:
    """Text without what stands in brackets."""
    while (inner := _BRACKETS.sub("", text)) != text:
        text = inner
    return text


def _items(text: str) -> list[str]:
    """Parts between commas that are not inside a quoted name."""
    return [x.strip() for x in _COMMA.split(text)]


def _bare(name: str) -> str:
    return name[1:-1].replace("``", "`") if name.startswith("`") else name


def _name_at(text: str) -> str:
    found = _FIRST.match(text)
    return _bare(found[0]) if found else ""


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _key(name: str, db: str | None) -> str:
    """Database and table of a possibly qualified name, both quoted, as one text."""
    parts = [_bare(x) for x in _FIRST.findall(name)]
    return f"{_quoted(parts[0] if len(parts) > 1 else db or '')}.{_quoted(parts[-1])}"


def _alteration(item: str, table: str, db: str | None) -> dict | None:
    """The action of one item of an ALTER TABLE; None if it leaves the columns alone."""
    told = _PLACE.search(item)
    place = {"place": _bare(told[1]) if told[1] else ""} if told else {}
    if found := _ADD.match(item):
        if not found[1]:
            return {"op": "lost", "table": table}  # columns in brackets
        return None if _NO_COLUMN.match(found[1]) else {"op": "add", "table": table, "renamed": _name_at(found[1]), **place}
    if found := _CUT.match(item):
        return None if _NO_COLUMN.match(found[1]) else {"op": "cut", "table": table, "column": _name_at(found[1])}
    if found := _CHANGE.match(item):
        return {"op": "change", "table": table, "column": _bare(found[1]), "renamed": _bare(found[2]), **place}
    if found := _MODIFY.match(item):
        return {"op": "change", "table": table, "column": _bare(found[1]), "renamed": _bare(found[1]), **place}
    if found := _RENAME_COLUMN.match(item):
        return {"op": "change", "table": table, "column": _bare(found[1]), "renamed": _bare(found[2])}
    if not _RENAME_KEY.match(item) and (found := _RENAME.fullmatch(item)):
        return {"op": "rename", "table": _key(found[1], db), "source": table}
    return None


def statement_actions(statement: str, db: str | None) -> list[dict]:
    """What one statement, with this default database, does to the columns of tables."""
    text = " ".join(_COMMENT.sub(" ", _LITERAL.sub("''", statement)).split()).removesuffix(";").strip()
    if found := _CREATE.fullmatch(text):
        table, rest, new = _key(found[2], db), found[3], " new" if found[1] else ""
        if like := _LIKE.match(rest):
            return [{"op": "like" + new, "table": table, "source": _key(like[1], db)}]
        body = _flat("\0" + rest[1:]) if rest.startswith("(") else ""
        lines = [x for x in _items(body[1:].split(")", 1)[0]) if x and not _NO_COLUMN.match(x)]
        known = lines and not _SELECT.search(re.sub("`[^`]*`", "", rest))
        return [{"op": "create" + new, "table": table, "columns": [_name_at(x) for x in lines] if known else None}]
    if found := _ALTER.fullmatch(text):
        made = [_alteration(x, _key(found[1], db), db) for x in _items(_flat(found[2]))]
        return [x for x in made if x]
    if found := _DROP.fullmatch(text):
        return [{"op": "drop", "table": _key(x, db)} for x in _items(found[1]) if x]
    if found := _DROP_ALL.fullmatch(text):
        return [{"op": "drop all", "table": _quoted(_bare(found[1])) + "."}]
    if found := _RENAMES.fullmatch(text):
        pairs = [_RENAMED.fullmatch(x) for x in _items(found[1])]
        return [{"op": "rename", "table": _key(x[2], db), "source": _key(x[1], db)} for x in pairs if x]
    return []


def _actions_column(statement: Column, db: Column) -> Column:
    @F.arrow_udf(f"array<{_ACTION}>")
    def actions(statements: pa.Array, databases: pa.Array) -> pa.Array:
        found = [statement_actions(s, d) for s, d in zip(statements.to_pylist(), databases.to_pylist(), strict=True)]
        return pa.array([[{n: x.get(n) for n in _FIELDS} for x in xs] for xs in found], pa.list_(_ACTION_ARROW))

    return actions(statement, db)


def definitions(events: DataFrame, slice_bytes: int | None = None) -> DataFrame:
    """``file, file_no, pos, no`` and one ``action`` for each step of each defining statement in the log's text.

    A statement's default database is the one of the last ``use`` before it in its file.
    """
    # Row events define nothing, and most of the others neither: their text is not taken apart.
    likely = pass_through(events.where(~F.col("record").contains("\n### ") & F.col("record").rlike(_DEFINES))).where(F.col("sql").rlike(_DEFINES))
    cut = likely.select("file", "file_no", "pos", "row_no", F.posexplode(F.split("sql", DELIMITER)).alias("at", "statement"))
    numbered = cut.select("file", "file_no", "pos", (F.col("row_no").cast("long") * 1_000_000 + F.col("at")).alias("no"), F.trim("statement", F.lit(" \n")).alias("statement"))
    use = F.nullif(F.regexp_extract("statement", rf"(?is)^use\s+({NAME})\s*;?$", 1), F.lit(""))
    stood = last_before(settle(numbered), use, "_use", ("pos", "no"), slice_bytes)
    bare = F.when(F.col("_use").startswith("`"), unquote_name(F.substring("_use", F.lit(2), F.length("_use") - 2))).otherwise(F.col("_use"))
    steps = stood.select("file", "file_no", "pos", "no", F.posexplode(_actions_column(F.col("statement"), bare)).alias("_step", "action"))
    return steps.select("file", "file_no", "pos", (F.col("no") * 1000 + F.col("_step")).alias("no"), "action")


def _families(pairs: DataFrame) -> DataFrame:
    """``table, family`` of tables that are linked by ``pairs`` (a, b): the smallest name that can be reached."""
    both = settle(pairs.union(pairs.select("b", "a")).distinct())
    found = settle(both.select(F.col("a").alias("table")).distinct().withColumn("family", F.col("table")))
    while True:
        near = both.join(found, F.col("b") == F.col("table")).groupBy("a").agg(F.min("family").alias("_near"))
        joined = settle(found.join(near, F.col("a") == F.col("table"), "left").select("table", "family", "_near"))
        if not joined.where("_near < family").limit(1).count():
            return found
        found = joined.select("table", F.least("family", "_near").alias("family"))


def _placed(columns: list[str | None], name: str, place: str | None) -> list[str | None] | None:
    """``columns`` with ``name`` at the end, first (an empty place) or after the column ``place``; None if there is none."""
    lowered = [(c or "").lower() for c in columns]
    if place and place.lower() not in lowered:
        return None
    at = len(columns) if place is None else lowered.index(place.lower()) + 1 if place else 0
    return [*columns[:at], name, *columns[at:]]


def _altered(columns: list[str | None] | None, step: dict) -> list[str | None] | None:
    """A table's columns after one action on them; None where they are unknown."""
    if columns is None or step["op"] == "lost":
        return None
    lowered, sought = [(c or "").lower() for c in columns], (step["column"] or "").lower()
    if step["op"] == "add":
        return columns if step["renamed"].lower() in lowered else _placed(columns, step["renamed"], step["place"])
    if sought not in lowered:
        return columns if step["op"] == "cut" else None
    at = lowered.index(sought)
    rest = columns[:at] + columns[at + 1 :]
    if step["op"] == "cut":
        return rest
    return [*columns[:at], step["renamed"], *columns[at + 1 :]] if step["place"] is None else _placed(rest, step["renamed"], step["place"])


def _versions(actions: pa.Table) -> pa.Table:
    """Versions that a family's actions make, one after the other; the last of each table and position."""
    held: dict[str, list[str | None] | None] = {}
    made: dict[tuple, list[str | None] | None] = {}
    before = lambda x: (x["rank"], x["file_no"] is not None, x["file_no"] or 0, x["file"] or "", x["pos"] or 0, x["no"])
    for x in sorted(actions.to_pylist(), key=before):
        place, table, op = (x["rank"], x["file_no"], x["file"], x["pos"]), x["table"], x["op"]
        if op in ("create new", "like new") and table in held:
            continue
        if op == "drop":
            if table in held:
                del held[table]
                made[place, table] = None
            continue
        if op in ("create", "create new"):
            names = x["columns"]
        elif op in ("like", "like new"):
            names = held.get(x["source"])
        elif op == "rename":
            if x["source"] in held:
                made[place, x["source"]] = None
            names = held.pop(x["source"], None)
        else:
            names = _altered(held.get(table), x)
        held[table] = made[place, table] = names
    rows = [{"table": t, "rank": r, "file_no": n, "file": f, "pos": p, "names": names} for ((r, n, f, p), t), names in made.items()]
    return pa.Table.from_pylist(rows, schema=_VERSION)


def schema_history(events: DataFrame, catalog: DataFrame, slice_bytes: int | None = None) -> DataFrame:
    """``db, table, at, names``: the columns of every table from a log position on; NULL where they are unknown or the table is gone.

    ``catalog`` (``db, table, ordinal, column``) holds before the log.  ``at`` is comparable with :func:`position`.
    """
    # The gaps of a catalog stay gaps.
    entries = F.map_from_entries(F.collect_list(F.struct("ordinal", "column")))
    first = catalog.groupBy("db", "table").agg(entries.alias("_m"), F.max("ordinal").alias("_last"))
    names = F.transform(F.sequence(F.lit(1), F.col("_last").cast("int")), lambda i: F.try_element_at("_m", i))
    key = F.concat(quote_name(F.col("db")), F.lit("."), quote_name(F.col("table")))
    absent = {n: F.lit(None).cast("string") for n in _FIELDS}

    def action(op: str, **given: Column) -> Column:
        parts = absent | {"op": F.lit(op), "columns": F.lit(None).cast("array<string>")} | given
        return F.struct(*[parts[n].alias(n) for n in _FIELDS]).alias("x")

    nowhere = position(0, F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("long"))
    before = first.select(nowhere.alias("at"), F.lit(0).cast("long").alias("no"), action("create", table=key, columns=names))
    steps = settle(definitions(events, slice_bytes).select(position().alias("at"), "no", F.col("action").alias("x")))
    # A dropped database ends the tables it has then, whatever family they are of.
    every = settle(before.union(steps).where("x.table is not null"))
    database = F.regexp_extract("x.table", r"^(`(?:[^`]|``)*`\.)", 1)
    tables = every.where("x.op <> 'drop all'").select(database.alias("_db"), F.col("x.table").alias("_t")).distinct()
    ended = every.where("x.op = 'drop all'").join(tables, F.col("x.table") == F.col("_db")).select("at", "no", action("drop", table=F.col("_t")))
    single = every.where("x.op <> 'drop all'").union(ended)
    families = _families(single.where("x.source is not null").select(F.col("x.table").alias("a"), F.col("x.source").alias("b")))
    of_family = single.join(families, F.col("x.table") == F.col("table"), "left").withColumn("family", F.coalesce("family", "x.table"))
    flat = of_family.select("family", "at.*", "no", "x.*")
    newest = flat.groupBy("family").applyInArrow(lambda actions: _versions(actions), _VERSION_DDL)
    part = lambda n: unquote_name(F.regexp_extract("table", r"^`((?:[^`]|``)*)`\.`((?:[^`]|``)*)`$", n))
    at = F.struct("rank", "file_no", "file", "pos").alias("at")
    return newest.select(part(1).alias("db"), part(2).alias("table"), at, "names")


def position(rank: int = 1, file_no: Column | None = None, file: Column | None = None, pos: Column | None = None) -> Column:
    """Log position as a value that can be compared; rank 0 is before all logs."""
    given = [F.col(n) if c is None else c for n, c in (("file_no", file_no), ("file", file), ("pos", pos))]
    return F.struct(F.lit(rank).alias("rank"), *[c.alias(n) for c, n in zip(given, ("file_no", "file", "pos"))])


def resolve_columns_at(images: DataFrame, history: DataFrame) -> DataFrame:
    """As :func:`~fleetledger.operators.changelog.resolve_columns`, with the names that hold at each change's position."""
    versions = history.groupBy("db", "table").agg(F.array_sort(F.collect_list(F.struct("at", "names"))).alias("_versions"))
    held = versions.select(F.struct("db", "table").alias("_db"), "_versions")

    def at_position(joined: DataFrame) -> DataFrame:
        last = F.element_at(F.filter("_versions", lambda v: v["at"] < position()), -1)
        stood = joined.withColumn("_names", F.when(F.exists("_versions", lambda v: v["at"] < position()), last["names"]))
        return stood.withColumns({"_ordinals": F.when(F.size("_names") > 0, F.sequence(F.lit(1), F.size("_names"))), "_gaps": F.exists("_names", lambda n: n.isNull())})

    return name_images(images, held, at_position)
