"""Value literals of decoded row events: ``'text'``, numbers, ``b'01'``, ``NULL``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Only groups need to be possessive: no recursion on long strings.  Runs of one
# character class are plain, which the matcher does in a tight loop.
_QUOTED = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*+'"
_NUMBER = r"[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"
_TEMPORAL = r"-?[0-9]+[-:][0-9]+[-:][0-9]+(?:[ T][0-9]+:[0-9]+:[0-9]+)?(?:\.[0-9]+)?"
# A place where a backslash starts an escape.
_UNESCAPED = r"((?<!\\)(?:\\\\)*+)"
LITERAL = rf"(?:{_QUOTED}|{_NUMBER}|{_TEMPORAL}|b'[01]*'|NULL)"
# What may follow a literal on its line: the unsigned reading of a number, and a type comment.
TRAILER = r"(?: *\([0-9]+\))?(?: */\*[^*\n]*\*/)? *"


def clean_literals(lines: Column) -> Column:
    """Text of one literal per line without type comments and unsigned readings.

    A quoted string ends its line with a quote, so nothing inside it can match.
    """
    return F.regexp_replace(lines, r"(?m) *(?: \([0-9]+\)(?: /\*[^*\n]*\*/)?| /\*[^*\n]*\*/) *$", "")


def is_literal(literal: Column) -> Column:
    """Whether the whole text is one well-formed literal."""
    return literal.rlike(rf"^{LITERAL}$")


def literal_value(literal: Column) -> Column:
    """Text value of a literal; NULL for the NULL literal."""
    inner = F.substring(literal, F.lit(2), F.length(literal) - 2)
    text = F.when(literal.contains("\\"), _unescape(inner)).otherwise(inner)
    bits = F.conv(F.regexp_extract(literal, "^b'([01]*)'$", 1), 2, 10)
    return (
        F.when(literal.startswith("'"), text)
        .when(literal == "NULL", F.lit(None).cast("string"))
        .when(literal.startswith("b'"), bits)
        .otherwise(literal)
    )


def sql_literals(lines: Column) -> Column:
    """Literals, one per line, as they may stand in a statement.

    ``\\xNN`` escapes mean nothing in a statement: the usual one (a quote) is rewritten
    on all lines at once, any other one has its line decoded and quoted again.
    Bare dates and times are quoted.
    """
    dated = F.regexp_replace(lines, rf"(?m)^({_TEMPORAL})$", "'$1'")
    usual = F.regexp_replace(dated, rf"{_UNESCAPED}\\x27", r"$1\\'")

    def again(literal: Column) -> Column:
        inner = F.substring(literal, F.lit(2), F.length(literal) - 2)
        rare = literal.contains("\\x") & literal.rlike(rf"{_UNESCAPED}\\x[0-9a-fA-F]{{2}}")
        return F.when(rare, quote(_unescape(inner))).otherwise(literal)

    decoded = F.array_join(F.transform(F.split(usual, "\n"), again), "\n")
    return F.when(lines.contains("\\x"), decoded).otherwise(dated)


def quote(value: Column) -> Column:
    """A string value as a quoted literal."""
    escaped = value
    for plain, written in [("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"), ("\x1a", "\\Z")]:
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def unquote_name(name: Column) -> Column:
    """A back-quoted identifier's inner text, doubled back quotes reduced."""
    return F.replace(name, F.lit("``"), F.lit("`"))


def quote_name(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def _unescape(inner: Column) -> Column:
    """Undo ``\\\\``, ``\\xNN`` and ``\\c`` escapes.

    Text with escaped backslashes is first cut at them, so that a backslash inside
    a piece always starts an escape.
    """
    pieces = F.array_join(F.transform(F.split(inner, r"\\\\"), _unescape_piece), "\\")
    return F.when(inner.contains("\\\\"), pieces).otherwise(_unescape_piece(inner))


def _unescape_piece(piece: Column) -> Column:
    def after_mark(part: Column, index: Column) -> Column:
        # Bytes are put together before they are read as text: a character may be printed as several of them.
        code = F.concat(F.unhex(F.substring(part, 1, 2)), _named_escapes(F.substring(part, 3, 1 << 30)).cast("binary"))
        return F.when(index == 0, _named_escapes(part).cast("binary")).otherwise(code)

    parts = F.transform(F.split(piece, r"\\x(?=[0-9a-fA-F]{2})"), after_mark)
    marked = F.aggregate(parts, F.lit("").cast("binary"), lambda done, part: F.concat(done, part)).cast("string")
    return F.when(piece.contains("\\x"), marked).otherwise(_named_escapes(piece))


def _named_escapes(text: Column) -> Column:
    for written, plain in [("\\n", "\n"), ("\\r", "\r"), ("\\0", "\0"), ("\\t", "\t"), ("\\Z", "\x1a")]:
        text = F.replace(text, F.lit(written), F.lit(plain))
    return F.regexp_replace(text, r"\\(.)", "$1")


def count_of(text: Column, piece: str) -> Column:
    """How often ``piece`` (ASCII) occurs in ``text``."""
    rest = F.replace(text, F.lit(piece), F.lit(""))
    return ((F.octet_length(text) - F.octet_length(rest)) / len(piece)).cast("int")
