"""Chat formatting by incremental rendering of a template that is only called, never looked into.

A template is a function from a list of (role, text) to one string.  Successive prefixes of a
conversation are rendered; what an output has beyond the one before is the span of the turn that was
added.  An output that does not begin with the one before rewrites history: such a conversation is
reported with the number of the turn and gets no spans and no mask.  Where the text lies within its turn is
found by two more renderings, with texts that share no character.

Every prefix is rendered from the first turn on, whatever its length, and so are the probes: a template may rewrite or place a turn
by all that stands before it.  What it renders of a long conversation grows with the square of the number of turns, so ``chat_template``
keeps the escaped turns of conversations of more than ``WINDOW`` turns, and a prefix of those costs it one joining of strings.

Defined cases: turns are ordered by turn, role and text, nulls first, and repeated rows are turns of their own; null
roles and texts count as empty; rows with a null conversation form one; an empty table gives no rows; other columns are not
read.  A conversation is one string, so it must fit one task's memory, as a document must; no two conversations are
held at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Longer conversations have their escaped turns kept, and the characters kept at most.
WINDOW, KEPT = 128, 1 << 25
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``text`` without control strings: each ``<|``, with any backslashes between, gets one backslash more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _turn(role: str, text: str) -> str:
    line = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"{START}{line}\n{escape(text)}{END}\n"


class _Turns(dict):
    """Formatted turns by role and text, KEPT characters at most."""

    size = 0

    def __missing__(self, turn: tuple[str, str]) -> str:
        made = _turn(*turn)
        if self.size > KEPT:
            self.clear()
            self.size = 0
        self.size += len(made)
        self[turn] = made
        return made


_kept = _Turns()


def chat_template(turns: Turns) -> str:
    """Marks of start and end around each turn; the role stands on a line of its own."""
    if len(turns) > WINDOW:
        return "".join(map(_kept.__getitem__, turns))
    return "".join(_turn(role, text) for role, text in turns)


def read_back(formatted: str) -> Turns:
    """The turns of a string that ``chat_template`` made."""
    plain = lambda role: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    turns, at = [], 0
    while at < len(formatted):
        line, end = formatted.find("\n", at), formatted.find(END + "\n", at)
        if not formatted.startswith(START, at) or not 0 <= line < end:
            raise ValueError(f"no turn at {at}")
        turns.append((plain(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[:half] == b[:half] else (low, half - 1)
    return low


def render(template: Template, turns: Turns, masked: frozenset[str] = frozenset({"assistant"})) -> dict:
    """formatted, spans (start, end of each turn), mask (start, end of each text to learn from) and rewritten_at."""
    before, spans, mask = template([]), [], []
    for k, (role, _) in enumerate(turns):
        after = template(turns[: k + 1])
        if not after.startswith(before):
            return {"formatted": template(turns), "spans": [], "mask": [], "rewritten_at": k}
        if role in masked:
            a, b = (template([*turns[:k], (role, probe)]) for probe in "ab")
            shared = len(before) if a.startswith(before) and b.startswith(before) else 0
            begin = shared + _common(a[shared:], b[shared:])
            # Strings of one length that differ at ``begin`` share no end that reaches back to it.
            tail = begin if len(a) == len(b) else 0
            mask.append((begin, len(after) - _common(a[tail:][::-1], b[tail:][::-1])))
        spans.append((len(before), len(after)))
        before = after
    return {"formatted": before, "spans": spans, "mask": mask, "rewritten_at": None}


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(turns: DataFrame, template: Template = chat_template, masked: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """conv_id, formatted, spans, mask and rewritten_at of every conversation in ``turns`` (conv_id, turn, role, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for identity, members in groupby(rows(batches), key=lambda row: row[0]):
            done = render(template, [(role or "", text or "") for _, role, text in members], masked)
            pairs = {name: pa.array([[{"start": a, "end": b} for a, b in done[name]]], _SPANS) for name in ("spans", "mask")}
            yield pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([identity], pa.int64()), "formatted": [done["formatted"]], **pairs, "rewritten_at": pa.array([done["rewritten_at"]], pa.int64())}
            )

    own = turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    span = "array<struct<start long, end long>>"
    return ordered.mapInArrow(formatted, f"conv_id long, formatted string, spans {span}, mask {span}, rewritten_at long")


def digests(formatted: Column, mask: Column) -> Column:
    """Struct of n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the formatted text and its mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, masks, strict=True):
            turns = read_back(text)
            said = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            every = "".join(f"{role}\n{words}\n" for role, words in turns)
            out.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read(formatted, mask)
