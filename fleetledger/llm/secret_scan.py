"""Secrets in texts, found by one automaton for all rules in one pass over the bytes.

``Scanner.flags`` runs the searching automaton over many stretches of text at once: a stretch
ends after a byte that brings every state back to the start, so no match crosses its end, and
the states of all stretches advance together, a byte a step.  Long stretches are cut into blocks that
are run from the start state at once, and again from the state the block before them ends in, until that is the
state they were run from.  Only stretches in which a rule
has a match are looked at again: the rule's own anchored automaton gives leftmost, longest,
non-overlapping spans, and matches that are too short are dropped.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole;
spans of different kinds may overlap; offsets are code points, ends exclusive; repeated rows
give repeated results; other columns are left alone.  Work is per row, without a shuffle.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fleetledger.llm.rule_automaton import Automaton, Rule

#: The rules, in the order in which kinds are listed; the first three are the base (fixed values).
RULES = (
    Rule("assign", rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, least=6, group=1),
    Rule("access", rb"AKIA[A-Z0-9]+", least=20),
    Rule("hex", rb"[0-9a-f]+", least=24, search=rb"[0-9a-f]{10}"),
    Rule("private_key", rb"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", rb"AIza[A-Za-z0-9_-]+", least=39),
)
BASE = ("assign", "access", "hex")
#: Bytes of a stretch, about, and bytes that are scanned together.
STRETCH, TOGETHER = 1024, 1 << 23
#: Bytes of a block of a stretch that no byte ends, and how often blocks are run together until their states agree.
LONGEST, ROUNDS = 2048, 3


class Scanner:
    """Automata of a list of rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.search = Automaton(list(rules), searching=True)
        self.anchored = [Automaton([rule], searching=False) for rule in rules]
        self.starts = [re.compile(b"[" + re.escape(bytes(sorted(a.first_bytes()))) + b"]") for a in self.anchored]
        self.exact = [re.compile(rule.expression, rule.flags) for rule in rules]

    def flags(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rule bits of the stretches of texts that lie one after the other and end at ``ends``."""
        resets = np.flatnonzero(self.search.resets[data]) + 1
        cuts = np.searchsorted(resets, np.arange(STRETCH, len(data), STRETCH))
        stops = np.unique(np.concatenate([resets[cuts[cuts < len(resets)]], ends]))
        stops = stops[stops > 0]
        starts = np.concatenate([[0], stops[:-1]])[: len(stops)]
        if not len(stops):
            return starts, stops, np.zeros(0, np.int64)
        blocks = -(-(stops - starts) // LONGEST)
        first = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(len(stops)), blocks)
        nth = np.arange(len(owner)) - first[owner]
        begin = starts[owner] + nth * LONGEST
        end = np.minimum(begin + LONGEST, stops[owner])
        into = np.zeros(len(owner), np.int32)
        state, found = self._together(data, begin, end, into)
        for _ in range(ROUNDS):
            came = np.where(nth > 0, np.roll(state, 1), 0)
            again = np.flatnonzero(came != into)
            if not len(again):
                break
            into[again] = came[again]
            state[again], found[again] = self._together(data, begin[again], end[again], into[again])
        for k in np.flatnonzero(nth > 0):  # a match longer than some blocks: one after the other
            if state[k - 1] != into[k]:
                into[k] = state[k - 1]
                state[k], found[k] = self.search.walk(data[begin[k] : end[k]], int(into[k]))
        return starts, stops, np.bitwise_or.reduceat(found, first)

    def _together(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last state and rule bits of blocks that are entered in the states ``into``, all advanced a byte a step."""
        search = self.search
        order = np.argsort(begin - end, kind="stable")  # longest first
        at, length = begin[order], (end - begin)[order]
        state, found = into[order], np.zeros(len(order), np.int64)
        step, accepts, byte_class = search.step, search.accepts_at, search.byte_class
        alive = np.searchsorted(-length, -np.arange(length[0]), "left")
        for j, n in enumerate(alive):  # of the n blocks longer than j
            now = step[state[:n] + byte_class[data[at[:n] + j]]]
            state[:n] = now
            found[:n] |= accepts[now]
        last, bits = np.empty_like(state), np.empty_like(found)
        last[order], bits[order] = state, found
        return last, bits

    def spans(self, data: bytes, bits: int) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, of the rules in ``bits``."""
        out = []
        for k, rule in enumerate(self.rules):
            at = 0
            while bits >> k & 1 and (start := self.starts[k].search(data, at)):
                end = self.anchored[k].longest(data, start.start())
                if end < 0:
                    at = start.start() + 1
                    continue
                at = end
                size = end - start.start()
                if rule.group:  # the automaton has no groups
                    exact = self.exact[k].match(data, start.start(), end)
                    size = exact.end(rule.group) - exact.start(rule.group)
                if size >= rule.least:
                    out.append((start.start(), end, k))
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text, by start, then by the order of the rules."""
        out: list[list] = [[] for _ in texts]
        coded = [(t or "").encode() for t in texts]
        low = 0
        while low < len(coded):
            high, size = low, 0
            while high < len(coded) and (size < TOGETHER or high == low):
                size += len(coded[high])
                high += 1
            joined = b"".join(coded[low:high])
            ends = np.cumsum([len(x) for x in coded[low:high]])
            begins, stops, found = self.flags(np.frombuffer(joined, np.uint8), ends)
            hit = np.flatnonzero(found)
            for k in hit[np.argsort(begins[hit])]:
                owner = int(np.searchsorted(ends, begins[k], "right"))
                first = int(ends[owner - 1]) if owner else 0
                begin = int(begins[k])
                out[low + owner] += [(a + begin - first, b + begin - first, r) for a, b, r in self.spans(joined[begin : int(stops[k])], int(found[k]))]
            low = high
        for i, spans in enumerate(out):
            if spans:
                starts_here = np.cumsum((np.frombuffer(coded[i], np.uint8) & 0xC0) != 0x80)
                place = np.concatenate([[0], starts_here])
                out[i] = [(self.rules[r].kind, int(place[a]), int(place[b])) for a, b, r in sorted(spans, key=lambda x: (x[0], x[2]))]
        return out


@functools.lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The automata of a list of rules; made once on the driver, a few MB whatever the data."""
    return Scanner(rules)


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of (kind, start, end) of all secrets in a text column."""
    own = SparkSession.active().sparkContext.broadcast(scanner(rules))

    @F.pandas_udf("array<struct<kind string, start long, end long>>")
    def spans(values: pd.Series) -> pd.Series:
        found = own.value.scan([v if isinstance(v, str) else None for v in values])
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in found], dtype=object)

    return spans(text)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
