"""Regular expressions of bytes as one minimal deterministic automaton.

Expressions of literals, sets, groups, alternatives and repeats (as ``re`` parses them) are
joined into one non-deterministic automaton.  Subset construction makes it deterministic over
classes of bytes that no rule tells apart, and partition refinement makes it minimal.  A
searching automaton starts anew at every byte: its state tells which rules have a match
that ends here.  An anchored one matches from a given place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_PARSE = re._parser.parse
_MOST_STATES = 50_000


@dataclass(frozen=True)
class Rule:
    """``least``: shorter matches are dropped (of group ``group``, 0 for the whole); ``search``: expression for the byte pass if not ``expression``."""

    kind: str
    expression: bytes
    flags: int = 0
    least: int = 0
    group: int = 0
    search: bytes = b""


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def add(self, items, flags: int, start: int) -> int:
        """Append parsed items after ``start``; the state after them."""
        for op, value in items:
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
                end = self.state()
                self.steps[start].append((_members(name, value, flags), end))
                start = end
            elif name == "SUBPATTERN":
                start = self.add(value[-1], flags, start)
            elif name == "BRANCH":
                end = self.state()
                for way in value[1]:
                    first = self.state()
                    self.empty[start].append(first)
                    self.empty[self.add(way, flags, first)].append(end)
                start = end
            elif name == "MAX_REPEAT":
                least, most, body = value
                for _ in range(least):
                    start = self.add(body, flags, start)
                if most is re._constants.MAXREPEAT:
                    around, end = self.state(), self.state()
                    self.empty[start] += [around, end]
                    self.empty[self.add(body, flags, around)] += [around, end]
                    start = end
                else:
                    end = self.state()
                    self.empty[start].append(end)
                    for _ in range(most - least):
                        start = self.add(body, flags, start)
                        self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"{name} is not supported in a rule")
        return start


def _members(name: str, value, flags: int) -> frozenset[int]:
    """Bytes of one item."""
    if name == "ANY":
        found = set(range(256)) - {10}
    elif name == "LITERAL":
        found = {value}
    elif name == "NOT_LITERAL":
        found = set(range(256)) - {value}
    else:
        found = set()
        for op, inner in value:
            if str(op) == "LITERAL":
                found.add(inner)
            elif str(op) == "RANGE":
                found.update(range(inner[0], inner[1] + 1))
            elif str(op) != "NEGATE":
                raise ValueError(f"{op} is not supported in a set")
        if str(value[0][0]) == "NEGATE":
            found = set(range(256)) - found
    if flags & re.IGNORECASE:
        found |= {ord(f) for b in found for f in (chr(b).lower(), chr(b).upper()) if b < 128 and len(f) == 1}
    return frozenset(found)


class Automaton:
    """Transition arrays: ``step[state * n_classes + byte_class[byte]]`` is the next state times n_classes."""

    def __init__(self, rules: list[Rule], searching: bool):
        nfa = _Nfa()
        start, finals = nfa.state(), {}
        for bit, rule in enumerate(rules):
            first = nfa.state()
            nfa.empty[start].append(first)
            pattern = (rule.search or rule.expression) if searching else rule.expression
            finals[nfa.add(_PARSE(pattern, rule.flags), rule.flags, first)] = 1 << bit
        sets = sorted({s for steps in nfa.steps for s, _ in steps}, key=sorted)
        marks: dict[tuple, int] = {}
        self.byte_class = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)], np.uint8)
        self.n_classes = len(marks)
        samples = [int(np.flatnonzero(self.byte_class == c)[0]) for c in range(self.n_classes)]

        def closure(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        begin = closure({start})
        numbers, order, rows = {begin: 0}, [begin], []
        for states in order:
            row = []
            for b in samples:
                after = closure({t for s in states for chars, t in nfa.steps[s] if b in chars} | ({start} if searching else set()))
                if after not in numbers:
                    numbers[after] = len(order)
                    order.append(after)
                    if len(order) > _MOST_STATES:
                        raise ValueError("these rules need too many states")
                row.append(numbers[after])
            rows.append(row)
        accepts = np.array([sum(finals.get(s, 0) for s in states) for states in order], np.int64)
        step, self.accepts = _minimal(np.array(rows, np.int64), accepts)
        self.n_states = len(step)
        self.dead = next((s for s in range(len(step)) if not self.accepts[s] and (step[s] == s).all()), -1)
        #: Bytes that lead every state back to the start: no match holds them, so texts may be cut after them.
        self.resets = (step == 0).all(axis=0)[self.byte_class]
        self.step = (step * self.n_classes).astype(np.int32).ravel()
        self.accepts_at = np.repeat(self.accepts, self.n_classes).astype(np.int64)
        self._steps = self._accepted = None  # made when a walk first needs them
        # For steps one by one from the start, which only anchored automata take.
        self._rows, self._class_list, self._accept_list = [] if searching else step.tolist(), self.byte_class.tolist(), self.accepts.tolist()

    def walk(self, data: np.ndarray, state: int) -> tuple[int, int]:
        """State and accepted bits after ``data``, entered in ``state`` (both as in ``step``)."""
        if self._steps is None:
            self._steps, self._accepted = self.step.tolist(), self.accepts_at.tolist()
        steps, accepted, bits = self._steps, self._accepted, 0
        for c in self.byte_class[data].tolist():
            state = steps[state + c]
            bits |= accepted[state]
        return state, bits

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``; -1 for none."""
        state, end, rows, classes, accepts, dead = 0, -1, self._rows, self._class_list, self._accept_list, self.dead
        for i in range(at, len(data)):
            state = rows[state][classes[data[i]]]
            if accepts[state]:
                end = i + 1
            elif state == dead:
                break
        return end

    def first_bytes(self) -> frozenset[int]:
        return frozenset(b for b in range(256) if self._rows[0][self._class_list[b]] != self.dead)


def _minimal(step: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join states that no input tells apart; the start stays state 0."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    firsts = np.unique(block, return_index=True)[1]
    order = np.argsort(firsts)  # the block of the start has the smallest first member
    renumber = np.empty(len(firsts), np.int64)
    renumber[order] = np.arange(len(firsts))
    block = renumber[block]
    firsts = firsts[order]
    return block[step[firsts]], accepts[firsts]
