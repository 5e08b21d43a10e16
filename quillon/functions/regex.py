"""A small byte regex dialect: leftmost-longest matching by a DFA built on the driver.

Literals, `.` (any byte), `[...]` with ranges and `^`, `|`, groups, `* + ? {n} {n,} {n,m}`,
and outside brackets \\d \\w \\s; every other escape is the character itself. There are no anchors,
captures or lazy forms, `{n,}` stops at 100, and an empty match never counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES, MOST_DEPTH, MOST_REPEAT, MOST_STATES = 512, 64, 100, 2048
_DIGIT = frozenset(range(48, 58))
_SETS = {ord("d"): _DIGIT, ord("w"): _DIGIT | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}, ord("s"): frozenset(b" \t\n\r\f\v")}
_ANY = frozenset(range(256))


class RegexError(ValueError):
    pass


class _Parser:
    """Recursive descent; a node is a tuple whose first entry says its kind."""

    def __init__(self, pattern: bytes) -> None:
        if len(pattern) > MOST_BYTES:
            raise RegexError("the pattern is longer than 512 bytes")
        self.text, self.at = pattern, 0

    def peek(self) -> int:
        return self.text[self.at] if self.at < len(self.text) else -1

    def take(self) -> int:
        self.at += 1
        if self.at > len(self.text):
            raise RegexError("the pattern ends too early")
        return self.text[self.at - 1]

    def whole(self) -> tuple:
        node = self.either(1)
        if self.at < len(self.text):
            raise RegexError(f"unexpected character at byte {self.at}")
        return node

    def either(self, depth: int) -> tuple:
        if depth > MOST_DEPTH:
            raise RegexError("nested too deeply")
        left = self.sequence(depth)
        if self.peek() != ord("|"):
            return left
        self.take()
        return ("or", left, self.either(depth + 1))

    def sequence(self, depth: int) -> tuple:
        parts = []
        while self.peek() not in (-1, ord("|"), ord(")")):
            parts.append(self.repeated(depth))
        return ("all", *parts)

    def repeated(self, depth: int) -> tuple:
        node = self.single(depth)
        while (c := self.peek()) in tuple(b"*+?{"):
            self.take()
            low, high = {ord("*"): (0, None), ord("+"): (1, None), ord("?"): (0, 1)}.get(c) or self.bounds()
            node = ("times", node, low, high)
        return node

    def number(self) -> int | None:
        begin = self.at
        while 48 <= self.peek() <= 57:
            self.take()
        return int(self.text[begin : self.at]) if self.at > begin else None

    def bounds(self) -> tuple[int, int]:
        low = self.number()
        high = low
        if low is None:
            raise RegexError("a repeat needs a number")
        if self.peek() == ord(","):
            self.take()
            high = self.number()
            high = MOST_REPEAT if high is None else high
        if self.peek() != ord("}"):
            raise RegexError("a repeat isn't closed")
        self.take()
        if low > high or high > MOST_REPEAT:
            raise RegexError("a repeat is out of bounds")
        return low, high

    def single(self, depth: int) -> tuple:
        c = self.take()
        if c == ord("("):
            node = self.either(depth + 1)
            if self.peek() != ord(")"):
                raise RegexError("a group isn't closed")
            self.take()
            return node
        if c == ord("["):
            return ("set", self.bracket())
        if c == ord("."):
            return ("set", _ANY)
        if c == ord("\\"):
            c = self.take()
            return ("set", _SETS.get(c, frozenset([c])))
        return ("set", frozenset([c]))

    def bracket(self) -> frozenset[int]:
        out: set[int] = set()
        negated = self.peek() == ord("^")
        if negated:
            self.take()
        while self.peek() != ord("]"):
            if self.peek() < 0:
                raise RegexError("a bracket isn't closed")
            low = self.take()
            if low == ord("\\"):
                low = self.take()
            high = low
            if self.peek() == ord("-") and self.at + 1 < len(self.text) and self.text[self.at + 1] != ord("]"):
                self.take()
                high = self.take()
                if high == ord("\\"):
                    high = self.take()
            out |= set(range(low, high + 1))
        self.take()
        return frozenset(_ANY - out if negated else out)


class _Nfa:
    """Thompson's construction: eps[s] are free moves, step[s] a byte set and its target."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def new(self) -> int:
        if len(self.eps) >= MOST_STATES:
            raise RegexError("the pattern needs too many states")
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, node: tuple, begin: int) -> int:
        """Build node from state begin; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.new()
            self.step[begin] = (node[1], end)
            return end
        if kind == "all":
            for part in node[1:]:
                here = self.new()
                self.eps[begin].append(here)
                begin = self.add(part, here)
            return begin
        if kind == "or":
            end = self.new()
            for part in node[1:]:
                here = self.new()
                self.eps[begin].append(here)
                self.eps[self.add(part, here)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            here = self.new()
            self.eps[begin].append(here)
            begin = self.add(part, here)
        if high is None:
            loop = self.new()
            self.eps[begin].append(loop)
            here, end = self.new(), self.new()
            self.eps[loop] += [here, end]
            self.eps[self.add(part, here)].append(loop)
            return end
        exits = [begin]
        for _ in range(high - low):
            here = self.new()
            self.eps[begin].append(here)
            begin = self.add(part, here)
            exits.append(begin)
        end = self.new()
        for state in exits:
            self.eps[state].append(end)
        return end


class Dfa(NamedTuple):
    table: np.ndarray  # (states, 256) int16; state 0 is dead, 1 begins
    accept: np.ndarray

    def full_match(self, text: bytes) -> bool:
        state, table = 1, self.table
        for c in text:
            state = table[state, c]
            if not state:
                return False
        return bool(self.accept[state])

    def full_matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of many texts lying at offsets in data; all take a step at once."""
        state = np.ones(len(offsets) - 1, self.table.dtype)
        size = np.diff(offsets)
        lane, step = np.flatnonzero(size), 0
        while len(lane):
            state[lane] = self.table[state[lane], data[offsets[lane] + step]]
            step += 1
            lane = lane[(state[lane] > 0) & (size[lane] > step)]
        return self.accept[state]

    def find_all(self, text: bytes) -> list[tuple[int, int]]:
        """Non-overlapping leftmost-longest matches that aren't empty, as byte spans."""
        _, begin, end = self.spans(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
        return list(zip(begin.tolist(), end.tolist()))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, begin, end) of the matches in many texts lying at offsets in data, begin and end within the text.

        Every byte that can begin a match starts a lane, and all lanes take a step at once. Of
        lanes that begin in a state like the first after one step, the earlier one stands for both. Texts
        with lanes alive after STEPS steps are searched again, one by one, in time linear in their matches.
        """
        table, accept = self.table, self.accept
        like_first = (table == table[1]).all(1) & (accept == accept[1])
        at = np.flatnonzero((table[1] > 0)[data])
        at = at[(at >= offsets[0]) & (at < offsets[-1])]
        text = np.searchsorted(offsets, at, "right") - 1
        if like_first[1:].sum() > 0 and len(at):
            stands = np.append(False, (at[1:] == at[:-1] + 1) & (text[1:] == text[:-1]) & like_first[table[1, data[at[:-1]]]])
            first = np.flatnonzero(~stands)
            tail = at[np.append(first[1:], len(at)) - 1]  # the last byte of those that a lane stands for
            at, text = at[first], text[first]
        else:
            tail = at
        end = np.full(len(at), -1, np.int64)
        lane, state, limit = np.arange(len(at)), np.ones(len(at), table.dtype), offsets[text + 1]
        for step in range(STEPS):
            if not len(lane):
                break
            state = table[state, data[at[lane] + step]]
            hit = accept[state]
            end[lane[hit]] = at[lane[hit]] + step + 1
            on = (state > 0) & (at[lane] + step + 1 < limit[lane])
            lane, state = lane[on], state[on]
        slow = np.unique(text[lane])
        found = end > 0
        if len(slow):
            found &= ~np.isin(text, slow)
        text, at, end, tail = text[found], at[found], end[found], tail[found]
        keep, last = np.ones(len(at), bool), -1
        overlap = np.flatnonzero(at[1:] < np.maximum.accumulate(end)[:-1]) if len(at) else at
        if len(overlap):
            begins, ends, tails = at.tolist(), end.tolist(), tail.tolist()
            for k in range(len(begins)):
                begins[k] = max(begins[k], last)
                if begins[k] > tails[k]:
                    keep[k] = False
                else:
                    last = ends[k]
            at = np.array(begins, np.int64)
        text, at, end = text[keep], at[keep], end[keep]
        if len(slow):
            parts = [self._linear(data[offsets[t] : offsets[t + 1]].tobytes()) for t in slow]
            text = np.append(text, np.repeat(slow, [len(x) for x in parts]))
            more = np.array([(a + offsets[t], b + offsets[t]) for t, x in zip(slow, parts, strict=True) for a, b in x], np.int64).reshape(-1, 2)
            at, end = np.append(at, more[:, 0]), np.append(end, more[:, 1])
            order = np.argsort(at)
            text, at, end = text[order], at[order], end[order]
        return text, at - offsets[text], end - offsets[text]

    def _linear(self, text: bytes) -> list[tuple[int, int]]:
        """From the end, which bytes begin a match; then only those are followed."""
        table, accept = self.table.tolist(), self.accept.tolist()
        known: dict[tuple[frozenset, int], frozenset] = {}
        good = frozenset(np.flatnonzero(self.accept).tolist())
        sets, begins = frozenset(), bytearray(len(text))
        into: dict[int, dict[int, list[int]]] = {}
        for k in range(len(text) - 1, -1, -1):
            c = text[k]
            if (sets, c) not in known:
                if c not in into:
                    into[c] = {}
                    for q in range(1, len(table)):
                        into[c].setdefault(table[q][c], []).append(q)
                known[sets, c] = frozenset(q for target in good | sets for q in into[c].get(target, ()))
            sets = known[sets, c]
            begins[k] = 1 in sets
        out, k = [], begins.find(1)
        while k >= 0:
            state, j, end = 1, k, -1
            while j < len(text):
                state = table[state][text[j]]
                if not state:
                    break
                j += 1
                if accept[state]:
                    end = j
            out.append((k, end))
            k = begins.find(1, end)
        return out


#: Steps that all lanes of a search take together.
STEPS = 64


@lru_cache(maxsize=64)
def compile_regex(pattern: str) -> Dfa:
    nfa = _Nfa()
    start = nfa.new()
    final = nfa.add(_Parser(pattern.encode()).whole(), start)

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    numbers: dict[frozenset[int], int] = {closure({start}): 1}
    rows, accept, todo = [np.zeros(256, np.int16)], [False], list(numbers)
    for states in todo:  # grows while it is walked
        accept.append(final in states)
        targets: dict[int, set[int]] = {}
        for s in states:
            if nfa.step[s]:
                for c in nfa.step[s][0]:
                    targets.setdefault(c, set()).add(nfa.step[s][1])
        row = np.zeros(256, np.int16)
        by_target: dict[frozenset[int], int] = {}
        for c, to in targets.items():
            to = frozenset(to)
            if to not in by_target:
                closed = closure(set(to))
                if closed not in numbers:
                    if len(numbers) >= MOST_STATES:
                        raise RegexError("the pattern needs too many states")
                    numbers[closed] = len(numbers) + 1
                    todo.append(closed)
                by_target[to] = numbers[closed]
            row[c] = by_target[to]
        rows.append(row)
    return Dfa(np.stack(rows), np.array(accept))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def count_matches(text: Column, pattern: str) -> Column:
    """Matches in each text; 0 for null."""
    dfa = compile_regex(pattern)

    @F.arrow_udf("int")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.bincount(dfa.spans(*_buffer(part))[0], minlength=len(part)).astype(np.int32))

    return count(text)


def find_matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end>> of byte spans."""
    dfa = compile_regex(pattern)

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            which, begin, end = dfa.spans(*_buffer(part))
            first = np.append(0, np.cumsum(np.bincount(which, minlength=len(part))))
            yield pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"]))

    return find(text)


def full_match(text: Column, pattern: str) -> Column:
    """Whether the whole of each text matches; false for null."""
    dfa = compile_regex(pattern)

    @F.arrow_udf("boolean")
    def match(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(dfa.full_matches(*_buffer(part)) & part.is_valid().to_numpy(zero_copy_only=False))

    return match(text)
