"""Secret scan with one combined deterministic automaton.

Every rule's regular expression is parsed into a byte NFA. A rule's scanning state is the ordered list of its live
match attempts, oldest first, each a set of NFA states; that makes the automaton find leftmost, longest,
non-overlapping matches. Subset construction over the product of all rules gives one deterministic automaton, Moore
minimisation shrinks it, and it becomes one flat transition array with 256 entries a state. A text is scanned once,
byte by byte, for all rules together; states in which a match has just ended are numbered last, so the inner loop is
one lookup and one comparison. A match's start is found by running the reversed rule back from its end. A PEM key's
header is found so; its body and END line are added where a match ends.

The operator is a map over Arrow batches: no shuffle, no state between rows, memory bounded by a batch.

Nulls and odd rows: a null text is read as empty, an empty text has no spans. Ids are passed through as they are,
null or repeated, and repeated rows are scanned each. Spans that tie in start are ordered by rule. Very long texts are scanned whole, in linear time. Extra columns are ignored (``scan``) or kept
(``redact``). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern (a subset of regular expressions), and what a match must measure.

    ``min_bytes`` is asked of the whole match, or, where ``value`` is set, of what follows the first : or = and
    an opening quote. Matches that fail are dropped, but have consumed their text. What ``tail`` finds right behind a
    match is part of it; ``rest`` says what ``redact`` takes besides, where there is no such tail.
    """

    kind: str
    pattern: str
    min_bytes: int = 1
    value: bool = False
    ignore_case: str = ""
    tail: bytes = b""
    rest: bytes = b""


#: A key's body: fields of old formats, then base64 in lines that may be indented, quoted or escaped. It holds no two
#: dashes in a row, so it never runs into another key. Possessive, so linear in the text.
_GAP = rb"(?:\s|[\"'`,;+>#*|]|\\+[nrt]|\\)"
_FIELDS = rb"%(gap)s*+(?:[A-Z][A-Za-z]*+(?:-[A-Za-z]++)*+:(?:[^\r\n\\-]|-(?!-))*+%(gap)s++)*+" % {b"gap": _GAP}
_BODY = _FIELDS + rb"(?:[A-Za-z0-9/=]|%(gap)s)*+-----END [A-Z ]*PRIVATE KEY-----" % {b"gap": _GAP}
#: The body of a key that was cut off: long base64 lines, and a short one behind them.
_CUT = _FIELDS + rb"(?:[A-Za-z0-9+/]{32,}+=*+(?:%(gap)s++|(?![^\s])))+(?:[A-Za-z0-9+/]++=*+(?=[\r\n]|\Z))?" % {b"gap": _GAP}


# The three base rules of the query's contract, in the order in which it lists them.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6, value=True, ignore_case="(password|passwd|secret|token|api_?key)"),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24}[0-9a-f]*"),
)
EXTRA = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=_BODY, rest=_CUT),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 24),
)
RULES = BASE + EXTRA


class Nfa:
    """A byte NFA with epsilon closure done: ``step[state]`` lists (byte set, next state)."""

    def __init__(self, rule: Rule) -> None:
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.text, self.at, self.fold = rule.pattern, 0, len(rule.ignore_case)
        start, self.end = self._either()
        self.start = self.closure({start})

    def _new(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def _either(self) -> tuple[int, int]:
        a, b = self._new(), self._new()
        while True:
            x, y = self._sequence()
            self.free[a].append(x)
            self.free[y].append(b)
            if self.text[self.at : self.at + 1] != "|":
                return a, b
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        a = b = self._new()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            begin = self.at
            x, y = self._atom()
            end = self.at
            mark = self.text[self.at : self.at + 1]
            if mark and mark in "?*+":
                self.at += 1
                p, q = self._new(), self._new()
                self.free[p].append(x)
                self.free[y].append(q)
                if mark in "?*":
                    self.free[p].append(q)
                if mark in "*+":
                    self.free[y].append(x)
                x, y = p, q
            elif mark == "{":
                to = self.text.index("}", self.at)
                for _ in range(int(self.text[self.at + 1 : to]) - 1):
                    self.at = begin
                    more = self._atom()
                    self.free[y].append(more[0])
                    y = more[1]
                    assert self.at == end
                self.at = to + 1
            self.free[b].append(x)
            b = y
        return a, b

    def _atom(self) -> tuple[int, int]:
        if self.text[self.at] == "(":
            self.at += 1
            found = self._either()
            self.at += 1
            return found
        fold = self.at < self.fold
        allowed = self._class() if self.text[self.at] == "[" else {self._byte()}
        if fold:
            allowed |= {ord(f(chr(c))) for c in allowed for f in (str.lower, str.upper)}
        a, b = self._new(), self._new()
        self.step[a].append((frozenset(allowed), b))
        return a, b

    def _byte(self) -> int:
        if self.text[self.at] == "\\":
            if self.text[self.at + 1] == "x":
                self.at += 4
                return int(self.text[self.at - 2 : self.at], 16)
            self.at += 1
        self.at += 1
        return ord(self.text[self.at - 1])

    def _class(self) -> set[int]:
        self.at += 1
        allowed: set[int] = set()
        while self.text[self.at] != "]":
            first = last = self._byte()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                last = self._byte()
            allowed |= set(range(first, last + 1))
        self.at += 1
        return allowed

    def closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if self.step[x] or x == self.end)

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({to for x in states for allowed, to in self.step[x] if byte in allowed})

    def reverse(self) -> dict[int, list[tuple[frozenset[int], int]]]:
        """For each state, (byte set, state) of what can come just before it."""
        back: dict[int, list[tuple[frozenset[int], int]]] = {}
        for x, moves in enumerate(self.step):
            for allowed, to in moves:
                for y in self.closure({to}):
                    back.setdefault(y, []).append((allowed, x))
        return back


Attempts = tuple[frozenset[int], ...]


class Scanner:
    """One rule's scanning states: ordered match attempts."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.nfa = rule, Nfa(rule)
        self.back = self.nfa.reverse()

    def matched(self, state: Attempts) -> bool:
        return bool(state) and self.nfa.end in state[0]

    @cache  # noqa: B019  scanners live as long as the compiled automaton
    def move(self, state: Attempts, byte: int) -> tuple[Attempts, bool]:
        """The state after a byte, and whether a match ended just before it."""
        had = self.matched(state)
        live: list[frozenset[int]] = []
        seen: set[int] = set()
        for k, states in enumerate(state):
            after = self.nfa.move(states, byte) - seen
            if had and k == 0 and after and self.nfa.end not in after:
                raise ValueError(f"rule {self.rule.kind}: a match that may end early needs a rescan")
            if after:
                live.append(after)
                seen |= after
        ended = had and not (live and self.nfa.end in live[0])
        if not had or ended:
            fresh = self.nfa.move(self.nfa.start, byte) - seen
            if fresh:
                live.append(fresh)
        for k, states in enumerate(live):
            if self.nfa.end in states:
                if k:
                    raise ValueError(f"rule {self.rule.kind}: a younger attempt can match before an older one")
                del live[1:]
                break
        return tuple(live), ended

    def begin(self, data: bytes, end: int, least: int) -> int:
        """The earliest start, at ``least`` or later, of a match that ends at ``end``."""
        states, start, at = {self.nfa.end}, end, end
        while at > least and states:
            at -= 1
            states = {x for y in states for allowed, x in self.back.get(y, ()) if data[at] in allowed}
            if states & self.nfa.start:
                start = at
        return start


@dataclass
class Automaton:
    """The combined automaton: ``table[state * 256 + byte]`` is the next state times 256; states from ``hot`` on
    (times 256) have seen a match end, of the rules in ``ended``; ``final`` are the rules in a match at the end."""

    scanners: list[Scanner]
    table: np.ndarray
    hot: int
    ended: dict[int, tuple[int, ...]]
    final: dict[int, tuple[int, ...]]

    def spans(self, data: bytes, table: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches in bytes, in order of their ends."""
        found: list[tuple[int, int, int]] = []
        free = [0] * len(self.scanners)

        def close(r: int, end: int) -> None:
            start = self.scanners[r].begin(data, end, free[r])
            free[r] = end
            end = _with(self.scanners[r].rule.tail, data, end)
            if _long_enough(self.scanners[r].rule, data, start, end):
                found.append((start, end, r))

        state, hot = 0, self.hot
        for at, byte in enumerate(data):
            state = table[state + byte]
            if state >= hot:
                for r in self.ended[state]:
                    close(r, at)
        for r in self.final.get(state, ()):
            close(r, len(data))
        return found


def _with(pattern: bytes, data: bytes, end: int) -> int:
    """The end of a match with what the pattern finds right behind it."""
    found = re.compile(pattern).match(data, end) if pattern else None
    return found.end() if found else end


def _long_enough(rule: Rule, data: bytes, start: int, end: int) -> bool:
    if not rule.value:
        return end - start >= rule.min_bytes
    at = start
    while data[at] not in b":=":
        at += 1
    at += 1
    while data[at] == 0x20:
        at += 1
    return end - at - (data[at] in b"\"'") >= rule.min_bytes


def _classes(scanners: list[Scanner]) -> np.ndarray:
    """A class number for each byte; bytes of a class are alike to all rules."""
    marks: dict[tuple[bool, ...], int] = {}
    sets = list({allowed for s in scanners for moves in s.nfa.step for allowed, _ in moves})
    return np.array([marks.setdefault(tuple(b in x for x in sets), len(marks)) for b in range(256)])


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """Subset construction over all rules at once, then minimisation."""
    scanners = [Scanner(r) for r in rules]
    of = _classes(scanners)
    sample = [int(np.flatnonzero(of == c)[0]) for c in range(of.max() + 1)]
    begin = (tuple(() for _ in scanners), ())
    number, todo, moves = {begin: 0}, [begin], []
    while len(moves) < len(todo):
        row = []
        for byte in sample:
            after = [s.move(x, byte) for s, x in zip(scanners, todo[len(moves)][0], strict=True)]
            to = (tuple(x for x, _ in after), tuple(r for r, (_, ended) in enumerate(after) if ended))
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        moves.append(row)
    final = [tuple(r for r, (s, x) in enumerate(zip(scanners, state, strict=True)) if s.matched(x)) for state, _ in todo]
    says = [(ended, f) for (_, ended), f in zip(todo, final, strict=True)]
    group = _minimised(np.array(moves), says)
    first = {int(g): k for k, g in reversed(list(enumerate(group)))}
    order = sorted(first, key=lambda g: (bool(says[first[g]][0]), first[g] != 0, first[g]))
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    table = np.stack([place[group[moves[first[g]]]][of] for g in order]) * 256
    ended = {k * 256: says[first[g]][0] for k, g in enumerate(order) if says[first[g]][0]}
    return Automaton(scanners, table.ravel().astype(np.int32), min(ended, default=len(order) * 256), ended, {k * 256: f for k, g in enumerate(order) if (f := says[first[g]][1])})


def _minimised(moves: np.ndarray, says: list[tuple]) -> np.ndarray:
    """The class of each state, states of a class being alike for all inputs (Moore's refinement)."""
    _, group = np.unique(np.array([hash(x) for x in says]), return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            return group
        group = finer


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The byte spans as code point spans."""
    if data.isascii():
        return spans
    at, points, where = 0, 0, {}
    for offset in sorted({x for a, b, _ in spans for x in (a, b)}):
        points += len(data[at:offset].decode())
        at = offset
        where[offset] = points
    return [(where[a], where[b], r) for a, b, r in spans]


def _mapped(automaton: Automaton, schema: pa.Schema, row: Callable[[bytes, list], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function: id and text in, id and what ``row`` makes of the text and its spans out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton.table.tolist()
        for b in batches:
            texts = [t or b"" for t in b.column(b.num_columns - 1).to_pylist()]
            rows = [row(t, sorted(automaton.spans(t, table), key=lambda x: (x[0], x[2]))) for t in texts]
            made = [pa.array([r[k] for r in rows], schema.field(b.num_columns - 1 + k).type) for k in range(len(schema) - b.num_columns + 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], schema=schema)

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """One row a document: doc_id, n_<kind> of the base rules, base_sha256 over their spans, spans of all rules.

    A span is kind:start:end in code points, end exclusive; spans are ordered by start, then by rule.
    """
    kinds = [r.kind for r in rules]
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in kinds[:base]], ("base_sha256", pa.string()), ("spans", pa.string())])

    def row(data: bytes, spans: list) -> tuple:
        points = in_code_points(data, spans)
        shown = [(r, f"{kinds[r]}:{a}:{b}") for a, b, r in points]
        own = ",".join(x for r, x in shown if r < base)
        return (*[sum(r == k for r, _ in shown) for k in range(base)], hashlib.sha256(own.encode()).hexdigest(), ",".join(x for _, x in shown))

    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(_mapped(compile_rules(rules), schema, row), ddl)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret in ``text`` replaced by [KIND]; overlapping spans become one mark, that of
    the first. ``n_chars``, if there is such a column, follows where a text changed. Rows without a secret, null texts
    among them, stay as they are."""
    automaton = compile_rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = automaton.table.tolist()
        for b in batches:
            k = b.schema.get_field_index(text_col)
            before = b.column(k).cast(pa.binary()).to_pylist()
            after = [_redacted(t, automaton, table) for t in before]
            b = b.set_column(k, b.schema.field(k), pa.array(after, pa.binary()).cast(b.schema.field(k).type))
            if (n := b.schema.get_field_index(length_col)) >= 0:
                lengths = [old if x == y else len(y.decode()) for old, x, y in zip(b.column(n).to_pylist(), before, after, strict=True)]
                b = b.set_column(n, b.schema.field(n), pa.array(lengths, b.schema.field(n).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def _redacted(data: bytes | None, automaton: Automaton, table: list[int]) -> bytes | None:
    if data is None:
        return None
    out, at = [], 0
    for a, b, r in sorted(automaton.spans(data, table), key=lambda x: (x[0], x[2])):
        rule = automaton.scanners[r].rule
        b = _with(rule.rest, data, b)
        if a >= at:
            out += [data[at:a], b"[" + rule.kind.upper().encode() + b"]"]
        at = max(at, b)
    return b"".join([*out, data[at:]]) if at else data
