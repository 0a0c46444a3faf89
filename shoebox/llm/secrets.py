"""Secret scans by one deterministic automaton for all rules.

The rules' regular expressions are compiled by subset construction and minimisation into
one transition array, so a text's bytes are passed once whatever the number of rules. Where
the automaton accepts, the rule's reversed automaton finds the leftmost start and its own
forward automaton the longest end.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import bounded_batches, text_bytes


@dataclass(frozen=True)
class Rule:
    """least: characters that the group must have for a match to count; dropped ones still use up their text. tail: what a match takes along."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1
    base: bool = False
    tail: str = ""


#: Headers and lines of base64, and all up to the END line where there is one.
_KEY_BODY = r"(?:[\r\n]+[A-Za-z]+-[A-Za-z]+:[A-Za-z0-9,\x20-]*)*(?:[\t\n\r\x20]+[A-Za-z0-9+/=]{16,})*(?:[\t\n\r\x20A-Za-z0-9+/=]*-----END [A-Z ]*PRIVATE KEY-----)?"

#: Patterns know literals, classes, groups, | ? * + {m,} {m,n} and \x escapes. Runs of hex digits
#: are looked at from 8 digits on, as the automaton counts them; maximal runs stay the same.
#: A private key goes to its END line, or without one to the end of its lines of base64.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20, True),
    Rule("hex", r"[0-9a-f]{8,}", False, 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=_KEY_BODY),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 30),
)


class _Parser:
    """A regular expression as nested tuples: set, cat, alt, rep."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.text, self.at, self.fold = pattern, 0, ignore_case

    def parse(self) -> tuple:
        tree = self._alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at}")
        return tree

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _alternatives(self) -> tuple:
        options = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def _sequence(self) -> tuple:
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("cat", parts)

    def _repeated(self) -> tuple:
        node = self._atom()
        while self._peek() and (m := re.match(r"[?*+]|\{(\d+)(,(\d*))?\}", self.text[self.at :])):
            self.at += m.end()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(m[0]) or (int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
            node = ("rep", node, low, high)
        return node

    def _atom(self) -> tuple:
        c = self._peek()
        if c == "(":
            self.at += 1
            node = self._alternatives()
            if self._peek() != ")":
                raise ValueError("group has no end")
            self.at += 1
            return node
        if c == "[":
            return ("set", self._class())
        if c == ".":
            self.at += 1
            return ("set", frozenset(range(256)) - {10})
        found = self._byte()
        return ("set", self._folded({found}))

    def _byte(self) -> int:
        c, self.at = self.text[self.at], self.at + 1
        if c != "\\":
            if ord(c) > 127:
                raise ValueError("patterns are ASCII")
            return ord(c)
        c, self.at = self.text[self.at], self.at + 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def _class(self) -> frozenset:
        self.at += 1
        inverse = self._peek() == "^"
        self.at += inverse
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._byte()
            found |= set(range(low, high + 1))
        self.at += 1
        return frozenset(range(256)) - self._folded(found) if inverse else self._folded(found)

    def _folded(self, found: Iterable[int]) -> frozenset:
        return frozenset(found) | (frozenset(y for x in found for y in (ord(chr(x).lower()), ord(chr(x).upper())) if x < 128) if self.fold else frozenset())


def _reversed(tree: tuple) -> tuple:
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in tree[1]])
    return ("rep", _reversed(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.steps: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.steps.append(None)
        return len(self.free) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Builds the tree behind start; returns where it ends."""
        kind = tree[0]
        if kind == "set":
            here, end = self.state(), self.state()
            self.free[start].append(here)
            self.steps[here] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closures(self) -> list[int]:
        """For every state, the states reached from it for free, as bits."""
        out = []
        for k in range(len(self.free)):
            found, todo = {k}, [k]
            while todo:
                more = [x for x in self.free[todo.pop()] if x not in found]
                found.update(more)
                todo += more
            out.append(sum(1 << x for x in found))
        return out


@dataclass
class Dfa:
    """table[state + byte] is the next state; states are multiples of 256, the accepting ones from hot on; dead: no way on."""

    table: array
    start: int
    hot: int
    dead: int
    accepts: dict[int, tuple[int, ...]]


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def compile_dfa(trees: list[tuple], anywhere: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation by refining the partition of the states."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {nfa.add(tree, root): k for k, tree in enumerate(trees)}
    alike: dict[tuple, int] = {}
    sets = list({s[0] for s in nfa.steps if s})
    group = [alike.setdefault(tuple(b in s for s in sets), len(alike)) for b in range(256)]
    one_of = [group.index(c) for c in range(len(alike))]
    closures = nfa.closures()
    moves = [{x: closures[s[1]] for x, s in enumerate(nfa.steps) if s and b in s[0]} for b in one_of]
    stepping = sum(1 << x for x, s in enumerate(nfa.steps) if s)
    first = closures[root]
    known, todo, rows = {first: 0}, [first], []
    for now in todo:
        live = [x for x in _bits(now & stepping)]
        row = []
        for move in moves:
            to = first if anywhere else 0
            for x in live:
                to |= move.get(x, 0)
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        rows.append(row)
    accept = [tuple(sorted(k for x, k in ends.items() if s >> x & 1)) for s in known]
    kinds = sorted(set(accept))
    part = [kinds.index(a) for a in accept]
    while True:
        seen: dict[tuple, int] = {}
        finer = [seen.setdefault((part[k], *(part[t] for t in row)), len(seen)) for k, row in enumerate(rows)]
        if len(seen) == len(set(part)):
            break
        part = finer
    of_part = {}
    for k, p in enumerate(part):
        of_part.setdefault(p, k)
    order = sorted(of_part, key=lambda p: bool(accept[of_part[p]]))
    number = {p: k for k, p in enumerate(order)}
    table = array("l")
    for p in order:
        row = rows[of_part[p]]
        table.extend(number[part[row[c]]] * 256 for c in group)
    accepts = {number[p] * 256: accept[of_part[p]] for p in order if accept[of_part[p]]}
    dead = next((number[p] * 256 for p in order if not accept[of_part[p]] and all(part[t] == p for t in rows[of_part[p]])), -1)
    return Dfa(table, number[part[0]] * 256, min(accepts, default=len(table)), dead, accepts)


class Scanner:
    """All rules in one automaton, and each rule's own, forward and reversed."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        trees = [_Parser(r.pattern, r.ignore_case).parse() for r in rules]
        self.rules = rules
        self.all = compile_dfa(trees, True)
        self.ahead = [compile_dfa([t], False) for t in trees]
        self.back = [compile_dfa([_reversed(t)], False) for t in trees]
        self.table: list[int] | None = None
        self.tail = [re.compile(r.tail.encode()) if r.tail else None for r in rules]
        self.exact = [re.compile(r.pattern.encode(), re.IGNORECASE if r.ignore_case else 0) for r in rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes: per rule leftmost, longest and not overlapping, ordered by start, then rule."""
        if self.table is None:  # a list of shared numbers is read faster than an array
            same = {x: x for x in self.all.table}
            self.table = [same[x] for x in self.all.table]
        table, state, hot, accepts = self.table, self.all.start, self.all.hot, self.all.accepts
        used = [0] * len(self.rules)
        found = []
        for at, b in enumerate(data):
            state = table[state + b]
            if state >= hot:
                for rule in accepts[state]:
                    if at >= used[rule] and (start := self._start(data, rule, at, used[rule])) is not None:
                        used[rule] = end = self._end(data, rule, start)
                        counts = self._counts(rule, data[start:end])
                        if self.tail[rule]:
                            used[rule] = end = self.tail[rule].match(data, end).end()
                        if counts:
                            found.append((start, rule, end))
        return sorted(found)

    def _start(self, data: bytes, rule: int, at: int, floor: int) -> int | None:
        dfa, state, start = self.back[rule], self.back[rule].start, None
        while at >= floor:
            state = dfa.table[state + data[at]]
            if state == dfa.dead:
                break
            if state >= dfa.hot:
                start = at
            at -= 1
        return start

    def _end(self, data: bytes, rule: int, at: int) -> int:
        dfa, state, end = self.ahead[rule], self.ahead[rule].start, at
        while at < len(data):
            state = dfa.table[state + data[at]]
            if state == dfa.dead:
                break
            at += 1
            if state >= dfa.hot:
                end = at
        return end

    def _counts(self, rule: int, match: bytes) -> bool:
        r = self.rules[rule]
        got = self.exact[rule].fullmatch(match)
        return len(got[r.group] if got else match) >= r.least


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    marks = sorted({x for s in spans for x in (s[0], s[2])})
    place, at, count = {}, 0, 0
    for m in marks:
        count += len(data[at:m].decode("utf-8", "replace"))
        place[m], at = count, m
    return [(place[s], r, place[e]) for s, r, e in spans]


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{r.kind}", pa.int64()) for r in RULES if r.base), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, a count for each base rule, base_sha256 over the base spans, and all spans as kind:start:end.

    Null and empty texts have no spans; null ids stay null; repeated rows each get a row;
    texts of any length are scanned whole; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(df.sparkSession)

    scanner = Scanner()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                spans = in_code_points(data, scanner.scan(data))
                base = [s for s in spans if RULES[s[1]].base]
                counts = [sum(s[1] == k for s in base) for k, r in enumerate(RULES) if r.base]
                rows.append((doc, *counts, hashlib.sha256(joined(base, RULES).encode()).hexdigest(), joined(spans, RULES)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_FOUND), _FOUND)], schema=_FOUND)

    ddl = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in _FOUND)
    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(scanned, ddl)


def redact_text(data: bytes, scanner: Scanner) -> bytes:
    """The text with every secret replaced by its kind; overlapping secrets by the first one's."""
    out, at = [], 0
    for start, rule, end in scanner.scan(data):
        if start >= at:
            out += [data[at:start], b"[" + scanner.rules[rule].kind.encode() + b" removed]"]
        at = max(at, end)
    return b"".join([*out, data[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its own columns, whatever their names, and the secrets in the text replaced.

    Null texts stay null, empty ones empty; null ids and repeated rows stay as they are; an
    empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    names = df.columns
    at = names.index(text_col)

    scanner = Scanner()

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = [None if null else redact_text(x, scanner).decode("utf-8", "replace") for x, null in zip(text_bytes(column), column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if k == at else batch.column(k) for k, f in enumerate(batch.schema)], schema=batch.schema)

    return df.mapInArrow(cleaned, df.schema)
