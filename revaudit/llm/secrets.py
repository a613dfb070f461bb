"""Secret scanning with one combined deterministic automaton.

The regular expressions of all rules become position automata, are joined by subset construction into one automaton
over byte classes and are minimised; what is left is one array of transitions and, for each accepting state, the rules
that accept there. A text is read once, byte by byte, for all rules. Where a rule accepts, its own reversed automaton
runs back to the leftmost start and its own forward automaton runs on to the longest end, which touches only the match.

The leftmost match of a rule must be the one that ends first; ``compile_rules`` proves that for each rule and refuses
a rule for which it does not hold.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# ---------------------------------------------------------------------------------------------------- expressions
# A small syntax: bytes, \xHH, [classes], (groups), | ? * + {m} {m,} {m,n}. A node is a tuple.


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def alternatives(self):
        out = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("or", out)

    def sequence(self):
        out = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            out.append(self.repeated())
        return ("then", out)

    def repeated(self):
        node = self.atom()
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                low, high = int(low), int(high) if high else (None if comma else int(low))
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("then", [node] * low + ([("many", node)] if high is None else [("maybe", node)] * (high - low)))
        return node

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        if self.p[self.i] == "(":
            self.i += 1
            node = self.alternatives()
            self.i += 1
            return node
        if self.p[self.i] != "[":
            return self.of({self.char()})
        self.i += 1
        negative, chars = self.p[self.i] == "^", set()
        self.i += negative
        while self.p[self.i] != "]":
            low = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                chars.update(range(low, self.char() + 1))
            else:
                chars.add(low)
        self.i += 1
        return ("not", chars) if negative else self.of(chars)

    def of(self, chars: set[int]):
        if self.fold:
            chars = {x for c in chars for x in (ord(chr(c).lower()), ord(chr(c).upper())) if c < 128} | chars
        return ("byte", frozenset(chars))


@dataclass
class _Positions:
    """A position automaton: the bytes of each position, where a match starts and ends, what follows what."""

    chars: list
    first: set
    last: set
    follow: list
    empty: bool

    def reversed(self) -> "_Positions":
        back = [set() for _ in self.chars]
        for i, x in enumerate(self.follow):
            for j in x:
                back[j].add(i)
        return _Positions(self.chars, self.last, self.first, back, self.empty)


def _positions(pattern: str, fold: bool) -> _Positions:
    chars: list = []
    follow: list[set] = []

    def walk(node):
        kind, x = node
        if kind in ("byte", "not"):
            chars.append(frozenset(range(256)) - x if kind == "not" else x)
            follow.append(set())
            return {len(chars) - 1}, {len(chars) - 1}, False
        if kind in ("many", "maybe"):
            first, last, _ = walk(x)
            if kind == "many":
                for i in last:
                    follow[i] |= first
            return first, last, True
        if kind == "or":
            parts = [walk(y) for y in x]
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        first, last, empty = set(), set(), True
        for y in x:
            f, l, e = walk(y)
            for i in last:
                follow[i] |= f
            first, last, empty = first | f if empty else first, last | l if e else l, empty and e
        return first, last, empty

    first, last, empty = walk(_Parser(pattern, fold).alternatives())
    return _Positions(chars, first, last, follow, empty)


# ------------------------------------------------------------------------------------------------------- automata


@dataclass
class Automaton:
    """``steps[state * width + classes[byte]]`` is the next state times ``width``; accepting states are the last ones,
    from ``accepting`` (times width) on, and ``rules`` names theirs. State 0 is where reading starts. ``dead``: the
    state without a way out, or -1."""

    classes: bytes
    width: int
    steps: list
    start: int
    accepting: int
    rules: dict
    dead: int


def determinise(parts: list[_Positions], anchored: bool) -> Automaton:
    """Subset construction and minimisation (partition refinement) of the union of ``parts``."""
    chars = [c for p in parts for c in p.chars]
    owner = [k for k, p in enumerate(parts) for _ in p.chars]
    bits = lambda places, base: sum(1 << base + i for i in places)
    base, first, follow, last = 0, 0, [], 0
    for p in parts:
        first, last = first | bits(p.first, base), last | bits(p.last, base)
        follow += [bits(x, base) for x in p.follow]
        base += len(p.chars)
    kinds: dict[int, int] = {}
    classes = bytes(kinds.setdefault(bits((i for i, c in enumerate(chars) if b in c), 0), len(kinds)) for b in range(256))
    hits, width = list(kinds), len(kinds)
    # A state is the set of positions just read, as bits. Unanchored, the empty set is the start; anchored, it is the
    # dead state and -1 is the start.
    names, todo, table, accept = {0: 0} | ({-1: 1} if anchored else {}), deque([0, -1] if anchored else [0]), [], []
    while todo:
        state = todo.popleft()
        can, ends, rest = first if state == -1 or not anchored else 0, [], max(state, 0)
        while rest:
            low = rest & -rest
            i = low.bit_length() - 1
            can |= follow[i]
            if last & low:
                ends.append(owner[i])
            rest ^= low
        row = []
        for hit in hits:
            to = hit & can
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        table.append(row)
        accept.append(frozenset(ends))
    group_of = {a: k for k, a in enumerate(dict.fromkeys(accept))}
    block, goes, n = np.array([group_of[a] for a in accept]), np.array(table), len(group_of)
    while True:
        block = np.unique(np.column_stack([block, block[goes]]), axis=0, return_inverse=True)[1].ravel()
        if int(block.max()) + 1 == n:
            break
        n = int(block.max()) + 1
    block = block.tolist()
    reps: dict[int, int] = {}
    for s, b in enumerate(block):
        reps.setdefault(b, s)
    first_block = block[1 if anchored else 0]
    order = sorted(reps, key=lambda b: (bool(accept[reps[b]]), b != first_block, b))
    place = {b: k * width for k, b in enumerate(order)}
    steps = [place[block[t]] for b in order for t in table[reps[b]]]
    rules = {place[b]: tuple(sorted(accept[reps[b]])) for b in order if accept[reps[b]]}
    return Automaton(classes, width, steps, place[first_block], min(rules, default=len(steps)), rules, place[block[0]] if anchored else -1)


@dataclass(frozen=True)
class Rule:
    """``pattern`` with letters in either case if ``fold``. A match shorter than ``least`` bytes after its ``head``
    (a regular expression of its first part, or none) is dropped, though it still blocks what it overlaps."""

    kind: str
    pattern: str
    fold: bool = False
    head: str = ""
    least: int = 0


_ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: The three base kinds, then what this scan adds.
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", True, _ASSIGN, 6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]+", least=24),
    Rule("jwt", "eyJ[A-Za-z0-9_.-]+", least=40),
    Rule("pem", "-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
)


@dataclass
class Scanner:
    rules: tuple
    scan: Automaton
    forward: list
    backward: list
    heads: list


def first_end_is_leftmost(rule: Rule) -> bool:
    """No match may lie within the shortest form of a match that starts before it and ends after it."""
    p = _positions(rule.pattern, rule.fold)
    own, free = determinise([p], True), determinise([p], False)
    todo, seen = [(own.start, None, False)], set()
    while todo:
        s, f, hit = todo.pop()
        for c in set(own.classes):
            byte = own.classes.index(c)
            t = own.steps[s + c]
            if t == own.dead:
                continue
            g = free.start if f is None else free.steps[f + free.classes[byte]]
            if t >= own.accepting:
                if hit:
                    return False
                continue
            x = (t, g, hit or f is not None and g >= free.accepting)
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return True


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...]) -> Scanner:
    parts = [_positions(r.pattern, r.fold) for r in rules]
    for r, p in zip(rules, parts):
        if p.empty or not first_end_is_leftmost(r):
            raise ValueError(f"rule {r.kind}: it matches nothing at all, or a match can hide within another")
    heads = [re.compile(r.head.encode(), re.I if r.fold else 0) if r.head else None for r in rules]
    return Scanner(rules, determinise(parts, False), [determinise([p], True) for p in parts], [determinise([p.reversed()], True) for p in parts], heads)


def spans(scanner: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, by start and then rule: for each rule its leftmost longest matches that do not
    overlap, without those that are too short."""
    a = scanner.scan
    steps, accepting, accepts = a.steps, a.accepting, a.rules
    ends = [0] * len(scanner.rules)
    found = []
    s = a.start
    for i, c in enumerate(data.translate(a.classes)):
        s = steps[s + c]
        if s >= accepting:
            for r in accepts[s]:
                if i >= ends[r] and (m := _match(scanner, r, data, ends[r], i)):
                    ends[r] = m[1]
                    rule, head = scanner.rules[r], scanner.heads[r]
                    value = head.match(data, m[0]).end() if head else m[0]
                    if m[1] - value >= rule.least:
                        found.append((m[0], r, m[1]))
    found.sort()
    return found


def _match(scanner: Scanner, r: int, data: bytes, low: int, at: int) -> tuple[int, int] | None:
    """The leftmost start from ``low`` of a match whose last byte is ``at``, and the longest end from there."""
    b, start = scanner.backward[r], -1
    s, i = b.start, at
    while i >= low:
        s = b.steps[s + b.classes[data[i]]]
        if s == b.dead:
            break
        if s >= b.accepting:
            start = i
        i -= 1
    if start < 0:
        return None
    f = scanner.forward[r]
    s, end, i = f.start, at + 1, start
    while i < len(data):
        s = f.steps[s + f.classes[data[i]]]
        if s == f.dead:
            break
        i += 1
        if s >= f.accepting:
            end = i
    return start, end


def to_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points; a continuation byte does not count."""
    if not found or data.isascii():
        return found
    at, n, place = 0, 0, {}
    for o in sorted({x for a, _, b in found for x in (a, b)}):
        n += sum(1 for c in data[at:o] if c & 0xC0 != 0x80)
        at, place[o] = o, n
    return [(place[a], r, place[b]) for a, r, b in found]


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (``key``, spans array<struct<kind, start, end>>): the secrets of every whole text, in code points with the
    end exclusive, by start and then by the order of the rules.

    A null or empty text has none. Null and repeated keys stay; other columns are not read.
    """
    scanner = compile_rules(rules)

    def run(keys: list, texts: list) -> list[list]:
        kinds = [r.kind for r in rules]
        return [keys, [[{"kind": kinds[r], "start": a, "end": b} for a, r, b in to_code_points(t, spans(scanner, t))] if t else [] for t in texts]]

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, spans array<struct<kind string, start long, end long>>"
    return map_rows(df, [F.col(key), F.col(text).cast("binary")], run, schema)


def digest(found: DataFrame, key: str = "doc_id", base: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """Counts of the base kinds and both span lists as text: the base one hashed, the whole one in full."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kind: lambda s: s.kind == kind
    own = F.filter("spans", lambda s: s.kind.isin(*base))
    return found.select(
        key,
        *(F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(own), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """The same spans by one regular expression after the other; for tests."""
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern.encode(), (text or "").encode(), re.I if r.fold else 0):
            head = re.match(r.head.encode(), m.group(), re.I if r.fold else 0).end() if r.head else 0
            if len(m.group()) - head >= r.least:
                out.append((m.start(), k, m.end()))
    data = (text or "").encode()
    return [(rules[k].kind, len(data[:a].decode()), len(data[:b].decode())) for a, k, b in sorted(out)]


def sha(items: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in items).encode()).hexdigest()
