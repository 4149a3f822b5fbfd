"""Secret scans: all rules in one minimised deterministic automaton over bytes, and their spans from one pass with it."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import flat, hex_sha256, scan, table


def _either(words: list[str]) -> str:
    """A pattern for words with letters in either case."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


#: kind, pattern, what is measured (the whole match, or its tail: from the first byte after which it could have ended), least
#: length of that, and whether it is a base rule.
RULES = [
    ("assign", f"({_either(['password', 'passwd', 'secret', 'token'])}|{_either(['api'])}_?{_either(['key'])})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", "tail", 8, True),
    ("access", r"AKIA[A-Z0-9]+", "whole", 16, True),
    ("hex", r"[0-9a-f]+", "whole", 32, True),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", "whole", 40, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", "whole", 15, False),
    ("google", r"AIza[0-9A-Za-z_-]+", "whole", 39, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "whole", 30, False),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "whole", 0, False),
]


def parse(pattern: str) -> tuple:
    """A pattern of literals, classes, groups, |, ?, *, + and {n} as a tree of bytes."""
    at = 0

    def alternatives():
        nonlocal at
        found = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def sequence():
        nonlocal at
        found = []
        while at < len(pattern) and pattern[at] not in "|)":
            x = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                op = pattern[at]
                if op == "{":
                    end = pattern.index("}", at)
                    x, at = ("seq", [x] * int(pattern[at + 1 : end])), end + 1
                else:
                    x, at = (op, x), at + 1
            found.append(x)
        return ("seq", found)

    def char() -> int:
        nonlocal at
        if pattern[at] == "\\":
            at += 2
            if pattern[at - 1] == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
            return ord(pattern[at - 1])
        at += 1
        return ord(pattern[at - 1])

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            x = alternatives()
            at += 1
            return x
        if pattern[at] == "[":
            at += 1
            members: set[int] = set()
            while pattern[at] != "]":
                low = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    members |= set(range(low, char() + 1))
                else:
                    members.add(low)
            at += 1
            return ("set", frozenset(members))
        return ("set", frozenset({char()}))

    return alternatives()


class Steps:
    """A pattern's states by Thompson's construction, without its empty steps: from each state, classes of bytes and next states."""

    def __init__(self, pattern: str) -> None:
        self.empty: list[list[int]] = [[]]
        self.steps: list[list[tuple[frozenset[int], int]]] = [[]]
        self.end = self._build(parse(pattern), 0)
        self.start = self.closure(0)

    def _new(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def _build(self, x, start: int) -> int:
        if x[0] == "set":
            end = self._new()
            self.steps[start].append((x[1], end))
            return end
        if x[0] == "seq":
            for y in x[1]:
                start = self._build(y, start)
            return start
        end = self._new()
        for y in x[1] if x[0] == "or" else [x[1]]:
            begin = self._new()
            self.empty[start].append(begin)
            last = self._build(y, begin)
            self.empty[last].append(end)
            if x[0] in "*+":
                self.empty[last].append(begin)
        if x[0] in "?*":
            self.empty[start].append(end)
        return end

    def closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(x for x in seen if self.steps[x] or x == self.end)

    def moved(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return frozenset().union(*(self.closure(t) for s in states for members, t in self.steps[s] if byte in members))


def leftmost(steps: Steps, bytes_: list[int]) -> tuple[list[list[int]], list[list[tuple[int, ...]]], list[bool]]:
    """Next state by state and class of bytes, where each of the next state's threads comes from, and which states hold a match.

    A state is its threads in the order of their starts, each a set of the pattern's states, without those that an earlier
    thread is in. A thread that reaches the end holds: it alone goes on, as far as it can, and no other begins. When it is
    at its end, the byte that ends it is read anew. That gives leftmost, longest matches that don't overlap, for patterns
    that can't go beyond an end without being at an end again; others are refused. Where a thread comes from: its number
    among the last state's threads, -1 if it begins with this byte.
    """
    names: dict[tuple, int] = {(): 0}
    order: list[tuple] = [()]
    move, origin = [], []
    for threads in order:
        row, sources = [], []
        for byte in bytes_:
            holding = len(threads) == 1 and steps.end in threads[0]
            fresh = [(steps.moved(steps.start, byte), -1)]
            now = [(steps.moved(t, byte), i) for i, t in enumerate(threads)]
            if holding:
                if now[0][0] and steps.end not in now[0][0]:
                    raise ValueError("a match goes on beyond where it may end")
                ended = not now[0][0]
                now = fresh if ended else now
                if ended and steps.end in fresh[0][0]:
                    raise ValueError("a match begins where another ends")
            else:
                now += fresh
            taken: set[int] = set()
            left = []
            for states, i in now:
                if states - taken:
                    left.append((frozenset(states - taken), i))
                taken |= states
            if ends := [k for k, (states, _) in enumerate(left) if steps.end in states]:
                if ends[0]:
                    raise ValueError("a match ends while one that began before it goes on")
                left = left[:1]
            to = tuple(states for states, _ in left)
            if to not in names:
                names[to] = len(order)
                order.append(to)
            row.append(names[to])
            sources.append(tuple(i for _, i in left))
        move.append(row)
        origin.append(sources)
    return move, origin, [len(t) == 1 and steps.end in t[0] for t in order]


def minimised(move, origin, holds):
    """The same machine with states merged that hold alike and lead to merged states by threads of the same origin."""
    group = [int(h) for h in holds]
    while True:
        names: dict[tuple, int] = {}
        finer = [names.setdefault((group[s], *((group[t], o) for t, o in zip(move[s], origin[s], strict=True))), len(names)) for s in range(len(move))]
        if len(names) == len(set(group)):
            break
        group = finer
    firsts = sorted({g: s for s, g in reversed(list(enumerate(group)))}.values())
    rank = {group[s]: i for i, s in enumerate(firsts)}
    return [[rank[group[t]] for t in move[s]] for s in firsts], [origin[s] for s in firsts], [holds[s] for s in firsts]


@dataclass(frozen=True)
class Machine:
    """classes: of each byte; move: next state by state * kinds + class, itself times kinds; own: each rule's own state by
    state; origin: of each rule, where threads come from by own state and class; holds: by rule and state; resets: bytes
    that lead from any state to the start, which is state 0."""

    classes: np.ndarray
    move: np.ndarray
    kinds: int
    own: np.ndarray
    origin: list
    holds: np.ndarray
    resets: np.ndarray


def combined(patterns: list[str]) -> Machine:
    """One machine for all patterns: the product of the minimised machines of each. States of a product that can be reached
    differ in some pattern's state, so it is minimal as well."""
    each = [Steps(p) for p in patterns]
    sets = {members for s in each for row in s.steps for members, _ in row}
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    example = [int(np.argmax(classes == c)) for c in range(len(kinds))]
    rules = [minimised(*leftmost(s, example)) for s in each]
    names = {(0,) * len(rules): 0}
    order = [(0,) * len(rules)]
    move = []
    for own in order:
        for c in range(len(kinds)):
            to = tuple(m[s][c] for (m, _, _), s in zip(rules, own, strict=True))
            if to not in names:
                names[to] = len(order)
                order.append(to)
            move.append(names[to])
    table_ = np.array(move, np.int64).reshape(len(order), -1)
    holds = np.array([[h[s] for s in (own[k] for own in order)] for k, (_, _, h) in enumerate(rules)])
    return Machine(classes, (table_ * len(kinds)).astype(np.int32).ravel(), len(kinds), np.array(order), [o for _, o, _ in rules], holds, (table_ == 0).all(0)[classes])


@functools.cache
def compiled() -> Machine:
    return combined([r[1] for r in RULES])


#: Bytes of a lane, about: stretches of text that a pass walks side by side. With fewer lanes left than FEW, each is walked alone.
LANE, FEW = 2048, 24


def walk(data: np.ndarray, offsets: np.ndarray, machine: Machine) -> np.ndarray:
    """The state after each byte, in one pass; each text begins in the start state. Texts are parted into lanes behind bytes
    that lead to the start from any state, so long texts are walked side by side as well, with the same states."""
    codes = machine.classes[data]
    out = np.zeros(len(data), np.int32)
    if not len(data):
        return out
    resets = np.nonzero(machine.resets[data])[0] + 1
    wanted = np.arange(LANE, len(data), LANE)
    at = np.searchsorted(resets, wanted)
    base = np.unique(np.concatenate([offsets[:-1], resets[at[at < len(resets)]]]))
    base = base[base < len(data)]
    length = np.diff(np.r_[base, len(data)])
    order = np.argsort(-length, kind="stable")
    base, length = base[order], length[order]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    state, i = np.zeros(len(base), np.int32), 0
    while i < len(live) and (m := live[i]) >= FEW:
        p = base[:m] + i
        state[:m] = machine.move[state[:m] + codes[p]]
        out[p] = state[:m]
        i += 1
    if i < len(live):
        steps = machine.move.tolist()
        for k in range(live[i]):
            s, seen = int(state[k]), []
            for c in codes[base[k] + i : base[k] + length[k]].tobytes():
                s = steps[s + c]
                seen.append(s)
            out[base[k] + i : base[k] + length[k]] = seen
    return out // machine.kinds


def find(data: np.ndarray, offsets: np.ndarray, machine: Machine, rules: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(text, start, rule, end) of the matches of at least the rules' least lengths, ascending; places are bytes of the text."""
    states = walk(data, offsets, machine)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    codes = machine.classes[data]
    out = []
    for k, (_, _, measure, least, _) in enumerate(rules):
        hold = machine.holds[k][states]
        before, after = np.zeros_like(hold), np.zeros_like(hold)
        before[1:], after[:-1] = hold[:-1], hold[1:]
        begins = np.nonzero(hold & (~before | first[:-1]))[0]
        ends = np.nonzero(hold & (~after | first[1:]))[0] + 1
        if measure == "tail":
            enough = ends - begins >= least
            begins, ends = begins[enough], ends[enough]
        origin = machine.origin[k]
        at_once = {c for c in range(machine.kinds) if origin[0][c] and machine.holds[k][machine.move[c] // machine.kinds]}
        if len(at_once) == sum(bool(o) for o in origin[0]):  # each match holds from its first byte on
            starts = begins
        else:
            starts = begins.copy()
            for n, p in enumerate(begins.tolist()):  # follow the thread that holds back to where it began
                thread = 0
                while True:
                    was = 0 if first[p] else machine.own[states[p - 1], k]
                    thread = origin[was][codes[p]][thread]
                    if thread < 0:
                        break
                    p -= 1
                starts[n] = p
        if measure == "whole":
            enough = ends - starts >= least
            starts, ends = starts[enough], ends[enough]
        text = np.searchsorted(offsets, starts, "right") - 1
        out += zip(text.tolist(), (starts - offsets[text]).tolist(), [k] * len(starts), (ends - offsets[text]).tolist(), strict=True)
    return sorted(out)


def spans(column: pa.Array, machine: Machine | None = None, rules: list[tuple] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """Of each text that has any: (start, rule, end) in code points, leftmost and not overlapping within a rule, ascending."""
    data, offsets = flat(column)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i, s, k, e in find(data, offsets, machine or compiled(), rules):
        out.setdefault(i, []).append((s, k, e))
    for i, found in out.items():
        lead = (data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80
        if not lead.all():
            point = np.r_[0, np.cumsum(lead)]
            out[i] = [(int(point[s]), k, int(point[e])) for s, k, e in found]
    return out


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
_NONE = hex_sha256(b"")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): counts and digest of the base rules' spans, and all spans. One pass, no
    shuffle. Null texts count as empty; texts without secrets have no spans and the digest of no bytes. Spans of
    different kinds may overlap. Texts of any length are read whole; repeated rows give repeated rows. The automaton is
    compiled once, on the driver; its size depends on RULES alone."""
    machine = compiled()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros((3, b.num_rows), np.int64)
        digest, listed = [_NONE] * b.num_rows, [""] * b.num_rows
        for i, found in spans(b.column("text"), machine).items():
            tell = [(RULES[k][4], f"{RULES[k][0]}:{s}:{e}") for s, k, e in found]
            for _, k, _ in found:
                if k < 3:
                    n[k, i] += 1
            digest[i] = hex_sha256(",".join(x for base, x in tell if base).encode())
            listed[i] = ",".join(x for _, x in tell)
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": digest, "spans": listed})

    return scan(docs.select("doc_id", "text"), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: secrets in all documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))
