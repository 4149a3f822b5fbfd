"""Matchers of headings and items: exact, glob, anchored regex, or anything.

A regex runs in linear time in RE2. Python's engine, which starts faster, takes short texts of ASCII against patterns whose
every part means the same to both (see _alike); which of them runs never shows in a result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_column, simple_fold

#: Unicode meanings of the short classes, for an engine whose own are ASCII; inside and outside of brackets.
_CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", "s": r"\t-\r \x{85}\p{Z}"}
_QUANTIFIER = re.compile(r"[*+?]|\{(\d+)(?:,\d*)?\}")
CAPTURE_NAME = re.compile(r"[a-z][a-z0-9_]*")


class PatternError(ValueError):
    pass


#: Characters up to which a text may go to the quick engine.
QUICK = 256


@dataclass(eq=False)
class _Group:
    name: str
    up: _Group | None
    alternatives: bool = False
    optional: bool = False
    repeats: bool = False


def translate(body: str) -> tuple[str, dict[str, bool]]:
    """The pattern for RE2, and of each named group whether it always takes part in a match.

    Groups without a name no longer capture; \\/ is a slash; a bare slash, look-around and back references are errors.
    """
    pattern, groups, _ = _translate(body)
    return pattern, groups


def _alike(body: str) -> bool:
    """Whether a pattern holds only what both engines read alike in ASCII text: characters, escaped marks, the short classes,
    brackets without classes of their own, groups without flags, | and greedy quantifiers in their plain form."""
    plain = re.sub(r"\\(?:[dwsDWS]|[^\w\s])", "", body)
    if not body.isascii() or "\\" in plain or "[:" in plain:
        return False
    plain = re.sub(r"\[\^?\]?[^\]\[]*\]", "x", plain)
    plain = re.sub(r"\{\d+(?:,\d*)?\}", "*", re.sub(r"\(\?(?::|P?<\w+>)", "(", plain))
    return not re.search(r"[][{}^$]|\(\?|[*+?][*+?]", plain) and len(re.findall(r"[*+]", plain)) <= 6


def _translate(body: str) -> tuple[str, dict[str, bool], bool]:
    """As translate, and whether the pattern is tame: alike for both engines, and no group that repeats holds repetition or
    alternatives, so that an engine that backtracks does little of it."""
    out, groups, top, i = [], [], _Group("", None), 0
    tame = _alike(body)
    while i < len(body):
        ch = body[i]
        closed = None
        if ch == "\\":
            nxt = body[i + 1 : i + 2]
            if not nxt:
                raise PatternError("a backslash ends the pattern")
            if nxt == "/":
                out.append("/")
            elif nxt in "123456789k":
                raise PatternError("back references are not part of the dialect")
            elif nxt in _CLASSES:
                out.append(f"[{_CLASSES[nxt]}]")
            elif nxt.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[nxt.lower()]}]")
            else:
                out.append(ch + nxt)
            i += 2
        elif ch == "/":
            raise PatternError("a slash must be written \\/")
        elif ch == "[":
            text, i = _brackets(body, i)
            out.append(text)
        elif ch == "(":
            if m := re.compile(r"\(\?P?<(?![=!])([^>]*)>").match(body, i):
                if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", m[1]):
                    raise PatternError(f"group name {m[1]!r}")
                top = _Group(m[1], top)
                groups.append(top)
                out.append(f"(?P<{m[1]}>")
                i = m.end()
            elif m := re.compile(r"\(\?([a-zA-Z-]*)([:)])").match(body, i):
                out.append(m[0])
                if m[2] == ":":
                    top = _Group("", top)
                i = m.end()
            elif body.startswith("(?", i):
                raise PatternError("look-around is not part of the dialect")
            else:
                top = _Group("", top)
                out.append("(?:")
                i += 1
        elif ch == ")":
            if top.up is None:
                raise PatternError("a bracket is not opened")
            closed, top = top, top.up
            out.append(ch)
            i += 1
        else:
            top.alternatives |= ch == "|"
            top.repeats |= ch in "*+?{"
            out.append(ch)
            i += 1
        if closed is not None and (m := _QUANTIFIER.match(body, i)):
            closed.optional = m[0] in "*?" or m[1] is not None and int(m[1]) == 0
            tame &= not (closed.repeats or closed.alternatives)
        if closed is not None:
            top.repeats |= closed.repeats
    if top.up is not None:
        raise PatternError("a bracket is not closed")

    def sure(g: _Group) -> bool:
        if g.optional:
            return False
        while g.up is not None:
            g = g.up
            if g.alternatives or g.optional:
                return False
        return True

    names = [g.name for g in groups]
    if len(set(names)) < len(names):
        raise PatternError("a group name repeats")
    return "".join(out), {g.name: sure(g) for g in groups}, tame


def _brackets(body: str, i: int) -> tuple[str, int]:
    out, start = ["["], i
    i += 1
    if body[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(body) and (body[i] != "]" or first):
        first = False
        if body.startswith("[:", i) and (end := body.find(":]", i)) > 0:
            out.append(body[i : end + 2])
            i = end + 2
        elif body[i] == "\\":
            nxt = body[i + 1 : i + 2]
            out.append(_CLASSES[nxt] if nxt in _CLASSES else r"\P{Nd}" if nxt == "D" else "/" if nxt == "/" else body[i : i + 2])
            i += 2
        elif body[i] == "/":
            raise PatternError("a slash must be written \\/")
        else:
            out.append("\\[" if body[i] == "[" else body[i])
            i += 1
    if i >= len(body):
        raise PatternError(f"brackets are not closed from {start}")
    return "".join(out) + "]", i + 1


@dataclass
class Matcher:
    """kind: exact, glob, regex or any. source is what the schema says, without the slashes of a regex."""

    kind: str
    source: str
    match_case: bool = False
    pattern: str = ""
    groups: dict[str, bool] = field(default_factory=dict)
    quick: re.Pattern | None = field(default=None, repr=False, compare=False)
    seen: dict[str, bool] = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def of(text: str, match_case: bool = False) -> Matcher:
        """Raises PatternError."""
        if len(text) > 1 and text[0] == text[-1] == "/":
            body, groups, tame = _translate(text[1:-1])
            m = Matcher("regex", text[1:-1].replace("\\/", "/"), match_case, rf"{'' if match_case else '(?i)'}\A(?:{body})\z", groups)
            try:
                pc.match_substring_regex(pa.array([""]), m.pattern)
            except pa.ArrowInvalid as x:
                raise PatternError(str(x)) from None
            if tame:
                plain = re.sub(r"(?<!\\)\(\?<(?=[A-Za-z_])", "(?P<", text[1:-1]).replace("\\/", "/")
                try:
                    m.quick = re.compile(plain, re.ASCII | (0 if match_case else re.IGNORECASE))
                except re.error:
                    m.quick = None
            return m
        if text == "*":
            return Matcher("any", "*", match_case)
        return Matcher("glob" if "*" in text else "exact", text, match_case, text if match_case else simple_fold(text))

    @property
    def label(self) -> str:
        return f"/{self.source}/" if self.kind == "regex" else self.source

    def matches(self, text: str | None) -> bool:
        """Text None, of an item without text, matches only anything."""
        if self.kind == "any":
            return True
        if text is None:
            return False
        if self.kind == "regex":
            if self.quick is not None and len(text) <= QUICK and text.isascii():
                return self.quick.fullmatch(text) is not None
            if text not in self.seen:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                self.seen[text] = pc.match_substring_regex(pa.array([text]), self.pattern)[0].as_py()
            return self.seen[text]
        text = text if self.match_case else simple_fold(text)
        if self.kind == "exact":
            return text == self.pattern
        first, *middle, last = self.pattern.split("*")
        if not text.startswith(first) or not text.endswith(last) or len(text) < len(first) + len(last):
            return False
        at, end = len(first), len(text) - len(last)
        for x in middle:
            at = text.find(x, at, end)
            if at < 0:
                return False
            at += len(x)
        return True

    def captures(self, text: str) -> dict[str, str]:
        if self.quick is not None and len(text) <= QUICK and text.isascii():
            m = self.quick.fullmatch(text)
            return m.groupdict() if m else {}
        return pc.extract_regex(pa.array([text]), self.pattern)[0].as_py() or {}

    def column(self, text: Column) -> Column:
        """Whether each text matches, null as False. Exact and glob stay in the JVM for ASCII text; a regex runs in RE2."""
        if self.kind == "any":
            return F.lit(True)
        if self.kind == "regex":
            pattern = self.pattern

            @F.arrow_udf("boolean")
            def found(x: pa.Array) -> pa.Array:
                return pc.fill_null(pc.match_substring_regex(x, pattern), False)

            return found(text)
        folded = text if self.match_case else fold_column(text)
        if self.kind == "exact":
            return F.coalesce(folded == F.lit(self.pattern), F.lit(False))
        like = "%".join(re.sub(r"([\\%_])", r"\\\1", x) for x in self.pattern.split("*"))
        return F.coalesce(folded.like(like), F.lit(False))

    def capture_column(self, text: Column, name: str) -> Column:
        """What the named group takes of each text; null where there is no match."""
        pattern = self.pattern

        @F.arrow_udf("string")
        def taken(x: pa.Array) -> pa.Array:
            return pc.struct_field(pc.extract_regex(x, pattern), name)

        return taken(text)
