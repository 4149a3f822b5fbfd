"""CommonMark block structure of one document: containers, leaves, and where in the source each lies."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from .inline import normal_label, reference_definition

_FENCE = re.compile(r"(`{3,}(?!.*`)|~{3,})(.*)")
_ATX = re.compile(r"#{1,6}(?=[ \t]|$)")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_BULLET = re.compile(r"[*+-](?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
_HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table "
    "tbody td tfoot th thead title tr track ul"
).replace(" ", "|")  # fixed values of the public CommonMark 0.31 text
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_HTML_START = [
    re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I),
    re.compile(r"<!--"),
    re.compile(r"<\?"),
    re.compile(r"<![A-Za-z]"),
    re.compile(r"<!\[CDATA\["),
    re.compile(rf"</?(?:{_HTML_NAMES})(?:\s|/?>|$)", re.I),
    re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"),
]
_HTML_END = [re.compile(r"</(?:script|pre|style|textarea)>", re.I), re.compile("-->"), re.compile(r"\?>"), re.compile(">"), re.compile(r"\]\]>")]
_COMMENTS = re.compile(r"(?:[ \t\n]*<!--(?:>|->|.*?-->))+[ \t\n]*\Z", re.S)
#: Characters of a heading line up to which what it says is kept for when it comes again.
SHORT_HEADING = 200
CONTAINERS = ("document", "quote", "list", "item")


@dataclass(eq=False, slots=True)
class Block:
    """kind, its first line and character there, its last line (exclusive), and what it holds."""

    kind: str
    line: int
    col: int
    end: int = 0
    level: int = 0
    list_kind: str = ""
    children: list[Block] = field(default_factory=list)
    lines: list[tuple[int, int, str]] = field(default_factory=list)  # line, character where the text starts, text
    open: bool = True
    marker: tuple = ()
    indent: int = 0

    @property
    def text(self) -> str:
        return self.lines[0][2] if len(self.lines) == 1 else "\n".join(t for _, _, t in self.lines)

    def comments_only(self) -> bool:
        """Whether an HTML block holds white space and whole comments alone."""
        return self.kind == "html" and bool(_COMMENTS.match(self.text))


class _Cursor:
    """A place in a line; a tab reaches to the next multiple of four columns and may be part used."""

    def __init__(self, line: str) -> None:
        self.s, self.at, self.col, self.spare = line, 0, 0, 0

    def indent(self) -> int:
        col, i = self.col, self.at
        while i < len(self.s) and self.s[i] in " \t":
            col += 1 if self.s[i] == " " else 4 - col % 4
            i += 1
        return col - self.col + self.spare

    def rest(self) -> str:
        return " " * self.spare + self.s[self.at :]

    def peek(self) -> int:
        i = self.at
        while i < len(self.s) and self.s[i] in " \t":
            i += 1
        return i

    def skip(self, columns: int) -> None:
        used = min(columns, self.spare)
        self.spare -= used
        columns -= used
        while columns > 0 and self.at < len(self.s) and self.s[self.at] in " \t":
            width = 1 if self.s[self.at] == " " else 4 - self.col % 4
            self.at, self.col = self.at + 1, self.col + width
            if width > columns:
                self.spare = width - columns
            columns -= width

    def jump(self, to: int) -> None:
        self.skip(10**9)
        self.col += to - self.at
        self.at, self.spare = to, 0


_CLOSING = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")


def _heading_text(raw: str) -> str:
    return _CLOSING.sub("", raw).strip(" \t") if "#" in raw else raw.strip(" \t")


def _atx(rest: str, m: re.Match) -> tuple[int, tuple, int, str]:
    """Level, marker, where the text starts and the text of a heading line, from its first # on."""
    raw = rest[m.end() :]
    return m.end(), ("atx", raw[:1] != "\t"), len(rest) - len(raw.lstrip(" \t")), _heading_text(raw)


@functools.lru_cache(4096)
def short_atx(line: str) -> tuple[int, tuple, int, str] | None:
    m = _ATX.match(line)
    return _atx(line, m) if m else None


class Parser:
    """Reads lines one by one into a tree; references holds the link reference definitions seen."""

    def __init__(self) -> None:
        self.root = Block("document", 0, 0)
        self.path = [self.root]
        self.references: dict[str, str] = {}
        self.n = 0

    def parse(self, lines: list[str]) -> Block:
        for self.n, line in enumerate(lines):
            if len(self.path) > 1 or not self._simple(line):
                self._line(line)
        while self.path:
            self._close()
        return self.root

    def _simple(self, line: str) -> bool:
        """Whether a line was read here: a short heading, a comment or an empty line where no block is open, as most lines of
        outlines are."""
        if not line:
            return True
        if line.startswith("<!--") and "-->" in line:
            self.root.children.append(Block("html", self.n, 0, self.n + 1, 1, lines=[(self.n, 0, line)], open=False))
            return True
        if line[0] != "#" or len(line) > SHORT_HEADING or not (found := short_atx(line)):
            return False
        level, marker, start, text = found
        self.root.children.append(Block("heading", self.n, 0, self.n + 1, level, lines=[(self.n, start, text)], open=False, marker=marker))
        return True

    def _close(self) -> None:
        b = self.path.pop()
        b.open = False
        if b.kind == "p":
            self._definitions(b)
            if not b.lines and self.path:
                self.path[-1].children.remove(b)
                return
        if b.kind == "code" and b.level == 0:
            while b.lines and not b.lines[-1][2].strip():
                b.lines.pop()
            b.end = b.lines[-1][0] + 1
        if b.kind in ("list", "item", "quote") and b.children:
            b.end = max(b.end if b.kind != "list" else 0, b.children[-1].end)

    def _definitions(self, p: Block) -> None:
        while p.lines and p.lines[0][2].startswith("["):
            text = p.text
            found = reference_definition(text)
            if not found:
                break
            label, target, end = found
            self.references.setdefault(normal_label(label), target)
            left = text[end:]
            n = left.count("\n") + 1 if left else 0
            p.lines = p.lines[len(p.lines) - n :] if n else []
            if p.lines:
                p.line, p.col = p.lines[0][0], p.lines[0][1]

    def _add(self, kind: str, at: int, **more) -> Block:
        while self.path[-1].kind not in CONTAINERS or (self.path[-1].kind == "list") != (kind == "item"):
            if kind == "item" and self.path[-1].kind != "list" and self.path[-1].kind in CONTAINERS:
                break
            self._close()
        b = Block(kind, self.n, at, self.n + 1, **more)
        self.path[-1].children.append(b)
        self.path.append(b)
        return b

    def _matched(self, c: _Cursor) -> tuple[int, bool]:
        """How many open blocks go on in this line; whether the line is thereby used up."""
        for k, b in enumerate(self.path[1:], 1):
            blank = c.peek() >= len(c.s)
            if b.kind == "quote":
                if c.indent() > 3 or c.s[c.peek() : c.peek() + 1] != ">":
                    return k, False
                c.jump(c.peek() + 1)
                c.skip(1)
            elif b.kind == "item":
                if blank:
                    if not b.children:
                        return k, False
                    c.skip(c.indent())
                elif c.indent() >= b.indent:
                    c.skip(b.indent)
                else:
                    return k, False
            elif b.kind == "code":
                if b.level:
                    mark, n = b.marker
                    close = re.fullmatch(rf"{re.escape(mark)}{{{n},}}[ \t]*", c.s[c.peek() :]) if c.indent() <= 3 else None
                    if close:
                        b.end = self.n + 1
                        del self.path[k + 1 :]
                        self._mark(k)
                        self._close()
                        return k, True
                    c.skip(min(b.indent, c.indent()))
                elif c.indent() >= 4:
                    c.skip(4)
                elif blank:
                    c.skip(c.indent())
                else:
                    return k, False
            elif b.kind == "html":
                if blank and b.level >= 5:
                    return k, False
            elif b.kind == "p":
                if blank:
                    return k, False
            elif b.kind != "list":
                return k, False
        return len(self.path), False

    def _mark(self, upto: int) -> None:
        for b in self.path[1:upto]:
            b.end = self.n + 1

    def _line(self, line: str) -> None:
        c = _Cursor(line)
        k, used = self._matched(c)
        if used:
            return
        all_matched = k == len(self.path)
        top = self.path[k - 1]
        paragraph = self.path[-1] if self.path[-1].kind == "p" else None
        if top.kind in ("code", "html"):
            self._leaf(top, c)
            return
        started = False
        while True:
            at, indent = c.peek(), c.indent()
            rest = c.s[at:]
            if not rest or (indent > 3 and (not started and paragraph or self.path[k - 1].kind == "p")):
                break
            if indent > 3:
                self._shut(k)
                c.skip(4)
                b = self._add("code", at)
                b.lines.append((self.n, at, c.rest()))
                self._mark(len(self.path))
                return
            in_p = all_matched and not started and top.kind == "p"
            ch = rest[0]
            if ch == ">":
                self._shut(k)
                self._add("quote", at)
                c.jump(at + 1)
                c.skip(1)
            elif m := ch == "#" and _ATX.match(rest):
                self._shut(k)
                level, marker, start, text = _atx(rest, m)
                b = self._add("heading", at, level=level)
                b.marker = marker
                b.lines.append((self.n, at + start, text))
                self._mark(len(self.path))
                self._close()
                return
            elif m := ch in "`~" and _FENCE.match(rest):
                self._shut(k)
                b = self._add("code", at, level=1)
                b.marker, b.indent = (ch, len(m[1])), indent
                self._mark(len(self.path))
                return
            elif ch == "<" and (kind := next((i for i, p in enumerate(_HTML_START) if p.match(rest) and (i < 6 or not (paragraph and not started))), None)) is not None:
                self._shut(k)
                b = self._add("html", at, level=kind)
                self._leaf(b, c)
                return
            elif in_p and ch in "=-" and (m := _SETEXT.match(rest)):
                self._definitions(top)
                if top.lines:
                    top.kind, top.level, top.marker = "heading", 1 if ch == "=" else 2, ("setext", True)
                    top.end = self.n + 1
                    self._mark(len(self.path))
                    self._close()
                    return
                c_line = rest
                self.path[-2].children.remove(self.path.pop()) if self.path[-1] is top else None
                b = self._add("p", at)
                b.lines.append((self.n, at, c_line))
                self._mark(len(self.path))
                return
            elif ch in "*-_" and _BREAK.match(rest):
                self._shut(k)
                self._add("break", at)
                self._mark(len(self.path))
                self._close()
                return
            elif item := self._marker(c, at, indent, rest, in_p):
                kind, mark, width = item
                self._shut(k)
                if not (self.path[-1].kind == "list" and (self.path[-1].list_kind, self.path[-1].marker) == (kind, mark)):
                    self._add("list", at, list_kind=kind).marker = mark
                b = self._add("item", at)
                c.jump(at + width)
                spaces = c.indent()
                blank = c.peek() >= len(c.s)
                take = 1 if spaces > 4 or spaces < 1 or blank else spaces
                b.indent = indent + width + take
                c.skip(take if not blank else min(spaces, 1))
            else:
                break
            started, k = True, len(self.path)
            self._mark(k)
        at = c.peek()
        blank = at >= len(c.s)
        if not all_matched and not started and not blank and paragraph:  # lazy continuation
            paragraph.lines.append((self.n, at, c.s[at:].rstrip("\r")))
            self._mark(len(self.path))
            paragraph.end = self.n + 1
            return
        self._shut(k)
        if blank:
            return
        tip = self.path[-1]
        if tip.kind != "p":
            tip = self._add("p", at)
        tip.lines.append((self.n, at, c.s[at:]))
        tip.end = self.n + 1
        self._mark(len(self.path))

    def _shut(self, k: int) -> None:
        while len(self.path) > k:
            self._close()

    def _leaf(self, b: Block, c: _Cursor) -> None:
        b.lines.append((self.n, c.at, c.rest()))
        self._mark(len(self.path))
        if b.kind == "html":
            b.end = self.n + 1
            if b.level < 5 and _HTML_END[b.level].search(c.s[c.at :]):
                self._shut(self.path.index(b) + 1)
                self._close()

    def _marker(self, c: _Cursor, at: int, indent: int, rest: str, in_p: bool):
        if m := _BULLET.match(rest):
            kind, mark = "bullet", m[0]
        elif m := _ORDERED.match(rest):
            kind, mark = "ordered", m[2]
            if in_p and int(m[1]) != 1:
                return None
        else:
            return None
        if in_p and not rest[m.end() :].strip(" \t"):
            return None
        return kind, mark, m.end()
