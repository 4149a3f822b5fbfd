"""One Markdown document as a forest of sections with preambles, lists and items, each with its place in the source."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from ..functions.text import heading_slug
from ..sources import frontmatter
from .blocks import SHORT_HEADING, Block, Parser, short_atx
from .inline import pieces, plain, stripped, visible

#: A comment that turns checks off: a tool's name, -disable for what follows or -disable-file, and the ids.
_DIRECTIVE = re.compile(r"<!--\s*([a-z][a-z0-9]*)-disable(-file)?[ \t]+([a-z_-]+(?:(?:[ \t]*,[ \t]*|[ \t]+)[a-z_-]+)*)\s*-->")
#: Characters of a paragraph that can lead in what follows.
LEAD_IN = 120
_NOTHING: frozenset[str] = frozenset()
_EMPTY: list = []  # what sections of an outline hold beside sections; nothing may be put into it


@dataclass(eq=False, slots=True)
class Node:
    """A section, a preamble block or a list item. text is what matchers see; None for an item without text."""

    kind: str
    line: int
    col: int
    start: int
    end: int
    level: int = 0
    list_kind: str = ""
    text: str | None = None
    shown: str | None = None
    raw: str = ""
    body: str = ""
    snippet: str = ""
    lead_in: bool = False
    off: frozenset[str] = frozenset()
    blocks: list[Node] = field(default_factory=list)
    sections: list[Node] = field(default_factory=list)
    items: list[Node] = field(default_factory=list)
    ordinal: int = 0
    parent: Node | None = None

    @property
    def path(self) -> list[str]:
        out, node = [], self
        while node is not None and node.kind == "section":
            out.append(node.shown)
            node = node.parent
        return out[::-1]

    @property
    def slug(self) -> str:
        return heading_slug(self.text or "")

    def extent(self) -> int:
        """End of the section: the furthest of its heading, blocks and sections."""
        out, todo = self.end, list(self.sections)
        for b in self.blocks:
            out = max(out, b.end)
        while todo:
            s = todo.pop()
            out = max([out, s.end, *(b.end for b in s.blocks)])
            todo += s.sections
        return out


@dataclass(eq=False)
class Document:
    source: str
    root: Node
    front: frontmatter.Frontmatter
    off: frozenset[str]
    starts: list[int]

    def title(self) -> Node | None:
        """The only top section, if it is of level 1: it is one with the root in paths."""
        s = self.root.sections
        return s[0] if len(s) == 1 and s[0].level == 1 else None

    def walk(self):
        """All sections in document order."""
        todo = self.root.sections[::-1]
        while todo:
            s = todo.pop()
            yield s
            todo += s.sections[::-1]


def decode(data: bytes) -> str:
    """UTF-8 without its byte order mark; raises UnicodeDecodeError."""
    return data.removeprefix(b"\xef\xbb\xbf").decode()


def parse(source: str, strip: bool = True, detail: bool = True, tool: str | None = None) -> Document:
    """The document of source. strip: matchers see text without inline markup; detail: bodies and snippets for search too; tool:
    the name in comments that turn checks off, any if None."""
    if (outline := _outline(source, strip)) is not None:
        return outline
    lines = re.sub(r"\r(?!\n)", "\n", source).split("\n") if "\r" in source else source.split("\n")
    ascii_ = source.isascii()
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += (len(x) if ascii_ else len(x.encode())) + 1
    total = len(source) if ascii_ else len(source.encode())
    starts.append(total)
    if "\r" in source:
        lines = [x.removesuffix("\r") for x in lines]
    front = frontmatter.read(lines)
    shown = ["" if i < front.skip else x for i, x in enumerate(lines)] if front.skip else lines
    if "\0" in source:
        shown = [x.replace("\0", "�") for x in shown]
    p = Parser()
    tree = p.parse(shown)
    refs = p.references
    off_lines, off_file = _directives(tree, lines, tool) if "-disable" in source else ({}, frozenset())
    make = _Maker(lines, starts, total, refs, strip, detail, off_lines, ascii_)
    root = Node("root", 1, 1, 0, total)
    stack, ordinals = [root], {}
    for b in tree.children:
        if b.kind == "heading":
            if not b.marker[1]:
                continue
            s = make.section(b)
            while len(stack) > 1 and stack[-1].level >= s.level:
                stack.pop()
            s.parent = stack[-1]
            stack[-1].sections.append(s)
            stack.append(s)
            ordinals = {}
        elif not b.comments_only():
            n = make.block(b)
            n.parent, n.ordinal = stack[-1], ordinals.get(n.kind, 0)
            ordinals[n.kind] = n.ordinal + 1
            stack[-1].blocks.append(n)
    return Document(source, root, front, off_file, starts)


def _outline(source: str, strip: bool) -> Document | None:
    """As parse, of a document of ASCII that is empty lines and short headings alone; None of any other. Such lines stand for
    themselves, so each is read once for all documents that have it."""
    if source[:1] not in ("#", "\n") or not source.isascii() or "-disable" in source:
        return None
    lines, total = source.split("\n"), len(source)
    root = Node("root", 1, 1, 0, total)
    stack, starts, at = [root], [], 0
    for i, line in enumerate(lines, 1):
        starts.append(at)
        end = at + len(line) + 1
        if line:
            if line[0] != "#" or len(line) > SHORT_HEADING or (found := _heading_line(line)) is None:
                return None
            level, sound, raw, stripped_, shown = found
            if sound:
                while len(stack) > 1 and stack[-1].level >= level:
                    stack.pop()
                above = stack[-1]
                s = Node("section", i, 1, at, end if end < total else total, level, "", stripped_ if strip else shown[1], shown[0], raw, "", "", False, _NOTHING, _EMPTY, [], _EMPTY, 0, above)
                above.sections.append(s)
                stack.append(s)
        at = end
    starts.append(total)
    return Document(source, root, frontmatter.Frontmatter(), _NOTHING, starts)


@functools.lru_cache(8192)
def _heading_line(line: str) -> tuple[int, bool, str, str, tuple[str, str]] | None:
    """Of a heading line in a document without link definitions: level, whether it counts, its text as written and without
    markup, and how it is shown and reads with markup; None if it is none or may need the whole document."""
    if "\r" in line or "\0" in line:
        return None
    found = short_atx(line)
    if found is None:
        return None
    level, marker, _, raw = found
    shown = stripped(raw, {}).strip()
    return level, marker[1], raw, shown, (shown, plain(raw).strip())


def _directives(tree: Block, lines: list[str], tool: str | None) -> tuple[dict[int, frozenset[str]], frozenset[str]]:
    """Ids turned off from the line after each comment (lines from 1), and for the whole file; code holds no comments."""
    code, todo = set(), [tree]
    while todo:
        b = todo.pop()
        if b.kind == "code":
            code.update(range(b.line, b.end))
        todo += b.children
    by_line, whole = {}, set()
    for i, x in enumerate(lines):
        if "-disable" in x and i not in code:
            for m in _DIRECTIVE.finditer(x):
                if tool is not None and m[1] != tool:
                    continue
                ids = frozenset(re.findall(r"[a-z_-]+", m[3]))
                if m[2]:
                    whole |= ids
                elif m[0] == x.strip():
                    by_line[i + 2] = ids
    return by_line, frozenset(whole)


class _Maker:
    def __init__(self, lines, starts, total, refs, strip, detail, off, ascii_) -> None:
        self.lines, self.starts, self.total, self.refs, self.strip, self.detail, self.off, self.ascii = lines, starts, total, refs, strip, detail, off, ascii_

    def width(self, line: int, col: int) -> int:
        """Bytes of the line's first col characters."""
        return min(col, len(self.lines[line])) if self.ascii else len(self.lines[line][:col].encode())

    def node(self, kind: str, b: Block, line: int, col: int, first: int) -> Node:
        end = self.starts[b.end] if b.end < len(self.starts) else self.total
        return Node(kind, line + 1, self.width(line, col) + 1, self.starts[line] + self.width(line, first), min(end, self.total), off=self.off.get(line + 1, _NOTHING))

    def texts(self, raw: str) -> tuple[str, str]:
        shown = stripped(raw, self.refs)
        if shown is raw:  # no markup
            shown = shown.strip()
            return shown, shown
        return (shown if self.strip else plain(raw)).strip(), shown.strip()

    def section(self, b: Block) -> Node:
        n = self.node("section", b, b.line, b.col, b.col)
        n.level, n.raw = b.level, b.text
        n.text, n.shown = self.texts(b.text)
        return n

    def block(self, b: Block) -> Node:
        line, col = b.line, b.col
        if b.kind == "code" and not b.level:
            line, col = next((i, c + len(t) - len(t.lstrip(" \t"))) for i, c, t in b.lines if t.strip())
        n = self.node(b.kind, b, line, col, b.col)
        n.list_kind = b.list_kind
        if self.detail:
            n.body, n.snippet = self.shown(b, False), self.shown(b, True)
        if b.kind == "p":
            n.raw = b.text
            n.lead_in = self.leads(b.text, n.snippet or self.shown(b, True))
        if b.kind == "list":
            for k, item in enumerate(b.children):
                x = self.node("item", item, item.line, item.col, item.col)
                x.parent, x.ordinal = n, k
                first = item.children[0] if item.children else None
                if first is not None and first.kind == "p":
                    x.raw = first.text
                    x.text, x.shown = self.texts(first.text)
                if self.detail:
                    x.body, x.snippet = self.shown(item, False), self.shown(item, True)
                n.items.append(x)
        return n

    def shown(self, b: Block, faithful: bool) -> str:
        out, todo = [], [b]
        while todo:
            x = todo.pop()
            if x.kind in ("p", "heading"):
                out.append(visible(x.text, self.refs, faithful))
            elif x.kind == "code":
                out.append(" ".join(x.text.split()))
            todo += x.children[::-1]
        return " ".join(x for x in out if x)

    def leads(self, raw: str, text: str) -> bool:
        if text.endswith(":") and len(text) <= LEAD_IN:
            return True
        m = re.fullmatch(r"\s*(\*{1,3}|_{1,3})(?=\S)(.*\S)\1\s*", raw, re.S)
        return bool(m) and m[1][0] not in "".join(t for k, t in pieces(m[2], self.refs) if k != "code") and m[2][0] != m[1][0]
