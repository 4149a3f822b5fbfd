"""Document paths: $.slug[1].[2]..deep/list[0]/item[3] to one node of a document, its text, and listings of nodes."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from ..functions.text import SLUG, heading_slug, preview
from .document import Document, Node

BLOCKS = ("p", "list", "code", "quote", "html", "break")
MOST = 4_294_967_295
_ORDINAL = r"(?:\[(0|[1-9][0-9]*)\])?"
_STEP = re.compile(rf"(\.\.)({SLUG}){_ORDINAL}|\.({SLUG}){_ORDINAL}|\.\[(0|[1-9][0-9]*)\]")
_TERMINAL = re.compile(rf"/(list){_ORDINAL}(?:(/item){_ORDINAL})?|/(p|code|quote|html|break){_ORDINAL}")


class PathSyntax(ValueError):
    def __init__(self, message: str, offset: int) -> None:
        super().__init__(message)
        self.offset = offset


class PathFailure(ValueError):
    """Unresolved or ambiguous: done steps were resolved, up to node resolved."""

    def __init__(self, kind: str, step: str, done: int, resolved: Node, candidates: list[Node]) -> None:
        super().__init__(f"{kind} at {step}")
        self.kind, self.step, self.done, self.resolved, self.candidates = kind, step, done, resolved, candidates


@dataclass(frozen=True)
class Step:
    """kind: child, at (a position), deep, or a block's kind, or item."""

    kind: str
    slug: str = ""
    index: int | None = None

    def __str__(self) -> str:
        at = "" if self.index is None else f"[{self.index}]"
        return {"child": f".{self.slug}{at}", "deep": f"..{self.slug}{at}", "at": f".{at}"}.get(self.kind, f"/{self.kind}{at}")


def parse_path(text: str) -> list[Step]:
    """Steps of a path; raises PathSyntax with a byte offset."""
    place = lambda i: len(text[:i].encode())
    if not text.startswith("$"):
        raise PathSyntax("a path starts with $", 0)
    at, out = 1, []
    number = lambda x, d=None: d if x is None else int(x) if len(x) < 12 else MOST + 1
    while m := _STEP.match(text, at):
        if m[1]:
            out.append(Step("deep", m[2], number(m[3])))
        elif m[4]:
            out.append(Step("child", m[4], number(m[5])))
        else:
            out.append(Step("at", "", number(m[6])))
        at = m.end()
    if m := _TERMINAL.match(text, at):
        if m[1]:
            out.append(Step("list", "", number(m[2], 0)))
            if m[3]:
                out.append(Step("item", "", number(m[4], 0)))
        else:
            out.append(Step(m[5], "", number(m[6], 0)))
        at = m.end()
    if at < len(text):
        raise PathSyntax("unexpected text", place(at))
    if any(s.index is not None and s.index > MOST for s in out):
        raise PathSyntax("an index is too large", place(len(text)))
    return out


class Paths:
    """Canonical paths of one document, in document order. The root and a sole heading of level 1 are one."""

    def __init__(self, doc: Document) -> None:
        self.doc, self.title = doc, doc.title()
        self.of: dict[int, str] = {}
        self.nodes: list[Node] = []
        self._list(doc.root, "$")

    def sections(self, node: Node) -> list[Node]:
        return self.title.sections if node is self.doc.root and self.title is not None else node.sections

    def blocks(self, node: Node) -> list[Node]:
        return node.blocks + self.title.blocks if node is self.doc.root and self.title is not None else node.blocks

    def _list(self, root: Node, path: str) -> None:
        todo = [(root, path)]
        while todo:
            node, path = todo.pop()
            self._put(node, path)
            counts: dict[str, int] = {}
            for b in self.blocks(node):
                k = counts.get(b.kind, 0)
                counts[b.kind] = k + 1
                self._put(b, f"{path}/{b.kind}[{k}]")
                for x in b.items:
                    self._put(x, f"{path}/{b.kind}[{k}]/item[{x.ordinal}]")
            below = self.sections(node)
            slugs = [s.slug for s in below]
            seen: dict[str, int] = {}
            steps = []
            for i, (s, slug) in enumerate(zip(below, slugs, strict=True)):
                if not slug:
                    step = f".[{i}]"
                elif slugs.count(slug) > 1 if len(slugs) < 50 else self._many(slugs, slug):
                    step = f".{slug}[{seen.get(slug, 0)}]"
                else:
                    step = f".{slug}"
                seen[slug] = seen.get(slug, 0) + 1
                steps.append((s, path + step))
            todo += steps[::-1]

    def _many(self, slugs: list[str], slug: str) -> bool:
        if getattr(self, "_slugs", None) is not slugs:
            self._slugs, self._counts = slugs, {}
            for x in slugs:
                self._counts[x] = self._counts.get(x, 0) + 1
        return self._counts[slug] > 1

    def _put(self, node: Node, path: str) -> None:
        self.of[id(node)] = path
        self.nodes.append(node)

    def deep(self, node: Node) -> list[Node]:
        out, todo = [], self.sections(node)[::-1]
        while todo:
            s = todo.pop()
            out.append(s)
            todo += s.sections[::-1]
        return out

    def resolve(self, steps: list[Step]) -> Node:
        now = self.doc.root
        for k, s in enumerate(steps):
            if s.kind in ("child", "deep", "at"):
                pool = self.deep(now) if s.kind == "deep" else self.sections(now)
                found = pool if s.kind == "at" else [x for x in pool if x.slug == s.slug]
                if s.index is None and len(found) > 1:
                    raise PathFailure("ambiguous", str(s), k, now, found)
            else:
                found = now.items if s.kind == "item" else [b for b in self.blocks(now) if b.kind == s.kind]
            i = s.index or 0
            if i >= len(found):
                raise PathFailure("unresolved", str(s), k, now, [])
            now = found[i]
        return now

    def extent(self, node: Node) -> tuple[int, int]:
        return node.start, node.extent() if node.kind == "section" else node.end

    # Reading.

    def height(self, node: Node) -> int:
        below = self.sections(node)
        return 1 + max(map(self.height, below)) if below else 0

    def content(self, node: Node, depth: int | None = None) -> str:
        data = self.doc.source.encode()
        parts = [data[a:b] for a, b in self._slices(node, depth) if b > a]
        first = data.find(b"\n")
        end = b"\r\n" if first > 0 and data[first - 1 : first] == b"\r" else b"\n"
        out = (end * 2).join([*(re.sub(rb"(?:\r?\n)+\Z", b"", p) for p in parts[:-1]), *parts[-1:]])
        if out and not out.endswith(b"\n"):
            out += end
        return out.decode()

    def _slices(self, node: Node, depth: int | None) -> list[tuple[int, int]]:
        if node.kind not in ("root", "section") or depth is None or self.height(node) <= depth:
            return [self.extent(node)]
        below = self.sections(node)
        if node.kind == "root":
            own = (0, below[0].start)
        else:
            own = (node.start, max([node.end, *(b.end for b in node.blocks)]))
        return [own] + [x for s in below for x in (self._slices(s, depth - 1) if depth else [])]

    def tree(self, base: Node, depth: int | None = None, blocks: bool = False) -> list[Node]:
        """base and what is below it: sections, and blocks and items if asked for."""
        if base.kind not in ("root", "section"):
            return [base, *(base.items if blocks else [])]
        out, todo = [], [(base, 0)]
        while todo:
            node, d = todo.pop()
            out.append(node)
            if blocks:
                for b in self.blocks(node):
                    out += [b, *b.items]
            if depth is None or d < depth:
                todo += [(s, d + 1) for s in self.sections(node)[::-1]]
        return out

    def entry(self, node: Node) -> dict:
        """A node of a listing, members in order."""
        a, b = self.extent(node)
        out = {"mdpath": self.of[id(node)], "kind": node.kind}
        if node.kind == "root":
            out |= {"level": 1 if self.title else None, "text": self.title.shown if self.title else None}
        elif node.kind == "section":
            out |= {"level": node.level, "text": node.shown}
        elif node.kind == "list":
            out |= {"items": len(node.items)}
        else:
            out |= {"preview": self.preview(node)}
        return out | {"bytes": b - a}

    def preview(self, node: Node) -> str:
        text = self.doc.source.encode()[node.start : node.end].decode()
        if node.kind == "p":
            return preview(text)
        if node.kind != "item":
            return ""
        if node.shown is not None:
            return preview(node.shown)
        return preview(re.sub(r"\A(?:[-*+]|[0-9]+[.)])", "", text.lstrip()).lstrip())

    def label(self, node: Node, file: str = "") -> str:
        if node.kind == "root":
            return self.title.shown if self.title else file
        if node.kind == "section":
            return node.shown
        if node.kind == "list":
            return f"list ({len(node.items)} items)"
        return f"{node.kind}: {self.preview(node)}" if node.kind in ("p", "item") else node.kind

    # Help for paths that lead nowhere.

    def failure(self, steps: list[Step], x: PathFailure, file: str = "") -> dict:
        """What is told of a path that led nowhere, members in order: nodes are the listing of what was reached, candidates
        the sections that the step fits, each with its label."""
        last = steps[x.done]
        terminal = last.kind not in ("child", "at", "deep")
        listed = x.candidates if x.kind == "ambiguous" else self.tree(x.resolved, 1, terminal)
        out = {"kind": x.kind, "path": "$" + "".join(map(_explicit, steps)), "step": _explicit(last).lstrip("/") if last.kind == "deep" or terminal else _explicit(last)[1:], "resolved": self.of[id(x.resolved)]}
        return out | {"candidates" if x.kind == "ambiguous" else "nodes": [{**self.entry(n), "label": self.label(n, file)} for n in listed], "suggestions": self.suggestions(steps, x)}

    def of_heading(self, path: str, most: int = 5) -> list[str]:
        """Sections whose slug is that of a path written as a heading: $.Set Up."""
        slug = heading_slug(re.sub(r"\A\$\.\.?", "", path)) if re.match(r"\$\.", path) else ""
        return [self.of[id(s)] for s in self.deep(self.doc.root) if slug and s.slug == slug][:most]

    def suggestions(self, steps: list[Step], failure: PathFailure | None, most: int = 5) -> list[str]:
        """Canonical paths close to what was asked for, at most that many, in document order: sections of the same slug deeper
        down; else those that are the fewest typing errors away, numbers before a slug set aside. Typing errors below the
        children only count where no child is near. As many of the further steps are kept as lead somewhere."""
        at = failure.done if failure else 0
        if at >= len(steps) or failure is not None and failure.kind == "ambiguous":
            return []
        step, base = steps[at], failure.resolved if failure else self.doc.root
        if not step.slug or base.kind not in ("root", "section"):
            return []
        below, children = self.deep(base), {id(s) for s in self.sections(base)} if step.kind == "child" else set()
        found = [s for s in below if s.slug == step.slug and (failure is None or id(s) not in children)]
        if not found:
            typos = {id(s): d for s in below if s.slug != step.slug and (d := edits(s.slug, step.slug, limit(step.slug))) is not None}
            if children & typos.keys():
                typos = {k: d for k, d in typos.items() if k in children}
            for s in below:
                if (tail := _NUMBERS.sub("", s.slug)) != s.slug and (d := edits(tail, step.slug, limit(step.slug))) is not None:
                    typos[id(s)] = min(d, typos.get(id(s), d))
            least = min(typos.values(), default=None)
            found = [s for s in below if typos.get(id(s)) == least is not None]
        out = (self.of[id(self._furthest(s, steps[at + 1 :]))] for s in found)
        return list(itertools.islice(dict.fromkeys(out), most))

    def _furthest(self, section: Node, rest: list[Step]) -> Node:
        """Where the most steps of rest lead from section."""
        for n in range(len(rest), 0, -1):
            try:
                return self.resolve(parse_path(self.of[id(section)]) + rest[:n])
            except PathFailure:
                continue
        return section


def _explicit(step: Step) -> str:
    """A step as reports spell it: places of blocks and items are told."""
    return str(step) if step.kind in ("child", "at", "deep") else f"/{step.kind}[{step.index or 0}]"


_NUMBERS = re.compile(r"^(?:[0-9]+-)+")


def limit(slug: str) -> int:
    return min(3, max(1, -(-len(slug) // 3)))


def edits(a: str, b: str, most: int) -> int | None:
    """Edit distance, None if it is over most."""
    if abs(len(a) - len(b)) > most:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None
