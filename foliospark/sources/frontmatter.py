"""Frontmatter: the YAML block at the very start of a document, as rows of values."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import yaml12


@dataclass
class Frontmatter:
    """state: absent, mapping or invalid; lines of the block (from 1); body of the document starts at line skip (from 0)."""

    state: str = "absent"
    start: int = 0
    end: int = 0
    skip: int = 0
    error: str = ""
    root: yaml12.Node | None = None
    anchors: dict[str, tuple[int, int]] = field(default_factory=dict)


def escape_pointer(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def read(lines: list[str]) -> Frontmatter:
    """Of the lines of a document: the block between a first line --- and the next line ---."""
    if not lines or lines[0] != "---":
        return Frontmatter()
    close = next((i for i in range(1, len(lines)) if lines[i] == "---"), None)
    if close is None:
        last = len(lines) - (not lines[-1] and len(lines) > 1)
        return Frontmatter("invalid", 1, last, len(lines), "the block is not closed")
    f = Frontmatter("invalid", 1, close + 1, close + 1)
    try:
        root = yaml12.flat(lines[1:close]) or yaml12.parse("\n".join(lines[1:close]) + "\n")
        if root is None or root.kind != "mapping":
            raise yaml12.YamlError("not a mapping")
        if twice := yaml12.duplicates(root):
            raise yaml12.YamlError(f"duplicate key {twice[0].text}")
        _check(root)
    except (yaml12.YamlError, RecursionError) as x:
        f.error = str(x) or "nested too deep"
        return f
    f.state, f.root = "mapping", root
    _anchors(f, root, "", lines)
    return f


def _check(node: yaml12.Node) -> None:
    for k, v in node.pairs:
        if k.kind != "string":
            raise yaml12.YamlError("a key is not a string", k.line, k.col)
        _check(v)
    for v in node.items:
        _check(v)
    if node.kind in ("special", "invalid"):
        raise yaml12.YamlError(f"{node.text} has no value here", node.line, node.col)


def _anchors(f: Frontmatter, node: yaml12.Node, pointer: str, lines: list[str]) -> None:
    def place(n: yaml12.Node) -> tuple[int, int]:
        text = lines[n.line] if n.line < len(lines) else ""
        return n.line + 1, len(text[: n.col - 1].encode()) + 1

    if node.alias:  # what an alias copies has no place of its own
        return
    for k, v in node.pairs:
        p = f"{pointer}/{escape_pointer(k.text)}"
        if k.placed:
            f.anchors[p] = place(k)
        _anchors(f, v, p, lines)
    for i, v in enumerate(node.items):
        p = f"{pointer}/{i}"
        if v.placed:
            f.anchors[p] = place(v)
        _anchors(f, v, p, lines)


def rows(f: Frontmatter) -> list[tuple[str, str, str, int, int]]:
    """(pointer, kind, text, line, column) of each value, parents first."""
    out = []

    def walk(node: yaml12.Node, pointer: str) -> None:
        line, col = f.anchors.get(pointer, (f.start, 1))
        out.append((pointer, node.kind, node.text, line, col))
        for k, v in node.pairs:
            walk(v, f"{pointer}/{escape_pointer(k.text)}")
        for i, v in enumerate(node.items):
            walk(v, f"{pointer}/{i}")

    if f.root is not None:
        walk(f.root, "")
    return out


def scalars(node: yaml12.Node) -> list[str]:
    """Strings, numbers and booleans; mappings by sorted key."""
    if node.kind == "mapping":
        return [x for _, v in sorted(((k.text, v) for k, v in node.pairs), key=lambda p: p[0]) for x in scalars(v)]
    if node.kind == "sequence":
        return [x for v in node.items for x in scalars(v)]
    return [node.text.lower() if node.kind == "boolean" else node.text] if node.kind != "null" else []
