"""YAML 1.2 core: nodes with their places, exact scalars, and bounds on depth and on what aliases expand to."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

#: Levels of nesting, and nodes that aliases may expand to for each event of the text.
DEPTH, EXPANSION = 128, 100


class YamlError(ValueError):
    def __init__(self, message: str, line: int = 1, col: int = 1) -> None:
        super().__init__(message)
        self.line, self.col = line, col


@dataclass(eq=False)
class Node:
    """A mapping (pairs of key and value nodes), a sequence (items) or a scalar: its kind, text and place (from 1, 1)."""

    kind: str
    line: int
    col: int
    text: str = ""
    pairs: list[tuple[Node, Node]] = field(default_factory=list)
    items: list[Node] = field(default_factory=list)
    tag: str = ""
    plain: bool = False
    placed: bool = True
    size: int = 1
    depth: int = 1
    alias: bool = False

    def get(self, key: str) -> Node | None:
        return next((v for k, v in self.pairs if k.text == key and k.kind not in ("mapping", "sequence")), None)

    def keys(self) -> list[str]:
        return [k.text for k, _ in self.pairs]

    def value(self):
        """As Python: None, bool, Exact numbers, str, list, dict."""
        if self.kind == "mapping":
            return {k.text: v.value() for k, v in self.pairs}
        if self.kind == "sequence":
            return [v.value() for v in self.items]
        if self.kind == "null":
            return None
        if self.kind == "boolean":
            return self.text.lower() == "true"
        return Exact(self.text, self.kind) if self.kind in ("integer", "float") else self.text


class Exact:
    """A number as it is spelled, with its exact value."""

    __slots__ = ("kind", "lexeme")

    def __init__(self, lexeme: str, kind: str) -> None:
        self.lexeme, self.kind = lexeme, kind

    @property
    def number(self):
        return canonical_number(self.lexeme)[1]

    def __eq__(self, other) -> bool:
        return isinstance(other, Exact) and self.number == other.number

    def __hash__(self) -> int:
        return hash(self.number)

    def __repr__(self) -> str:
        return self.lexeme


_INT = re.compile(r"[-+]?[0-9]+")
_OCT, _HEX = re.compile(r"[-+]?0o[0-7]+"), re.compile(r"[-+]?0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?")
_SPECIAL = re.compile(r"[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")


def scalar_kind(text: str) -> str:
    """What a plain scalar is under the core schema."""
    if text in ("", "~", "null", "Null", "NULL"):
        return "null"
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return "boolean"
    if _INT.fullmatch(text) or _OCT.fullmatch(text) or _HEX.fullmatch(text):
        return "integer"
    if _FLOAT.fullmatch(text):
        return "float"
    return "special" if _SPECIAL.fullmatch(text) else "string"


def canonical_number(text: str):
    """(kind, exact value) of an integer or decimal: an int, or (digits, exponent of ten) without trailing zeros."""
    body = text.lstrip("+-")
    sign = -1 if text[:1] == "-" else 1
    if body[:2] in ("0o", "0x"):
        return "integer", sign * int(body[2:], 8 if body[1] == "o" else 16)
    if _INT.fullmatch(text):
        return "integer", int(text) if len(text) < 4000 else sign * int(body.lstrip("0")[:4000] or "0")
    mantissa, _, exponent = body.lower().partition("e")
    whole, _, part = mantissa.partition(".")
    digits, power = (whole + part).lstrip("0"), int(exponent or 0) - len(part)
    stripped = digits.rstrip("0")
    power += len(digits) - len(stripped)
    if not stripped:
        return "float", 0
    if 0 <= power <= 400:
        return "float", sign * int(stripped) * 10**power
    return "float", (sign * int(stripped), power)


_FLAT = re.compile(r"([A-Za-z_][A-Za-z0-9_]{0,60}): ([A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_])?)", re.ASCII)


def flat(lines: list[str]) -> Node | None:
    """What parse gives of lines that are all a bare key and a bare word, as most frontmatter is; None of any others."""
    found = [_FLAT.fullmatch(x) for x in lines]
    if not found or None in found:
        return None
    root = Node("mapping", 1, 1, depth=2, size=1 + 2 * len(found))
    for i, m in enumerate(found, 1):
        root.pairs.append((Node(scalar_kind(m[1]), i, 1, m[1], plain=True), Node(scalar_kind(m[2]), i, m.start(2) + 1, m[2], plain=True)))
    return root


def _marks(event) -> tuple[int, int]:
    return event.start_mark.line + 1, event.start_mark.column + 1


def parse(text: str, reject_tags: bool = False) -> Node | None:
    """The single document of text; None if it is empty. Aliases give copies, within the bounds."""
    if yaml is None:
        raise ImportError("reading YAML needs the yaml module")
    anchors: dict[str, Node] = {}
    stack: list[tuple[Node, str | None, Node | None]] = []
    root, documents, events, spent = None, 0, 0, 0

    def put(node: Node) -> None:
        nonlocal root
        if not stack:
            root = node
            return
        top, anchor, key = stack.pop()
        if top.kind == "sequence":
            top.items.append(node)
            stack.append((top, anchor, None))
        elif key is None:
            stack.append((top, anchor, node))
        else:
            top.pairs.append((key, node))
            stack.append((top, anchor, None))
        top.size += node.size
        top.depth = max(top.depth, node.depth + 1)
        if len(stack) - 1 + top.depth > DEPTH + 1:
            raise YamlError("nested too deep", node.line, node.col)

    try:
        for e in yaml.parse(text, Loader=yaml.SafeLoader):
            events += 1
            line, col = _marks(e)
            if isinstance(e, yaml.DocumentStartEvent):
                documents += 1
                if documents > 1:
                    raise YamlError("more than one document", line, col)
            elif isinstance(e, (yaml.MappingStartEvent, yaml.SequenceStartEvent)):
                node = Node("mapping" if isinstance(e, yaml.MappingStartEvent) else "sequence", line, col, tag=e.tag or "")
                if reject_tags and e.tag and not e.tag.startswith("tag:yaml.org,2002:"):
                    raise YamlError(f"tag {e.tag} is not part of the core schema", line, col)
                stack.append((node, e.anchor, None))
                if len(stack) > DEPTH:
                    raise YamlError("nested too deep", line, col)
            elif isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                node, anchor, _ = stack.pop()
                if anchor:
                    anchors[anchor] = node
                put(node)
            elif isinstance(e, yaml.AliasEvent):
                if e.anchor not in anchors:
                    raise YamlError(f"unknown alias {e.anchor}", line, col)
                was = anchors[e.anchor]
                spent += was.size
                if spent > EXPANSION * max(events, 1):
                    raise YamlError("aliases expand to too much", line, col)
                put(Node(was.kind, line, col, was.text, was.pairs, was.items, was.tag, was.plain, True, was.size, was.depth, True))
            elif isinstance(e, yaml.ScalarEvent):
                node = Node(_scalar(e, reject_tags, line, col), line, col, e.value, tag=e.tag or "", plain=e.style is None)
                node.placed = not (e.style in ("|", ">") and not e.value.strip("\n"))
                if e.anchor:
                    anchors[e.anchor] = node
                put(node)
    except yaml.YAMLError as x:
        mark = getattr(x, "problem_mark", None)
        raise YamlError(str(getattr(x, "problem", None) or x), mark.line + 1 if mark else 1, mark.column + 1 if mark else 1) from None
    return root


def _scalar(e, reject_tags: bool, line: int, col: int) -> str:
    tag = e.tag or ""
    core = "tag:yaml.org,2002:"
    if reject_tags and tag and tag not in {core + x for x in ("str", "int", "float", "bool", "null")}:
        raise YamlError(f"tag {tag} is not part of the core schema", line, col)
    if tag in (core + "str", "!"):
        return "string"
    if tag.startswith(core):
        wanted = {"int": "integer", "float": "float", "bool": "boolean", "null": "null"}.get(tag[len(core) :], "string")
        found = scalar_kind(e.value)
        return wanted if found == wanted or wanted == "string" or wanted == "float" and found == "integer" else "invalid"
    kind = scalar_kind(e.value) if e.style is None else "string"
    return kind


def duplicates(node: Node) -> list[Node]:
    """Keys that repeat an earlier key of their mapping, anywhere in the tree."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        seen = set()
        for k, v in x.pairs:
            if k.kind not in ("mapping", "sequence"):
                if k.text in seen:
                    out.append(k)
                seen.add(k.text)
            todo.append(v)
        todo += x.items
    return out
