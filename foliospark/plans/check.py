"""Documents against a schema: every rule that a document breaks, as a row. A document is one unit of work and needs no other."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..functions import typed
from ..functions.text import simple_fold
from ..operators.document import Document, Node, parse
from ..operators.sequence import assign
from ..sources import yaml12
from ..sources.frontmatter import escape_pointer
from .schema import Constraint, ContentRule, Proposition, Rule, Schema, Scope

#: Order of targets, and of what a diagnostic may point at in the schema.
TARGETS = ("header", "missing_header", "document", "frontmatter", "block", "missing_block", "item", "missing_item")
_NAMES = {"section": ("section", "sections"), "block": ("block", "blocks"), "item": ("item", "items")}


@dataclass(slots=True)
class Diagnostic:
    id: str
    line: int
    col: int
    target: dict
    message: str
    node: dict | None = None
    place: tuple[int, int] | None = None
    involved: list[tuple[list[str], int, int]] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    suppressed: bool = False


@dataclass(eq=False, slots=True)
class Bound:
    """A scope of one parent: the sections that each rule took, with what was bound below them."""

    scope: Scope
    owner: Node | None
    taken: list[list[tuple[Node, Bound | None]]]
    top: Bound | None = None
    below: list[Bound] = field(default_factory=list)


def _header(node: Node) -> dict:
    return {"kind": "header", "path": node.path}


def _costs(fits: list[list[bool]], wild: list[bool]) -> list[list[int]]:
    return [[int(w) if x else -1 for x, w in zip(f, wild, strict=True)] for f in fits]


class _Run:
    """One document's check."""

    def __init__(self, schema: Schema, doc: Document, titled: bool = False) -> None:
        self.schema, self.doc, self.out, self.fitting = schema, doc, [], titled
        self.front: dict[str, tuple[str, object]] = {}

    def emit(self, id_: str, target: dict, message: str, at: Node | tuple[int, int] = (1, 1), node: dict | None = None, place=None, off: frozenset = frozenset(), **more) -> None:
        line, col = (at.line, at.col) if isinstance(at, Node) else at
        if isinstance(at, Node) and not target["kind"].startswith("missing"):
            off = at.off
        self.out.append(Diagnostic(id_, line, col, target, message, node, place, suppressed=id_ in self.doc.off or id_ in off, **more))

    def run(self) -> list[Diagnostic]:
        s, root = self.schema, self.doc.root
        self.frontmatter()
        tops = root.sections
        h1 = [x for x in tops if x.level == 1]
        self.base = 1 if s.title is False or s.title and not h1 else 0
        self.levels()
        if s.title is None:
            self.content(root, s.root.content, {"kind": "document"}, True)
            self.constraints(self.bind(s.root, None, self.admitted(root), False))
        elif s.title is False:
            for x in h1:
                self.emit("not-allowed", _header(x), "no title may stand", x, {"kind": "title"}, s.title_place)
            self.content(root, s.root.content, {"kind": "document"}, True)
            self.constraints(self.bind(s.root, None, [x for x in self.admitted(root) if x.level > 1], True))
        else:
            self.titled(h1, [x for x in self.admitted(root) if x.level > 1])
        return self.out

    def titled(self, h1: list[Node], loose: list[Node]) -> None:
        s, title = self.schema, {"kind": "title"}
        if not h1:
            self.emit("missing-title", {"kind": "missing_header", "parent": [], "matcher": s.title.label}, f"no title {s.title.label}", (1, 1), title, s.title_place)
            self.constraints(self.bind(s.root, None, loose, True))
            return
        for x in h1:
            if not self.fitting and not s.title.matches(x.text):
                self.emit("not-allowed", _header(x), f"the title is not {s.title.label}", x, title, s.title_place)
        if len(h1) > 1:
            self.emit("too-many-sections", _header(h1[1]), "more than one title", h1[1], title, s.title_place)
        for k, x in enumerate(h1):
            self.content(x, s.root.content, title, len(h1) == 1)
            self.constraints(self.bind(s.root, x, (loose if not k else []) + self.admitted(x), len(h1) == 1))

    # Structure.

    def admitted(self, parent: Node) -> list[Node]:
        """Child sections one level down; all of them if levels may be skipped."""
        level = parent.level if parent.kind == "section" else self.base
        return [x for x in parent.sections if self.schema.skips or x.level <= level + 1]

    def levels(self) -> None:
        if self.schema.skips:
            return
        for x in self.doc.walk():
            above = x.parent.level if x.parent.kind == "section" else self.base
            if x.level > above + 1:
                self.emit("skipped-level", _header(x), f"level {x.level} under level {above}", x)

    def bind(self, scope: Scope, owner: Node | None, children: list[Node], voice: bool, top: Bound | None = None) -> Bound:
        """voice: what is missing is missing from the document, not from owner."""
        kept = []
        for x in children if scope.guards else ():
            guard = next((i for i, (m, _) in enumerate(scope.guards) if m.matches(x.text)), None)
            if guard is None:
                kept.append(x)
            else:
                self.emit("not-allowed", _header(x), f"{scope.guards[guard][0].label} is not allowed here", x, {"kind": "guard", "scope": list(scope.path), "index": guard}, scope.guards[guard][1])
        if not scope.guards:
            kept = list(children)
        bound = Bound(scope, None if voice else owner, [[] for _ in scope.rules or []])
        bound.top = top or bound
        if scope.rules is None:
            return bound
        fits = [scope.fits(x.text) for x in kept] if scope.rules else [[]] * len(kept)
        if scope.extras:
            kept = [x for x, f in zip(kept, fits, strict=True) if any(f)]
            fits = [f for f in fits if any(f)]
        if scope.unordered:
            rules = [f.index(True) if True in f else -1 for f in fits]
        elif not scope.rules:
            rules = [-1] * len(kept)
        else:
            wild = [r.matcher.kind == "any" for r in scope.rules]
            rules, _ = assign(_costs(fits, wild), [r.low for r in scope.rules], [r.high for r in scope.rules], wild)
        parent = [] if voice or owner is None else owner.path
        at = (1, 1) if voice or owner is None else owner
        above = self.owner_of(scope)
        for x, f, j in zip(kept, fits, rules, strict=True):
            if j < 0:
                id_ = "misplaced-section" if any(f) else "unexpected-section"
                self.emit(id_, _header(x), f"{x.shown} is {'out of place' if any(f) else 'not expected'} here", x, *above)
            else:
                bound.taken[j].append((x, None))
        for j, r in enumerate(scope.rules):
            nodes = [x for x, _ in bound.taken[j]]
            own = {"kind": "rule", "scope": list(scope.path), "index": j}
            self.counts("section", nodes, r, {"kind": "missing_header", "parent": parent, "matcher": r.matcher.label}, at, own, _header)
            self.captured(r, nodes, own)
            if r.scope.says_nothing():
                continue
            for k, x in enumerate(nodes):
                self.content(x, r.scope.content, own, False)
                inner = self.bind(r.scope, x, self.admitted(x), False, bound.top)
                bound.taken[j][k] = (x, inner)
                bound.below.append(inner)
        return bound

    def owner_of(self, scope: Scope) -> tuple[dict | None, tuple[int, int] | None]:
        if scope.path:
            rules = self.schema.root.rules
            for i in scope.path[:-1]:
                rules = rules[i].scope.rules
            return {"kind": "rule", "scope": list(scope.path[:-1]), "index": scope.path[-1]}, rules[scope.path[-1]].place
        return (None, None) if self.schema.title is None else ({"kind": "title"}, self.schema.title_place)

    def counts(self, what: str, nodes: list[Node], rule, missing: dict, at, own: dict, target) -> None:
        one, many = _NAMES[what]
        n, label = len(nodes), missing["matcher"] if isinstance(missing["matcher"], str) else json.dumps(missing["matcher"])
        if n < rule.low:
            id_ = f"missing-{one}" if not n else f"too-few-{many}"
            self.emit(id_, missing, f"{n} of at least {rule.low} {many} {label}", at, own, rule.place)
        if rule.high is not None and n > rule.high:
            self.emit(f"too-many-{many}", target(nodes[rule.high]), f"{n} of at most {rule.high} {many} {label}", nodes[rule.high], own, rule.place)

    def captured(self, rule: Rule, nodes: list[Node], own: dict) -> None:
        if not rule.captures:
            return
        keys: dict[str, list] = {c: [] for c in rule.captures}
        for x in nodes:
            taken = rule.matcher.captures(x.text)
            for name, kind in rule.captures.items():
                try:
                    keys[name].append((typed.parse(kind, taken[name] or ""), taken[name]))
                except typed.Invalid as why:
                    keys[name].append(None)
                    self.emit("invalid-value", _header(x), f"capture {name} of type {kind}: {taken[name]} is {why}", x, {**own, "kind": "capture", "name": name}, rule.place)
        for k, o in enumerate(rule.order):
            seen = keys[o.by]
            if any(v is None for v in seen):
                continue
            for i in range(1, len(seen)):
                a, b = (seen[i - 1], seen[i]) if not o.descending else (seen[i], seen[i - 1])
                if not (a[0] < b[0] or a[0] == b[0] and not o.strict):
                    pair = [(n.path, n.line, n.col) for n in nodes[i - 1 : i + 1]]
                    self.emit("order-violation", _header(nodes[i]), f"{o.by}: {seen[i][1]} after {seen[i - 1][1]}", nodes[i], {**own, "kind": "order_entry", "order_index": k}, rule.place, involved=pair)

    # Blocks and items.

    def content(self, owner: Node, rules: list[ContentRule] | None, schema_owner: dict, voice: bool) -> None:
        if rules is None:
            return
        blocks = owner.blocks
        edges = [[min((int(kind == "any") for kind, lk in r.alternatives if kind == "any" or kind == b.kind and lk in (None, b.list_kind)), default=-1) for r in rules] for b in blocks]
        taken, _ = assign(edges, [r.low for r in rules], [r.high for r in rules], [r.reluctant for r in rules])
        target = lambda b: {"kind": "block", "parent": owner.path, "block": b.kind, "index": b.ordinal}
        section = owner.kind == "section" and not voice
        above = schema_owner if schema_owner["kind"] != "document" else None
        for b, e, j in zip(blocks, edges, taken, strict=True):
            if j < 0:
                fits = max(e, default=-1) >= 0
                self.emit("misplaced-block" if fits else "unexpected-block", target(b), f"this {b.kind} is {'out of place' if fits else 'not expected'} here", b, above)
        for j, r in enumerate(rules):
            own = {"kind": "content_rule", "owner": schema_owner, "index": j}
            mine = [b for b, k in zip(blocks, taken, strict=True) if k == j]
            self.counts("block", mine, r, {"kind": "missing_block", "parent": owner.path if section else [], "matcher": r.label()}, owner if section else (1, 1), own, target)
            if r.items is not None:
                for b in mine:
                    if b.kind == "list":
                        self.items(b, owner, r, own)

    def items(self, listed: Node, owner: Node, rule: ContentRule, content: dict) -> None:
        rules, nodes = rule.items, listed.items
        where = {"parent": owner.path, "index": listed.ordinal}
        wild = [r.matcher.kind == "any" for r in rules]
        fits = [[r.matcher.matches(x.text) for r in rules] for x in nodes]
        taken, _ = assign(_costs(fits, wild), [r.low for r in rules], [r.high for r in rules], wild)
        target = lambda x: {"kind": "item", "list": where, "index": x.ordinal}
        for x, f, j in zip(nodes, fits, taken, strict=True):
            if j < 0:
                self.emit("misplaced-item" if any(f) else "unexpected-item", target(x), f"item {x.ordinal} is {'out of place' if any(f) else 'not expected'}", x, content, rule.place)
        for j, r in enumerate(rules):
            mine = [x for x, k in zip(nodes, taken, strict=True) if k == j]
            self.counts("item", mine, r, {"kind": "missing_item", "list": where, "matcher": r.matcher.label}, (listed.line, listed.col), {"kind": "item_rule", "content": {k: content[k] for k in ("owner", "index")}, "index": j}, target)

    # Frontmatter.

    def frontmatter(self) -> None:
        s, f = self.schema, self.doc.front
        node = {"kind": "frontmatter"}
        whole = {"kind": "frontmatter"} if f.state == "absent" else {"kind": "frontmatter", "line_range": {"start_line": f.start, "end_line": f.end}}
        if f.state == "absent":
            if s.front_required:
                self.emit("missing-frontmatter", whole, "a frontmatter block is required", (1, 1), node)
            state = ("suppressed", None) if s.front_required else ("absent", None)
            self.front = {c.name: state for c in s.front_captures}
            return
        if not s.front_allowed:
            self.emit("forbidden-frontmatter", whole, "no frontmatter block may stand", (1, 1), node)
        if f.state == "invalid":
            self.emit("invalid-frontmatter", whole, f.error, (1, 1), node)
            self.front = {c.name: ("suppressed", None) for c in s.front_captures}
            return
        if s.front_schema is not None:
            for pointer, message in sorted(s.front_schema.errors(f.root.value())):
                self.emit("frontmatter-schema", {**whole, "pointer": pointer}, message, f.anchors.get(pointer, (1, 1)), {"kind": "frontmatter_schema_declaration"})
        for c in s.front_captures:
            self.front[c.name] = self.front_value(c, whole)

    def nearest(self, pointer: str) -> tuple[int, int]:
        while pointer and pointer not in self.doc.front.anchors:
            pointer = pointer.rpartition("/")[0]
        return self.doc.front.anchors.get(pointer, (1, 1))

    def front_value(self, c, whole: dict) -> tuple[str, object]:
        root = self.doc.front.root
        own = {"kind": "frontmatter_capture", "name": c.name}
        found = c.path.nodes(root)
        if not found or found[0][1].kind == "null":
            if not c.required:
                return "absent", None
            pointer = "".join("/" + escape_pointer(str(p)) for p in found[0][0]) if found else self.absent_pointer(c.path, root)
            target = whole if pointer is None else {**whole, "pointer": pointer}
            self.emit("missing-value", target, f"capture {c.name} needs a value", self.nearest(pointer or ""), own, c.place)
            return "suppressed", None
        path, node = found[0]
        try:
            wanted = typed.KINDS.get(c.type, "string")
            if node.kind != wanted:
                raise typed.Invalid(f"a {node.kind}, not a {wanted}" + ("; quote it" if node.kind == "float" else ""))
            if c.type == "bool":
                return "bound", node.text.lower() == "true"
            if c.type == "int":
                n = yaml12.canonical_number(node.text)[1]
                if not -(1 << 63) <= n < 1 << 63:
                    raise typed.Invalid("out of the range of 64 bits")
                return "bound", True
            typed.parse(c.type, node.text)
            return "bound", True
        except typed.Invalid as why:
            pointer = "".join("/" + escape_pointer(str(p)) for p in path)
            self.emit("invalid-value", {**whole, "pointer": pointer}, f"capture {c.name} of type {c.type}: {why}", self.nearest(pointer), own, c.place)
            return "suppressed", None

    @staticmethod
    def absent_pointer(query, root) -> str | None:
        out, node = "", root
        for _, [(kind, key)] in query.segments:
            if kind == "index" and key < 0:
                n = len(node.items) if node is not None and node.kind == "sequence" else 0
                if n + key < 0:
                    return None
                key += n
            out += "/" + escape_pointer(str(key))
            if node is not None:
                node = node.get(key) if kind == "name" and node.kind == "mapping" else node.items[key] if kind == "index" and node.kind == "sequence" and key < len(node.items) else None
        return out

    # Constraints.

    def constraints(self, bound: Bound) -> None:
        for c in bound.scope.constraints:
            self.constraint(c, bound)
        for b in bound.below:
            self.constraints(b)

    def constraint(self, c: Constraint, bound: Bound) -> None:
        own = {"kind": "constraint", "scope": list(bound.scope.path), "index": c.index}
        headers: dict[int, Node] = {}
        values, hidden = [], False
        for p in [*([c.condition] if c.condition else []), *c.operands]:
            value, off = self.truth(p, bound, own, c, headers)
            values.append(value)
            hidden |= off
        if hidden:
            return
        if c.kind == "ordered":
            lists = [x for x in values if x]
            ok = all(max(n.start for n in a) < min(n.start for n in b) for a, b in zip(lists, lists[1:], strict=False))
        else:
            v = [bool(x) for x in values]
            n = sum(v)
            ok = {
                "one_of": n == 1,
                "any_of": n >= 1,
                "at_most_one": n <= 1,
                "all_or_none": n in (0, len(v)),
                "requires": not v[0] or all(v[1:]),
                "conflicts": not v[0] or not any(v[1:]),
            }[c.kind]
        if not ok:
            owner = bound.owner
            involved = [(n.path, n.line, n.col) for _, n in sorted(headers.items())]
            if c.references is None:
                c.references = [self.reference(p, bound) for p in [*([c.condition] if c.condition else []), *c.operands]]
            target = {"kind": "document"} if owner is None else _header(owner)
            self.emit(c.kind, target, f"{c.kind} of {', '.join(p.locator for p in c.operands)} does not hold", (1, 1) if owner is None else owner, own, c.place, involved=involved, references=c.references)

    def truth(self, p: Proposition, bound: Bound, own: dict, c: Constraint, headers: dict[int, Node]):
        """(value, whether it can't be told): for a section the sections found, else a boolean."""
        if p.kind == "capture":
            state, value = self.front.get(p.name, ("absent", None))
            return state == "bound" and value is not False, state == "suppressed"
        if p.kind == "query":
            return self.queried(p, own, c)
        now = bound.top if p.absolute else bound
        for k, (rule, position) in enumerate(p.steps):
            taken = now.taken[rule]
            if position is not None:
                taken = taken[position : position + 1]
            if k == len(p.steps) - 1:
                headers.update({n.start: n for n, _ in taken})
                return [n for n, _ in taken], False
            if len(taken) > 1:
                return [], True
            if not taken:
                return [], False
            now = taken[0][1]
        return [], False

    def queried(self, p: Proposition, own: dict, c: Constraint):
        f = self.doc.front
        if f.state != "mapping":
            return False, f.state == "invalid"
        found = [(path, n) for path, n in p.query.nodes(f.root) if n.kind != "null"]
        if p.equals is not None:
            kind, text = p.equals
            return any(n.kind == kind and self.same(kind, n.text, text) for _, n in found), False
        bad = [(path, n) for path, n in found if n.kind != "boolean"]
        for path, n in bad:
            pointer = "".join("/" + escape_pointer(str(x)) for x in path)
            target = {"kind": "frontmatter", "line_range": {"start_line": f.start, "end_line": f.end}, "pointer": pointer}
            self.emit("invalid-value", target, f"{p.locator} reads a boolean, not a {n.kind}", self.nearest(pointer), own, c.place)
        return any(n.kind == "boolean" and n.text.lower() == "true" for _, n in found), bool(bad)

    def same(self, kind: str, a: str, b: str) -> bool:
        if kind in ("integer", "float"):
            return yaml12.canonical_number(a) == yaml12.canonical_number(b)
        if kind == "boolean":
            return a.lower() == b.lower()
        return a == b if self.schema.match_case else simple_fold(a) == simple_fold(b)

    def reference(self, p: Proposition, bound: Bound) -> dict:
        if p.kind == "capture":
            kind = next(c.type for c in self.schema.front_captures if c.name == p.name)
            return {"kind": "frontmatter_capture", "locator": p.locator, "name": p.name, "type": kind}
        if p.kind == "query":
            out = {"kind": "frontmatter_query", "locator": p.locator, "query": p.query.source}
            if p.equals is not None:
                kind, text = p.equals
                out["equals"] = {"type": kind, "value": text.lower() == "true" if kind == "boolean" else None if kind == "null" else text}
            return out
        scope, names, rule = bound.top.scope if p.absolute else bound.scope, [], None
        for i, _ in p.steps:
            rule = scope.rules[i]
            names.append(rule.name or "")
            scope = rule.scope
        m = {"kind": rule.matcher.kind} | ({} if rule.matcher.kind == "any" else {"value": rule.matcher.source})
        at = [i for _, i in p.steps]
        return {"kind": "rule", "locator": p.locator, "anchor": "schema_root" if p.absolute else "current_scope", "path": names} | ({"positions": at} if any(i is not None for i in at) else {}) | {"matcher": m}


def checks(schema: Schema, doc: Document, titled: bool = False) -> list[Diagnostic]:
    """Every diagnostic of a document, those that it turns off too. titled: its title is known to fit, whatever it says here."""
    return _Run(schema, doc, titled).run()


def check(schema: Schema, source: str, all_of_them: bool = False, tool: str | None = None) -> list[Diagnostic]:
    """The diagnostics of one document; with all_of_them those that the document turns off too, by comments of tool (None:
    of any)."""
    doc = parse(source, schema.strip, detail=False, tool=tool)
    return [d for d in checks(schema, doc) if all_of_them or not d.suppressed]


def target_key(t: dict) -> tuple:
    """Sorts targets: by kind, then by their members in order, absent ones first."""

    def key(x):
        if isinstance(x, dict):
            return tuple((0,) if k not in x else (1, key(x[k])) for k in ("path", "parent", "list", "block", "one_of", "list_kind", "matcher", "line_range", "start_line", "end_line", "pointer", "index") if True)
        if isinstance(x, list):
            return tuple(key(y) for y in x)
        return x.encode() if isinstance(x, str) else x

    m = t.get("matcher")
    rank = (0,) if not isinstance(m, dict) else (int("one_of" in m),)
    return TARGETS.index(t["kind"]), key({k: v for k, v in t.items() if k not in ("kind", "matcher")}), rank, key(m) if m is not None else ()
