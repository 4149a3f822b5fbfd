"""The schema language: YAML text to a checked plan, or to all of its errors with their places."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from ..functions.patterns import CAPTURE_NAME, Matcher, PatternError
from ..functions.text import SLUG, heading_slug
from ..functions.typed import TYPES
from ..sources import yaml12
from ..sources.yaml12 import Node, YamlError, scalar_kind
from . import jsonpath, jsonschema

MOST = 4_294_967_295
RESERVED = ("fm", "linkdefs")
LISTS = ("one_of", "any_of", "at_most_one", "all_or_none", "ordered")
_REPEAT = re.compile(r"(0|[1-9][0-9]*)\.\.(0|[1-9][0-9]*|n)")
_SCOPE_KEYS = ("content", "sections", "forbid_sections", "extras", "unordered", "constraints")


@dataclass(frozen=True)
class SchemaError:
    id: str
    message: str
    line: int
    col: int


class SchemaErrors(ValueError):
    def __init__(self, errors: list[SchemaError]) -> None:
        super().__init__("; ".join(f"{e.line}:{e.col} {e.id} {e.message}" for e in errors))
        self.errors = errors


@dataclass(eq=False)
class Order:
    by: str
    descending: bool
    strict: bool


@dataclass(eq=False)
class ItemRule:
    matcher: Matcher
    low: int
    high: int | None
    id: str | None
    place: tuple[int, int] = (1, 1)


@dataclass(eq=False)
class ContentRule:
    """alternatives: (block, list kind or None), a single one unless one_of."""

    alternatives: list[tuple[str, str | None]]
    choice: bool
    low: int
    high: int | None
    id: str | None
    items: list[ItemRule] | None = None
    place: tuple[int, int] = (1, 1)

    def label(self) -> dict:
        each = [{"block": b} | ({"list_kind": k} if k else {}) for b, k in self.alternatives]
        return {"one_of": each} if self.choice else each[0]

    @property
    def reluctant(self) -> bool:
        return not self.choice and self.alternatives[0][0] == "any"


@dataclass(eq=False)
class Scope:
    """What a parent says of its child sections; rules None: it says nothing of their grammar."""

    rules: list[Rule] | None = None
    guards: list[tuple[Matcher, tuple[int, int]]] = field(default_factory=list)
    extras: bool = False
    unordered: bool = False
    constraints: list[Constraint] = field(default_factory=list)
    content: list[ContentRule] | None = None
    path: tuple[int, ...] = ()
    names: dict = field(default_factory=dict)
    known: dict[str | None, list[bool]] = field(default_factory=dict, repr=False)

    def fits(self, text: str | None) -> list[bool]:
        """Which rules match a heading's text; what short texts fit is kept for when they come again."""
        found = self.known.get(text)
        if found is None:
            found = [r.matcher.matches(text) for r in self.rules]
            if text is not None and len(text) <= 200:
                if len(self.known) >= 2000:
                    self.known.clear()
                self.known[text] = found
        return found

    def says_nothing(self) -> bool:
        """Whether nothing that stands in the scope can break it."""
        return self.rules is None and self.content is None and not self.guards and not self.constraints


@dataclass(eq=False)
class Rule:
    matcher: Matcher
    low: int
    high: int | None
    id: str | None
    scope: Scope
    captures: dict[str, str] = field(default_factory=dict)
    order: list[Order] = field(default_factory=list)
    place: tuple[int, int] = (1, 1)

    @property
    def name(self) -> str | None:
        return self.id or (heading_slug(self.matcher.source) or None if self.matcher.kind == "exact" else None)


@dataclass(eq=False)
class Proposition:
    """kind section: steps of (rule index, position or None) from the constraint's scope, or from the outermost if absolute;
    declared are the steps from the outermost in either case; query: a JSONPath with an optional (kind, text) to equal; capture: a name."""

    kind: str
    locator: str
    steps: list[tuple[int, int | None]] = field(default_factory=list)
    absolute: bool = False
    query: jsonpath.Query | None = None
    equals: tuple[str, str] | None = None
    name: str = ""
    declared: tuple = ()

    def identity(self, match_case: bool = False):
        if self.kind == "section":
            return ("section", self.declared)
        if self.kind == "capture":
            return ("capture", self.name)
        e = self.equals
        if e is not None:
            from ..functions.text import simple_fold

            kind, text = e
            e = (kind, str(yaml12.canonical_number(text)) if kind in ("integer", "float") else text.lower() if kind == "boolean" else "" if kind == "null" else text if match_case else simple_fold(text))
        return ("query", self.query.source, e)


@dataclass(eq=False)
class Constraint:
    kind: str
    operands: list[Proposition]
    condition: Proposition | None = None
    place: tuple[int, int] = (1, 1)
    index: int = 0
    references: list[dict] | None = None  # how diagnostics name the operands, made when first needed


@dataclass(eq=False)
class FrontCapture:
    name: str
    type: str
    path: jsonpath.Query
    required: bool
    place: tuple[int, int] = (1, 1)


@dataclass(eq=False)
class Schema:
    """root is the top scope: of level 1 headings under outline, else of level 2. title: None under outline, else a
    matcher, or False where no title may stand."""

    root: Scope
    title: Matcher | bool | None
    match_case: bool = False
    strip: bool = True
    skips: bool = False
    front_required: bool = False
    front_allowed: bool = True
    front_schema: jsonschema.Validator | None = None
    front_captures: list[FrontCapture] = field(default_factory=list)
    title_place: tuple[int, int] = (1, 1)


class _Loader:
    def __init__(self, text: str, resources: dict) -> None:
        self.errors: list[SchemaError] = []
        self.resources = resources
        self.pending: list[tuple[Scope, Node, list[Scope]]] = []
        self.text = text

    def fail(self, id_: str, node, message: str) -> None:
        line, col = (node.line, node.col) if isinstance(node, Node) else node
        self.errors.append(SchemaError(id_, message, line, col))

    def load(self) -> Schema:
        try:
            root = yaml12.parse(self.text, reject_tags=True)
        except (YamlError, RecursionError) as x:
            raise SchemaErrors([SchemaError("syntax", str(x), getattr(x, "line", 1), getattr(x, "col", 1))]) from None
        if root is None or root.kind != "mapping":
            raise SchemaErrors([SchemaError("invalid-document-shape", "a schema is a mapping", 1, 1)])
        for key, captures in self._twice(root):
            self.fail("invalid-capture" if captures else "syntax", key, f"duplicate key {key.text}")
        if self.errors:
            raise SchemaErrors(self.errors)
        schema = self._schema(root)
        if not self.errors and schema is not None:
            for scope, node, chain in self.pending:
                self._constraints(scope, node, chain, schema)
        if self.errors:
            raise SchemaErrors(sorted(self.errors, key=lambda e: (e.line, e.col, e.id)))
        return schema

    def _twice(self, node: Node, inside: bool = False):
        out, seen = [], set()
        for k, v in node.pairs:
            if k.kind in ("mapping", "sequence"):
                continue
            if k.text in seen:
                out.append((k, inside))
            seen.add(k.text)
            if not v.alias:
                out += self._twice(v, k.text == "captures" and v.kind == "mapping")
        for v in node.items:
            out += self._twice(v) if not v.alias else []
        return out

    def keys(self, node: Node, allowed: tuple[str, ...], id_: str = "invalid-document-shape") -> dict[str, tuple[Node, Node]]:
        """Key and value of each allowed key; others are errors."""
        out = {}
        for k, v in node.pairs:
            if k.kind != "string" or k.text not in allowed:
                self.fail(id_, k, f"unknown key {k.text}")
            else:
                out[k.text] = (k, v)
        return out

    def boolean(self, pair, default=None, id_: str = "invalid-document-shape"):
        if pair is None:
            return default
        if pair[1].kind != "boolean":
            self.fail(id_, pair[1], f"{pair[0].text} must be a boolean")
            return default
        return pair[1].text.lower() == "true"

    def _schema(self, root: Node) -> Schema | None:
        got = self.keys(root, ("version", "options", "frontmatter", "outline", "title", *_SCOPE_KEYS))
        version = got.get("version")
        if version is None or version[1].kind != "integer":
            self.fail("invalid-document-shape", version[1] if version else root, "version must be an integer")
        elif yaml12.canonical_number(version[1].text)[1] != 1:
            self.fail("unsupported-version", version[1], f"version {version[1].text}")
        options = {"match_case": False, "strip_inline_markup": True, "allow_skipped_levels": False}
        if "options" in got:
            if got["options"][1].kind != "mapping":
                self.fail("invalid-document-shape", got["options"][1], "options must be a mapping")
            else:
                for k, pair in self.keys(got["options"][1], tuple(options)).items():
                    options[k] = self.boolean(pair, options[k])
        self.match_case = options["match_case"]
        outline = "outline" in got
        others = [got[k][0] for k in ("title", "sections") if k in got]
        if outline and others:
            shape = sorted([got["outline"][0], *others], key=lambda n: (n.line, n.col))
            self.fail("conflicting-outline", shape[1], "outline beside title or sections")
            return None
        if not outline and not others:
            for k in ("content", "forbid_sections", "extras", "unordered", "constraints"):
                if k in got:
                    self.fail("invalid-document-shape", got[k][0], f"{k} needs outline, title or sections")
            self.fail("invalid-document-shape", root, "outline, title or sections is needed")
            return None
        title: Matcher | bool | None = None
        place = (1, 1)
        if not outline:
            pair = got.get("title")
            place = (pair or got["sections"])[0].line, (pair or got["sections"])[0].col
            if pair is None:
                title = Matcher("any", "*", self.match_case)
            elif pair[1].kind == "null":
                title = False
            elif pair[1].kind != "string":
                self.fail("invalid-document-shape", pair[1], "title must be a string or null")
            else:
                title = self.matcher(pair[1])
        accept = "outline" if outline else "sections"
        scope = self._scope({("sections" if k == accept else k): v for k, v in got.items() if k == accept or k in _SCOPE_KEYS}, (), [])
        schema = Schema(scope, title, self.match_case, options["strip_inline_markup"], options["allow_skipped_levels"], title_place=place)
        if "frontmatter" in got:
            self._front(schema, got["frontmatter"][1])
        return schema

    def matcher(self, node: Node, id_: str = "invalid-document-shape") -> Matcher | None:
        if node.kind != "string":
            self.fail(id_, node, "a matcher is a string")
            return None
        try:
            return Matcher.of(node.text, self.match_case)
        except PatternError as x:
            self.fail("invalid-matcher", node, str(x))
            return None

    def count(self, got: dict, exempt: bool, place: Node) -> tuple[int, int | None]:
        """Least and most; exempt rules have the default 1..1 for any matcher."""
        required, repeat = got.get("required"), got.get("repeat")
        misshaped = [x for x, kind in ((required, "boolean"), (repeat, "string")) if x and x[1].kind != kind]
        for x in misshaped:
            self.fail("invalid-document-shape", x[1], f"{x[0].text} must be a {'boolean' if x is required else 'string'}")
        if misshaped:
            return 1, 1
        if required and repeat:
            self.fail("conflicting-cardinality", max(required[0], repeat[0], key=lambda n: (n.line, n.col)), "required beside repeat")
            return 1, 1
        if required:
            return (1, 1) if self.boolean(required, True) else (0, 1)
        if repeat:
            m = _REPEAT.fullmatch(repeat[1].text)
            if m and int(m[1]) <= MOST and (m[2] == "n" or max(1, int(m[1])) <= int(m[2]) <= MOST):
                return int(m[1]), None if m[2] == "n" else int(m[2])
            self.fail("invalid-repeat", repeat[1], f"repeat {repeat[1].text}")
            return 1, 1
        if not exempt and place.kind == "string" and ("*" in place.text or len(place.text) > 1 and place.text[0] == place.text[-1] == "/"):
            self.fail("missing-cardinality", place, "a pattern needs required or repeat")
        return 1, 1

    def ident(self, got: dict, outermost: bool) -> str | None:
        if "id" not in got:
            return None
        node = got["id"][1]
        if node.kind != "string" or not re.fullmatch(SLUG, node.text):
            self.fail("invalid-document-shape", node, f"id {node.text}")
            return None
        if outermost and node.text in RESERVED:
            self.fail("reserved-id", node, f"id {node.text} is reserved")
            return None
        return node.text

    def _scope(self, got: dict, path: tuple[int, ...], chain: list[Scope], captures: dict | None = None) -> Scope:
        """got: the scope's keys, its accepting list as sections. captures: names that its owner's captures take."""
        scope = Scope(path=path)
        chain = [*chain, scope]
        names: dict[str, tuple[Node, object]] = dict(captures or {})

        def name(key: str | None, node: Node, what) -> None:
            if key is None:
                return
            if key in names:
                later = max(node, names[key][0], key=lambda n: (n.line, n.col))
                self.fail("duplicate-id", later, f"name {key} repeats")
            else:
                names[key] = (node, what)

        if "content" in got:
            scope.content = self._content(got["content"][1], not path, name)
        if "sections" in got:
            listed = got["sections"][1]
            if listed.kind != "sequence":
                self.fail("invalid-document-shape", listed, "a list of rules is needed")
                scope.rules = []
            else:
                scope.rules = []
                for i, node in enumerate(listed.items):
                    if (rule := self._rule(node, (*path, i), chain, not path)) is not None:
                        scope.rules.append(rule)
                        name(rule.name, node, ("rule", i))
        if "forbid_sections" in got:
            listed = got["forbid_sections"][1]
            if listed.kind != "sequence":
                self.fail("invalid-document-shape", listed, "a list of guards is needed")
            for node in listed.items:
                if node.kind != "mapping":
                    self.fail("invalid-document-shape", node, "a guard is a mapping")
                    continue
                g = self.keys(node, ("match",))
                if "match" not in g:
                    self.fail("invalid-document-shape", node, "a guard needs match")
                elif (m := self.matcher(g["match"][1])) is not None:
                    scope.guards.append((m, (g["match"][1].line, g["match"][1].col)))
        if "extras" in got:
            if got["extras"][1].kind != "string" or got["extras"][1].text != "anywhere":
                self.fail("invalid-document-shape", got["extras"][1], "extras must be anywhere")
            scope.extras = True
        scope.unordered = bool(self.boolean(got.get("unordered"), False))
        for k in ("extras", "unordered", "constraints"):
            if k in got and "sections" not in got:
                self.fail("invalid-document-shape", got[k][0], f"{k} needs a list of sections")
        if scope.unordered and scope.rules:
            wild = next((i for i, r in enumerate(scope.rules) if r.matcher.kind == "any"), None)
            for r in scope.rules[wild + 1 :] if wild is not None else []:
                self.fail("unreachable-rule", r.place, "a wildcard takes all before it")
        scope.names = {k: v[1] for k, v in names.items()}
        if "constraints" in got:
            self.pending.append((scope, got["constraints"][1], chain))
        return scope

    def _rule(self, node: Node, path: tuple[int, ...], chain: list[Scope], outermost: bool) -> Rule | None:
        if node.kind != "mapping":
            self.fail("invalid-document-shape", node, "a rule is a mapping")
            return None
        got = self.keys(node, ("id", "match", "required", "repeat", "captures", "order", *_SCOPE_KEYS))
        if "match" not in got:
            self.fail("invalid-document-shape", node, "a rule needs match")
            return None
        m = self.matcher(got["match"][1])
        low, high = self.count(got, False, got["match"][1])
        ident = self.ident(got, outermost)
        before = len(self.errors)
        captures = self._captures(got.get("captures"), m)
        names = {k: (n, ("capture", t)) for k, (n, t) in captures.items()}
        order = self._order(got.get("order"), {k: t for k, (_, t) in captures.items()}, high) if len(self.errors) == before else []
        scope = self._scope({k: v for k, v in got.items() if k in _SCOPE_KEYS}, path, chain, names)
        if m is None:
            return None
        rule = Rule(m, low, high, ident, scope, {k: t for k, (_, t) in captures.items()}, order, (got["match"][1].line, got["match"][1].col))
        if outermost and ident is None and rule.name in RESERVED:
            self.fail("reserved-id", got["match"][1], f"id {rule.name} is reserved")
        return rule

    def _captures(self, pair, m: Matcher | None) -> dict[str, tuple[Node, str]]:
        if pair is None:
            return {}
        key, node = pair
        if node.kind != "mapping" or not node.pairs:
            self.fail("invalid-capture", key, "captures must be a mapping that isn't empty")
            return {}
        out = {}
        for k, v in node.pairs:
            if k.kind != "string" or not CAPTURE_NAME.fullmatch(k.text):
                self.fail("invalid-capture", k, f"capture name {k.text}")
            elif v.kind != "string" or v.text not in TYPES:
                self.fail("invalid-capture", v, f"capture type {v.text}")
            elif m is not None and m.kind != "regex":
                self.fail("invalid-capture", k, "only a regex captures")
            elif m is not None and not m.groups.get(k.text):
                self.fail("invalid-capture", k, f"group {k.text} is missing or may take no part")
            else:
                out[k.text] = (k, v.text)
        return out

    def _order(self, pair, captures: dict[str, str], high: int | None) -> list[Order]:
        if pair is None:
            return []
        key, node = pair
        if node.kind != "sequence" or not node.items:
            self.fail("invalid-order", key, "order must be a list that isn't empty")
            return []
        if high is not None and high <= 1:
            self.fail("invalid-order", key, "order on a rule that occurs once at most")
            return []
        out: list[Order] = []
        for x in node.items:
            if x.kind != "mapping":
                self.fail("invalid-order", x, "an order entry is a mapping")
                continue
            n = len(self.errors)
            got = self.keys(x, ("by", "dir", "strict"), "invalid-order")
            by, way = got.get("by"), got.get("dir")
            if by is None or by[1].kind != "string" or by[1].text not in captures:
                self.fail("invalid-order", by[1] if by else x, "by must name a capture of the rule")
            if way is not None and (way[1].kind != "string" or way[1].text not in ("asc", "desc")):
                self.fail("invalid-order", way[1], "dir must be asc or desc")
            strict = self.boolean(got.get("strict"), False, "invalid-order")
            if len(self.errors) > n:
                continue
            entry = Order(by[1].text, way is not None and way[1].text == "desc", strict)
            if any((entry.by, entry.descending, entry.strict) == (o.by, o.descending, o.strict) for o in out):
                self.fail("invalid-order", x, "the entry repeats")
            else:
                out.append(entry)
        return out

    def _content(self, node: Node, outermost: bool, name) -> list[ContentRule]:
        if node.kind != "sequence":
            self.fail("invalid-content-rule", node, "content must be a list")
            return []
        return [r for i, x in enumerate(node.items) if (r := self._content_rule(x, i, outermost, name)) is not None]

    def _alternative(self, node: Node) -> tuple[str, str | None] | None:
        bad = lambda n, t: self.fail("invalid-content-rule", n, t)
        if node.kind != "mapping":
            return bad(node, "an alternative is a mapping")
        n = len(self.errors)
        for k, _ in node.pairs:
            if k.text in ("id", "required", "repeat", "items", "one_of"):
                bad(k, f"an alternative has no {k.text}")
        got = self.keys(Node("mapping", 0, 0, pairs=[p for p in node.pairs if p[0].text not in ("id", "required", "repeat", "items", "one_of")]), ("block", "list_kind"))
        if "block" not in got:
            return bad(node, "an alternative needs block") if len(self.errors) == n else None
        found = self._block(got)
        return found if len(self.errors) == n else None

    def _block(self, got: dict) -> tuple[str, str | None] | None:
        block = got["block"][1]
        if block.kind != "string" or block.text not in ("p", "list", "any"):
            self.fail("invalid-content-rule", block, f"block {block.text}")
            return None
        kind = None
        if "list_kind" in got:
            k, v = got["list_kind"]
            if block.text != "list":
                self.fail("invalid-content-rule", k, "list_kind needs block list")
            elif v.kind != "string" or v.text not in ("bullet", "ordered", "any"):
                self.fail("invalid-content-rule", v, f"list_kind {v.text}")
            else:
                kind = None if v.text == "any" else v.text
        return block.text, kind

    def _content_rule(self, node: Node, i: int, outermost: bool, name) -> ContentRule | None:
        if node.kind != "mapping":
            self.fail("invalid-content-rule", node, "a content rule is a mapping")
            return None
        got = self.keys(node, ("id", "block", "one_of", "required", "repeat", "list_kind", "items"))
        both = [got[k][0] for k in ("block", "one_of") if k in got]
        if len(both) != 1:
            self.fail("invalid-content-rule", min(both, key=lambda n: (n.line, n.col)) if both else node, "block or one_of, not both, is needed")
            return None
        n = len(self.errors)
        items = None
        if "block" in got:
            found = self._block(got)
            if found is None:
                return None
            alternatives = [found]
        else:
            listed = got["one_of"][1]
            for k in ("list_kind", "items"):
                if k in got:
                    self.fail("invalid-content-rule", got[k][0], f"one_of has no {k}")
            if listed.kind != "sequence" or len(listed.items) < 2:
                self.fail("invalid-content-rule", listed, "one_of needs two alternatives")
                return None
            each = [(x, self._alternative(x)) for x in listed.items]
            alternatives = []
            for x, a in each:
                if a is not None and a in alternatives:
                    self.fail("invalid-content-rule", x, "the alternative repeats")
                elif a is not None:
                    alternatives.append(a)
        ident = self.ident(got, outermost)
        low, high = self.count(got, True, node)
        inner: list = []
        if "items" in got and "block" in got:
            if alternatives[0][0] != "list":
                self.fail("invalid-content-rule", got["items"][0], "items needs block list")
            else:
                keep = name if ident is None else lambda k, nd, w: inner.append((k, nd, w))
                items = self._items(got["items"][1], i, outermost and ident is None, keep)
        rule = ContentRule(alternatives, "one_of" in got, low, high, ident, items, (node.line, node.col)) if len(self.errors) == n else None
        seen: dict = {}
        for k, nd, w in inner:
            if k is not None and k in seen:
                self.fail("duplicate-id", nd, f"name {k} repeats")
            seen[k] = w
        name(ident, node, ("content", i, seen))
        return rule

    def _items(self, node: Node, content: int, outermost: bool, name) -> list[ItemRule]:
        if node.kind != "sequence":
            self.fail("invalid-content-rule", node, "items must be a list")
            return []
        out = []
        for j, x in enumerate(node.items):
            if x.kind != "mapping":
                self.fail("invalid-content-rule", x, "an item rule is a mapping")
                continue
            got = self.keys(x, ("id", "match", "required", "repeat"))
            if "match" not in got:
                self.fail("invalid-document-shape", x, "an item rule needs match")
                continue
            m = self.matcher(got["match"][1])
            low, high = self.count(got, False, got["match"][1])
            ident = self.ident(got, outermost)
            name(ident, x, ("item", content, j))
            if m is not None:
                out.append(ItemRule(m, low, high, ident, (x.line, x.col)))
        return out

    def _front(self, schema: Schema, node: Node) -> None:
        if node.kind != "mapping":
            self.fail("invalid-document-shape", node, "frontmatter must be a mapping")
            return
        got = self.keys(node, ("required", "allow", "schema", "captures"))
        schema.front_required = bool(self.boolean(got.get("required"), False))
        schema.front_allowed = bool(self.boolean(got.get("allow"), True))
        for k in ("required", "captures"):
            if not schema.front_allowed and k in got and (k == "captures" or schema.front_required):
                self.fail("conflicting-frontmatter", max(got[k][0], got["allow"][0], key=lambda n: (n.line, n.col)), f"{k} beside allow: false")
        if "schema" in got:
            v = got["schema"][1]
            try:
                if v.kind == "mapping":
                    value = v.value()
                    if any(not isinstance(r, str) or not r.startswith("#") for r in jsonschema.references(value)):
                        raise jsonschema.SchemaInvalid("references of an inline schema start with #")
                    schema.front_schema = jsonschema.Validator(value)
                elif v.kind == "string":
                    if v.text not in self.resources:
                        raise jsonschema.SchemaInvalid(f"{v.text} can't be read")
                    schema.front_schema = jsonschema.Validator(self.resources[v.text], self.resources, v.text)
                else:
                    self.fail("invalid-document-shape", v, "schema must be a path or a mapping")
            except (jsonschema.SchemaInvalid, RecursionError) as x:
                self.fail("invalid-frontmatter-schema", v, str(x))
        if "captures" in got and schema.front_allowed:
            key, v = got["captures"]
            if v.kind != "mapping" or not v.pairs:
                self.fail("invalid-capture", key, "captures must be a mapping that isn't empty")
                return
            for k, x in v.pairs:
                if (c := self._front_capture(k, x)) is not None:
                    schema.front_captures.append(c)

    def _front_capture(self, k: Node, x: Node) -> FrontCapture | None:
        bad = lambda n, t: self.fail("invalid-capture", n, t)
        if k.kind != "string" or not CAPTURE_NAME.fullmatch(k.text):
            return bad(k, f"capture name {k.text}")
        if x.kind != "mapping":
            return bad(x, "a frontmatter capture is a mapping")
        n = len(self.errors)
        got = self.keys(x, ("path", "type", "required"), "invalid-capture")
        if "type" not in got or got["type"][1].kind != "string" or got["type"][1].text not in TYPES:
            bad(got["type"][1] if "type" in got else x, "a type is needed")
        required = self.boolean(got.get("required"), False, "invalid-capture")
        path = jsonpath.Query(f"$['{k.text}']", [(False, [("name", k.text)])])
        if "path" in got:
            try:
                path = jsonpath.parse(got["path"][1].text) if got["path"][1].kind == "string" else None
            except jsonpath.QueryError:
                path = None
            if path is None or not path.singular:
                bad(got["path"][1], "path must be a singular query from $")
        return FrontCapture(k.text, got["type"][1].text, path, required, (k.line, k.col)) if len(self.errors) == n else None

    # Constraints are bound once all names are known.

    def _constraints(self, scope: Scope, node: Node, chain: list[Scope], schema: Schema) -> None:
        if node.kind != "sequence":
            self.fail("invalid-document-shape", node, "constraints must be a list")
            return
        for i, x in enumerate(node.items):
            if x.kind != "mapping" or len(x.pairs) != 1 or x.pairs[0][0].text not in (*LISTS, "requires", "conflicts"):
                self.fail("invalid-document-shape", x, "a constraint has one known key")
                continue
            k, v = x.pairs[0]
            n = len(self.errors)
            if k.text in LISTS:
                if v.kind != "sequence" or len(v.items) < 2:
                    self.fail("invalid-document-shape", v, f"{k.text} needs two locators")
                    continue
                found = [self._proposition(y, scope, chain, schema, k.text == "ordered") for y in v.items]
                condition, nodes = None, v.items
            else:
                other = "then" if k.text == "requires" else "then_not"
                got = self.keys(v, ("if", other)) if v.kind == "mapping" else {}
                if len(got) != 2:
                    self.fail("invalid-document-shape", v, f"{k.text} needs if and {other}")
                    continue
                then = got[other][1]
                nodes = then.items if then.kind == "sequence" else [then]
                if not nodes:
                    self.fail("invalid-document-shape", then, f"{other} is empty")
                    continue
                condition = self._proposition(got["if"][1], scope, chain, schema)
                found = [self._proposition(y, scope, chain, schema) for y in nodes]
            if len(self.errors) > n:
                continue
            seen = {condition.identity(self.match_case)} if condition else set()
            for y, p in zip(nodes, found, strict=True):
                if p.identity(self.match_case) in seen:
                    self.fail("duplicate-ref", y, f"{y.text} repeats")
                seen.add(p.identity(self.match_case))
            if k.text == "ordered":
                self._same_scope(found, scope, chain, v)
            scope.constraints.append(Constraint(k.text, found, condition, (x.line, x.col), i))

    def _same_scope(self, found: list[Proposition], scope: Scope, chain: list[Scope], node: Node) -> None:
        def home(p: Proposition):
            s = chain[0] if p.absolute else scope
            for i, _ in p.steps[:-1]:
                s = s.rules[i].scope
            return s, p.steps[:-1]

        homes = [home(p) for p in found]
        if any(h[0] is not homes[0][0] or h[1] != homes[0][1] for h in homes) or not homes[0][0].unordered:
            self.fail("ordered-scope-mismatch", node, "ordered needs one scope that is unordered")

    def _proposition(self, node: Node, scope: Scope, chain: list[Scope], schema: Schema, ordered: bool = False) -> Proposition | None:
        shape = lambda t: self.fail("invalid-document-shape", node, t)
        if node.kind != "string":
            return shape("a locator is a string")
        text = node.text
        if text.startswith("fm[") or text.startswith("fm.") or text == "fm":
            if ordered:
                return self.fail("ordered-scope-mismatch", node, "frontmatter has no place among headings")
            if text.startswith("fm."):
                if not CAPTURE_NAME.fullmatch(text[3:]):
                    return shape(f"locator {text}")
                if all(c.name != text[3:] for c in schema.front_captures):
                    return self.fail("unresolved-ref", node, f"no capture {text[3:]}")
                return Proposition("capture", text, name=text[3:])
            try:
                query, end = jsonpath.parse_prefix(text, 3)
            except jsonpath.QueryError as x:
                return shape(str(x))
            while text[end : end + 1] in (" ", "\t") and end < len(text):
                end += 1
            if text[end : end + 1] != "]" or end + 1 < len(text) and text[end + 1] != "=":
                return shape(f"locator {text}")
            equals = None
            if end + 1 < len(text):
                literal = text[end + 2 :]
                one = None
                try:
                    one = yaml12.parse(literal + "\n", reject_tags=True)
                except YamlError:
                    return shape(f"literal {literal}")
                if one is not None and one.kind in ("mapping", "sequence", "invalid"):
                    return shape(f"literal {literal}")
                equals = (one.kind, one.text) if one is not None else (scalar_kind(""), "")
            return Proposition("query", text, query=query, equals=equals)
        m = re.fullmatch(rf"(\$\.)?((?:{SLUG}|[a-z][a-z0-9_]*)(?:\[(?:0|[1-9][0-9]*)\])?(?:\.(?:{SLUG}|[a-z][a-z0-9_]*)(?:\[(?:0|[1-9][0-9]*)\])?)*)((?:/[a-z]+(?:\[(?:0|[1-9][0-9]*)\])?)*)", text)
        if not m:
            return shape(f"locator {text}")
        now, steps = (chain[0] if m[1] else scope), []
        names, plural = [(x.split("[")[0], int(x.split("[")[1][:-1]) if "[" in x else None) for x in m[2].split(".")], False
        for at, (name, i) in enumerate(names):
            if plural:
                if ordered:
                    return self.fail("ordered-scope-mismatch", node, "a repeated ancestor needs a position")
                return shape(f"{names[at - 1][0]} may repeat and needs a position")
            what = now.names.get(name) if now is not None else None
            if what is None:
                return self.fail("unresolved-ref", node, f"no name {name}")
            if what[0] != "rule":
                return self.fail("ordered-scope-mismatch", node, f"{name} has no place among headings") if ordered else shape(f"{name} is not a section")
            rule = now.rules[what[1]]
            steps.append((what[1], i))
            plural = i is None and (rule.high is None or rule.high > 1)
            now = rule.scope
        if m[3]:
            kind = m[3].split("/")[1].split("[")[0]
            if kind in ("p", "list") and not any(a[0] == kind for r in now.content or [] for a in r.alternatives):
                return self.fail("unresolved-ref", node, f"no {kind} is declared there")
            return self.fail("ordered-scope-mismatch", node, "a block has no place among headings") if ordered else shape(f"{text} is no proposition")
        lead = [] if m[1] else [(next(i for i, r in enumerate(up.rules) if r.scope is down), None) for up, down in itertools.pairwise(chain)]
        return Proposition("section", text, steps, bool(m[1]), declared=(*lead, *steps))


def load(text: str, resources: dict | None = None) -> Schema:
    """The schema that text spells; raises SchemaErrors with all errors found. resources: linked JSON documents by path."""
    return _Loader(text, resources or {}).load()
