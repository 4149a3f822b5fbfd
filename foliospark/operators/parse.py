"""Documents to tables of nodes, frontmatter values and index units. One pass over the documents, no shuffle."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import columns
from ..functions.text import file_stem
from ..sources import frontmatter
from .document import Document, Node, decode, parse
from .paths import Paths

#: Rows put out at once.
ROWS = 5_000
#: Rows and characters up to which what a text gives is kept for when it comes again.
SHORT_ROWS, SHORT_TEXT = 100, 4_000
#: Rows that are kept so in all.
KNOWN_ROWS = 20_000

NODES = columns(
    "node_id int, parent_id int, last_id int, depth int, kind string, level int, list_kind string, ord int, kind_ord int, text string, shown string, slug string, "
    "header_path strings, mdpath string, start long, end long, extent long, line long, col long, off strings, lead_in boolean, above int"
)
FRONT = columns("pointer string, kind string, text string, line long, col long")
DOCUMENTS = columns("n_bytes long, n_sections int, h1 int, merged boolean, off strings, front_state string, front_error string, front_start int, front_end int, error string")
UNITS = columns("mdpath string, parent_list string, kind string, bytes long, section_bytes long, context string, body string, snippet string")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Out:
    """Rows of documents on their way out. Rows of a text that comes again are made, and turned to Arrow, once."""

    def __init__(self, names: list[str], arrow: pa.Schema) -> None:
        self.names, self.arrow = names, arrow
        self.rows: list[dict] = []
        self.spans: dict[object, tuple[int, int]] = {}
        self.taken: list[tuple[int, int, int]] = []  # document, its first row, its rows
        self.total = 0

    def put(self, document: int, start: int, n: int) -> None:
        if n:
            self.taken.append((document, start, n))
            self.total += n

    def full(self) -> bool:
        return len(self.rows) >= ROWS or self.total >= 4 * ROWS

    def batch(self, keys: pa.Array) -> pa.RecordBatch:
        document, start, n = np.array(self.taken, np.int64).T
        before = np.cumsum(n) - n
        at = np.repeat(start - before, n) + np.arange(self.total)
        made = [pa.array([r.get(x) for r in self.rows], self.arrow.field(x).type) for x in self.names]
        if self.total != len(self.rows) or (at != np.arange(self.total)).any():
            index = pa.array(at)
            made = [x.take(index) for x in made]
        out = [keys.take(pa.array(np.repeat(document, n))), *made]
        self.__init__(self.names, self.arrow)
        return pa.RecordBatch.from_arrays(out, schema=self.arrow)


def per_document(docs: DataFrame, fn: Callable[[object, str], Iterator[dict]], schema: T.StructType, key: str = "doc_id", text: str = "source", fields: Iterable[str] | None = None, keyed: bool = False, alike: Callable[[str], str] | None = None) -> DataFrame:
    """Rows (key, fn's columns) that fn makes of each document; of these columns only fields, if given. text is a string or
    UTF-8 bytes; null counts as empty. Unless keyed, rows come of the text alone, and fn is called once for a text that soon
    comes again; texts of which alike gives the same have the same rows. Documents that aren't UTF-8 are passed over by fn's caller: see failures."""
    names = schema.names if fields is None else list(fields)
    whole = T.StructType([docs.schema[key], *(schema[x] for x in names)])
    arrow = _arrow(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[object, list[dict]] = {}
        held = 0
        out = _Out(names, arrow)
        for b in batches:
            keys = b.column(0).cast(arrow.field(0).type)
            named = keys.to_pylist() if keyed else itertools.repeat(None)
            for i, (k, x) in enumerate(zip(named, b.column(1).to_pylist(), strict=False)):
                shared = not keyed and (x is None or len(x) <= SHORT_TEXT)
                source = x
                if shared and alike and isinstance(x, str):
                    x = alike(x)  # noqa: PLW2901
                span = out.spans.get(x) if shared else None
                if span is None:
                    found = known.get(x) if shared else None
                    if found is None:
                        try:
                            source = decode(source) if isinstance(source, bytes) else source or ""
                        except UnicodeDecodeError:
                            continue
                        found = list(fn(k, source))
                        if shared and len(found) <= SHORT_ROWS:
                            if held >= KNOWN_ROWS:
                                known, held = {}, 0
                            known[x] = found
                            held += 1 + len(found)
                    span = len(out.rows), len(found)
                    if shared:
                        out.spans[x] = span
                    out.rows += found
                out.put(i, *span)
                if out.full():
                    yield out.batch(keys)
            if out.taken:
                yield out.batch(keys)

    return docs.select(key, text).mapInArrow(run, whole)


def failures(docs: DataFrame, key: str = "doc_id", text: str = "source") -> DataFrame:
    """Documents that can't be read: (key, error). They take no part in any other result."""
    bytes_ = F.col(text).cast("binary")
    return docs.where(F.col(text).isNotNull() & ~F.is_valid_utf8(bytes_)).select(key, F.lit("not valid UTF-8").alias("error"))


def node_rows(doc: Document, fields: Iterable[str] | None = None) -> Iterator[dict]:
    """The root, sections, blocks and items in document order; last_id is the last node below a node, above the level of the
    section that a node lies in. fields: the columns that are wanted, all if None."""
    wanted = set(NODES.names if fields is None else fields)
    of = Paths(doc).of if "mdpath" in wanted else {}
    ids: dict[int, int] = {}
    last: dict[int, int] = {}
    order: list[tuple[Node, Node | None, int, int]] = []
    todo: list[tuple[Node, Node | None, int, int]] = [(doc.root, None, 0, 0)]
    while todo:
        node, parent, ord_, depth = todo.pop()
        ids[id(node)] = len(order)
        order.append((node, parent, ord_, depth))
        if node.sections:
            todo += [(s, node, i, depth + 1) for i, s in enumerate(node.sections)][::-1]
        if node.items:
            todo += [(x, node, i, depth) for i, x in enumerate(node.items)][::-1]
        if node.blocks:
            todo += [(b, node, i, depth) for i, b in enumerate(node.blocks)][::-1]
    if "last_id" in wanted:
        for node, parent, _, _ in reversed(order):
            i = ids[id(node)]
            last[i] = max(last.get(i, i), i)
            if parent is not None:
                p = ids[id(parent)]
                last[p] = max(last.get(p, p), last[i])

    def header_path(node: Node, parent: Node | None) -> list[str]:
        owner = node if node.kind == "section" else parent if node.kind != "item" else parent.parent
        return owner.path if owner is not None else []

    makers = {
        "node_id": lambda i, node, parent, ord_, depth: i,
        "parent_id": lambda i, node, parent, ord_, depth: ids[id(parent)] if parent is not None else None,
        "last_id": lambda i, node, parent, ord_, depth: last[i],
        "depth": lambda i, node, parent, ord_, depth: depth,
        "kind": lambda i, node, parent, ord_, depth: node.kind,
        "level": lambda i, node, parent, ord_, depth: node.level,
        "list_kind": lambda i, node, parent, ord_, depth: node.list_kind or None,
        "ord": lambda i, node, parent, ord_, depth: ord_,
        "kind_ord": lambda i, node, parent, ord_, depth: node.ordinal,
        "text": lambda i, node, parent, ord_, depth: node.text,
        "shown": lambda i, node, parent, ord_, depth: node.shown,
        "slug": lambda i, node, parent, ord_, depth: node.slug if node.kind == "section" else None,
        "header_path": lambda i, node, parent, ord_, depth: header_path(node, parent),
        "mdpath": lambda i, node, parent, ord_, depth: of.get(id(node)),
        "start": lambda i, node, parent, ord_, depth: node.start,
        "end": lambda i, node, parent, ord_, depth: node.end,
        "extent": lambda i, node, parent, ord_, depth: node.extent() if node.kind == "section" else node.end,
        "line": lambda i, node, parent, ord_, depth: node.line,
        "col": lambda i, node, parent, ord_, depth: node.col,
        "off": lambda i, node, parent, ord_, depth: sorted(node.off),
        "lead_in": lambda i, node, parent, ord_, depth: node.lead_in,
        "above": lambda i, node, parent, ord_, depth: parent.level if parent is not None and parent.kind == "section" else None,
    }
    used = [(name, make) for name, make in makers.items() if name in wanted]
    for i, (node, parent, ord_, depth) in enumerate(order):
        yield {name: make(i, node, parent, ord_, depth) for name, make in used}


#: Columns of nodes that no heading's words have a part in, and headings of plain words, which are headings whatever they say.
_SHAPE = {"node_id", "parent_id", "last_id", "depth", "kind", "level", "list_kind", "ord", "kind_ord", "line", "col", "off", "lead_in", "above"}
_WORDS = re.compile(r"^(#{1,6}) [A-Za-z0-9]+(?: [A-Za-z0-9]+)*$", re.ASCII | re.MULTILINE)


def _shape(source: str) -> str:
    return _WORDS.sub(r"\1 x", source)


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "source", strip: bool = True, fields: Iterable[str] | None = None) -> DataFrame:
    """All nodes of all documents, the root (node 0) included. parent_id of a top section or block is 0. fields: the columns
    to give beside the key, all if None; what isn't asked for isn't made."""
    fields = None if fields is None else list(fields)
    alike = _shape if fields is not None and _SHAPE.issuperset(fields) else None
    return per_document(docs, lambda _, s: node_rows(parse(s, strip, detail=False), fields), NODES, key, text, fields, alike=alike)


def front_values(docs: DataFrame, key: str = "doc_id", text: str = "source", fields: Iterable[str] | None = None) -> DataFrame:
    """Every frontmatter value with its JSON pointer, kind, text and place, or with those of them that fields name."""

    def rows(_, s: str):
        f = frontmatter.read([x.removesuffix("\r") for x in s.split("\n")])
        return [dict(zip(("pointer", "kind", "text", "line", "col"), r, strict=True)) for r in frontmatter.rows(f)]

    return per_document(docs, rows, FRONT, key, text, fields)


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "source") -> DataFrame:
    """One row per document: sizes, headings of level 1, what it turns off, and the state of its frontmatter."""

    def rows(_, s: str):
        d = parse(s, detail=False)
        h1 = sum(x.level == 1 for x in d.root.sections)
        f = d.front
        yield {"n_bytes": len(s.encode()), "n_sections": sum(1 for _ in d.walk()), "h1": h1, "merged": d.title() is not None, "off": sorted(d.off), "front_state": f.state, "front_error": f.error or None, "front_start": f.start, "front_end": f.end, "error": None}

    return per_document(docs, rows, DOCUMENTS, key, text)


def unit_rows(source: str, path: str) -> Iterator[dict]:
    """Index units of one document: the root if it has a title or frontmatter, sections, blocks and items."""
    doc = parse(source)
    paths, stem = Paths(doc), file_stem(path)
    title = paths.title

    def context(section: Node | None) -> str:
        above = [stem] + ([title.shown] if title else [])
        names = [] if section is None else section.path[1:] if title else section.path
        return " / ".join(x for x in above + names if x)

    front = " ".join(frontmatter.scalars(doc.front.root)) if doc.front.root is not None and doc.front.state == "mapping" else ""
    if title is not None or doc.front.state == "mapping":
        body = " ".join(x for x in (title.shown if title else "", front) if x)
        yield {"mdpath": "$", "parent_list": None, "kind": "root", "bytes": doc.root.end, "section_bytes": None, "context": stem, "body": body, "snippet": front}
    owners = [doc.root, *paths.deep(doc.root)]
    for owner in owners:
        section = owner if owner.kind == "section" else None
        size = paths.extent(owner)[1] - owner.start if section is not None else None
        around = context(section)
        blocks = paths.blocks(owner)
        if section is not None:
            up = section.parent if section.parent.kind == "section" and section.parent is not title else None
            shown = " ".join(b.snippet for b in blocks if b.snippet)
            yield {"mdpath": paths.of[id(owner)], "parent_list": None, "kind": "section", "bytes": size, "section_bytes": None, "context": context(up), "body": section.shown, "snippet": shown}
        lead: list[Node] = []
        for k, b in enumerate(blocks):
            if b.lead_in and k + 1 < len(blocks):
                lead.append(b)
                continue
            join = lambda name, b=b, lead=tuple(lead): " ".join(x for x in [*(getattr(y, name) for y in lead), getattr(b, name)] if x)
            common = {"section_bytes": size, "context": around}
            yield {"mdpath": paths.of[id(b)], "parent_list": None, "kind": b.kind, "bytes": b.end - b.start, "body": join("body"), "snippet": join("snippet"), **common}
            lead = []
            for x in b.items:
                if x.body:
                    yield {"mdpath": paths.of[id(x)], "parent_list": paths.of[id(b)], "kind": "item", "bytes": x.end - x.start, "body": x.body, "snippet": x.snippet, **common}


def units(docs: DataFrame, path: str = "path", text: str = "source", fields: Iterable[str] | None = None) -> DataFrame:
    """Index units of all documents. fields: the columns to give beside the path, all if None; only context tells of the path."""
    fields = UNITS.names if fields is None else list(fields)
    return per_document(docs, lambda p, s: unit_rows(s, p or ""), UNITS, path, text, fields, keyed="context" in fields)
