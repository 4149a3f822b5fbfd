"""Checking a table of documents: diagnostics as rows, in one pass without a shuffle."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import columns
from ..functions.patterns import Matcher
from ..operators.document import Document, parse
from ..operators.parse import SHORT_ROWS, SHORT_TEXT, failures, per_document
from ..operators.sequence import Inconsistent
from .check import checks, target_key
from .jsonpath import QueryCost
from .schema import Schema, SchemaErrors, load

INVOLVED = T.ArrayType(columns("header_path strings, line long, col long"))
DIAGNOSTICS = columns(
    "ord int, id string, line long, col long, target string, message string, schema_node string, schema_line int, schema_col int, involved headers, refs strings, suppressed boolean, error string",
    headers=INVOLVED,
)
#: Columns of what a document is told.
SHOWN = [x for x in DIAGNOSTICS.names if x not in ("suppressed", "error")]


_ENCODE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


_QUOTED = json.encoder.encode_basestring


def _json(x) -> str | None:
    """Compact JSON; most of what is written are small objects of texts, for which an encoder costs more than its work."""
    if x is None:
        return None
    if type(x) is dict and "kind" in x and len(x) == 2 and type(x.get("path")) is list:
        return f'{{"kind":{_QUOTED(x["kind"])},"path":[{",".join(map(_QUOTED, x["path"]))}]}}' if next(iter(x)) == "kind" else _ENCODE(x)
    return _ENCODE(x)


def _compiled(schema: Schema | str, resources: dict | None) -> str:
    text = schema if isinstance(schema, str) else None
    if text is None:
        raise TypeError("a schema's text is needed")
    load(text, resources)  # errors show on the driver, before any task
    return text


_LOADED: dict[str, Schema] = {}


def _schema(text: str, resources: dict | None) -> Schema:
    """Compiled once for each Python worker."""
    key = text if not resources else text + "\0" + repr(sorted(resources.items(), key=str))
    if key not in _LOADED:
        if len(_LOADED) > 64:
            _LOADED.clear()
        _LOADED[key] = load(text, resources)
    return _LOADED[key]


def _sort_key(d):
    return (0,) if d.place is None else (1, d.place), target_key(d.target), d.message.encode(), _json(d.node) or "", json.dumps(d.involved), json.dumps(d.references)


def _place(d):
    return d.line, d.col, d.id


def ordered(found: list) -> list:
    """Diagnostics in their total order: by place and id, and what these leave open by the rest."""
    found = sorted(found, key=_place)
    if all(_place(a) < _place(b) for a, b in itertools.pairwise(found)):
        return found
    return [d for _, tied in itertools.groupby(found, _place) for d in sorted(tied, key=_sort_key)]


#: A plain title, and what stands for it where documents that differ in it alone are checked as one.
_TITLE = re.compile(r"# ([A-Za-z0-9]+(?: [A-Za-z0-9]+)*)(?=\n|\Z)", re.ASCII)
_STAND_IN = "Qq7TitleQq7"


class _Titled:
    """Of the latest question asked of a worker: rows by a document's text behind its title, None where the title's text may
    matter. Texts and rows are counted, and all are let go when they are too many."""

    MOST = 60_000

    def __init__(self) -> None:
        self.asked, self.rows, self.held = "", {}, 0

    def of(self, asked: str) -> dict[str, list[dict] | None]:
        if asked != self.asked:
            self.asked, self.rows, self.held = asked, {}, 0
        return self.rows

    def put(self, asked: str, text: str, rows: list[dict] | None) -> None:
        if rows is not None and len(rows) > SHORT_ROWS:
            return
        if self.held >= self.MOST:
            self.rows, self.held = {}, 0
        self.of(asked)[text] = rows
        self.held += 1 + len(rows or ()) + len(text) // 200


_TITLED = _Titled()



def _one_title(doc: Document) -> bool:
    """Whether the first line is a document's only heading of level 1, of which only the schema's title says anything."""
    tops = [x for x in doc.root.sections if x.level == 1]
    return len(tops) == 1 and tops[0].line == 1 and tops[0].text == _STAND_IN


def _takes(schema: Schema, title: str) -> bool:
    return isinstance(schema.title, Matcher) and schema.title.matches(title)


def _put_title(x, title: str):
    """x with title where it stands; what holds none is x itself."""
    if isinstance(x, str):
        return x.replace(_STAND_IN, title) if _STAND_IN in x else x
    if isinstance(x, dict):
        return {k: _put_title(v, title) if v.__class__ in (str, list, dict) else v for k, v in x.items()}
    return [_put_title(v, title) for v in x] if isinstance(x, list) else x


_MAKERS = {
    "id": lambda d: d.id,
    "line": lambda d: d.line,
    "col": lambda d: d.col,
    "target": lambda d: _json(d.target),
    "message": lambda d: d.message,
    "schema_node": lambda d: _json(d.node),
    "schema_line": lambda d: d.place[0] if d.place else None,
    "schema_col": lambda d: d.place[1] if d.place else None,
    "involved": lambda d: [{"header_path": p, "line": n, "col": c} for p, n, c in d.involved],
    "refs": lambda d: [_json(r) for r in d.references],
    "suppressed": lambda d: d.suppressed,
}


def _checked(docs: DataFrame, schemas: dict[str | None, str], resources: dict | None, key: str, text: str, tool: str | None, fields: list[str], every: bool) -> DataFrame:
    """every: what a document turns off and errors too; name: of the schema, where fields have it."""
    spelled = {name: _compiled(x, resources) for name, x in schemas.items()}
    made = [(x, _MAKERS[x]) for x in fields if x in _MAKERS]
    sort = "ord" in fields

    def found(source: str, titled: bool = False) -> list[dict] | None:
        """Rows of a document; None if titled, so with a title that fits, and one of them may depend on what it says."""
        out = []
        read: dict[bool, Document] = {}
        for name, x in spelled.items():
            schema = _schema(x, resources)
            try:
                if schema.strip not in read:
                    read[schema.strip] = parse(source, schema.strip, detail=False, tool=tool)
                if titled and not _one_title(read[schema.strip]):
                    return None
                all_ = checks(schema, read[schema.strip], titled)
                if titled and any(_STAND_IN in d.message for d in all_):
                    return None
                all_ = ordered(all_) if sort else all_
            except (QueryCost, RecursionError, Inconsistent) as e:
                if every:
                    out.append({"error": str(e) or "nested too deep", "schema": name})
                continue
            for i, d in enumerate(all_):
                if every or not d.suppressed:
                    row = {x: make(d) for x, make in made}
                    row["ord"], row["schema"] = i, name
                    out.append(row)
        return out

    memo = repr((sorted(spelled.items(), key=str), sorted((resources or {}).items(), key=str), tool, fields, every))

    def rows(_, source: str):
        m = _TITLE.match(source) if len(source) <= SHORT_TEXT else None
        if m is None or _STAND_IN in source or not all(_takes(_schema(x, resources), m[1]) for x in spelled.values()):
            return found(source)
        rest = source[m.end() :]
        known = _TITLED.of(memo)
        if rest in known:
            under = known[rest]
        else:
            under = found(f"# {_STAND_IN}{rest}", True)
            _TITLED.put(memo, rest, under)
        return found(source) if under is None else [_put_title(row, m[1]) for row in under]

    return per_document(docs, rows, T.StructType([*DIAGNOSTICS.fields, T.StructField("schema", T.StringType())]), key, text, fields)


def checked(docs: DataFrame, schema: str, resources: dict | None = None, key: str = "doc_id", text: str = "source", tool: str | None = None) -> DataFrame:
    """Every diagnostic, those that a document turns off marked as suppressed, and one row with error for each document
    whose check could not be finished. ord is the place in the document's total order. tool: the name in comments that turn
    checks off, any if None."""
    return _checked(docs, {None: schema}, resources, key, text, tool, DIAGNOSTICS.names, True)


def validate(docs: DataFrame, schema: str, resources: dict | None = None, key: str = "doc_id", text: str = "source", tool: str | None = None, fields: Iterable[str] | None = None) -> DataFrame:
    """Diagnostics of all documents against the schema's text. Suppression comes last, so what a document turns off still
    has its effect on what depends on it. fields: the columns to give beside the key, all if None; what isn't asked for isn't
    made. Raises SchemaErrors."""
    return _checked(docs, {None: schema}, resources, key, text, tool, SHOWN if fields is None else list(fields), False)


def validate_each(docs: DataFrame, schemas: dict[str, str], fields: Iterable[str], resources: dict | None = None, key: str = "doc_id", text: str = "source", tool: str | None = None) -> DataFrame:
    """As validate, against several schemas by name, reading each document once; fields may have schema, the name."""
    return _checked(docs, schemas, resources, key, text, tool, list(fields), False)


SCHEMA_ERRORS = columns("ord int, id string, line long, col long, message string")


def schema_errors(schemas: DataFrame, key: str = "doc_id", text: str = "source") -> DataFrame:
    """What is wrong with each text of a table of schemas, in order; nothing of a sound one. One pass, no shuffle."""

    def rows(_, source: str):
        try:
            load(source)
        except SchemaErrors as x:
            for i, e in enumerate(x.errors):
                yield {"ord": i, "id": e.id, "line": e.line, "col": e.col, "message": e.message}

    return per_document(schemas, rows, SCHEMA_ERRORS, key, text)


def operational_errors(docs: DataFrame, schema: str, resources: dict | None = None, key: str = "doc_id", text: str = "source") -> DataFrame:
    """(key, error) of documents without a verdict: not UTF-8, a query that would cost too much, or an assignment that breaks
    its own rules."""
    return failures(docs, key, text).unionByName(checked(docs, schema, resources, key, text).where("error is not null").select(key, "error"))


def summary(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """files, documents, schemas and diagnostics of one run."""
    zero = F.lit(0).cast("long")
    both = docs.agg(F.count("*").alias("files"), zero.alias("found")).unionByName(diagnostics.agg(zero.alias("files"), F.count("*").alias("found")))
    return both.agg(F.sum("files").alias("files"), F.sum("files").alias("documents"), zero.alias("schemas"), F.sum("found").alias("diagnostics"))
