"""Reading one node of each document by its path, and listing nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.columns import columns
from .document import parse
from .parse import per_document
from .paths import PathFailure, Paths, PathSyntax, parse_path

CONTENT = columns("mdpath string, bytes long, content string, outcome string, step string, resolved string, candidates strings, suggestions strings")
TREE = columns("ord int, mdpath string, kind string, level int, text string, items int, preview string, label string, bytes long")


def content(docs: DataFrame, path: str, depth: int | None = None, key: str = "doc_id", text: str = "source") -> DataFrame:
    """One row per document: the selected text, or how the path failed with what might have been meant. PathSyntax is raised at once."""
    steps = parse_path(path)

    def rows(_, source: str):
        p = Paths(parse(source, detail=False))
        try:
            node = p.resolve(steps)
        except PathFailure as x:
            told = p.failure(steps, x)
            yield {"outcome": x.kind, "step": told["step"], "resolved": told["resolved"], "candidates": [p.of[id(c)] for c in x.candidates], "suggestions": told["suggestions"]}
            return
        found = p.content(node, depth)
        yield {"mdpath": p.of[id(node)], "bytes": len(found.encode()), "content": found, "outcome": "success"}

    return per_document(docs, rows, CONTENT, key, text)


def tree(docs: DataFrame, path: str = "$", depth: int | None = None, blocks: bool = False, key: str = "doc_id", text: str = "source") -> DataFrame:
    """Nodes at and below a path in each document, in order; no rows where the path leads nowhere."""
    steps = parse_path(path)

    def rows(name, source: str):
        p = Paths(parse(source, detail=False))
        try:
            base = p.resolve(steps)
        except PathFailure:
            return
        for i, node in enumerate(p.tree(base, depth, blocks)):
            yield {"ord": i, **p.entry(node), "label": p.label(node, str(name))}

    return per_document(docs, rows, TREE, key, text)


__all__ = ["PathSyntax", "content", "tree"]
