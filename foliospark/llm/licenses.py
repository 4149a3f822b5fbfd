"""License scans: Aho-Corasick over normalised words, and a shunting-yard reader of licence expressions."""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORDS, scan, table

#: Phrases of whole words, the label of each, whether the phrase is one of the base ones, and what it weighs as evidence.
PHRASES = [
    ("under the mit license", "mit", True, 0.9),
    ("apache license version 2", "apache-2", True, 0.9),
    ("cc by nc", "cc-by-nc", True, 0.9),
    ("permission is hereby granted free of charge to any person", "mit", False, 0.8),
    ("licensed under the apache license", "apache-2", False, 0.7),
    ("gnu affero general public license", "agpl", False, 0.8),
    ("gnu lesser general public license", "lgpl", False, 0.8),
    ("gnu general public license", "gpl", False, 0.8),
    ("mozilla public license", "mpl", False, 0.8),
    ("redistribution and use in source and binary forms", "bsd", False, 0.8),
    ("creative commons attribution", "cc-by", False, 0.6),
    ("cc by sa", "cc-by-sa", False, 0.7),
    ("cc by nd", "cc-by-nd", False, 0.7),
    ("public domain dedication", "cc0", False, 0.6),
    ("all rights reserved", "all-rights-reserved", False, 0.5),
]
TAG = "spdx license identifier"
#: Identifiers that a corpus may take by default; an expression is permitted if some way of fulfilling it uses these alone.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "zlib", "cc-by-4.0", "0bsd"})
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}
#: What may stand between tokens; where an expression can't end yet it may go on in the next line, behind marks of a comment.
_GAP, _WRAP = re.compile(rb"[ \t]*"), re.compile(rb"[ \t]*(?:\r?\n[ \t]*(?:(?:#+|//+|\*+|;+|--+|%+)[ \t]*)?)?")
_WORD = re.compile(rb"[^ ]+")


def parse_expression(text: str | bytes, at: int = 0) -> list[str] | None:
    """The longest licence expression in text from at on, in postfix order; None if there is none.

    Shunting-yard, token by token until the expression ends, however long it is: and binds closer than or, with closer than
    both; all read from the left. Identifiers and operators are lower-cased. Unclosed brackets end the expression where it
    last was complete. Within brackets and behind an operator, the expression may go on in the next line.
    """
    data = text.encode() if isinstance(text, str) else text
    out: list[str] = []
    ops: list[str] = []
    best: tuple[int, list[str]] | None = None
    operand, depth = True, 0  # whether an identifier or an opening bracket is due; open brackets
    while True:
        wraps = depth > 0 or (operand and bool(ops))
        m = _TOKEN.match(data, (_WRAP if wraps else _GAP).match(data, at).end())
        if not m:
            break
        t, at = m[0].decode().lower(), m.end()
        if operand:
            if t == "(":
                ops.append(t)
                depth += 1
                continue
            if t in _BINDS or t == ")":
                break
            out.append(t)
            operand = False
        elif t == ")":
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif t in _BINDS:
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = True
            continue
        else:
            break
        if not depth:
            best = len(out), ops[::-1]
    return out[: best[0]] + best[1] if best else None


def permitted(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> bool:
    """Whether the expression can be fulfilled with allowed identifiers alone; an exception after with only adds rights."""
    stack: list[bool] = []
    for t in postfix:
        if t in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if t == "and" else a or b if t == "or" else a)
        else:
            stack.append(t.rstrip("+") in allowed)
    return stack[0]


def identifiers(postfix: list[str]) -> list[str]:
    """The licences named, without exceptions."""
    names: list[str] = []
    begins: list[int] = []  # where the names of each operand begin
    for t in postfix:
        if t in _BINDS:
            second = begins.pop()
            if t == "with":
                del names[second:]
        else:
            begins.append(len(names))
            names.append(t)
    return names


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label, base, weight in PHRASES:
        a.add_word(f" {phrase} ", (len(phrase) + 1, label, base, weight))
    a.add_word(f" {TAG} ", (len(TAG) + 1, None, False, 0.95))
    a.make_automaton()
    return a


def scan_text(data: bytes) -> dict:
    """All that one text shows: n_words, base places, labels, score and what its tags permit (None without tags)."""
    spaced = data.translate(WORDS)
    words = spaced.split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, base_labels, labels, miss, ok, tags = [], set(), set(), 1.0, None, []
    at, seen = 0, 0
    weights = {}
    for end, (back, label, is_base, weight) in automaton().iter(line):
        start = end - back
        if is_base or label is None:
            seen, at = (seen + line.count(" ", at, start), start) if start >= at else (line.count(" ", 0, start), start)
        if label is None:
            tags.append(seen)
            continue
        labels.add(label)
        weights[label] = max(weight, weights.get(label, 0))
        if is_base:
            base.append(seen)
            base_labels.add(label)
    for postfix in _tagged(data, spaced, tags):
        ok = permitted(postfix) and ok is not False
        for x in identifiers(postfix):
            labels.add(x)
            weights[x] = 0.95
    for w in weights.values():
        miss *= 1 - w
    return {"n_words": len(words), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None), "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": 1 - miss, "permitted": ok}


def _tagged(data: bytes, spaced: bytes, tags: list[int]) -> list[list[str]]:
    """The expressions behind the tags that begin with these words of a text, where there are any."""
    if not tags:
        return []
    wanted, out = {t + TAG.count(" ") for t in tags}, []
    for i, m in enumerate(_WORD.finditer(spaced)):
        if i in wanted:
            at = _GAP.match(data, m.end()).end()
            if found := parse_expression(data, at + (data[at : at + 1] == b":")):
                out.append(found)
    return out


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, permitted boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): see SCHEMA. One pass, no shuffle; null texts count as empty.

    n_base, first_word, last_word and base_labels tell the base phrases of PHRASES alone. labels has all phrases and
    the identifiers of SPDX tags. score is the chance that some licence applies, each label a separate witness.
    permitted tells whether all tags can be fulfilled with PERMISSIVE licences; null without tags. Empty texts and
    texts without licence have no labels, null places and score 0. Texts and expressions of any length are read to their
    end; repeated rows give repeated rows.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [scan_text(x or b"") for x in b.column("text").cast(pa.binary()).to_pylist()]
        types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "permitted": pa.bool_()}
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {k: pa.array([x[k] for x in out], t) for k, t in types.items()})

    return scan(docs.select("doc_id", "text"), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: licences in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
