"""Search queries beyond plain words: phrases, AND, OR, NOT, + and -, brackets, and ranges of terms.

Reading is lenient: what has no meaning is passed over, so any text is a query. Words beside each other must all occur;
AND binds closer than OR. A query that only excludes matches nothing.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import analyze

_TOKEN = re.compile(r'"([^"]*)"?|([\[{])\s*(\S+)\s+TO\s+([^\s\]}]+)\s*([\]}])|([()])|([+-])(?=\S)|([^\s()"\[\]{}]+)|\S')


@dataclass(frozen=True)
class Leaf:
    """A phrase of analysed terms, one of one term, or a range of terms (low and high, each with whether it counts itself)."""

    terms: tuple[str, ...] = ()
    low: tuple[str, bool] | None = None
    high: tuple[str, bool] | None = None


@dataclass
class Tree:
    """kind: leaf, and, or, not."""

    kind: str
    parts: list[Tree] = field(default_factory=list)
    leaf: Leaf | None = None

    def leaves(self, wanted: bool = True) -> list[Leaf]:
        """Those that a match may hold (wanted), or that exclude it."""
        if self.kind == "leaf":
            return [self.leaf] if wanted else []
        inner = not wanted if self.kind == "not" else wanted
        return list(dict.fromkeys(x for p in self.parts for x in p.leaves(inner)))


def is_plain(query: str) -> bool:
    """Whether a query is words alone, without any of the marks above."""
    return not re.search(r'["()\[\]{}]|(?:\A|\s)[+-]\S|(?:\A|\s)(?:AND|OR|NOT)(?:\s|\Z)', query)


def parse_query(query: str) -> Tree | None:
    """The query's tree; None if nothing in it can match."""
    tokens = [m for m in _TOKEN.finditer(query)]
    at = 0

    def either() -> Tree | None:
        nonlocal at
        found = [both()]
        while at < len(tokens) and tokens[at][8] == "OR":
            at += 1
            found.append(both())
        return _join("or", found)

    def both() -> Tree | None:
        nonlocal at
        found = []
        while at < len(tokens) and tokens[at][6] != ")" and tokens[at][8] != "OR":
            if tokens[at][8] == "AND":
                at += 1
                continue
            found.append(one())
        return _join("and", found)

    def one() -> Tree | None:
        nonlocal at
        m = tokens[at]
        at += 1
        if m[8] == "NOT" or m[7] == "-":
            x = one() if at < len(tokens) and tokens[at][6] != ")" else None
            return Tree("not", [x]) if x else None
        if m[7] == "+":
            return one() if at < len(tokens) else None
        if m[6] == "(":
            x = either()
            at += at < len(tokens)  # the closing bracket
            return x
        if m[2]:
            bound = lambda x, open_: None if x == "*" else ((analyze(x) or [x.lower()])[0], open_)
            return Tree("leaf", leaf=Leaf((), bound(m[3], m[2] == "["), bound(m[4], m[5] == "]")))
        terms = tuple(analyze(m[1] if m[1] is not None else m[8] or ""))
        return Tree("leaf", leaf=Leaf(terms)) if terms else None

    out = None
    while at < len(tokens):
        more = either()
        at += at < len(tokens)  # a closing bracket that none opened
        out = _join("and", [out, more])
    return out if out and out.leaves() else None


def _join(kind: str, parts: list[Tree | None]) -> Tree | None:
    found = [x for x in parts if x]
    return found[0] if len(found) == 1 else Tree(kind, found) if found else None


def _within(leaf: Leaf) -> Column:
    term, out = F.col("term"), F.lit(True)
    if leaf.low:
        out &= term >= leaf.low[0] if leaf.low[1] else term > leaf.low[0]
    if leaf.high:
        out &= term <= leaf.high[0] if leaf.high[1] else term < leaf.high[0]
    return out


def holding(found: DataFrame, units: DataFrame, tree: Tree, gain: Column) -> DataFrame:
    """(path, mdpath, parent_list, gain, in_context) of the units that the tree matches in their bodies. found are postings, gain
    what one adds to a score. Postings are filtered to the query's terms and ranges first; phrases are looked up in the bodies
    of units that hold all their terms, no others."""
    wanted, every = tree.leaves(), list(dict.fromkeys(tree.leaves() + tree.leaves(False)))
    terms = sorted({t for x in every for t in x.terms})
    ranges = [x for x in every if not x.terms]
    body, context = F.col("field") == "body", F.col("field") == "context"
    scored = functools.reduce(lambda a, b: a | b, [F.col("term").isin(*sorted({t for x in wanted for t in x.terms})), *(_within(x) for x in wanted if not x.terms)])
    has = {t: F.max(F.when(body & (F.col("term") == t), True)).alias(f"t{i}") for i, t in enumerate(terms)}
    within = {x: F.max(F.when(body & _within(x), True)).alias(f"r{i}") for i, x in enumerate(ranges)}
    own = functools.reduce(lambda a, b: a | b, [F.col("term").isin(*terms), *map(_within, ranges)])
    counted = [F.sum(F.when(body & scored, gain)).alias("gain"), F.count_distinct(F.when(context & scored, F.col("term"))).alias("n_context")]
    rows = found.where(own).groupBy("path", "mdpath", "parent_list").agg(*counted, *has.values(), *within.values())
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    named = {t: flag(f"t{i}") for i, t in enumerate(terms)}
    columns: dict[Leaf, Column] = {x: flag(f"r{i}") for i, x in enumerate(ranges)}
    phrases = [x for x in every if len(x.terms) > 1]
    for x in every:
        if x.terms:
            columns[x] = functools.reduce(lambda a, b: a & b, (named[t] for t in x.terms))
    if phrases:
        some = functools.reduce(lambda a, b: a | b, (columns[x] for x in phrases))
        texts = rows.where(some).select("path", "mdpath").join(units.select("path", "mdpath", "body"), ["path", "mdpath"])
        rows = rows.join(texts.select("path", "mdpath", _standing([x.terms for x in phrases])(F.col("body")).alias("_met")), ["path", "mdpath"], "left")
        for i, x in enumerate(phrases):
            columns[x] = columns[x] & F.coalesce(F.get("_met", F.lit(i)), F.lit(False))

    def holds(t: Tree) -> Column:
        if t.kind == "leaf":
            return columns[t.leaf]
        parts = [holds(p) for p in t.parts]
        return ~parts[0] if t.kind == "not" else functools.reduce((lambda a, b: a & b) if t.kind == "and" else (lambda a, b: a | b), parts)

    n = len({t for x in wanted for t in x.terms})
    positive = functools.reduce(lambda a, b: a | b, (columns[x] for x in wanted))
    return rows.where(holds(tree) & positive).select("path", "mdpath", "parent_list", F.coalesce("gain", F.lit(0.0)).alias("gain"), (F.lit(n > 0) & (F.col("n_context") >= n)).alias("in_context"))


def _standing(phrases: list[tuple[str, ...]]):
    """Of each body, whether the terms of each phrase stand side by side in it."""

    @F.pandas_udf("array<boolean>")
    def met(bodies: pd.Series) -> pd.Series:
        def one(body):
            terms = analyze(body or "")
            return [any(tuple(terms[i : i + len(p)]) == p for i in range(len(terms) - len(p) + 1)) for p in phrases]

        return bodies.map(one)

    return met
