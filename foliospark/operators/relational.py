"""Checks over tables of nodes as DataFrame plans: for node tables that are kept, so that documents need not be parsed again.

All tables have doc_id; headings also node_id (document order), parent_id and text. Everything but assign_ordered runs in
the JVM, and whatever is grouped is grouped by document and parent, so one shuffle by doc_id serves a chain of them.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import Matcher
from .paths import Step, parse_path
from .sequence import assign

#: Sections of a deeper level end at a heading of the same level or a lower one.
LEVELS = 6


def nest(headings: DataFrame) -> DataFrame:
    """headings (doc_id, node_id, level) with parent_id: the last earlier heading of a lower level that is still open, else 0."""
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.coalesce(F.last(F.when(F.col("level") == n, F.col("node_id")), True).over(w), F.lit(0)) for n in range(1, LEVELS + 1)]
    out = headings.withColumn("_last", F.array(*last))
    lower = F.slice("_last", F.lit(1), F.col("level") - 1)
    return out.withColumn("parent_id", F.when(F.col("level") > 1, F.coalesce(F.array_max(lower), F.lit(0))).otherwise(F.lit(0)).cast("int")).drop("_last")


def skipped_levels(nodes: DataFrame, base: Column | int = 0) -> DataFrame:
    """Sections more than one level under their parent, the root standing at base; no scope or guard matters."""
    return nodes.where((F.col("kind") == "section") & (F.col("level") > F.coalesce("above", F.lit(base) if isinstance(base, int) else base) + 1))


def admitted(nodes: DataFrame, base: int = 0, skips: bool = False) -> DataFrame:
    """Sections that may take part in their parent's rules."""
    if skips:
        return nodes.where("kind = 'section'")
    return nodes.where(may_take_part(base))


def may_take_part(base: int = 0) -> Column:
    """Whether a node is a section at most one level under what it lies in, the root standing at base."""
    return (F.col("kind") == "section") & (F.col("level") <= F.coalesce("above", F.lit(base)) + 1)


def _first(matchers: list[Matcher], text: Column) -> Column:
    """Index of the first matcher that matches, null if none: a chain of conditions, no join."""
    return F.coalesce(*(F.when(m.column(text), F.lit(i)) for i, m in enumerate(matchers)), F.lit(None).cast("int"))


def guarded(headings: DataFrame, guards: list[str], match_case: bool = False) -> DataFrame:
    """headings with guard: the first guard that matches; rows where it is null go on to the rules."""
    return headings.withColumn("guard", _first([Matcher.of(g, match_case) for g in guards], F.col("text")))


def classify(headings: DataFrame, rules: list[str], match_case: bool = False) -> DataFrame:
    """headings with rule: the first rule that matches, null if none does, as in an unordered scope."""
    return headings.withColumn("rule", _first([Matcher.of(r, match_case) for r in rules], F.col("text")))


def extras(headings: DataFrame, rules: list[str], match_case: bool = False) -> DataFrame:
    """headings that some rule matches; the others pass unseen."""
    return classify(headings, rules, match_case).where("rule is not null").drop("rule")


def assign_ordered(headings: DataFrame, rules: list[tuple[str, int, int | None]], match_case: bool = False) -> DataFrame:
    """headings with rule (null: none) and accepted (whether the whole scope is), as in an ordered scope; rules are
    (matcher, least, most).

    A scope, one parent's children, is gathered with its match results alone; it is bounded by what one document puts
    under one heading. Where all rules are different exact matchers, windows decide, and only scopes that fail are gathered.
    """
    matchers = [Matcher.of(m, match_case) for m, _, _ in rules]
    fits = headings.withColumn("fits", F.array(*(m.column(F.col("text")) for m in matchers)))
    scope = ["doc_id", "parent_id"]
    low, high, wild = [r[1] for r in rules], [r[2] for r in rules], [m.kind == "any" for m in matchers]
    if all(m.kind == "exact" for m in matchers) and len({m.pattern for m in matchers}) == len(matchers):
        return _assign_exact(fits, scope, low, high, wild)
    return _gathered(fits, scope, low, high, wild)


def _assign_exact(fits: DataFrame, scope: list[str], low: list[int], high: list[int | None], wild: list[bool]) -> DataFrame:
    one = F.array_position("fits", True) - 1
    x = fits.withColumn("rule", F.when(one >= 0, one.cast("int")))
    w = Window.partitionBy(*scope)
    back = F.col("rule") < F.lag("rule").over(w.orderBy("node_id"))
    counts = [F.sum((F.coalesce("rule", F.lit(-1)) == j).cast("int")).over(w) for j in range(len(low))]
    within = functools.reduce(operator.and_, [(c >= a) & (c <= b if b is not None else F.lit(True)) for c, a, b in zip(counts, low, high, strict=True)], F.lit(True))
    x = x.withColumn("_back", F.coalesce(F.col("rule").isNull() | back, F.lit(False))).withColumn("_within", within)
    x = x.withColumn("accepted", F.col("_within") & ~F.max("_back").over(w)).drop("_back", "_within")
    rest = _gathered(x.where("not accepted").drop("rule", "accepted"), scope, low, high, wild)
    return x.where("accepted").drop("fits").unionByName(rest)


def _gathered(fits: DataFrame, scope: list[str], low: list[int], high: list[int | None], wild: list[bool]) -> DataFrame:
    groups = fits.groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("node_id", "fits"))).alias("x"))
    groups = groups.select(*scope, F.col("x.node_id").alias("ids"), F.col("x.fits").alias("fits"))
    cost = np.array(wild, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rules, accepted = [], []
            for f in b.column("fits").to_pylist():
                taken, ok = assign(np.where(np.array(f, bool).reshape(len(f), len(low)), cost[None], -1), low, high, wild)
                rules.append([None if t < 0 else t for t in taken])
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(s) for s in scope] + [b.column("ids"), pa.array(rules, pa.list_(pa.int32())), pa.array(accepted, pa.bool_())], [*scope, "ids", "rules", "accepted"])

    kinds = ", ".join(f"`{s}` {fits.schema[s].dataType.simpleString()}" for s in scope)
    done = groups.mapInArrow(run, f"{kinds}, ids array<{fits.schema['node_id'].dataType.simpleString()}>, rules array<int>, accepted boolean")
    flat = done.select(*scope, "accepted", F.explode(F.arrays_zip("ids", "rules")).alias("z")).select(*scope, "accepted", F.col("z.ids").alias("node_id"), F.col("z.rules").alias("rule"))
    return fits.drop("fits").join(flat, [*scope, "node_id"])


def cardinality(scopes: DataFrame, taken: DataFrame, rules: list[tuple[str, int, int | None]]) -> DataFrame:
    """Diagnostics of counts: (doc_id, parent_id, rule, id, n, node_id of the first heading too many).

    scopes has every (doc_id, parent_id) to check, with headings or without; taken has rule. Counts are summed before the
    shuffle; the rules are literals, so no table of rules is joined.
    """
    w = Window.partitionBy("doc_id", "parent_id", "rule").orderBy("node_id")
    most = F.coalesce(*(F.when(F.col("rule") == j, F.lit(h)) for j, (_, _, h) in enumerate(rules) if h is not None), F.lit(None).cast("int"))
    over = taken.where("rule is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == most + 1).select("doc_id", "parent_id", "rule", "node_id")
    counts = taken.where("rule is not null").groupBy("doc_id", "parent_id").agg(*(F.count(F.when(F.col("rule") == j, 1)).alias(f"c{j}") for j in range(len(rules))))
    wide = scopes.select("doc_id", "parent_id").join(counts, ["doc_id", "parent_id"], "left")
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("rule"), F.coalesce(f"c{j}", F.lit(0)).alias("n"), F.lit(a).alias("low"), F.lit(b).cast("int").alias("high")) for j, (_, a, b) in enumerate(rules))))
    x = wide.select("doc_id", "parent_id", each.alias("x")).select("doc_id", "parent_id", "x.*")
    id_ = F.when((F.col("n") == 0) & (F.col("low") > 0), "missing-section").when(F.col("n") < F.col("low"), "too-few-sections").when(F.col("n") > F.col("high"), "too-many-sections")
    x = x.withColumn("id", id_).where("id is not null").drop("low", "high")
    return x.join(over, ["doc_id", "parent_id", "rule"], "left")


def value_order(taken: DataFrame, key: Column, descending: bool = False, strict: bool = False, scope: tuple[str, ...] = ("doc_id", "parent_id", "rule")) -> DataFrame:
    """Second nodes of neighbours whose keys stand in the wrong order. A key that is null, an invalid value, leaves its
    whole sequence out: values around it were never neighbours."""
    x = taken.withColumn("_key", key)
    w = Window.partitionBy(*scope)
    x = x.withColumn("_before", F.lag("_key").over(w.orderBy("node_id"))).withColumn("_bad", F.max(F.col("_key").isNull()).over(w))
    a, b = (F.col("_key"), F.col("_before")) if descending else (F.col("_before"), F.col("_key"))
    return x.where(~F.col("_bad") & F.col("_before").isNotNull() & (a >= b if strict else a > b)).drop("_key", "_before", "_bad")


def constraint(kind: str, operands: list[Column], condition: Column | None = None) -> Column:
    """Whether a constraint holds, of boolean operands that are never null."""
    n = functools.reduce(operator.add, [x.cast("int") for x in operands])
    every, some = functools.reduce(operator.and_, operands), functools.reduce(operator.or_, operands)
    return {
        "one_of": lambda: n == 1,
        "any_of": lambda: n >= 1,
        "at_most_one": lambda: n <= 1,
        "all_or_none": lambda: n.isin(0, len(operands)),
        "requires": lambda: ~condition | every,
        "conflicts": lambda: ~condition | ~some,
    }[kind]()


def violated(holds: Column, suppressed: list[Column]) -> Column:
    """Whether to report: any operand that can't be told hides the constraint, whatever the others say."""
    return ~holds & ~functools.reduce(operator.or_, suppressed, F.lit(False))


def sets_in_order(taken: DataFrame, rules: list[int]) -> DataFrame:
    """(doc_id, parent_id, holds): whether all nodes of each listed rule come before those of the next one that has any."""
    ends = taken.where(F.col("rule").isin(rules)).groupBy("doc_id", "parent_id").agg(*(f(F.when(F.col("rule") == r, F.col("node_id"))).alias(f"{n}{k}") for k, r in enumerate(rules) for n, f in (("a", F.min), ("b", F.max))))
    holds, last = F.lit(True), F.lit(None).cast("int")
    for k in range(len(rules)):
        holds = holds & F.coalesce(last < F.col(f"a{k}"), F.lit(True))
        last = F.coalesce(F.col(f"b{k}"), last)
    return ends.select("doc_id", "parent_id", holds.alias("holds"))


def front_equals(values: DataFrame, pointer: str, kind: str, text: str) -> DataFrame:
    """Documents with a value there of that kind and text. The pointer reaches the scan as a filter."""
    return values.where((F.col("pointer") == pointer) & (F.col("kind") == kind) & (F.col("text") == text)).select("doc_id").distinct()


def front_boolean(values: DataFrame, pointer: str) -> DataFrame:
    """(doc_id, holds, invalid) of a boolean read: true if some value is true; values that are neither boolean nor null are invalid."""
    x = values.where(F.col("pointer") == pointer)
    return x.groupBy("doc_id").agg(F.bool_or((F.col("kind") == "boolean") & (F.lower("text") == "true")).alias("holds"), F.bool_or(~F.col("kind").isin("boolean", "null")).alias("invalid"))


def canonical_steps(nodes: DataFrame) -> DataFrame:
    """Sections with step: their slug, with a number where siblings share it, or their position without one."""
    s = nodes.where("kind = 'section'")
    w = Window.partitionBy("doc_id", "parent_id", "slug")
    many = F.count("*").over(w) > 1
    number = F.row_number().over(w.orderBy("node_id")) - 1
    step = F.when(F.col("slug") == "", F.format_string(".[%d]", F.col("ord"))).when(many, F.format_string(".%s[%d]", F.col("slug"), number)).otherwise(F.concat(F.lit("."), "slug"))
    return s.withColumn("step", step)


def resolve(nodes: DataFrame, path: str) -> DataFrame:
    """What a path leads to in each document: (doc_id, outcome, done, n, node_id, mdpath). Each step is one filtered join,
    by document; outcome is success, unresolved or ambiguous, done counts the steps taken, n the candidates of the last."""
    steps = parse_path(path)
    merged = F.col("_tops") == 1
    tops = nodes.where("kind = 'section' and parent_id = 0").groupBy("doc_id").agg(F.count("*").alias("_tops"), F.min("level").alias("_level"), F.min("node_id").alias("_title"))
    root = nodes.where("kind = 'root'").select("doc_id", F.col("last_id").alias("hi"))
    now = root.join(tops, "doc_id", "left").withColumn("title", F.when(merged & (F.col("_level") == 1), F.col("_title"))).select("doc_id", F.lit(0).alias("at"), "hi", "title", F.lit("success").alias("outcome"), F.lit(0).alias("done"), F.lit(1).cast("long").alias("n"))
    for s in steps:
        now = _step(nodes, now, s)
    here = nodes.select("doc_id", F.col("node_id").alias("at"), "mdpath")
    return now.join(here, ["doc_id", "at"], "left").select("doc_id", "outcome", "done", "n", F.when(F.col("outcome") == "success", F.col("at")).alias("node_id"), F.when(F.col("outcome") == "success", F.col("mdpath")).alias("mdpath"))


def _step(nodes: DataFrame, now: DataFrame, s: Step) -> DataFrame:
    x = nodes.select("doc_id", "node_id", "parent_id", "last_id", "kind", "slug", F.col("kind_ord"))
    live = now.where("outcome = 'success'")
    pool = x.join(live.select("doc_id", "at", "hi", "title"), "doc_id")
    owner = (F.col("parent_id") == F.col("at")) | (F.col("at") == 0) & (F.col("parent_id") == F.col("title"))
    if s.kind in ("child", "at", "deep"):
        under = (F.col("node_id") > F.col("at")) & (F.col("node_id") <= F.col("hi")) if s.kind == "deep" else owner
        pool = pool.where((F.col("kind") == "section") & under & (F.col("title").isNull() | (F.col("node_id") != F.col("title"))))
        if s.slug:
            pool = pool.where(F.col("slug") == s.slug)
    else:
        pool = pool.where((F.col("kind") == s.kind) & owner)
    picked = F.sort_array(F.collect_list(F.struct("node_id", "last_id")))
    index = s.index or 0
    found = pool.groupBy("doc_id").agg(F.count("*").alias("_n"), picked.alias("_x"))
    found = found.select("doc_id", "_n", F.get("_x", F.lit(index)).alias("_x"))
    out = live.join(found, "doc_id", "left").withColumn("n", F.coalesce("_n", F.lit(0).cast("long")))
    unsure = F.lit(s.index is None) & (F.col("n") > 1)
    outcome = F.when(unsure, "ambiguous").when(F.col("_x").isNull(), "unresolved").otherwise("success")
    ok = outcome == "success"
    out = out.select("doc_id", F.when(ok, F.col("_x.node_id")).otherwise(F.col("at")).alias("at"), F.when(ok, F.col("_x.last_id")).otherwise(F.col("hi")).alias("hi"), "title", outcome.alias("outcome"), (F.col("done") + ok.cast("int")).alias("done"), "n")
    return out.unionByName(now.where("outcome <> 'success'"))


def section_text(nodes: DataFrame, docs: DataFrame, node_ids: DataFrame) -> DataFrame:
    """(doc_id, node_id, content) of whole sections or blocks: a slice of the source's bytes. docs has doc_id, source."""
    at = node_ids.select("doc_id", "node_id").join(nodes.select("doc_id", "node_id", "start", "extent"), ["doc_id", "node_id"])
    cut = F.substring(F.col("source").cast("binary"), F.col("start").cast("int") + 1, (F.col("extent") - F.col("start")).cast("int"))
    return at.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "node_id", F.decode(cut, "UTF-8").alias("content"))


def near_slugs(nodes: DataFrame, slug: str) -> DataFrame:
    """Sections whose slug, without leading numbers, is a typing error away from slug: (doc_id, node_id, slug, distance)."""
    from ..functions.text import numbered_tail
    from .paths import limit

    d = F.levenshtein(numbered_tail(F.col("slug")), F.lit(slug), limit(slug))
    return nodes.where("kind = 'section'").select("doc_id", "node_id", "mdpath", "slug", d.alias("distance")).where("distance >= 0")
