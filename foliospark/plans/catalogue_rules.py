"""More queries of the catalogue: schemas, the forms of Markdown, single diagnostics, values, texts and the index on disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import typed
from ..functions.columns import columns
from ..functions.patterns import Matcher
from ..operators import parse, read, relational, search
from ..operators.query import parse_query
from . import rendered as r
from .catalogue import _BARE, _HAS, _FLAGS, _ORDER, _SEQ, _L, by_document, query
from .render import exit_status, human_report
from .validate import schema_errors, validate, validate_each

_HEAD = "version: 1\ntitle: NAME\n"
_ONE = _HEAD + "sections:\n- {match: NAME, id: a, required: false}\n"
_GROUP = _HEAD + "sections:\n- match: '/NAME (?<n>[0-9]+)/'\n"
#: Schemas, and the id, line and column of what is wrong with each.
SCHEMAS = [
    ("version: 1\ntitle: [NAME\n", "syntax", 3, 1),
    ("version: 1\ntitle: NAME\n---\nversion: 1\n", "syntax", 3, 1),
    ("version: 1\ntitle: !own NAME\n", "syntax", 2, 8),
    ("version: 1\nversion: 1\ntitle: NAME\n", "syntax", 2, 1),
    ("version: 2\ntitle: NAME\n", "unsupported-version", 1, 10),
    ("title: NAME\n", "invalid-document-shape", 1, 1),
    (_HEAD + "colour: red\n", "invalid-document-shape", 3, 1),
    ("version: 1\ntitle: NAME\noutline:\n- match: NAME\n", "conflicting-outline", 3, 1),
    (_HEAD + "sections:\n- NAME\n", "invalid-document-shape", 4, 3),
    (_HEAD + "unordered: true\nsections:\n- {match: '*', repeat: '0..n'}\n- match: NAME\n", "unreachable-rule", 6, 10),
    (_HEAD + "sections:\n- match: '/NAME(/'\n  required: true\n", "invalid-matcher", 4, 10),
    (_HEAD + "sections:\n- match: '/(?=NAME)x/'\n  required: true\n", "invalid-matcher", 4, 10),
    (_HEAD + "sections:\n- match: '/NAME/x/'\n  required: true\n", "invalid-matcher", 4, 10),
    (_HEAD + "sections:\n- {match: NAME, required: true, repeat: '1..2'}\n", "conflicting-cardinality", 4, 35),
    (_HEAD + "sections:\n- {match: NAME, repeat: '3..2'}\n", "invalid-repeat", 4, 27),
    (_HEAD + "sections:\n- match: 'NAME *'\n", "missing-cardinality", 4, 10),
    (_HEAD + "sections:\n- {match: NAME, id: fm}\n", "reserved-id", 4, 23),
    (_HEAD + "sections:\n- {match: NAME, id: a}\n- {match: NAME 2, id: a}\n", "duplicate-id", 5, 3),
    (_GROUP + "  required: false\n  captures: {m: int}\n", "invalid-capture", 6, 14),
    (_HEAD + "sections:\n- match: '/NAME (?<n>[0-9]+)?/'\n  required: false\n  captures: {n: int}\n", "invalid-capture", 6, 14),
    (_GROUP + "  repeat: 0..n\n  captures: {n: int, n: int}\n", "invalid-capture", 6, 22),
    (_GROUP + "  repeat: 0..n\n  captures: {n: int}\n  order:\n  - by: m\n", "invalid-order", 8, 9),
    (_GROUP + "  required: false\n  captures: {n: int}\n  order:\n  - by: n\n", "invalid-order", 7, 3),
    (_HEAD + "content:\n- {block: NAME}\n", "invalid-content-rule", 4, 11),
    (_HEAD + "content:\n- {block: p, list_kind: bullet}\n", "invalid-content-rule", 4, 14),
    (_HEAD + "content:\n- one_of:\n  - block: p\n  - block: p\n", "invalid-content-rule", 6, 5),
    (_ONE + "constraints:\n- any_of: [a, b]\n", "unresolved-ref", 6, 15),
    (_ONE + "constraints:\n- any_of: [a, a/p]\n", "unresolved-ref", 6, 15),
    (_ONE + "constraints:\n- any_of: [a, $.a]\n", "duplicate-ref", 6, 15),
    (_ONE + "constraints:\n- any_of: [a]\n", "invalid-document-shape", 6, 11),
    (_ONE + "- {match: NAME 2, id: b, required: false}\nconstraints:\n- ordered: [a, b]\n", "ordered-scope-mismatch", 7, 12),
    (_HEAD + "frontmatter:\n  schema: {type: NAME}\n", "invalid-frontmatter-schema", 4, 11),
    (_HEAD + "frontmatter:\n  schema: {$ref: other.json}\n", "invalid-frontmatter-schema", 4, 11),
    (_HEAD + "frontmatter:\n  captures:\n    name: {type: NAME}\n", "invalid-capture", 5, 18),
    (_HEAD + "frontmatter:\n  captures:\n    name: {type: int, path: 'x'}\n", "invalid-capture", 5, 29),
    (_HEAD + "sections:\n- match: NAME\n", None, None, None),
]
_EXPECTED = ", ".join(f"({i}, '{x[1]}', {x[2]}, {x[3]})" for i, x in enumerate(SCHEMAS) if x[1])


@query(f"SELECT n_nationkey * 1000 + k AS doc_id, id, line::bigint AS line, col::bigint AS col FROM nation, (VALUES {_EXPECTED}) AS v(k, id, line, col)")
def schema_error_places(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([(i, x[0]) for i, x in enumerate(SCHEMAS)], "k int, source string")
    n = r.table(spark, d, "nation").select("n_nationkey", "n_name")
    name = F.regexp_replace("n_name", "[^A-Z]", "")
    docs = n.join(F.broadcast(kinds)).select((F.col("n_nationkey") * 1000 + F.col("k")).alias("doc_id"), F.replace("source", F.lit("NAME"), name).alias("source"))
    return schema_errors(docs).select("doc_id", "id", "line", "col")


def _by_kind(column: str, forms: list[str]) -> Column:
    """The form whose number is what is left of column divided by their number, NAME in it being p_name."""
    k = F.col(column) % len(forms)
    out = F.lit(None).cast("string")
    for i, x in enumerate(forms):
        out = F.when(k == i, F.replace(F.lit(x), F.lit("NAME"), F.col("p_name"))).otherwise(out)
    return out


def _forms(spark: SparkSession, d: str, forms: list[str]) -> DataFrame:
    return r.parts(spark, d).select(F.col("p_partkey").alias("doc_id"), _by_kind("p_partkey", forms).alias("source"))


def _cases(n: int, cases: dict[int, str]) -> str:
    return f"CASE p_partkey % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " END"


# The forms of Markdown.

_HEADINGS = ["# NAME", "   ### NAME", "    ## NAME", "####### NAME", "## NAME ##", "## NAME#", "##NAME", "## NAME &amp; \\*x\\*", "##", "NAME\n===", "NAME\n---", "```\n# NAME\n```", "> # NAME", "#\tNAME"]


@query(f"SELECT doc_id, level, shown FROM (SELECT p_partkey AS doc_id, {_cases(14, {0: 1, 1: 3, 4: 2, 5: 2, 7: 2, 8: 2, 9: 1, 10: 2})}::int AS level, {_cases(14, {0: 'p_name', 1: 'p_name', 4: 'p_name', 5: chr(39).join(['p_name || ', '#', '']), 7: chr(39).join(['p_name || ', ' & *x*', '']), 8: chr(39) * 2, 9: 'p_name', 10: 'p_name'})} AS shown FROM part) WHERE level IS NOT NULL")
def heading_forms(spark: SparkSession, d: str) -> DataFrame:
    return parse.nodes(_forms(spark, d, _HEADINGS)).where("kind = 'section'").select("doc_id", "level", "shown")


_ITEM_FORMS = ["- NAME\n- two", "* NAME\n\n* two", "- > NAME\n- two", "-\n- two", "1. NAME\n   more\n2. two", "- **NAME** `x` [y](z) ![w](v)\n- two"]


@query(f"SELECT p_partkey AS doc_id, {_cases(6, {0: 'p_name', 1: 'p_name', 2: 'NULL', 3: 'NULL', 4: "p_name || chr(10) || 'more'", 5: chr(39).join(['p_name || ', ' x y w', ''])})} AS shown, CASE WHEN p_partkey % 6 = 4 THEN 'ordered' ELSE 'bullet' END AS list_kind, 'two' AS second FROM part")
def item_texts(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(_forms(spark, d, _ITEM_FORMS))
    return n.groupBy("doc_id").agg(F.max(F.when((F.col("kind") == "item") & (F.col("ord") == 0), F.col("shown"))).alias("shown"), F.max("list_kind").alias("list_kind"), F.max(F.when((F.col("kind") == "item") & (F.col("ord") == 1), F.col("shown"))).alias("second"))


_BLOCK_FORMS = ["NAME\n\n<!-- NAME -->\n\n- NAME\n", "<div>NAME</div>\n\nNAME\n\n***\n", "> NAME\n\n```\nNAME\n```\n", "<!-- NAME\n-->\n<!-- x -->\n\nNAME\n"]


@query(f"SELECT p_partkey AS doc_id, {_cases(4, {0: chr(39) + 'p,list' + chr(39), 1: chr(39) + 'html,p,break' + chr(39), 2: chr(39) + 'quote,code' + chr(39), 3: chr(39) + 'p' + chr(39)})} AS kinds FROM part")
def transparent_comments(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(_forms(spark, d, _BLOCK_FORMS)).where("parent_id = 0 and kind <> 'item'")
    return n.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


@query(f"SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'list' ELSE 'p' END AS kind, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY rn) - 1)::int AS kind_ord, 'Order ' || l_orderkey AS within FROM {_SEQ} s")
def kind_ordinals(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "\n1. ").otherwise("\n"), r.flag_heading().substr(4, 1), F.lit("\n\n<!-- x -->"))
    n = parse.nodes(r.order_documents(spark, d, text)).where("kind in ('p', 'list')")
    return n.select("doc_id", "kind", "kind_ord", F.element_at("header_path", -1).alias("within"))


@query("SELECT p_partkey AS doc_id, 2::int AS level, p_name || ' & x y z' AS shown, '**' || p_name || '** & `x` [y](z) <b>z</b>' AS text FROM part")
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    docs = r.parts(spark, d).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("## **"), "p_name", F.lit("** &amp; `x` [y](z) <b>z</b>\n")).alias("source"))
    return parse.nodes(docs, strip=False).where("kind = 'section'").select("doc_id", "level", "shown", "text")


# Matchers and admission.


@query("SELECT c_nationkey AS doc_id, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING' GROUP BY 1")
def exact_match_case(spark: SparkSession, d: str) -> DataFrame:
    from .catalogue import _segments

    return _segments(spark, d).where(Matcher.of("BUILDING", match_case=True).column(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) FILTER (WHERE l_quantity <= 25) AS strict, count(*) FILTER (WHERE l_orderkey IS NOT NULL) AS loose, count(*) FILTER (WHERE l_quantity > 25) AS skipped FROM {_L} GROUP BY doc_id HAVING count(l_orderkey) > 0")
def level_admission(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("l_quantity") > 25, "\n# Top\n\n### ").otherwise("\n# Top\n\n## "), F.col("l_linenumber").cast("string"))
    n = parse.nodes(r.order_documents(spark, d, text), fields=["kind", "level", "above"]).where("kind = 'section' and level > 1")
    out = n.groupBy("doc_id").agg(F.count_if(relational.may_take_part()).alias("strict"), F.count("*").alias("loose"))
    return out.withColumn("skipped", F.col("loose") - F.col("strict"))


@query(f"SELECT doc_id, count(*) AS strict, 0::bigint AS loose FROM {_L} WHERE l_quantity > 25 GROUP BY doc_id")
def skipped_levels_allowed(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("l_quantity") > 25, "#### Deep ").otherwise("## Flat "), F.col("l_linenumber").cast("string"))
    docs = r.order_documents(spark, d, text)
    rules = 'unordered: true\nsections:\n- {match: "Flat *", repeat: "0..n", sections: [{match: "Deep *", repeat: "0..n"}]}\n- {match: "Deep *", repeat: "0..n"}\n'
    schemas = {"strict": _ORDER + rules, "loose": _ORDER + "options: {allow_skipped_levels: true}\n" + rules}
    found = validate_each(docs, schemas, ["schema", "id"]).where("schema = 'loose' or id = 'skipped-level'")
    out = found.groupBy("doc_id").agg(F.count_if(F.col("schema") == "strict").alias("strict"), F.count_if(F.col("schema") == "loose").alias("loose"))
    return out.select("doc_id", F.expr("nullif(strict, 0)").alias("strict"), "loose")


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '/' || p_name || '/' ELSE '*' END AS label FROM part")
def matcher_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = r.parts(spark, d).select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/"), "p_name", F.lit("/"))).otherwise("*").alias("source"))
    return parse.per_document(docs, lambda _, x: iter([{"label": Matcher.of(x).label}]), columns("label string"))


# Content and items, one diagnostic each.


def _content(spark: SparkSession, d: str, forms: list[str], schema: str) -> DataFrame:
    return by_document(validate(_forms(spark, d, forms), "version: 1\ntitle: '*'\n" + schema, fields=["id"]))


@query("SELECT p_partkey AS doc_id, 'too-few-blocks' AS id, 1::bigint AS n FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'missing-block', 1 FROM part WHERE p_partkey % 3 = 0")
def too_few_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, ["# T\n", "# T\n\nNAME\n", "# T\n\nNAME\n\nmore\n"], 'content:\n- {block: p, repeat: "2..3"}\n')


@query("SELECT p_partkey AS doc_id, u.id AS id, 1::bigint AS n FROM part, (VALUES ('misplaced-block'), ('missing-block')) AS u(id) WHERE p_partkey % 2 = 1")
def misplaced_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _content(spark, d, ["# T\n\nNAME\n\n- NAME\n", "# T\n\n- NAME\n\nNAME\n"], "content:\n- block: p\n- block: list\n")


@query("""SELECT p_partkey AS doc_id, id, 1::bigint AS n FROM part, (VALUES (1, 'missing-item'), (2, 'too-few-items'), (3, 'too-many-items'), (4, 'misplaced-item'), (4, 'missing-item'), (5, 'unexpected-item')) AS v(k, id) WHERE p_partkey % 6 = k""")
def item_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    forms = ["- a\n- a\n- NAME", "- NAME", "- a\n- NAME", "- a\n- a\n- a\n- a\n- NAME", "- NAME\n- a\n- a", "- a\n- a\n- NAME\n- zz"]
    schema = "content:\n- block: list\n  items:\n  - {match: a, repeat: '2..3'}\n  - {match: '/.+ .+/', required: true}\n"
    return _content(spark, d, [f"# T\n\n{x}\n" for x in forms], schema)


@query("SELECT p_partkey AS doc_id, ord::int AS ord, ord::bigint AS place FROM part, range(13) AS u(ord) WHERE p_partkey % 2 = 0")
def item_positions_in_order(spark: SparkSession, d: str) -> DataFrame:
    docs = _forms(spark, d, ["# T\n\n" + "- NAME\n" * 13, "# T\n\n- a\n"])
    found = validate(docs, "version: 1\ntitle: T\ncontent:\n- block: list\n  items:\n  - {match: a, required: false}\n", fields=["ord", "id", "target"]).where("id = 'unexpected-item'")
    return found.select("doc_id", "ord", F.get_json_object("target", "$.index").cast("bigint").alias("place"))


# Frontmatter.


@query("SELECT event_id AS doc_id, 'forbidden-frontmatter' AS id, 1::bigint AS line FROM events")
def forbidden_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return validate(r.event_documents(spark, d, F.concat(F.lit("k: "), "k")), _BARE + "frontmatter: {allow: false}\n", fields=["id", "line"]).select("doc_id", "id", "line")


_K = "(json_extract_string(props, '$.k'))::bigint"


@query(f"SELECT event_id AS doc_id, CASE WHEN {_K} % 3 = 2 THEN 'invalid-value' ELSE 'any_of' END AS id FROM events WHERE {_K} % 3 = 2 OR {_K} % 3 = 1")
def capture_truth(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k").cast("long") % 3
    docs = r.event_documents(spark, d, F.concat(F.lit("on: "), F.when(k == 0, "true").when(k == 1, "false").otherwise("maybe")))
    schema = _BARE + "frontmatter:\n  captures:\n    switch: {type: bool, path: $.on}\nconstraints:\n- any_of: [fm.switch, 'fm[$.none]']\n"
    return validate(docs, schema, fields=["id"]).select("doc_id", "id")


@query("SELECT event_id AS doc_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def results_met_once(spark: SparkSession, d: str) -> DataFrame:
    docs = r.event_documents(spark, d, F.concat(F.lit("flag: "), F.when(F.col("event_id") % 2 == 0, "often").otherwise("true")))
    found = validate(docs, _BARE + "constraints:\n- any_of: [\"fm[$['flag','flag','flag']]\", 'fm[$.none]']\n", fields=["id"]).where("id = 'invalid-value'")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT event_id AS doc_id, row_number() OVER (PARTITION BY event_id ORDER BY p)::int - 1 AS ord, p AS pointer FROM events, (VALUES ('/a'), ('/b/0'), ('/b/1')) AS v(p)")
def schema_errors_by_pointer(spark: SparkSession, d: str) -> DataFrame:
    docs = r.event_documents(spark, d, F.lit("b: [x, y]"), F.concat(F.lit("a: "), "k"))
    schema = _BARE + "frontmatter:\n  schema:\n    properties:\n      b: {items: {type: integer}}\n      a: {type: string}\n"
    found = validate(docs, schema, fields=["target"]).select("doc_id", F.get_json_object("target", "$.pointer").alias("pointer"))
    return found.select("doc_id", F.row_number().over(_window("doc_id", "pointer")).cast("int").alias("o"), "pointer").select("doc_id", (F.col("o") - 1).alias("ord"), "pointer")


def _window(key: str, *order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy(*order)


@query("SELECT event_id AS doc_id, CASE event_id % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' WHEN 2 THEN 'float' END AS kind, CASE WHEN event_id % 4 = 3 THEN 'invalid-frontmatter' END AS id FROM events")
def tagged_scalars(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    value = F.when(k == 0, F.concat(F.lit('!!int "'), "k", F.lit('"'))).when(k == 1, F.concat(F.lit("!!str "), "k")).when(k == 2, F.concat(F.lit("!!float "), "k")).otherwise(F.repeat(F.lit("["), 200))
    docs = r.event_documents(spark, d, F.concat(F.lit("v: "), value))
    values = parse.front_values(docs, fields=["pointer", "kind"]).where("pointer = '/v'").select("doc_id", "kind")
    found = validate(docs, _BARE, fields=["id"]).select("doc_id", "id")
    return docs.select("doc_id").join(values, "doc_id", "left").join(found, "doc_id", "left").select("doc_id", "kind", "id")


# Roots and constraints.


@query(f"SELECT doc_id, 'missing-section' AS id, 1::bigint AS n FROM {_HAS} WHERE NOT a UNION ALL SELECT doc_id, 'unexpected-section', c FROM (SELECT l_orderkey AS doc_id, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)")
def general_root(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# "), F.col("l_returnflag"))
    docs = r.joined(r.order_lines(spark, d), "o_orderkey", r.LINES, F.when(F.col("l_orderkey").isNotNull(), text), dealt=True)
    return by_document(validate(docs, "version: 1\nunordered: true\noutline:\n- {match: A, repeat: '1..n'}\n- {match: N, repeat: '0..n'}\n", fields=["id"]))


@query(f"SELECT doc_id, na + nn AS involved, 2::bigint AS refs FROM (SELECT doc_id, count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag = 'N') AS nn FROM {_L} GROUP BY 1) WHERE na > 0 AND nn > 0")
def involved_headers(spark: SparkSession, d: str) -> DataFrame:
    found = validate(r.order_documents(spark, d, r.flag_heading()), _ORDER + "unordered: true\n" + _FLAGS + "constraints:\n- at_most_one: [a, n]\n", fields=["involved", "refs"])
    return found.select("doc_id", F.size("involved").cast("long").alias("involved"), F.size("refs").cast("long").alias("refs"))


@query(f"SELECT doc_id, exit::int AS status, lines FROM (SELECT doc_id, CASE WHEN count(l_orderkey) > 0 THEN 1 ELSE 0 END AS exit, count(l_orderkey) AS lines FROM {_L} GROUP BY doc_id)")
def reports_and_status(spark: SparkSession, d: str) -> DataFrame:
    docs = r.order_documents(spark, d, r.flag_heading())
    each = validate(docs, _ORDER + "sections: []\n", fields=["ord", "line", "col", "id", "message"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "line", "col", "id", "message"))).alias("x"))

    @F.pandas_udf("long")
    def lines(x):
        return x.map(lambda rows: len(human_report("a.md", [q if isinstance(q, dict) else q.asDict() for q in rows]).splitlines()) if rows is not None else 0)

    n = F.coalesce(lines("x"), F.lit(0))
    return docs.select("doc_id").join(each, "doc_id", "left").select("doc_id", F.when(n > 0, exit_status(1)).otherwise(exit_status(0)).cast("int").alias("status"), n.cast("long").alias("lines"))


# Values and texts.


@query("SELECT p_partkey AS doc_id, '-' || p_size AS whole, p_size || '.0.' || p_partkey AS dotted, p_size || '.0.' || p_partkey || '-rc.1' AS semver FROM part WHERE p_size > 0")
def canonical_values(spark: SparkSession, d: str) -> DataFrame:
    p = r.parts(spark, d).where("p_size > 0")
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("-00"), F.col("p_size").cast("string"), F.lit(" 0"), F.col("p_size").cast("string"), F.lit(".00."), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_size").cast("string"), F.lit(".0."), F.col("p_partkey").cast("string"), F.lit("-rc.1")).alias("source"))

    def rows(_, x: str):
        a, b, c = x.split(" ")
        yield {"whole": typed.canonical("int", a), "dotted": typed.canonical("dotted", b), "semver": typed.canonical("semver", c)}

    return parse.per_document(docs, rows, columns("whole string, dotted string, semver string"))


@query("SELECT p_partkey AS doc_id, replace(p_name, ' ', '-') AS tail, least(3, greatest(1, ceil(length(p_name) / 3.0)))::int AS most FROM part")
def numbered_slugs(spark: SparkSession, d: str) -> DataFrame:
    p = r.parts(spark, d).select(F.col("p_partkey").alias("doc_id"), t.slug_column(F.concat(F.col("p_size").cast("string"), F.lit(". "), F.col("p_partkey").cast("string"), F.lit(") "), "p_name")).alias("slug"))
    tail = t.numbered_tail(F.col("slug"))
    return p.select("doc_id", tail.alias("tail"), t.typo_limit(tail).alias("most"))


@query(r"SELECT p_partkey AS doc_id, p_name || '\t\\u{7}\\' AS compact, p_name || '\t\u{7}\' AS human FROM part".replace(r"\\u{7}\\' AS compact", r"\u{7}\\' AS compact"))
def escapes(spark: SparkSession, d: str) -> DataFrame:
    docs = r.parts(spark, d).select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit("\t\x07\\")).alias("source"))
    return parse.per_document(docs, lambda _, x: iter([{"compact": t.escape_compact(x), "human": t.escape_human(x)}]), columns("compact string, human string"))


@query("SELECT p_partkey AS doc_id, p_partkey % 3 = 0 AS plain, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END::int AS n FROM part WHERE p_name LIKE '% %'")
def plain_queries(spark: SparkSession, d: str) -> DataFrame:
    docs = r.parts(spark, d).where("p_name like '% %'").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, " OR x").otherwise(' "x"')).alias("source"))

    def rows(_, x: str):
        words = search.simple_terms(x)
        yield {"plain": words is not None, "n": len(words or [])}

    return parse.per_document(docs, rows, columns("plain boolean, n int"))


@query("SELECT p_partkey AS doc_id, true AS starts, true AS cut, true AS whole FROM part")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = r.parts(spark, d).select(F.col("p_partkey").alias("doc_id"), F.concat(F.repeat(F.lit("pad "), 100), "p_name", F.lit(" "), F.repeat(F.lit("x "), 200)).alias("source"))

    def rows(_, x: str):
        name = x[400:].split(" ", 1)[0]
        s = search.snippet(x, set(search.query_terms(name)))
        yield {"starts": s.startswith("…") and name in s, "cut": s.endswith("…") and len(s) > 100, "whole": len(s) <= search.SNIPPET + 2}

    return parse.per_document(docs, rows, columns("starts boolean, cut boolean, whole boolean"))


# Search beyond words.


@query("SELECT p_partkey::varchar AS path FROM part WHERE (p_name IN ('red bolt', 'hot ring') OR p_name LIKE 'cold %') AND p_name NOT LIKE '% gear'")
def search_boolean(spark: SparkSession, d: str) -> DataFrame:
    p = r.parts(spark, d)
    u = p.select(F.col("p_partkey").cast("string").alias("path"), F.lit("$").alias("mdpath"), F.lit(None).cast("string").alias("parent_list"), F.col("p_name").alias("body"), F.lit("").alias("context"))
    found, tree = search.postings(u), parse_query('("red bolt" OR "hot rings" OR [cold TO cold]) -gear')
    return search.ranked_query(found, u, search.statistics(u, found, ["red", "bolt", "hot", "ring"]), tree).select("path")


# Units and the index on disk.


@query("SELECT 'docs/' || p_partkey || '.md' AS path, p_partkey || ' / Top / ' || p_name AS context, 'See ' || p_name || ': one' AS body, 'p' AS kind FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'docs/' || p_partkey || '.md', p_partkey || ' / Top / ' || p_name, 'one', 'p' FROM part WHERE p_partkey % 2 = 1")
def unit_contexts(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("See "), "p_name", F.lit(":\n\n"))).otherwise("")
    docs = r.parts(spark, d).select(F.concat(F.lit("docs/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Top\n\n## "), "p_name", F.lit("\n\n"), lead, F.lit("one\n")).alias("source"))
    return parse.units(docs).where("kind = 'p'").select("path", "context", "body", "kind")


@query("SELECT event_id::varchar AS path, CASE WHEN event_id % 2 = 0 THEN 'T ' ELSE '' END || 'one ' || json_extract_string(props, '$.k') AS body, 'one ' || json_extract_string(props, '$.k') AS snippet FROM events")
def root_units(spark: SparkSession, d: str) -> DataFrame:
    docs = r.event_documents(spark, d, F.concat(F.lit("z: "), "k"), F.lit("a: one")).select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.replace("source", F.lit("## Body"), F.lit("# T"))).otherwise(F.col("source")).alias("source"))
    return parse.units(docs, fields=["kind", "body", "snippet"]).where("kind = 'root'").select("path", "body", "snippet")


@query("""SELECT 'all' AS scope, count(*) FILTER (WHERE p_partkey % 5 > 0) AS total, least(7, count(*) FILTER (WHERE p_partkey % 5 > 0)) AS shown, 1000::bigint AS most FROM part WHERE p_name LIKE 'red %'
UNION ALL SELECT 'one', count(*) FILTER (WHERE p_partkey % 5 > 0), least(7, count(*) FILTER (WHERE p_partkey % 5 > 0)), 1000 FROM part WHERE p_name LIKE 'red %' AND p_partkey % 3 = 1""")
def index_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """An index that is made, then refreshed: every fifth file goes, and is found no more; a prefix narrows a search."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    p = r.parts(spark, d).withColumn("path", F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")))
    files = p.select("path", F.lit(0).cast("timestamp").alias("mtime"), F.length("p_name").cast("long").alias("size"), F.concat(F.lit("- "), "p_name").cast("binary").alias("source"), "p_partkey")
    folder = f"{shared.rstrip('/')}/folio-index-{uuid.uuid4().hex}"
    index = search.Index(spark, folder)
    index.refresh(files.drop("p_partkey"))
    index.refresh(files.where("p_partkey % 5 > 0").drop("p_partkey"))
    rows = [(name, found["total"], len(found["hits"]), search.MOST) for name, prefix in (("all", ""), ("one", "1/")) for found in [index.search("RED", 7, prefix)]]
    index.fs.delete(index._path(""), True)
    return spark.createDataFrame(rows, "scope string, total long, shown long, most long")


@query("SELECT o_orderkey AS doc_id, '# Order ' || o_orderkey || chr(10) AS content FROM orders")
def read_to_a_depth(spark: SparkSession, d: str) -> DataFrame:
    return read.content(r.order_documents(spark, d, r.flag_heading()), "$", depth=0).select("doc_id", "content")
