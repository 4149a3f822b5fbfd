"""Queries over the library's operators, by name, and SQL that gives the same rows from the tables, without Markdown."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.patterns import Matcher
from ..functions.text import preview_column, size_column, slug_column
from ..operators import parse, read, relational, search
from ..sources import files
from . import rendered as r
from .render import results
from .validate import summary, validate

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "cardinality_missing"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_KEPT: list[DataFrame] = []

#: Line items with their order, as every document of line headings has them.
_L = "(SELECT o_orderkey AS doc_id, l.* FROM orders LEFT JOIN lineitem l ON o_orderkey = l_orderkey)"
_SEQ = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)"


def query(sql: str | None = None, name: str | None = None):
    def put(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, d: str) -> DataFrame:
            while _KEPT:
                _KEPT.pop().unpersist()
            return fn(spark, d)

        key = name or fn.__name__
        _QUERIES[key] = run
        if sql:
            _SQL[key] = sql
        return run

    return put


def by_document(found: DataFrame, *columns: str) -> DataFrame:
    """How many diagnostics of each id a document has."""
    return found.groupBy("doc_id", "id", *columns).agg(F.count("*").alias("n"))


def kept(df: DataFrame) -> DataFrame:
    """A node table that a plan reads more than once: parsed once, on disk where memory ends, parsed again if an executor goes.
    It is let go when the next query begins; a result that still needs it then parses again."""
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[-1]


# Parsing and structure.


@query(f"SELECT doc_id, count(l_orderkey) AS n_sections, (count(*) FILTER (WHERE l_orderkey IS NOT NULL) > 0)::int + 1 AS depth FROM {_L} GROUP BY doc_id")
def parse_sections(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(r.order_documents(spark, d, r.line_heading()), fields=["kind", "level", "depth"])
    return n.groupBy("doc_id").agg(F.count(F.when((F.col("kind") == "section") & (F.col("level") == 2), 1)).alias("n_sections"), F.max("depth").alias("depth"))


@query(f"SELECT doc_id, count(*) AS n FROM {_L} WHERE l_quantity > 25 GROUP BY doc_id")
def skipped_levels(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("l_quantity") > 25, "#### ").otherwise("## "), F.col("l_linenumber").cast("string"))
    return relational.skipped_levels(parse.nodes(r.order_documents(spark, d, text), fields=["kind", "level", "above"])).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, 'skipped-level' AS id, count(*) AS n FROM {_L} WHERE l_quantity > 25 GROUP BY doc_id")
def skipped_levels_checked(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("l_quantity") > 25, "#### ").otherwise("## "), F.col("l_linenumber").cast("string"))
    return by_document(validate(r.order_documents(spark, d, text), 'version: 1\ntitle: "*"\n', fields=["id"]))


@query("""SELECT l_orderkey AS doc_id, rn::int AS node_id, (CASE WHEN lv = 1 THEN 0 ELSE coalesce(greatest(
  CASE WHEN lv > 1 THEN max(CASE WHEN lv2 = 1 THEN rn END) OVER w END, CASE WHEN lv > 2 THEN max(CASE WHEN lv2 = 2 THEN rn END) OVER w END), 0) END)::int AS parent_id
FROM (SELECT *, (1 + l_linenumber % 3) AS lv, (1 + l_linenumber % 3) AS lv2 FROM """ + _SEQ + """ s)
WINDOW w AS (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def nested_sections(spark: SparkSession, d: str) -> DataFrame:
    w = r.table(spark, d, "lineitem").select("l_orderkey", *r.LINES)
    from pyspark.sql.window import Window

    flat = w.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*r.LINES)).alias("node_id"), (1 + F.col("l_linenumber") % 3).alias("level"))
    return relational.nest(flat).select("doc_id", "node_id", "parent_id")


# Matchers.


def _segments(spark: SparkSession, d: str) -> DataFrame:
    c = r.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    text = F.concat(F.lit("## "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.initcap("c_mktsegment")))
    return parse.nodes(r.joined(c, "c_nationkey", ("c_custkey",), text)).where("kind = 'section'")


@query("SELECT c_nationkey AS doc_id, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY 1")
def exact_match_fold(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).where(Matcher.of("bUILDing").column(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS doc_id, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY 1")
def extras_anywhere(spark: SparkSession, d: str) -> DataFrame:
    return relational.extras(_segments(spark, d), ["Building", "Furniture"]).groupBy("doc_id").agg(F.count("*").alias("n"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return parse.nodes(r.brand_documents(spark, d, F.concat(F.lit("## "), "p_name"))).where("kind = 'section'")


@query("SELECT p_brand AS doc_id, count(*) AS n FROM part WHERE p_name ILIKE '% ring' GROUP BY 1")
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).where(Matcher.of("* RING").column(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS doc_id, CASE WHEN p_name LIKE 'red %' THEN 0 WHEN p_name LIKE '% bolt' THEN 1 ELSE 2 END AS rule, count(*) AS n FROM part GROUP BY 1, 2")
def unordered_classifier(spark: SparkSession, d: str) -> DataFrame:
    return relational.classify(_names(spark, d), ["red *", "* bolt", "*"]).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n, sum(l_linenumber)::bigint AS total, min(strftime(l_shipdate, '%Y%m%d')::int) AS first_day FROM lineitem GROUP BY 1")
def regex_capture_int(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(r.order_documents(spark, d, r.line_heading())).where("level = 2")
    m = Matcher.of(r"/Line (?<n>\d+) - (?<day>\d{4}-\d{2}-\d{2})/")
    x = n.select("doc_id", typed.column("int", m.capture_column(F.col("text"), "n")).alias("n"), typed.column("date", m.capture_column(F.col("text"), "day")).alias("day"))
    return x.groupBy("doc_id").agg(F.count("n").alias("n"), F.sum("n").alias("total"), F.min("day").alias("first_day"))


# Scopes: guards, cardinalities, ordered grammar.

_ORDER = 'version: 1\ntitle: "/Order [0-9]+/"\n'


@query("SELECT l_orderkey AS doc_id, 'not-allowed' AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def guard_not_allowed(spark: SparkSession, d: str) -> DataFrame:
    return by_document(validate(r.order_documents(spark, d, r.flag_heading()), _ORDER + "forbid_sections:\n- match: r\n"))


@query("SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_returnflag = 'R') AS n_guarded, count(*) AS n FROM lineitem GROUP BY 1")
def guard_filter(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(r.order_documents(spark, d, r.flag_heading())).where("level = 2")
    return relational.guarded(n, ["x", "r"]).groupBy("doc_id").agg(F.count("guard").alias("n_guarded"), F.count("*").alias("n"))


_CARDINALITY = f"""SELECT doc_id, CASE WHEN n = 0 THEN 'missing-section' WHEN n < 2 THEN 'too-few-sections' ELSE 'too-many-sections' END AS id,
  CASE WHEN n > 4 THEN 6 ELSE 1 END::bigint AS line, CASE WHEN n > 4 THEN 1 ELSE 0 END::bigint AS excess
FROM (SELECT doc_id, count(l_orderkey) AS n FROM {_L} GROUP BY doc_id) WHERE n < 2 OR n > 4"""


@query(_CARDINALITY)
def cardinality_missing(spark: SparkSession, d: str) -> DataFrame:
    found = validate(r.order_documents(spark, d, r.line_heading()), _ORDER + 'sections:\n- match: "/Line .*/"\n  repeat: "2..4"\n')
    return found.select("doc_id", "id", "line", F.get_json_object("target", "$.kind").eqNullSafe("header").cast("long").alias("excess"))


@query(f"SELECT doc_id, CASE WHEN n = 0 THEN 'missing-section' WHEN n < 2 THEN 'too-few-sections' ELSE 'too-many-sections' END AS id, n, CASE WHEN n > 4 THEN 6 ELSE -1 END::int AS node_id FROM (SELECT doc_id, count(l_orderkey) AS n FROM {_L} GROUP BY doc_id) WHERE n < 2 OR n > 4")
def cardinality_by_plan(spark: SparkSession, d: str) -> DataFrame:
    n = kept(parse.nodes(r.order_documents(spark, d, r.line_heading())))
    rules = [("/Line .*/", 2, 4)]
    scopes = n.where("level = 1").select("doc_id", F.col("node_id").alias("parent_id"))
    taken = relational.classify(n.where("level = 2"), [m for m, _, _ in rules])
    return relational.cardinality(scopes, taken, rules).select("doc_id", "id", "n", F.coalesce("node_id", F.lit(-1)).alias("node_id"))


_FLAGS = 'sections:\n- {match: A, repeat: "0..n"}\n- {match: N, repeat: "0..n"}\n- {match: R, repeat: "0..n"}\n'


@query(f"SELECT l_orderkey AS doc_id, bool_and(coalesce(l_returnflag >= p, true)) AS accepted FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY rn) AS p FROM {_SEQ} s) GROUP BY 1")
def ordered_accept(spark: SparkSession, d: str) -> DataFrame:
    n = kept(parse.nodes(r.order_documents(spark, d, r.flag_heading())).where("level = 2"))
    return relational.assign_ordered(n, [("A", 0, None), ("N", 0, None), ("R", 0, None)]).groupBy("doc_id").agg(F.bool_and("accepted").alias("accepted"))


_RECOVERY = f"""WITH s AS (SELECT l_orderkey, rn, l_returnflag AS f FROM {_SEQ} q),
k AS (SELECT l_orderkey, rn, count(*) FILTER (WHERE f = 'A') OVER w AS a, count(*) FILTER (WHERE f = 'N') OVER w AS b, count(*) FILTER (WHERE f = 'R') OVER w AS c FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY rn)
  UNION ALL SELECT DISTINCT l_orderkey, 0, 0, 0, 0 FROM s),
m AS (SELECT *, max(a - b) OVER (PARTITION BY l_orderkey ORDER BY rn) AS best FROM k)
SELECT l_orderkey AS doc_id, 'misplaced-section' AS id, max(rn) - (max(c) + max(best + b - c)) AS n FROM m GROUP BY 1 HAVING max(rn) > max(c) + max(best + b - c)"""


@query(_RECOVERY)
def ordered_recovery(spark: SparkSession, d: str) -> DataFrame:
    return by_document(validate(r.order_documents(spark, d, r.flag_heading()), _ORDER + _FLAGS))


@query(_RECOVERY.replace("'misplaced-section' AS id, ", ""))
def ordered_recovery_by_plan(spark: SparkSession, d: str) -> DataFrame:
    n = kept(parse.nodes(r.order_documents(spark, d, r.flag_heading())).where("level = 2"))
    x = relational.assign_ordered(n, [("A", 0, None), ("N", 0, None), ("R", 0, None)])
    return x.where("rule is null").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE rn < coalesce(stop, 1000000)) AS n_first, count(*) FILTER (WHERE rn >= coalesce(stop, 1000000)) AS n_wild FROM (SELECT *, min(CASE WHEN l_returnflag <> 'A' THEN rn END) OVER (PARTITION BY l_orderkey) AS stop FROM {_SEQ} s) GROUP BY 1")
def wildcard_cost(spark: SparkSession, d: str) -> DataFrame:
    n = kept(parse.nodes(r.order_documents(spark, d, r.flag_heading())).where("level = 2"))
    x = relational.assign_ordered(n, [("a", 0, None), ("*", 0, None)])
    return x.groupBy("doc_id").agg(F.count(F.when(F.col("rule") == 0, 1)).alias("n_first"), F.count(F.when(F.col("rule") == 1, 1)).alias("n_wild"))


# Content and items.


@query(f"SELECT doc_id, CASE WHEN n = 0 THEN 'missing-block' ELSE 'too-many-blocks' END AS id, CASE WHEN n = 0 THEN 1 ELSE 9 END::bigint AS line FROM (SELECT doc_id, count(l_orderkey) AS n FROM {_L} GROUP BY doc_id) WHERE n = 0 OR n > 3")
def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = r.order_documents(spark, d, F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")), gap="\n\n")
    return validate(docs, _ORDER + 'content:\n- block: p\n  repeat: "1..3"\n').select("doc_id", "id", "line")


@query("SELECT p_partkey AS doc_id, 'missing-block' AS id FROM part WHERE p_size % 3 = 2 UNION ALL SELECT p_partkey, 'unexpected-block' FROM part WHERE p_size % 3 = 2")
def content_one_of(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "* ").otherwise("> ")
    docs = r.parts(spark, d).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("# Part\n\n"), mark, F.col("p_name")).alias("source"))
    return validate(docs, 'version: 1\ntitle: Part\ncontent:\n- one_of:\n  - block: p\n  - {block: list, list_kind: bullet}\n').select("doc_id", "id")


@query("SELECT p_brand AS doc_id, 'unexpected-item' AS id, count(*) AS n FROM part WHERE NOT regexp_full_match(p_name, '.* (ring|bolt)') GROUP BY 1")
def items_match(spark: SparkSession, d: str) -> DataFrame:
    docs = r.brand_documents(spark, d, F.concat(F.lit("- "), "p_name"), F.lit("# Parts\n"))
    return by_document(validate(docs, 'version: 1\ntitle: Parts\ncontent:\n- block: list\n  items:\n  - match: "/.* (RING|BOLT)/"\n    repeat: "0..n"\n'))


# Typed values and their order.

_DATES = r"""sections:
- match: '/Line (?<n>\d+) - (?<day>.+)/'
  repeat: "0..n"
  captures: {day: date}
  order:
  - {by: day, dir: desc%s}
"""


def _dates(strict: str) -> str:
    return f"SELECT l_orderkey AS doc_id, 'order-violation' AS id, count(*) AS n FROM (SELECT *, lag(l_shipdate::date) OVER (PARTITION BY l_orderkey ORDER BY rn) AS p FROM {_SEQ} s) WHERE p {strict} l_shipdate::date GROUP BY 1"


@query(_dates("<"))
def order_violation_date(spark: SparkSession, d: str) -> DataFrame:
    return by_document(validate(r.order_documents(spark, d, r.line_heading()), _ORDER + _DATES % ""))


@query(_dates("<="))
def order_violation_strict(spark: SparkSession, d: str) -> DataFrame:
    return by_document(validate(r.order_documents(spark, d, r.line_heading()), _ORDER + _DATES % ", strict: true"))


@query(_dates("<=").replace("'order-violation' AS id, ", ""))
def order_violation_by_plan(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(r.order_documents(spark, d, r.line_heading())).where("level = 2")
    day = typed.column("date", F.regexp_extract("text", r"(\S+)$", 1))
    return relational.value_order(n, day, descending=True, strict=True, scope=("doc_id", "parent_id")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""SELECT l_orderkey AS doc_id, 'order-violation' AS id, count(*) AS n FROM (SELECT *, lag(l_shipdate::date) OVER (PARTITION BY l_orderkey ORDER BY rn) AS p FROM {_SEQ} s) WHERE p < l_shipdate::date AND l_orderkey % 7 <> 0 GROUP BY 1
UNION ALL SELECT l_orderkey, 'invalid-value', count(*) FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1 GROUP BY 1
UNION ALL SELECT l_orderkey, 'order-violation', count(*) FROM (SELECT *, lag(l_shipdate::date) OVER (PARTITION BY l_orderkey ORDER BY rn) AS p, bool_or(l_linenumber = 1) OVER (PARTITION BY l_orderkey) AS bad FROM {_SEQ} s) WHERE l_orderkey % 7 = 0 AND NOT bad AND p < l_shipdate::date GROUP BY 1""")
def order_suppression(spark: SparkSession, d: str) -> DataFrame:
    day = F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 1), "2023-02-30").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    text = F.concat(F.lit("## Line "), F.col("l_linenumber").cast("string"), F.lit(" - "), day)
    return by_document(validate(r.order_documents(spark, d, text), _ORDER + _DATES % ""))


@query("""SELECT p_brand AS doc_id, count(*) AS n FROM (SELECT p_brand, k, lag(k) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS p FROM
  (SELECT p_brand, p_partkey, [p_size, p_partkey % 10, 0, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 ELSE 0 END] AS k FROM part)) WHERE p > k GROUP BY 1""")
def semver_order(spark: SparkSession, d: str) -> DataFrame:
    pre = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-rc."), (F.col("p_partkey") % 7).cast("string"))).otherwise("")
    text = F.concat(F.lit("## "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".0"), pre)
    n = parse.nodes(r.brand_documents(spark, d, text)).where("kind = 'section'")
    return relational.value_order(n, typed.column("semver", F.col("text")), scope=("doc_id",)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT p_brand AS doc_id, 'order-violation' AS id, count(*) AS n FROM (SELECT p_brand, k, lag(k) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS p FROM
  (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_size::bigint, p_partkey % 10] ELSE [p_size::bigint, p_partkey % 10, 0] END AS k FROM part)) WHERE p >= k GROUP BY 1""")
def dotted_order(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("## v0"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(".0"))
    schema = r"""version: 1
title: null
sections:
- match: '/v(?<v>[0-9.]+)/'
  repeat: "0..n"
  captures: {v: dotted}
  order: [{by: v, strict: true}]
"""
    return by_document(validate(r.brand_documents(spark, d, text), schema))


# Frontmatter.

_K = "(json_extract_string(props, '$.k'))::bigint"
_BARE = 'version: 1\ntitle: null\nsections:\n- Body\n'.replace("- Body", "- match: Body")


@query("SELECT event_id AS doc_id, 'invalid-value' AS id, '/k' AS pointer, 2::bigint AS line FROM events WHERE event_id % 2 = 1")
def fm_int_kind(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 2 == 1, F.col("value").cast("string")).otherwise(F.col("k"))
    docs = r.event_documents(spark, d, F.concat(F.lit("k: "), value))
    found = validate(docs, _BARE + "frontmatter:\n  captures:\n    k: {type: int}\n", fields=["id", "target", "line"])
    return found.select("doc_id", "id", F.get_json_object("target", "$.pointer").alias("pointer"), "line")


@query(f"SELECT event_id AS doc_id, 'missing-value' AS id, '/k' AS pointer FROM events WHERE {_K} % 2 = 0")
def fm_missing_required(spark: SparkSession, d: str) -> DataFrame:
    docs = r.event_documents(spark, d, F.concat(F.lit("user: "), F.col("user_id").cast("string")), F.when(F.col("k").cast("long") % 2 == 1, F.concat(F.lit("k: "), "k")))
    found = validate(docs, _BARE + "frontmatter:\n  captures:\n    k: {type: int, required: true}\n", fields=["id", "target"])
    return found.select("doc_id", "id", F.get_json_object("target", "$.pointer").alias("pointer"))


@query(f"SELECT event_id AS doc_id, 'one_of' AS id, 'document' AS kind FROM events WHERE (event_type = 'click')::int + ({_K} < 50 AND {_K} = 10)::int + ({_K} = 20)::int <> 1")
def fm_equality(spark: SparkSession, d: str) -> DataFrame:
    docs = r.event_documents(spark, d, F.concat(F.lit("type: "), "event_type"), F.concat(F.lit("k: "), "k"))
    found = validate(docs, _BARE + "constraints:\n- one_of: ['fm[$.type]=Click', 'fm[$.k]=10', \"fm[$['k']]=0x14\"]\n", fields=["id", "target"])
    return found.select("doc_id", "id", F.get_json_object("target", "$.kind").alias("kind"))


@query("SELECT event_id AS doc_id, 'any_of' AS id FROM events WHERE event_id % 4 IN (1, 2) UNION ALL SELECT event_id, 'invalid-value' FROM events WHERE event_id % 4 = 3")
def fm_bool_read(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id") % 4
    docs = r.event_documents(spark, d, F.concat(F.lit("flag: "), F.when(e == 0, "True").when(e == 1, "false").when(e == 2, "~").otherwise("yes")))
    return validate(docs, _BARE + "constraints:\n- any_of: ['fm[$.flag]', 'fm[$.none]']\n", fields=["id"]).select("doc_id", "id")


@query(f"SELECT event_id AS doc_id, event_type = 'click' AS is_click, {_K} >= 50 AS holds FROM events")
def fm_values_by_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = r.event_documents(spark, d, F.concat(F.lit("type: "), "event_type"), F.concat(F.lit("high: "), (F.col("k").cast("long") >= 50).cast("string")))
    values = kept(parse.front_values(docs))
    clicks = relational.front_equals(values, "/type", "string", "click").withColumn("is_click", F.lit(True))
    return relational.front_boolean(values, "/high").select("doc_id", "holds").join(clicks, "doc_id", "left").select("doc_id", F.coalesce("is_click", F.lit(False)).alias("is_click"), "holds")


@query(f"SELECT event_id AS doc_id, '/k' AS pointer, count(*) AS n FROM events WHERE {_K} < 30 OR {_K} > 80 GROUP BY 1 UNION ALL SELECT event_id, '', 1 FROM events WHERE event_type = 'view'")
def fm_json_schema(spark: SparkSession, d: str) -> DataFrame:
    docs = r.event_documents(spark, d, F.when(F.col("event_type") != "view", F.concat(F.lit("type: "), "event_type")), F.concat(F.lit("k: "), "k"))
    schema = _BARE + "frontmatter:\n  schema:\n    type: object\n    required: [type]\n    properties:\n      k: {$ref: '#/$defs/k'}\n    $defs:\n      k: {type: integer, minimum: 30, maximum: 80}\n"
    return validate(docs, schema, fields=["target"]).groupBy("doc_id", F.get_json_object("target", "$.pointer").alias("pointer")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id AS doc_id, 'any_of' AS id FROM events WHERE NOT ({_K} % 3 = 1 OR {_K} % 5 = 4)")
def fm_jsonpath(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k").cast("long")
    docs = r.event_documents(spark, d, F.concat(F.lit("tags: [a"), (k % 3).cast("string"), F.lit(", {x: "), (k % 5).cast("string"), F.lit("}]")))
    return validate(docs, _BARE + "constraints:\n- any_of: ['fm[$.tags[*]]=a1', 'fm[$.tags[-1].x]=4']\n", fields=["id"]).select("doc_id", "id")


@query("SELECT event_id AS doc_id, CASE event_id % 3 WHEN 0 THEN 'invalid-frontmatter' ELSE 'missing-frontmatter' END AS id FROM events WHERE event_id % 3 < 2")
def fm_states(spark: SparkSession, d: str) -> DataFrame:
    e = r.spread(r.table(spark, d, "events").select("event_id"))
    m = F.col("event_id") % 3
    docs = e.select(F.col("event_id").alias("doc_id"), F.when(m == 0, "---\n- 1\n---\n## Body").when(m == 1, "## Body").otherwise("---\na: 1\n---\n## Body").alias("source"))
    return validate(docs, _BARE + "frontmatter: {required: true}\n", fields=["id"]).select("doc_id", "id")


# Constraints.

_HAS = f"(SELECT doc_id, coalesce(bool_or(l_returnflag = 'A'), false) AS a, coalesce(bool_or(l_returnflag = 'N'), false) AS n, coalesce(bool_or(l_returnflag = 'R'), false) AS r FROM {_L} GROUP BY doc_id)"
_SETS = {
    "one_of": ("one_of: [a, n, r]", "a::int + n::int + r::int <> 1"),
    "any_of": ("any_of: [a, n]", "NOT (a OR n)"),
    "at_most_one": ("at_most_one: [a, n]", "a AND n"),
    "all_or_none": ("all_or_none: [a, n, r]", "a::int + n::int + r::int NOT IN (0, 3)"),
    "requires": ("requires: {if: a, then: [n, r]}", "a AND NOT (n AND r)"),
    "conflicts": ("conflicts: {if: a, then_not: $.r}", "a AND r"),
}


def _constraint(kind: str, text: str, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = r.order_documents(spark, d, r.flag_heading())
        return validate(docs, _ORDER + "unordered: true\n" + _FLAGS + f"constraints:\n- {text}\n", fields=["id", "target"]).select("doc_id", "id", F.get_json_object("target", "$.kind").alias("kind"))

    query(f"SELECT doc_id, '{kind}' AS id, 'document' AS kind FROM {_HAS} WHERE {where}", f"constraint_{kind}")(run)


for _kind, (_text, _where) in _SETS.items():
    _constraint(_kind, _text, _where)


@query(f"SELECT doc_id, a::int + n::int + r::int = 1 AS one_of, a AND n AND r OR NOT a AND NOT n AND NOT r AS all_or_none, NOT a OR n AS requires FROM {_HAS}")
def constraints_by_plan(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(r.order_documents(spark, d, r.flag_heading()))
    x = n.groupBy("doc_id").agg(*(F.max((F.col("text").eqNullSafe(f)) & (F.col("level") == 2)).alias(f.lower()) for f in "ANR"))
    a, b, c = (F.coalesce(k, F.lit(False)) for k in "anr")
    return x.select("doc_id", relational.constraint("one_of", [a, b, c]).alias("one_of"), relational.constraint("all_or_none", [a, b, c]).alias("all_or_none"), relational.constraint("requires", [b], a).alias("requires"))


_ENDS = f"(SELECT l_orderkey AS doc_id, max(CASE WHEN l_returnflag = 'A' THEN rn END) AS a2, min(CASE WHEN l_returnflag = 'N' THEN rn END) AS n1, max(CASE WHEN l_returnflag = 'N' THEN rn END) AS n2, min(CASE WHEN l_returnflag = 'R' THEN rn END) AS r1 FROM {_SEQ} s GROUP BY 1)"


@query(f"SELECT doc_id, 'ordered' AS id FROM {_ENDS} WHERE NOT (coalesce(a2 < n1, true) AND coalesce(coalesce(n2, a2) < r1, true))")
def constraint_ordered(spark: SparkSession, d: str) -> DataFrame:
    docs = r.order_documents(spark, d, r.flag_heading())
    return validate(docs, _ORDER + "unordered: true\n" + _FLAGS + "constraints:\n- ordered: [a, n, r]\n", fields=["id"]).select("doc_id", "id")


@query(f"SELECT doc_id, coalesce(a2 < n1, true) AND coalesce(coalesce(n2, a2) < r1, true) AS holds FROM {_ENDS}")
def sets_in_order(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(r.order_documents(spark, d, r.flag_heading())).where("level = 2")
    return relational.sets_in_order(relational.classify(n, ["A", "N", "R"]), [0, 1, 2]).select("doc_id", "holds")


@query(f"""SELECT doc_id, 'any_of' AS id FROM (SELECT doc_id, count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag = 'N') AS nn,
  count(*) FILTER (WHERE l_returnflag IN ('A', 'N') AND l_quantity > 25) AS late FROM {_L} GROUP BY doc_id) WHERE na <= 1 AND nn <= 1 AND late = 0""")
def constraint_suppressed(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(r.flag_heading(), F.when(F.col("l_quantity") > 25, "\n### Late").otherwise(""))
    rule = "- match: %s\n  required: false\n  sections:\n  - {match: Late, required: false}\n"
    schema = _ORDER + "unordered: true\nsections:\n" + "".join(rule % f for f in "ANR") + "constraints:\n- any_of: [a.late, n.late]\n"
    return validate(r.order_documents(spark, d, text), schema, fields=["id"]).where("id = 'any_of'").select("doc_id", "id")


# Suppression, titles, order of reports.


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 AND l_orderkey % 5 <> 0 GROUP BY 1")
def inline_suppression(spark: SparkSession, d: str) -> DataFrame:
    off = F.when(F.col("l_linenumber") % 2 == 0, "<!-- folio-disable unexpected-section -->\n").otherwise("")
    every = F.when(F.col("l_orderkey") % 5 == 0, "<!-- folio-disable-file skipped-level, unexpected-section -->\n").otherwise("")
    docs = r.order_documents(spark, d, F.concat(F.lit("\n"), every, off, r.line_heading()))
    return validate(docs, _ORDER + "sections: []\n", fields=["id"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS doc_id, 'missing-title' AS id, 1::bigint AS line FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'not-allowed', 1 FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT o_orderkey, 'too-many-sections', 2 FROM orders WHERE o_orderkey % 4 = 3""")
def titles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    docs = r.spread(r.table(spark, d, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("doc_id"), F.when(k == 0, "## Body").when(k == 1, "# Order\n## Body").when(k == 2, "# Other\n## Body").otherwise("# Order\n# Order\n## Body").alias("source"))
    return validate(docs, "version: 1\ntitle: Order\n", fields=["id", "line"]).select("doc_id", "id", "line")


@query(f"SELECT l_orderkey AS doc_id, (rn - 1)::int AS ord, (rn + 1)::bigint AS line, 4::bigint AS width FROM {_SEQ} s")
def diagnostic_total_order(spark: SparkSession, d: str) -> DataFrame:
    found = validate(r.order_documents(spark, d, r.flag_heading()), _ORDER + "sections: []\n", fields=["ord", "line", "target"])
    return found.select("doc_id", "ord", "line", (F.length(F.get_json_object("target", "$.path[1]")) + 3).cast("long").alias("width"))


@query(f"SELECT doc_id, n AS n_diagnostics FROM (SELECT doc_id, count(l_orderkey) AS n FROM {_L} GROUP BY doc_id)")
def json_results(spark: SparkSession, d: str) -> DataFrame:
    docs = r.order_documents(spark, d, r.flag_heading())
    out = results(docs, validate(docs, _ORDER + "sections: []\n"), ".folio.yml")
    listed = F.from_json(F.get_json_object("json", "$.diagnostics"), "array<struct<id:string,location:struct<line:long,column:long>,target:struct<kind:string,path:array<string>>>>")
    return out.select("doc_id", F.size(F.filter(listed, lambda x: (x["id"] == "unexpected-section") & (x["location"]["column"] == 1) & (F.size(x["target"]["path"]) == 2))).cast("long").alias("n_diagnostics"))


@query("SELECT count(DISTINCT o_orderkey) AS files, count(DISTINCT o_orderkey) AS documents, 0::bigint AS schemas, count(l_orderkey) AS diagnostics FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = r.order_documents(spark, d, r.flag_heading())
    return summary(validate(docs, _ORDER + "sections: []\n", fields=["id"]), docs)


# Paths and reading.


@query("SELECT n_nationkey::bigint AS doc_id, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation UNION ALL SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    names = r.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), "n_name").union(r.table(spark, d, "part").select("p_partkey", "p_name"))
    return names.select("doc_id", slug_column(F.col("n_name")).alias("slug"))


_PATHS = f"""SELECT l_orderkey AS doc_id, '$.' || lower(l_returnflag) || CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_returnflag) > 1
  THEN '[' || (row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY rn) - 1) || ']' ELSE '' END AS mdpath FROM {_SEQ} s"""


@query(_PATHS)
def document_paths(spark: SparkSession, d: str) -> DataFrame:
    return parse.nodes(r.order_documents(spark, d, r.flag_heading())).where("level = 2").select("doc_id", "mdpath")


@query(_PATHS)
def document_paths_by_plan(spark: SparkSession, d: str) -> DataFrame:
    n = parse.nodes(r.order_documents(spark, d, r.flag_heading()))
    return relational.canonical_steps(n).where("level = 2").select("doc_id", F.concat(F.lit("$"), "step").alias("mdpath"))


@query("SELECT p_partkey AS doc_id, (17 + strlen(p_name) * 2)::bigint AS section_bytes, (3 + strlen(p_name) + 1)::bigint AS heading_bytes FROM part")
def section_extent_bytes(spark: SparkSession, d: str) -> DataFrame:
    docs = r.parts(spark, d).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("## "), "p_name", F.lit("\n\nText.\n\n* "), "p_name", F.lit("\n\n\n## Next\n")).alias("source"))
    n = parse.nodes(docs).where("kind = 'section' and slug <> 'next'")
    return n.select("doc_id", (F.col("extent") - F.col("start") + 2).alias("section_bytes"), (F.col("end") - F.col("start")).alias("heading_bytes"))


_SECOND = f"SELECT o_orderkey AS doc_id, CASE WHEN h IS NULL THEN 'unresolved' ELSE 'success' END AS outcome, h AS content FROM orders LEFT JOIN (SELECT l_orderkey, '## Line ' || l_linenumber || ' - ' || strftime(l_shipdate, '%Y-%m-%d') || chr(10) AS h FROM {_SEQ} s WHERE rn = 2) ON o_orderkey = l_orderkey"


@query(_SECOND)
def read_section(spark: SparkSession, d: str) -> DataFrame:
    return read.content(r.order_documents(spark, d, r.line_heading()), "$.[1]").select("doc_id", "outcome", "content")


@query(f"SELECT l_orderkey AS doc_id, '## Line ' || l_linenumber || ' - ' || strftime(l_shipdate, '%Y-%m-%d') || CASE WHEN rn < n THEN chr(10) ELSE '' END AS content FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {_SEQ} q) s WHERE rn = 2")
def read_section_by_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = r.order_documents(spark, d, r.line_heading())
    n = kept(parse.nodes(docs))
    at = relational.resolve(n, "$.[1]").where("outcome = 'success'")
    return relational.section_text(n, docs, at).select("doc_id", "content")


@query(f"SELECT doc_id, CASE count(*) FILTER (WHERE l_returnflag = 'A') WHEN 0 THEN 'unresolved' WHEN 1 THEN 'success' ELSE 'ambiguous' END AS outcome, count(*) FILTER (WHERE l_returnflag = 'A') AS n, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'A') = 1 THEN '$.a' END AS mdpath FROM {_L} GROUP BY doc_id")
def descendant_resolve(spark: SparkSession, d: str) -> DataFrame:
    return relational.resolve(kept(parse.nodes(r.order_documents(spark, d, r.flag_heading()))), "$..a").select("doc_id", "outcome", "n", "mdpath")


@query(f"SELECT doc_id, count(*) FILTER (WHERE l_orderkey IS NOT NULL) + 1 AS n_rows, max(CASE WHEN l_orderkey IS NULL THEN 0 ELSE 1 END)::bigint AS deepest, first('Order ' || doc_id) AS label FROM {_L} GROUP BY doc_id")
def read_tree(spark: SparkSession, d: str) -> DataFrame:
    t = read.tree(r.order_documents(spark, d, r.line_heading()))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max((F.col("kind") == "section").cast("long")).alias("deepest"), F.max(F.when(F.col("mdpath") == "$", F.col("label"))).alias("label"))


@query("SELECT p_brand AS doc_id, replace(p_name, ' ', '-') AS slug, levenshtein(replace(p_name, ' ', '-'), 'hot-rign')::int AS distance, count(*) AS n FROM part WHERE levenshtein(replace(p_name, ' ', '-'), 'hot-rign') <= 3 GROUP BY 1, 2, 3")
def suggest_typo(spark: SparkSession, d: str) -> DataFrame:
    return relational.near_slugs(_names_all(spark, d), "hot-rign").groupBy("doc_id", "slug", "distance").agg(F.count("*").alias("n"))


def _names_all(spark: SparkSession, d: str) -> DataFrame:
    return parse.nodes(r.brand_documents(spark, d, F.concat(F.lit("## "), "p_name")))


@query("SELECT p_partkey AS doc_id, CASE WHEN n < 1000 THEN n || 'B' WHEN n < 1000000 THEN ((n + 50) // 100) // 10 || '.' || ((n + 50) // 100) % 10 || 'kB' ELSE ((n + 50000) // 100000) // 10 || '.' || ((n + 50000) // 100000) % 10 || 'MB' END AS size, left(p_name, 4) || CASE WHEN length(p_name) > 4 THEN '…' ELSE '' END AS shown FROM (SELECT *, (p_partkey * p_partkey * p_size) AS n FROM part)")
def sizes_and_previews(spark: SparkSession, d: str) -> DataFrame:
    p = r.parts(spark, d)
    n = F.col("p_partkey") * F.col("p_partkey") * F.col("p_size")
    return p.select(F.col("p_partkey").alias("doc_id"), size_column(n).alias("size"), preview_column(F.concat("p_name", F.lit("\r\nmore")), 4).alias("shown"))


# Search.


def _part_units(spark: SparkSession, d: str) -> DataFrame:
    docs = r.brand_documents(spark, d, F.concat(F.lit("* "), "p_name"), F.concat(F.lit("# "), F.lit("Parts\n"))).withColumnRenamed("doc_id", "path")
    return parse.units(docs)


_ITEMS = "(SELECT p_brand AS path, '$/list[0]/item[' || (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) || ']' AS mdpath, p_name FROM part)"


@query(f"SELECT path, mdpath FROM {_ITEMS} WHERE p_name = 'red bolt' UNION ALL SELECT p_brand, '$/list[0]' FROM part GROUP BY 1 HAVING count(*) FILTER (WHERE p_name = 'red bolt') = 0 AND count(*) FILTER (WHERE p_name LIKE 'red %') > 0 AND count(*) FILTER (WHERE p_name LIKE '% bolt') > 0")
def search_conjunction(spark: SparkSession, d: str) -> DataFrame:
    u = kept(_part_units(spark, d))
    found = kept(search.postings(u))
    terms = search.query_terms("Bolts, RED")
    return search.ranked(found, search.statistics(u, found, terms), terms).select("path", "mdpath")


@query("SELECT 'bolt' AS term, count(DISTINCT p_brand) AS blocks FROM part WHERE p_name LIKE '% bolt' UNION ALL SELECT 'red', count(DISTINCT p_brand) FROM part WHERE p_name LIKE 'red %'")
def search_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.term_counts(search.postings(_part_units(spark, d)), ["red", "bolt"])


@query("""WITH u AS (SELECT p_partkey, p_name, p_brand FROM part), s AS (SELECT count(*) AS n, 3.0 AS avgdl FROM u),
d AS (SELECT count(*) FILTER (WHERE p_name LIKE 'red %') AS d1, count(*) FILTER (WHERE p_name LIKE '% ring') AS d2 FROM u)
SELECT p_partkey::varchar AS path, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * 2.2 / (1 + 1.2) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * 2.2 / (1 + 1.2), 6) AS score
FROM u, s, d WHERE p_name = 'red ring' ORDER BY score DESC, path LIMIT 25""")
def search_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    p = r.parts(spark, d)
    u = p.select(F.col("p_partkey").cast("string").alias("path"), F.lit("$").alias("mdpath"), F.lit(None).cast("string").alias("parent_list"), F.concat_ws(" ", "p_name", F.lit("x")).alias("body"), F.lit("").alias("context"))
    found = search.postings(u, stemmed=False)
    terms = ["red", "ring"]
    return search.top(search.ranked(found, search.statistics(u, found, terms), terms), 25).select("path", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey::varchar AS path, CASE WHEN o_orderkey % 10 = 0 THEN 'remove' ELSE 'index' END AS action FROM orders WHERE o_orderkey % 10 IN (0, 1, 2)")
def index_refresh_plan(spark: SparkSession, d: str) -> DataFrame:
    o = r.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"), F.col("o_custkey").alias("size"), (F.col("o_orderkey") % 10).alias("m"))
    listed = o.where("m <> 0").withColumn("size", F.when(F.col("m") == 2, F.col("size") + 1).otherwise(F.col("size")))
    return search.refresh_plan(listed, o.where("m <> 1"))


@query("SELECT 'n' || c_nationkey || '/' || c_custkey || '.md' AS path, CASE WHEN c_custkey % 50 = 0 THEN 'n' || c_nationkey || '/' || c_custkey || '.folio.yml' WHEN c_nationkey < 5 THEN 'n' || c_nationkey || '/.folio.yml' ELSE '.folio.yml' END AS schema FROM customer")
def schema_discovery(spark: SparkSession, d: str) -> DataFrame:
    c = r.table(spark, d, "customer")
    stem = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string"))
    docs = c.select(F.concat(stem, F.lit(".md")).alias("path"))
    own = c.where("c_custkey % 50 = 0").select(F.concat(stem, F.lit(".folio.yml")).alias("path"))
    folders = c.where("c_nationkey < 5").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/.folio.yml")).alias("path")).distinct()
    return files.schema_for(docs, own.unionByName(folders).unionByName(c.limit(1).select(F.lit(".folio.yml").alias("path"))))


def queries() -> dict[str, Query]:
    from . import catalogue_rules  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
