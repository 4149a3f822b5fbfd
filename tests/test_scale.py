"""What keeps queries linear: documents read once, rows dealt out, and short cuts that give what the long way gives."""

import random
import re
from dataclasses import asdict

import pytest
from foliospark.operators import document, parse
from foliospark.plans import catalogue, rendered, schema, validate
from foliospark.sources import yaml12

#: The passes over documents that each query's plan has, by what they give beside the key.
PASSES = {
    "fm_int_kind": ["id target line"],
    "fm_missing_required": ["id target"],
    "diagnostic_total_order": ["ord line target"],
    "misplaced_blocks": ["id"],
    "root_units": ["kind body snippet"],
    "forbidden_frontmatter": ["id line"],
    "constraint_one_of": ["id target"],
    "results_met_once": ["id"],
    "json_results": ["ord id line col target message schema_node schema_line schema_col involved refs"],
    "fm_bool_read": ["id"],
    "item_diagnostics": ["id"],
    "capture_truth": ["id"],
    "inline_suppression": ["id"],
    "fm_json_schema": ["target"],
    "constraint_suppressed": ["id"],
    "fm_equality": ["id target"],
    "skipped_levels_allowed": ["schema id"],
    "fm_jsonpath": ["id"],
    "schema_errors_by_pointer": ["target"],
    "item_positions_in_order": ["ord id target"],
    "tagged_scalars": ["pointer kind", "id"],
    "level_admission": ["kind level above"],
}


@pytest.mark.parametrize("name", sorted(PASSES))
def test_passes(spark, tables, name):
    plan = catalogue.queries()[name](spark, str(tables))._jdf.queryExecution().analyzed().toString()
    found = [" ".join(x.split("#")[0] for x in m.split(", ")[1:]) for m in re.findall(r"MapInArrow .*?, \[(.*?)\]", plan)]
    assert found == PASSES[name]


def _outlines(n):
    rng = random.Random(7)
    lines = ["", "# T", "## A", "### A b", "## *a* &amp; \\*", "#x", "##", "#\tA", "####### A", "## A ##", "# Top 1", "## A  b", "###   C"]
    return ["\n".join(rng.choices(lines, k=rng.randint(1, 7))) for _ in range(n)]


def test_outlines_read_as_any_document(monkeypatch):
    wanted = []
    with monkeypatch.context() as m:
        m.setattr(document, "_outline", lambda *_: None)
        m.setattr(document.Parser, "_simple", lambda *_: False)
        for x in _outlines(500):
            wanted.append([list(parse.node_rows(document.parse(x, strip, False))) for strip in (True, False)])
    got = [[list(parse.node_rows(document.parse(x, strip, False))) for strip in (True, False)] for x in _outlines(500)]
    assert got == wanted
    for x in _outlines(500):
        fields = sorted(parse._SHAPE)
        assert list(parse.node_rows(document.parse(x, True, False), fields)) == list(parse.node_rows(document.parse(parse._shape(x), True, False), fields))


def test_texts_that_come_again(spark):
    docs = spark.createDataFrame([(i, "## A\n\n- x\n" * (i % 3)) for i in range(50)], "doc_id int, source string").coalesce(1)
    n = [(r.doc_id, r.mdpath) for r in parse.nodes(docs).collect()]
    assert n == [(i, r["mdpath"]) for i in range(50) for r in parse.node_rows(document.parse("## A\n\n- x\n" * (i % 3), True, False))]
    u = [(r.path, r.context) for r in parse.units(docs.selectExpr("concat('f', doc_id, '.md') path", "source")).where("kind = 'section'").collect()]
    assert [p.removesuffix(".md") for p, _ in u] == [c.split(" / ")[0] for _, c in u]


def test_rows_of_one_row_group_are_dealt_out(spark, tables):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for docs in (rendered.event_documents(spark, str(tables)), rendered.parts(spark, str(tables))):
            sizes = [len(x) for x in docs.rdd.glom().collect()]
            assert sum(x > 0 for x in sizes) > 1 and max(sizes) < sum(sizes) / 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("lines", [["a: 1"], ["b: x", "b: 1.5", "null: y"], ["k: 2024-01-01", "on: true", "h: 0x1f"], ["a: b: c"], ["a: 'x'"], ["a: x #y"], ["a: x."]])
def test_flat_frontmatter(lines):
    short = yaml12.flat(lines)
    assert short is None or asdict(short) == asdict(yaml12.parse("\n".join(lines) + "\n"))


SCHEMAS = [
    "version: 1\ntitle: '/T [0-9]+/'\nsections: []\n",
    "version: 1\ntitle: '*'\nunordered: true\nsections:\n- {match: A, repeat: '0..n'}\n- {match: B, required: true}\nconstraints:\n- at_most_one: [a, b]\n",
    "version: 1\ntitle: T 1\nsections:\n- {match: A, required: true}\n",
    "version: 1\ntitle: null\nsections:\n- {match: 'T *', required: true}\n",
]


@pytest.mark.parametrize("text", SCHEMAS)
def test_documents_that_differ_in_their_title(spark, text):
    rng = random.Random(5)
    sources = [f"# T {rng.randint(1, 3)}\n" + "\n".join(rng.choices(["## A", "## B", "# T 2", "text", "", "### C", "```", "<!-- x-disable unexpected-section -->"], k=rng.randint(0, 5))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(sources)), "doc_id int, source string").coalesce(1)
    got = sorted((r.doc_id, r.ord, r.id, r.line, r.target, r.message, str(r.involved), r.refs) for r in validate.validate(docs, text).collect())
    s, wanted = schema.load(text), []
    for i, x in enumerate(sources):
        found = validate.ordered(validate.checks(s, document.parse(x, s.strip, detail=False)))
        wanted += [(i, k, d.id, d.line, validate._json(d.target), d.message, len(d.involved), [validate._json(r) for r in d.references]) for k, d in enumerate(found) if not d.suppressed]
    assert [g[:6] + (g[7],) for g in got] == [w[:6] + (w[7],) for w in sorted(wanted)]


def test_what_is_kept_is_bounded():
    kept = validate._Titled()
    for i in range(5000):
        kept.put("q", str(i), [{"id": "x"}] * 50)
        assert sum(1 + len(x) for x in kept.of("q").values()) <= kept.MOST + 51
    assert kept.of("q") and not kept.of("other")
