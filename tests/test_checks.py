"""Schemas and the diagnostics that they give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions.text import heading_slug, slug_column
from foliospark.operators.sequence import Inconsistent, verify
from foliospark.plans import schema
from foliospark.plans.check import check
from foliospark.plans.jsonschema import SchemaInvalid, Validator


def found(text, source):
    return sorted((d.id, d.line, d.target) for d in check(schema.load(text), source))


def ids(text, source):
    return [x[0] for x in found(text, source)]


T = 'version: 1\ntitle: "*"\n'


@pytest.mark.parametrize(
    ("text", "source", "want"),
    [
        (T + "sections:\n- match: A\n- match: B\n", "# T\n## B\n## A\n", ["misplaced-section", "missing-section"]),
        (T + "sections:\n- match: A\n", "# T\n## A\n## X\n", ["unexpected-section"]),
        (T + "sections:\n- match: A\nextras: anywhere\n", "# T\n## A\n## X\n", []),
        (T + 'sections:\n- {match: "*", repeat: "0..n"}\n- match: A\n- {match: "*", repeat: "0..n"}\n', "# T\n## A\n## A\n", []),
        (T + "sections:\n- match: A\nforbid_sections:\n- match: A\n", "# T\n## A\n", ["missing-section", "not-allowed"]),
        (T + 'unordered: true\nsections:\n- match: A\n- {match: "B*", repeat: "1..1"}\n', "# T\n## Bx\n## A\n## By\n", ["too-many-sections"]),
        (T, "# T\n### X\n", ["skipped-level"]),
        (T, "## X\n", ["missing-title"]),
        (T, "# A\n# B\n", ["too-many-sections"]),
        ("version: 1\ntitle: null\nsections: []\n", "# A\n## B\n", ["not-allowed"]),
        ("version: 1\noutline: []\n", "## B\n", ["skipped-level"]),
        ("version: 1\noutline:\n- match: A\n  content: [{block: p}]\n", "x\n# A\n- i\n", ["missing-block", "unexpected-block"]),
        (T + "content:\n- {block: list, items: [{match: x}]}\n", "# T\n- y\n-\n", ["missing-item", "unexpected-item", "unexpected-item"]),
        (T + "content:\n- {block: any, repeat: '0..n'}\n- {block: p}\n", "# T\na\n\nb\n", []),
        (T + "sections:\n- match: A\n", "# T\n<!-- x-disable unexpected-section -->\n## Y\n## A\n", []),
        (T + "sections:\n- match: A\n", "# T\n<!-- x-disable-file missing-section -->\n", []),
        (T + "frontmatter: {required: true}\n", "# T\n", ["missing-frontmatter"]),
        (T + "frontmatter: {allow: false}\n", "---\n- 1\n---\n# T\n", ["forbidden-frontmatter", "invalid-frontmatter"]),
        (T + "frontmatter: {captures: {v: {type: semver}}}\n", "---\nv: 1.2\n---\n# T\n", ["invalid-value"]),
    ],
)
def test_diagnostics(text, source, want):
    assert ids(text, source) == want


def test_targets_speak_for_the_document_or_the_title():
    text = T + "sections:\n- match: A\n"
    assert found(text, "# T\n") == [("missing-section", 1, {"kind": "missing_header", "parent": [], "matcher": "A"})]
    two = found(text, "# T\n# U\n")
    assert ("missing-section", 2, {"kind": "missing_header", "parent": ["U"], "matcher": "A"}) in two and len(two) == 3


def test_suppressed_values_keep_their_effect():
    text = T + "sections:\n- match: '/(?<v>.+)/'\n  repeat: '0..n'\n  captures: {v: int}\n  order: [{by: v}]\n"
    assert ids(text, "# T\n## 2\n## 1\n") == ["order-violation"]
    assert ids(text, "# T\n## 2\n<!-- x-disable invalid-value -->\n## x\n## 1\n") == []


def test_constraints_hide_behind_what_can_not_be_told():
    text = T + "unordered: true\nsections:\n- {match: A, required: false, sections: [{match: X, required: false}]}\n- {match: B, required: false}\nconstraints:\n- any_of: [a.x, b]\n"
    assert ids(text, "# T\n## A\n") == ["any_of"] and ids(text, "# T\n## A\n### X\n") == [] and ids(text, "# T\n## A\n## A\n") == ["too-many-sections"]


R = T + "sections:\n- match: A\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: [", ["syntax"]),
        ("version: 1\nversion: 1\ntitle: x\n", ["syntax"]),
        ("version: 2\ntitle: x\n", ["unsupported-version"]),
        ("version: 1\ntitle: x\nfoo: 1\n", ["invalid-document-shape"]),
        ("version: 1\noutline: []\nsections: []\n", ["conflicting-outline"]),
        ("version: 1\ntitle: x\nsections:\n- match: '*'\n", ["missing-cardinality"]),
        ("version: 1\ntitle: x\nsections:\n- {match: a, required: true, repeat: '1..1'}\n", ["conflicting-cardinality"]),
        ("version: 1\ntitle: x\nsections:\n- {match: a, repeat: '2..1'}\n", ["invalid-repeat"]),
        ("version: 1\ntitle: x\nsections:\n- {match: '/(/', repeat: '0..n'}\n", ["invalid-matcher"]),
        ("version: 1\ntitle: x\nsections:\n- match: a\n- match: A\n", ["duplicate-id"]),
        ("version: 1\ntitle: x\nsections:\n- {match: a, id: fm}\n", ["reserved-id"]),
        ("version: 1\ntitle: x\nsections:\n- {match: '/(?<v>a)?/', required: true, captures: {v: int}}\n", ["invalid-capture"]),
        ("version: 1\ntitle: x\nsections:\n- {match: '/(?<v>a)/', required: true, captures: {v: int}, order: [{by: v}]}\n", ["invalid-order"]),
        ("version: 1\ntitle: x\nunordered: true\nsections:\n- {match: '*', repeat: '0..n'}\n- match: a\n", ["unreachable-rule"]),
        ("version: 1\ntitle: x\ncontent:\n- {block: p, one_of: []}\n", ["invalid-content-rule"]),
        ("version: 1\ntitle: x\ncontent:\n- {block: quote}\n", ["invalid-content-rule"]),
        (R + "constraints:\n- any_of: [a, b]\n", ["unresolved-ref"]),
        (R + "constraints:\n- any_of: [a, $.a]\n- any_of: [a]\n", ["duplicate-ref", "invalid-document-shape"]),
        (R + "constraints:\n- requires: {if: a, then: a}\n", ["duplicate-ref"]),
        (R + "- match: B\nconstraints:\n- ordered: [a, b]\n", ["ordered-scope-mismatch"]),
        ("version: 1\ntitle: x\nfrontmatter: {required: true, allow: false}\n", ["conflicting-frontmatter"]),
        ("version: 1\ntitle: x\nfrontmatter: {schema: {$ref: other.json}}\n", ["invalid-frontmatter-schema"]),
        ("version: 1\ntitle: x\nsections: []\nextras: no\n", ["invalid-document-shape"]),
        ("", ["invalid-document-shape"]),
    ],
)
def test_schema_errors(text, want):
    with pytest.raises(schema.SchemaErrors) as x:
        schema.load(text)
    assert [e.id for e in x.value.errors] == want


def test_a_large_scope_stays_fast():
    text = T + "extras: anywhere\nsections:\n" + "".join(f"- {{match: 'H {i} *', id: r{i}, required: false}}\n" for i in range(100))
    source = "# T\n" + "".join(f"## H {i} x\n" for i in range(200))
    assert ids(text, source) == []


def test_only_the_named_tool_turns_checks_off():
    rules = schema.load("version: 1\ntitle: T\nsections: []\n")
    text = "# T\n\n<!-- other-disable unexpected-section -->\n## A\n\n<!-- mine-disable unexpected-section -->\n## B\n"
    assert [len(check(rules, text, tool=t)) for t in (None, "mine", "other", "none")] == [0, 1, 1, 2]


def test_patterns_of_json_schemas_take_linear_time():
    slow = {"type": "string", "pattern": "^(a+)+$"}
    assert Validator(slow).errors("a" * 60 + "b") and not Validator(slow).errors("a" * 60)
    assert Validator({"pattern": "a$"}).errors("a\n") and not Validator({"pattern": "(?=b)b"}).errors("abc")
    with pytest.raises(SchemaInvalid):
        Validator({"patternProperties": {"(": True}})


@pytest.mark.parametrize(("rules", "accepted"), [([0, 0, 1], True), ([0, 1, 0], False), ([1, -1, -1], False), ([0, -1, 1], True), ([1, 1, 1], True), ([0, 0], False), ([2, 2, 2], False)])
def test_assignments_are_verified(rules, accepted):
    edges, low, high = np.array([[0, -1], [0, 0], [0, 0]]), [1, 0], [2, None]
    ok = accepted and rules == [0, 0, 1]
    if ok:
        verify(edges, low, high, rules, accepted)
    else:
        with pytest.raises(Inconsistent):
            verify(edges, low, high, rules, accepted)


def test_slugs_of_any_text(spark):
    texts = ["Setup & Run", "Mälardalen ﬃ", "ﬀ—É 2", "", None, "--a--", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(slug_column(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [None if t is None else heading_slug(t) for t in texts]
