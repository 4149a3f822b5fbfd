"""Parsing, sequences, typed values, paths: plain Python, against brute force where there is one."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.functions import typed
from foliospark.functions.patterns import Matcher, PatternError
from foliospark.functions.stem import analyze, stem
from foliospark.functions.text import escape_compact, heading_slug, simple_fold, size_text
from foliospark.operators.document import decode, parse
from foliospark.operators.paths import PathFailure, Paths, PathSyntax, parse_path
from foliospark.operators.search import snippet
from foliospark.operators.sequence import assign
from foliospark.plans import jsonpath, jsonschema
from foliospark.sources import frontmatter, yaml12
from foliospark.sources.files import Ignore, walk


def kinds(text):
    d = parse(text)
    return [(b.kind, b.line) for b in d.root.blocks], [(s.level, s.text, s.line) for s in d.walk()]


@pytest.mark.parametrize(
    ("text", "blocks", "sections"),
    [
        ("# A\ntext\n## B #\n", [], [(1, "A", 1), (2, "B", 3)]),
        ("Title\n=====\n\nSub\n---\n", [], [(1, "Title", 1), (2, "Sub", 4)]),
        ("```\n# no\n```\n    # no\n\n> # no\n", [("code", 1), ("code", 4), ("quote", 6)], []),
        ("#\tno\n#no\n####### no\n", [("p", 2)], []),
        ("- a\n- b\n\n  c\n* d\n1. e\n", [("list", 1), ("list", 5), ("list", 6)], []),
        ("a\nb\n***\n<!-- x -->\n\n<div>\nhi\n\n[r]: /u\n\nz\n", [("p", 1), ("break", 3), ("html", 6), ("p", 11)], []),
        ("> a\nb\n", [("quote", 1)], []),
        ("~~~ x\na\n~~~~\nb", [("code", 1), ("p", 4)], []),
        ("", [], []),
    ],
)
def test_block_structure(text, blocks, sections):
    assert kinds(text) == (blocks, sections)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("**Foo** [bar](x)", "Foo bar"), ("`a*b`", "a*b"), ("a \\* b &amp; c", "a * b & c"), ("![alt *x*](y)", "alt x"), ("*a* _b_ snake_case", "a b snake_case"), ("<b>x</b>", "x"), ("<http://x.y>", "http://x.y"), ("[a][r]", "a"), ("[a]", "[a]"), ("*a", "*a"), ("***a** b*", "a b"), ("``a`b``", "a`b")],
)
def test_heading_text(raw, want):
    assert parse(f"# {raw}\n\n[r]: /u\n").root.sections[0].text == want


def test_items_and_their_text():
    d = parse("- one\n  two\n- \n- > q\n- ```\n  x\n  ```\n- [ ] t\n")
    assert [(i.text, i.line) for i in d.root.blocks[0].items] == [("one\ntwo", 1), (None, 3), (None, 4), (None, 5), ("[ ] t", 8)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab#-*>`=_ \n1.[]()<!\t", max_size=60))
def test_any_text_parses_with_sane_ranges(text):
    d = parse(text)
    p = Paths(d)
    size = len(text.encode())
    for n in p.nodes:
        assert 0 <= n.start <= n.end <= size
        assert p.resolve(parse_path(p.of[id(n)])) is n
    assert len(set(p.of.values())) == len(p.nodes)


def brute(edges, low, high, reluctant):
    n, q = edges.shape
    best = None
    for cut in itertools.combinations_with_replacement(range(n + 1), q - 1) if q else [()]:
        ends = [0, *cut, n]
        counts = [b - a for a, b in zip(ends, ends[1:], strict=False)] if q else []
        if not q and n or any(not a <= c <= (n if b is None else b) for c, a, b in zip(counts, low, high, strict=True)):
            continue
        taken = [j for j, c in enumerate(counts) for _ in range(c)]
        if any(edges[i, j] < 0 for i, j in enumerate(taken)):
            continue
        key = (sum(edges[i, j] for i, j in enumerate(taken)), [c if r else -c for c, r in zip(counts, reluctant, strict=True)])
        if best is None or key < best[0]:
            best = key, taken
    if best:
        return best[1], True
    options = []

    def go(i, j, left, cost, trace, taken):
        if i == n:
            options.append((left, cost, trace, taken))
            return
        if j < q and edges[i, j] >= 0:
            go(i + 1, j, left, cost + edges[i, j], [*trace, 0], [*taken, j])
        go(i + 1, j, left + 1, cost, [*trace, 1], [*taken, -1])
        if j + 1 < q:
            go(i, j + 1, left, cost, [*trace, 2], taken)

    go(0, 0, 0, 0, [], [])
    return min(options)[3], False


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_assignment_against_brute_force(data):
    n, q = data.draw(st.integers(0, 5)), data.draw(st.integers(0, 3))
    edges = np.array(data.draw(st.lists(st.lists(st.integers(-1, 1), min_size=q, max_size=q), min_size=n, max_size=n)), np.int64).reshape(n, q)
    low = data.draw(st.lists(st.integers(0, 2), min_size=q, max_size=q))
    high = [data.draw(st.sampled_from([None, a, a + 1])) for a in low]
    reluctant = data.draw(st.lists(st.booleans(), min_size=q, max_size=q))
    assert assign(edges, low, high, reluctant) == brute(edges, low, high, reluctant)


@pytest.mark.parametrize(("kind", "good", "bad"), [("int", ["-01", "9223372036854775807"], ["9223372036854775808", "1.0", " 1", ""]), ("bool", ["true"], ["True", ""]), ("date", ["2024-02-29", "0000-01-01"], ["2023-02-29", "2024-1-01"]), ("semver", ["1.0.0-rc.1", "18446744073709551615.0.0"], ["1.0", "1.0.0+b", "01.0.0", "1.0.0-01"]), ("dotted", ["1.02.0", "4294967295"], ["4294967296", "1.", ""])])
def test_typed_values(kind, good, bad):
    for x in good:
        typed.parse(kind, x)
    for x in bad:
        with pytest.raises(typed.Invalid):
            typed.parse(kind, x)


def test_typed_order():
    versions = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "2.0.0"]
    keys = [typed.parse("semver", v) for v in versions]
    assert keys == sorted(keys) and typed.parse("dotted", "1.02") == typed.parse("dotted", "1.2") < typed.parse("dotted", "1.2.0")
    assert typed.canonical("int", "-01") == "-1" and typed.canonical("dotted", "1.02") == "1.2"


@pytest.mark.parametrize(("matcher", "yes", "no"), [("Straße", ["straße"], ["STRASSE"]), ("S", ["ſ"], ["ss"]), ("a*c", ["abc", "AC", "a\nc"], ["abcd"]), ("*x*", ["axb", "x"], ["ab"]), (r"/v\d+/", ["v12", "v٣"], ["v", "v1x"]), (r"/a\/b/", ["a/b"], ["ab"]), ("/.+/", ["x"], ["", "a\nb"])])
def test_matchers(matcher, yes, no):
    m = Matcher.of(matcher)
    assert all(m.matches(x) for x in yes) and not any(m.matches(x) for x in no) and not m.matches(None)


@pytest.mark.parametrize("bad", [r"/(a)\1/", "/(?=a)/", "/a/b/", "/(/", "/[a/"])
def test_patterns_outside_the_dialect(bad):
    with pytest.raises(PatternError):
        Matcher.of(bad)


def test_groups_that_may_take_no_part():
    assert Matcher.of("/(?<a>x)(?:y|(?P<b>z))(?<c>w)?((?<d>v)){0,2}/").groups == {"a": True, "b": False, "c": False, "d": False}


def test_slugs_sizes_and_escapes():
    assert [heading_slug(x) for x in ("Mälardalen & ﬃ", "  A--b ", "😀", "İx")] == ["malardalen-ffi", "a-b", "", "ix"]
    assert [size_text(n) for n in (999, 1000, 1949, 1950, 999_999, 2_000_000)] == ["999B", "1.0kB", "1.9kB", "2.0kB", "1000.0kB", "2.0MB"]
    assert escape_compact("a\\\t\n\r") == "a\\\\\\t\\n\\u{d}" and simple_fold("ΑΣς") == "ασσ"


GUIDE = "# Guide\n\n## Mälardalen & ﬃ\n\nText.\n\n## FAQ\n\n### Question\n\nOne.\n\n### Question\n\nTwo.\n\n## 😀\n"


def test_paths_and_sizes():
    p = Paths(parse(GUIDE))
    assert [(e["mdpath"], e["bytes"]) for e in map(p.entry, p.tree(p.doc.root))] == [("$", 94), ("$.malardalen-ffi", 28), ("$.faq", 47), ("$.faq.question[0]", 19), ("$.faq.question[1]", 19), ("$.[2]", 8)]
    assert p.content(p.resolve(parse_path("$.faq")), 0) == "## FAQ\n" and p.content(p.resolve(parse_path("$..question[1]"))) == "### Question\n\nTwo.\n"
    with pytest.raises(PathFailure, match="ambiguous"):
        p.resolve(parse_path("$..question"))
    with pytest.raises(PathFailure) as x:
        p.resolve(parse_path("$.faqq"))
    assert p.suggestions(parse_path("$.faqq"), x.value) == ["$.faq"]
    for bad in ("x", "$.A", "$.a[01]", "$.a/item", "$..[1]", "$.a/p/p"):
        with pytest.raises(PathSyntax):
            parse_path(bad)


SHELF = "# Shelf\n\n## 3. Tools\n\n### 3.1 Hand Plane\n\n#### Blade\n\n### Saw\n\n## Plane\n\n## Planes Two\n\n## 9. Glue\n"


@pytest.mark.parametrize(
    ("path", "found"),
    [
        ("$.saw", ["$.3-tools.saw"]), ("$.hand-plane.blade", ["$.3-tools.3-1-hand-plane.blade"]), ("$.hand-plane.none", ["$.3-tools.3-1-hand-plane"]), ("$.glue", ["$.9-glue"]), ("$.plan", ["$.plane"]),
        ("$..blad", ["$.3-tools.3-1-hand-plane.blade"]), ("$.sav", ["$.3-tools.saw"]), ("$.nothing-like-it", []), ("$.[7]", []), ("$.plane/list[2]", []), ("$.3-tools.hand-plame", ["$.3-tools.3-1-hand-plane"]),
    ],
)
def test_suggestions(path, found):
    p, steps = Paths(parse(SHELF)), parse_path(path)
    with pytest.raises(PathFailure) as x:
        p.resolve(steps)
    assert p.suggestions(steps, x.value) == found


@pytest.mark.parametrize(("text", "kind"), [("yes", "string"), ("010", "integer"), ("0x1F", "integer"), ("-0o7", "integer"), ("12:30", "string"), ("1_000", "string"), (".5", "float"), ("1e3", "float"), ("~", "null"), ("True", "boolean"), ("2024-01-01", "string"), (".inf", "special")])
def test_core_scalars(text, kind):
    assert yaml12.scalar_kind(text) == kind


def test_frontmatter_states_and_places():
    f = frontmatter.read("---\na: 1\nb:\n  - x\n  - {c: 2.50}\n---\nbody".split("\n"))
    assert f.state == "mapping" and f.anchors == {"/a": (2, 1), "/b": (3, 1), "/b/0": (4, 5), "/b/1": (5, 5), "/b/1/c": (5, 6)}
    assert frontmatter.scalars(f.root) == ["1", "x", "2.50"]
    for bad in ("---\n- 1\n---", "---\na: 1", "---\na: 1\na: 2\n---", "---\n1: x\n---", "---\n---", "---\na: [\n---"):
        assert frontmatter.read(bad.split("\n")).state == "invalid"
    assert frontmatter.read(["--- ", "a: 1", "---"]).state == "absent"
    bomb = "a: &a [x,x,x,x,x,x,x,x,x,x]\n" + "".join(f"{c}: &{c} [{','.join('*' + p for _ in range(10))}]\n" for p, c in zip("abcdefg", "bcdefgh", strict=True))
    assert frontmatter.read(["---", *bomb.split("\n"), "---"]).state == "invalid"


DATA = yaml12.parse("{a: [1, 2, {b: x}], c: {d: true, e: null}, 'q''r': 5}")


@pytest.mark.parametrize(("query", "pointers"), [("$", [()]), ("$.a[*]", [("a", 0), ("a", 1), ("a", 2)]), ("$.a[-1].b", [("a", 2, "b")]), ("$['q\\'r']", [("q'r",)]), ("$.a[0:2]", [("a", 0), ("a", 1)]), ("$..b", [("a", 2, "b")]), ("$.a[0,0]", [("a", 0)]), ("$.a[?@.b=='x']", [("a", 2)]), ("$.a[?@>1]", [("a", 1)]), ("$.c[?@==null]", [("c", "e")]), ("$.x.y", []), ("$[?length(@)==3]", [("a",)])])
def test_queries(query, pointers):
    assert [p for p, _ in jsonpath.parse(query).nodes(DATA)] == pointers


@pytest.mark.parametrize("bad", ["a", "$.", "$[", "$[01]", "$[9007199254740992]", "$.a[?foo(@)]", "$['a", "$ "])
def test_queries_that_are_none(bad):
    with pytest.raises(jsonpath.QueryError):
        jsonpath.parse(bad)


def test_json_schema():
    v = jsonschema.Validator({"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/$defs/n"}, "l": {"items": {"type": "string"}, "uniqueItems": True}}, "additionalProperties": False, "$defs": {"n": {"type": "integer", "exclusiveMinimum": 3}}})
    value = lambda text: yaml12.parse(text).value()
    assert v.errors(value("{a: 4, l: [x, y]}")) == [] and [p for p, _ in v.errors(value("{a: 3, l: [x, x, 1], z: 1}"))] == ["/a", "/l", "/l/2", ""]
    assert [p for p, _ in v.errors(value("{}"))] == [""] and v.errors(value("{a: 4.0}")) == []
    with pytest.raises(jsonschema.SchemaInvalid):
        jsonschema.Validator({"$ref": "#/nowhere"})


@pytest.mark.parametrize(("word", "want"), [("running", "run"), ("bolts", "bolt"), ("generously", "generous"), ("happiness", "happi"), ("skies", "sky"), ("hopping", "hop"), ("relational", "relat"), ("national", "nation"), ("consistency", "consist"), ("knightly", "knight"), ("as", "as"), ("ties", "tie"), ("cries", "cri"), ("hoped", "hope"), ("feed", "feed"), ("agreed", "agre")])
def test_stems(word, want):
    assert stem(word) == want


def test_analysis_and_snippets():
    assert analyze("The Bolts, running_x! " + "y" * 40) == ["the", "bolt", "run", "x"]
    text = "alpha " * 60 + "needle here " + "omega " * 60
    s = snippet(text, {"needl"})
    assert "needle" in s and s.startswith("…") and s.endswith("…") and len(s) <= 162 and snippet("short", set()) == "short"


def test_walk_honours_ignore_files(tmp_path):
    for f in ("a.md", "b.MARKDOWN", "c.txt", ".hidden.md", "sub/d.md", "sub/e.md", "keep/.f.md", "out/g.md"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("x")
    (tmp_path / ".gitignore").write_text("e.md\n/out/\n!keep/.f.md\n")
    found, notes, complete = walk(tmp_path)
    assert [p for p, _, _ in found] == ["a.md", "b.MARKDOWN", "keep/.f.md", "sub/d.md"] and complete and not notes
    assert Ignore("**/x/*.md").verdict("a/b/x/y.md", False) and Ignore("*.md\n!y.md").verdict("y.md", False) is False


def test_decoding():
    assert decode(b"\xef\xbb\xbfa") == "a"
    with pytest.raises(UnicodeDecodeError):
        decode(b"\xff")
