"""Whole documents against whole schemas: every diagnostic with its target, none more."""

from collections import Counter

import pytest

from foliospark.plans import schema
from foliospark.plans.check import check


def told(d):
    """A diagnostic in one line: its id, and what it points at."""
    t = d.target
    at = {
        "header": lambda: "/".join(t["path"]), "missing_header": lambda: "/".join([*t["parent"], f"<{t['matcher']}>"]), "document": lambda: "", "frontmatter": lambda: t.get("pointer", "-"),
        "block": lambda: f"{'/'.join(t['parent'])}#{t['block']}{t['index']}", "missing_block": lambda: "/".join([*t["parent"], "<block>"]), "item": lambda: f"{'/'.join(t['list']['parent'])}#list{t['list']['index']}.{t['index']}", "missing_item": lambda: f"{'/'.join(t['list']['parent'])}#list{t['list']['index']}.<{t['matcher']}>",
    }[t["kind"]]()
    return f"{d.id} {at}".strip()


RECIPE = """version: 1
title: "*"
content:
- block: p
  required: false
sections:
- match: Ingredients
  content:
  - block: list
    list_kind: bullet
    items:
    - {match: "/[0-9]+ g .+/", repeat: "1..n"}
    - {match: salt, required: false}
- match: "/Step (?<n>[0-9]+)/"
  repeat: "1..3"
  captures: {n: int}
  order:
  - {by: n, strict: true}
- {match: Notes, required: false, extras: anywhere, sections: [{match: Sources}]}
"""
MINUTES = """version: 1
title: null
options: {match_case: true}
unordered: true
forbid_sections:
- match: "/.*(secret|Secret).*/"
sections:
- {match: Present, id: present}
- {match: Votes, id: votes, required: false}
- {match: Motion *, id: motion, repeat: "0..n", sections: [{match: Result, id: result, required: false}]}
constraints:
- requires: {if: votes, then: [present]}
- at_most_one: [votes, "motion[0].result"]
"""
LOG = """version: 1
title: Changes
frontmatter:
  required: true
  captures:
    release: {type: semver, required: true}
    final: {type: bool}
  schema:
    type: object
    properties:
      tags: {type: array, items: {type: string}}
    additionalProperties: true
sections:
- match: '/(?<v>\\d+\\.\\d+) - (?<day>.+)/'
  repeat: "0..n"
  captures: {v: dotted, day: date}
  order:
  - {by: day, dir: desc}
  - {by: v, dir: desc, strict: true}
constraints:
- any_of: [fm.final, "fm[$.tags[*]]=draft"]
"""
BOOK = """version: 1
unordered: false
outline:
- {match: Preface, required: false}
- match: Part *
  repeat: "2..3"
  sections:
  - {match: "*", repeat: "1..2"}
- match: Index
"""
CASES = [
    ("recipe: all there", RECIPE, "# Bread\n\nFine.\n\n## Ingredients\n\n- 500 g flour\n- 20 g yeast\n- salt\n\n## Step 1\n\n## Step 2\n", []),
    ("recipe: nothing but a title", RECIPE, "# Bread\n", ["missing-section <Ingredients>", "missing-section </Step (?<n>[0-9]+)/>"]),
    ("recipe: no title", RECIPE, "Some text.\n", ["missing-title <*>", "missing-section <Ingredients>", "missing-section </Step (?<n>[0-9]+)/>"]),
    ("recipe: items out of place", RECIPE, "# Bread\n## Ingredients\n* salt\n* 5 g oil\n* pepper\n## Step 1\n", ["misplaced-item Bread/Ingredients#list0.0", "unexpected-item Bread/Ingredients#list0.2"]),
    ("recipe: a numbered list", RECIPE, "# Bread\n## Ingredients\n1. 5 g oil\n## Step 1\n", ["unexpected-block Bread/Ingredients#list0", "missing-block Bread/Ingredients/<block>"]),
    ("recipe: loose items of several blocks", RECIPE, "# Bread\n## Ingredients\n- 5 g oil\n\n  more on oil\n\n- > salt\n## Step 1\n", ["unexpected-item Bread/Ingredients#list0.1"]),
    ("recipe: steps in disorder", RECIPE, "# B\n## Ingredients\n- 1 g x\n## Step 2\n## Step 1\n## Step 1\n", ["order-violation B/Step 1", "order-violation B/Step 1"]),
    ("recipe: too many steps", RECIPE, "# B\n## Ingredients\n- 1 g x\n## Step 1\n## Step 2\n## Step 3\n## Step 4\n", ["too-many-sections B/Step 4"]),
    ("recipe: sections out of order", RECIPE, "# B\n## Step 1\n## Ingredients\n- 1 g x\n", ["misplaced-section B/Step 1", "missing-section </Step (?<n>[0-9]+)/>"]),
    ("recipe: extras below notes alone", RECIPE, "# B\n## Ingredients\n- 1 g x\n## Step 1\n## Notes\n### Any\n### Sources\n## Any\n", ["unexpected-section B/Any"]),
    ("recipe: notes without sources", RECIPE, "# B\n## Ingredients\n- 1 g x\n## Step 1\n## Notes\n### Any\n", ["missing-section B/Notes/<Sources>"]),
    ("recipe: two titles", RECIPE, "# B\n## Ingredients\n- 1 g x\n## Step 1\n# C\n", ["too-many-sections C", "missing-section C/<Ingredients>", "missing-section C/</Step (?<n>[0-9]+)/>"]),
    ("recipe: a level skipped", RECIPE, "# B\n## Ingredients\n- 1 g x\n#### Deep\n## Step 1\n", ["skipped-level B/Ingredients/Deep"]),
    ("recipe: a comment is no block", RECIPE, "# B\n\n<!-- one -->\n\nText.\n\n<!-- two\nlines -->\n\n## Ingredients\n- 1 g x\n## Step 1\n", []),
    ("recipe: turned off", RECIPE, "<!-- folio-disable-file missing-section -->\n# B\n## Ingredients\n- 1 g x\n<!-- folio-disable unexpected-section -->\n## Any\n", []),
    ("recipe: code holds no headings", RECIPE, "# B\n## Ingredients\n- 1 g x\n## Step 1\n```\n## Step 9\n```\n    ## Step 8\n", []),
    ("minutes: case matters", MINUTES, "## present\n", ["unexpected-section present", "missing-section <Present>"]),
    ("minutes: any order", MINUTES, "## Motion 2\n## Votes\n## Present\n## Motion 1\n", []),
    ("minutes: a guard takes a section and what is below it", MINUTES, "## Present\n## Motion secret\n### Result\n### Other\n", ["not-allowed Motion secret"]),
    ("minutes: a title where none may stand", MINUTES, "# Minutes\n## Present\n", ["not-allowed Minutes", "missing-section <Present>"]),
    ("minutes: first of a repeated rule", MINUTES, "## Present\n## Votes\n## Motion 1\n### Result\n", ["at_most_one"]),
    ("minutes: second of a repeated rule", MINUTES, "## Present\n## Votes\n## Motion 1\n## Motion 2\n### Result\n", []),
    ("minutes: what is required", MINUTES, "## Votes\n", ["missing-section <Present>", "requires"]),
    ("log: fine", LOG, "---\nrelease: 1.2.0-rc.1\nfinal: true\n---\n# Changes\n## 1.10 - 2024-02-29\n## 1.9 - 2023-01-01\n", []),
    ("log: no frontmatter", LOG, "# Changes\n", ["missing-frontmatter -"]),
    ("log: broken frontmatter", LOG, "---\na: [1\n---\n# Changes\n", ["invalid-frontmatter -"]),
    ("log: values", LOG, "---\nrelease: 1.2\nfinal: maybe\ntags: [x, 3]\n---\n# Changes\n", ["invalid-value /release", "invalid-value /final", "frontmatter-schema /tags/1"]),
    ("log: value that is missing", LOG, "---\nfinal: false\n---\n# Changes\n", ["missing-value /release", "any_of"]),
    ("log: another way to meet a constraint", LOG, "---\nrelease: 1.0.0\ntags: [a, Draft]\n---\n# Changes\n", []),
    ("log: no such day", LOG, "---\nrelease: 1.0.0\nfinal: true\n---\n# Changes\n## 1.0 - 2023-02-29\n## 1.0 - 2024-01-01\n", ["invalid-value Changes/1.0 - 2023-02-29", "order-violation Changes/1.0 - 2024-01-01"]),
    ("log: another title", LOG, "---\nrelease: 1.0.0\nfinal: true\n---\n# News\n", ["not-allowed News"]),
    ("book: parts", BOOK, "# Preface\n# Part One\n## A\n# Part Two\n## B\n## C\n# Index\n", []),
    ("book: one part", BOOK, "# Part One\n## A\n# Index\n", ["too-few-sections <Part *>"]),
    ("book: chapters", BOOK, "# Part One\n# Part Two\n## A\n## B\n## C\n# Index\n", ["missing-section Part One/<*>", "too-many-sections Part Two/C"]),
    ("book: index first", BOOK, "# Index\n# Part One\n## A\n# Part Two\n## A\n", ["misplaced-section Index", "missing-section <Index>"]),
    ("book: empty", BOOK, "", ["missing-section <Part *>", "missing-section <Index>"]),
]


@pytest.mark.parametrize(("rules", "source", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_documents(rules, source, want):
    assert Counter(map(told, check(schema.load(rules), source))) == Counter(want)
