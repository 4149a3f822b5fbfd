"""Matchers: both engines agree wherever the quick one may run."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.functions.patterns import QUICK, Matcher

ATOMS = ["a", "b", r"\d", r"\w", "[ab]", "[^a]", "(a|b)", "(?:ab)", ".", r"\.", r"\s", "x?", "a*", "b+", r"\d{2}", "a{1,2}", "a{,2}", "$", "^", r"\-", r"[\d-]", "[]a]", "|", "(?P<n>a+)", r"\n", r"\bb", "{", "}"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), min_size=1, max_size=5), st.text(alphabet="aAbB1 .-]\n{,2}", max_size=7), st.booleans())
def test_short_and_long_texts_meet_the_same_matches(parts, text, match_case):
    try:
        m = Matcher.of("/" + "".join(parts) + "/", match_case)
    except ValueError:
        return
    want = pc.match_substring_regex(pa.array([text]), m.pattern)[0].as_py()
    assert m.matches(text) == want
    if want and m.groups:
        assert {k: v or "" for k, v in m.captures(text).items()} == pc.extract_regex(pa.array([text]), m.pattern)[0].as_py()


@pytest.mark.parametrize(("body", "text"), [(r"a$\n", "a\n"), ("a{,2}", "aa"), ("a{,2}", "a{,2}"), ("a.*b", "a\nb"), ("[a-c]+", "abc")])
def test_length_does_not_tell(body, text):
    m = Matcher.of(f"/(?:{body})x*/")
    assert m.matches(text) == m.matches(text + "x" * QUICK)


def test_columns_agree_with_single_texts(spark):
    texts = ["a\n", "aa", "a{,2}", "AB", "", None, "ſ"]
    for body in (r"/a$\n/", "/a{,2}/", "/[a-b]+/", "/s/", "A*", "ab"):
        m = Matcher.of(body)
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        assert [r.m for r in df.select("i", m.column(df.t).alias("m")).orderBy("i").collect()] == [m.matches(t) for t in texts]
