"""Operators that look at each text alone: licences, personal data, secrets, toxicity."""

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import licenses, pii, secret_scans, toxicity

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "x" * 300_000), (5, "same"), (5, "same"), (None, "word"), (6, "İß ſ \x00 😀")]
DOCS = "doc_id bigint, text string"


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_license_phrases_and_expressions(spark):
    texts = [(1, "Under the MIT License; under the mit license"), (2, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nmit"), (3, "cc-by-nc and apache license, version 2.0"), (4, "under the mit licensed"), *[(10 + i, t) for i, (_, t) in enumerate(ODD)]]
    got = rows(licenses.scan_licenses(spark.createDataFrame(texts, DOCS)))
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 0, 4, "mit")
    assert got[2].labels == "apache-2.0,gpl-2.0-only,mit" and got[2].permitted and got[2].n_base == 0
    assert got[3].base_labels == "apache-2,cc-by-nc" and (got[3].first_word, got[3].last_word) == (0, 4)
    assert got[4].n_base == 0 and got[4].first_word is None
    assert got[10].n_words == 0 and got[10].score == 0.0 and got[13].n_words == 1


@pytest.mark.parametrize(("text", "postfix"), [("MIT", ["mit"]), ("a OR b AND c", ["a", "b", "c", "and", "or"]), ("(a or b) and c", ["a", "b", "or", "c", "and"]), ("a with x or b", ["a", "x", "with", "b", "or"]), ("(a", None), ("a and", ["a"]), ("", None), ("or", None), ("a )", ["a"])])
def test_shunting_yard(text, postfix):
    assert licenses.parse_expression(text) == postfix


def test_long_and_wrapped_expressions():
    names = [f"lic-{i}" for i in range(3000)]
    assert licenses.identifiers(licenses.parse_expression(" OR ".join(names))) == names
    text = "// SPDX-License-Identifier: (MIT OR\n//   Apache-2.0) AND\n// ISC\n// BSD\nspdx license identifier - no\nSPDX-License-Identifier:Zlib WITH x OR 0BSD"
    got = licenses.scan_text(text.encode())
    assert got["labels"] == "0bsd,apache-2.0,isc,mit,zlib" and got["permitted"]
    got = licenses.scan_text(("SPDX-License-Identifier: " + " OR ".join(names)).encode())
    assert got["labels"].split(",") == sorted(names) and got["permitted"] is False
    assert licenses.identifiers(licenses.parse_expression("a with (b or c) or d and e with f")) == ["a", "d", "e"]


def test_permitted_needs_some_allowed_way():
    assert licenses.permitted(licenses.parse_expression("GPL-3.0 or MIT"))
    assert not licenses.permitted(licenses.parse_expression("GPL-3.0 and MIT"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["under the mit license", "cc-by-nc", "the", "license", "Apache License, Version 2", "é"]), max_size=12))
def test_base_places_against_brute_force(parts):
    text = " ".join(parts)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    places = [i for p, _, base, _ in licenses.PHRASES if base for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    got = licenses.scan_text(text.encode())
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1209.@-+ ()", max_size=60))
def test_base_personal_data_against_plain_patterns(text):
    want = [(0, *m.span()) for m in EMAIL.finditer(text)]
    want += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            want.append((2, *m.span()))
    want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert pii.base_spans(text) == want


def test_field_finds_numbers_by_shape_and_cue():
    field = pii.trained()
    texts = ["please call me at 212-555-0188 tonight", "her ssn is 219-09-9998 on file", "nothing here in 1984 at all"]
    found = pii.added_spans(texts, [pii.base_spans(t) for t in texts], field)
    assert [(texts[0][a:b]) for _, a, b in found[0]] == ["212-555-0188"]
    assert [pii.KINDS[k] for k, _, _ in found[1]] == ["ssn"] and not found[2]


def test_viterbi_against_all_paths():
    field = pii.trained()
    words = "ssn 219-09-9998 or 12".split()
    e = np.array([field.w[f].sum(0) for f in field.ids(words)])
    k = len(pii.LABELS)
    best = max(np.ndindex(*[k] * len(words)), key=lambda y: field.t[k, y[0]] + sum(e[i, y[i]] for i in range(len(y))) + sum(field.t[a, b] for a, b in zip(y, y[1:])))
    assert list(field.decode([words])[0]) == list(best)


def test_long_runs_are_decoded_whole():
    text = "tél 01 23 45 67 89 merci " * 600  # each word of a number lies at some multiple of 512
    assert len(pii.sequences(text)) == 1
    got = pii.added_spans([text], [[]], pii.trained())[0]
    assert got == [(len(pii.BASE), *m.span()) for m in re.finditer("01 23 45 67 89", text)]


def test_pieces_of_viterbi_do_not_show(monkeypatch):
    field, g = pii.trained(), np.random.default_rng(2)
    vocabulary = "ssn 219-09-9998 born 12/05/1984 call (212) 555-0187 DE89 3704 0044 the 12".split()
    texts = [list(g.choice(vocabulary, n)) for n in (40, 1, 7, 8, 9, 25, 16)]
    monkeypatch.setattr(pii, "PIECE", 100)
    whole = field.decode(texts)
    monkeypatch.setattr(pii, "PIECE", 8)
    assert all((a == b).all() for a, b in zip(whole, field.decode(texts), strict=True))


def test_personal_data_of_odd_texts(spark):
    got = pii.find_personal_data(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(got) == len(ODD) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


SECRETS = [
    (r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32), (r"gh[pousr]_[A-Za-z0-9]+", 0, 40), (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    (r"AIza[0-9A-Za-z_-]+", 0, 39), (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30), (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
PARTS = ["token", "Pass", "word", "passwd", "=", ":", " ", '"', "AKIA", "ABCD1234", "deadbeef" * 4, "0f", "é", "API_KEY", "-", "eyJ", "eyJab", ".eyJ", ".ccc", "-----BEGIN ", "PRIVATE KEY", "-----", "ghp_", "x" * 36, "xoxb-", "AIza", "\n", "abcdefgh", "ſecret"]


def plain_secrets(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(SECRETS) for m in re.finditer(p, text) if len(m[g]) >= n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25), min_size=1, max_size=4))
def test_secrets_against_plain_patterns(texts):
    texts = ["".join(x) for x in texts]
    got = secret_scans.spans(pa.array([*texts, None]))
    assert [got.get(i, []) for i in range(len(texts))] == [plain_secrets(t) for t in texts] and len(texts) not in got


def test_secrets_at_and_beyond_lanes(monkeypatch):
    text = ("x, token = abcdefgh1234 " + "0" * 40 + "\n-----BEGIN " + "A" * 60 + " PRIVATE KEY----- é ") * 300
    texts = [text, "y" * 5000 + text, "", "f" * 9000, text[7:]] * 8
    want = [plain_secrets(t) for t in texts]
    for lane, few in ((2048, 24), (64, 1), (64, 10**6)):
        monkeypatch.setattr(secret_scans, "LANE", lane)
        monkeypatch.setattr(secret_scans, "FEW", few)
        got = secret_scans.spans(pa.array(texts))
        assert [got.get(i, []) for i in range(len(texts))] == want


def test_machine_of_other_patterns_and_refused_ones():
    patterns = ["ab+", "a(x|y)*z", "[0-9]{3}"]
    rules = [("", p, "whole", 0, True) for p in patterns]
    texts = ["abbc ab", "axyxz 12 1234567", "az123", "", "aab", "zzabczz 999 aaz"]
    got = secret_scans.spans(pa.array(texts), secret_scans.combined(patterns[:2]), rules[:2])
    assert [got.get(i, []) for i in range(len(texts))] == [sorted((m.start(), k, m.end()) for k, p in enumerate(patterns[:2]) for m in re.finditer(p, t)) for t in texts]
    for refused in ("a(bc)?", "abc|b", "[0-9]"):
        with pytest.raises(ValueError):
            secret_scans.combined([refused])


def test_secrets_of_odd_texts(spark):
    got = secret_scans.scan_secrets(spark.createDataFrame([*ODD, (9, 'token: "abcdefgh12"')], DOCS)).collect()
    assert len(got) == len(ODD) + 1 and [r.n_assign for r in got if r.doc_id == 9] == [1]


def test_toxicity_learns_without_held_out_rows(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = rows(toxicity.score_toxicity(docs, model))
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(got[d].predicted, t) for d, t in truth.items() if got[d].held_out and d in got]
    toxic = [p for p, t in held if t]
    clean = [p for p, t in held if not t]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.05 * len(clean)  # some labels are noise
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.learn(docs, flipped).words == model.words


def test_machines_match_clauses():
    model = toxicity.Model({b"zork": 2.0}, {})
    weigh = lambda text: float(model.weigh(pa.array([text]))[0])
    plain, aimed, negated, reported = weigh("a zork"), weigh("you zork"), weigh("not a zork"), weigh("they said. she said zork")
    assert aimed == weigh("zork like you") == 2 * plain > reported > negated > 0 and weigh("not. a zork") == plain
    assert weigh("kill the process") == weigh("i will kill time. you") == 0 < weigh("I will kill you") == weigh("you i will kill")
    assert model.score(model.weigh(pa.array(["kill the process", "what a stupid idea"]))).max() < toxicity.THRESHOLD < model.score(model.weigh(pa.array(["I'll kill you, you idiot"]))).max()


KINDS = {"zork": ("insult", 2.0), "idiot": ("insult", toxicity.SEED_WEIGHT), "kill": ("threat", toxicity.SEED_WEIGHT), "you": ("target", 0), "not": ("negation", 0), "said": ("report", 0)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*KINDS, "Zork", "word", "été", ".", "!", "\n", ",", "zorks"]), max_size=30))
def test_clauses_against_brute_force(parts):
    text, want = " ".join(parts), 0.0
    for clause in re.split(r"[.!?;\n]", text):
        kinds = [KINDS.get(w.lower(), ("other", 0)) for w in re.findall(r"[^\W_]+", clause)]
        for i, (kind, weight) in enumerate(kinds):
            around, before = {k for k, _ in kinds[:i] + kinds[i + 1 :]}, {k for k, _ in kinds[:i]}
            aimed = "target" in around
            if kind == "insult" or (kind == "threat" and aimed):
                want += weight * (1 if aimed else 0.5) * (0.25 if "negation" in before else 1) * (0.5 if "report" in before else 1)
    got = toxicity.Model({b"zork": 2.0}, {}).weigh(pa.array(["", text, None]))
    assert got[0] == got[2] == 0 and abs(got[1] - want) < 1e-9


def test_long_words_are_learned_whole(spark):
    long = "q" * 60
    docs = spark.createDataFrame([(i, f"{'a ' + long + 'x' if i % 2 else 'some ' + long + 'y'} text {i}") for i in range(300)] + [(1, "zz " * 3), (1, None)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert (long + "x").encode() in model.words and not any(w.endswith(b"y") for w in model.words)


def test_toxicity_of_odd_texts(spark):
    model = toxicity.Model({}, {})
    got = toxicity.score_toxicity(spark.createDataFrame(ODD, DOCS), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    wide = spark.createDataFrame([(1, "fine", "en", 3.0)], "doc_id bigint, text string, held_out string, score double")
    assert toxicity.reject_toxic(wide, model).columns == wide.columns
    assert json.dumps(toxicity.learn(spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).words) == "{}"
