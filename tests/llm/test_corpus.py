"""Operators over a whole corpus, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import decontam, fingerprints, mixing, neardup, sharding, suffix_dedup
from foliospark.llm.common import components

DOCS = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# Repeated strings.


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 for x in b)))
def test_suffix_array_and_prefixes(text):
    sa = suffix_dedup.suffix_array(text)
    assert sa == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=25).map(lambda b: bytes(x % 2 for x in b)), max_size=4), st.integers(2, 6))
def test_repeats_by_suffix_array(texts, length):
    for got, want in zip(suffix_dedup.repeated(texts, length), brute_repeats(texts, length), strict=True):
        assert (got == want).all()


def brute_rows(rows, length=400):
    data = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), t, m in zip(rows, data, brute_repeats(data, length), strict=True):
        want[d, len(t), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()] += 1
    return want


def removed_rows(spark, rows):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, DOCS)).collect())


@pytest.mark.parametrize("group", [4096, 3])
def test_repeats_by_anchors(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    g = np.random.default_rng(3)
    some = lambda n: bytes(g.integers(97, 123, n, np.uint8))
    passage = some(900)
    texts = [some(300) + passage[a : a + 500] + some(100) for a in (0, 40, 90, 90, 300)]
    texts += [passage, passage, b"", b"short", b"z" * 1500, some(350) * 3]
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(99, None), (None, passage.decode()), (0, texts[0].decode())]
    assert removed_rows(spark, rows) == brute_rows(rows)


@pytest.mark.parametrize("group", [4096, 7])
def test_repeats_of_edited_copies_and_of_crossed_parts(spark, monkeypatch, group):
    """Copies with changes at any place, and texts of one beginning and one end out of a few, so that neighbours in the order
    of either side differ on the other."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    g = np.random.default_rng(8)
    some = lambda n: bytes(g.integers(97, 123, n, np.uint8))
    base, heads, middle, tails = some(1000), [some(210) for _ in range(4)], some(60), [some(210) for _ in range(4)]
    rows = []
    for i in range(40):
        t = bytearray(base)
        for at in g.integers(0, 1000, int(g.integers(0, 5))):
            t[at] = 48 + int(g.integers(10))
        rows.append((i, t.decode()))
    for i in range(40):
        rows.append((100 + i, (some(int(g.integers(1, 9))) + heads[g.integers(4)] + middle + tails[g.integers(4)] + some(int(g.integers(1, 9)))).decode()))
    assert removed_rows(spark, rows) == brute_rows(rows)


def test_repeats_in_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    g = np.random.default_rng(4)
    t = bytes(g.integers(97, 123, 5000, np.uint8))
    rows = [(1, t.decode()), (2, t[700:1500].decode() + "!" + t[2900:3350].decode()), (3, t[:399].decode())]
    assert removed_rows(spark, rows) == brute_rows(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 3), st.integers(0, 999)), min_size=1, max_size=12))
def test_surroundings_against_brute_force(cuts):
    base = bytes(np.random.default_rng(6).integers(97, 99, 800, np.uint8))
    length, reach = 400, 400 - suffix_dedup.GRAM
    left, right = [], []
    for cut_left, cut_right, changes, seed in cuts:
        x = bytearray(base)
        for at in np.random.default_rng(seed).integers(0, 800, changes):
            x[at] = 122
        x[368:400] = base[368:400]
        left.append(bytes(x[cut_left * 9 : 368])[::-1])
        right.append(bytes(x[368 : 768 - cut_right * 9]))
    got = suffix_dedup._repeated_starts(left, right, length)
    strings = [{p: (a[::-1] + b)[p - reach + len(a) : p - reach + len(a) + length] for p in range(reach - len(a), reach + 1) if p + length <= reach + len(b)} for a, b in zip(left, right, strict=True)]
    seen = Counter((p, x) for own in strings for p, x in own.items())
    assert [{p for p, x in own.items() if seen[p, x] > 1} for own in strings] == [set(np.nonzero(row)[0]) for row in got]


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


# Benchmark leaks.


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def brute_hits(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, names in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= names
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 40])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    g = np.random.default_rng(5)
    text = lambda n: " ".join(g.choice(["a", "b", "C", "dé", "e"], n))
    items = [(i, text(int(n))) for i, n in enumerate([3, 5, 12, 15, 30, 4])] + [(7, None), (8, "!!"), (2, "a b"), (9, "A B")]
    docs = [(i, text(int(n))) for i, n in enumerate(g.integers(0, 60, 25))] + [(30, items[4][1] + " x " + items[4][1]), (31, None), (32, ""), (33, "x" * 100_000), (None, items[3][1]), (30, "a b")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contamination(spark.createDataFrame(docs, DOCS), bench).drop(*decontam._LONGEST).collect()
    want = brute_hits(docs, items)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    clean = decontam.clean(spark.createDataFrame([(*d, "q") for d in docs], DOCS + ", n_hit string"), bench).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in clean))) == sorted(repr(d) for d, w in zip(docs, want, strict=True) if not w[-1])


def brute_longest(docs, items, shortest):
    out = set()
    for i, t in items:
        w = words(t)
        for s in range(len(w)):
            found = []
            for d, x in docs:
                v = words(x)
                for p in range(len(v)):
                    n = 0
                    while s + n < len(w) and p + n < len(v) and w[s + n] == v[p + n]:
                        n += 1
                    found.append((n, d, p))
            most = max(found, default=(0,))[0]
            out |= {(str(i), s, most, d, p) for n, d, p in found if n == most >= shortest}
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_longest_matches_and_their_places(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    g = np.random.default_rng(9)
    text = lambda n: " ".join(g.choice(["a", "b", "c"], n))
    items = [(i, text(70)) for i in range(4)]
    docs = [(i, text(90) + (" " + items[i % 4][1] if i % 3 == 0 else "")) for i in range(9)] + [(20, items[0][1]), (21, None), (22, "zz")]
    got = decontam.longest_matches(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), 6).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_longest(docs, items, 6)
    rows = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert [(r.longest, r.longest_item, r.longest_item_word, r.longest_word) for r in rows if r.doc_id == 20] == [(70, "0", 0, 0)]


def test_decontamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven", 9), (2, "clean", 8)], "doc_id bigint, text string, n_hit int")
    bench = spark.createDataFrame([(5, "zero two three four five six nine")], "item_id bigint, text string")
    assert decontam.clean(docs, bench).columns == docs.columns and decontam.clean(docs, bench).count() == 2
    assert decontam.clean(docs, bench.limit(0)).count() == 2 and decontam.longest_matches(docs, bench.limit(0)).count() == 0
    assert [r.n_words for r in decontam.contamination(docs, bench.limit(0)).collect()] == [7, 1] and decontam.contamination(docs.limit(0), bench).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=12), max_size=6))
def test_suffix_array_of_words(stretches):
    symbols = np.array([x for s in stretches for x in [*s, 0]] + [0], np.int64)
    tail = lambda i: next(tuple(symbols[i:j]) for j in range(i, len(symbols)) if symbols[j] == 0)
    sa = decontam.suffix_array(symbols).tolist()
    assert sorted(sa) == np.nonzero(symbols)[0].tolist() and [tail(i) for i in sa] == sorted(map(tail, sa))


# Near duplicates.


def brute_components(docs, k=4, percent=80):
    sets = []
    for _, t in docs:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(s), least[top(i)], d == least[top(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def near_documents():
    g = np.random.default_rng(11)
    base = [list(g.choice([f"w{i}" for i in range(400)], 80)) for _ in range(3)]
    docs = [(100 + i, t) for i, t in enumerate(["", None, "a", "A", "a b", "a b c d", "a b c d e f", "a b c d e f g"])]
    for i in range(90):
        w = list(base[i % 3])
        for at in g.integers(0, 80, int(g.integers(0, 5))):
            w[at] = f"x{g.integers(1000)}"
        docs.append((1000 + i, " ".join(w)))
    return docs


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    docs = near_documents()
    got = neardup.near_duplicates(spark.createDataFrame(docs, DOCS), shingle=4).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(docs))


def test_near_duplicates_of_odd_tables(spark):
    wide = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "a b c d e", "z"), (2, None, "q")], "doc_id bigint, text string, component_id string")
    kept = neardup.deduplicated(wide)
    assert kept.columns == wide.columns and sorted(r.component_id for r in kept.collect()) == ["q", "x", "y", "z"]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def repeated_documents():
    """Rows (doc_id, text, at) with repeated and null doc_ids; T and its near copy V, and U, W and X, which are unlike."""
    t, u, w, x = (" ".join(f"{c}{i}" for i in range(60)) for c in "tuwx")
    v = t + " end"
    rows = [(3, t), (7, t), (7, u), (7, v), (None, v), (None, t), (None, w), (None, w), (None, w + " end"), (9, x), (9, x), (9, x), (9, x + " end"), (5, ""), (5, ""), (None, None), (None, " "), (7, None)]
    return [(d, text, i) for i, (d, text) in enumerate(rows)]


def test_one_row_of_each_component_stays(spark):
    rows = repeated_documents()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, th int")
    kept = neardup.one_each(docs)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and set(got) <= set(rows) and len(got) == len(set(got))
    group = lambda text: (text or "").strip()[:1]
    assert sorted((group(t), d is None, d or 0) for d, t, _ in got if group(t)) == [("t", False, 3), ("u", False, 7), ("w", True, 0), ("x", False, 9)]
    assert [r for r in sorted(got, key=lambda r: r[2]) if not group(r[1])] == rows[13:]
    again = neardup.one_each(docs.repartition(7)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, got))


def test_texts_that_share_a_doc_id_are_decided_one_by_one(spark):
    rows = repeated_documents()[:3]
    for keep in (neardup.deduplicated, neardup.one_each):
        got = keep(spark.createDataFrame(rows, "doc_id bigint, text string, at int")).collect()
        assert sorted(r["at"] for r in got) == [0, 2]
    stage = dict(pytest.importorskip("corpus_pipeline").STAGES)["near duplicates"]
    got = stage(spark, spark.createDataFrame([(None, "a b c d e", 0), (None, "a b c d e", 1)], "doc_id bigint, text string, at int"), "")
    assert got.count() == 1


def test_sketches_estimate_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    mix = lambda x: np.sort(neardup._mixed(x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1))
    with np.errstate(over="ignore"):
        s = neardup.registers([mix(a), mix(b), np.empty(0, np.uint64)])
    est, used = neardup.estimate(s[0], s[1])
    assert abs(est - 800 / 1200) < 0.2 and used == neardup.REGISTERS and (s[2] == 0xFFFF).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 60), (7, 7)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert all(got.get(i, i) == 0 for i in range(31)) and got[50] == got[60] == 40


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_links(spark, seed):
    g = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in g.integers(0, 60, (int(g.integers(1, 60)), 2))]
    root = list(range(60))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    got = dict(map(tuple, components(spark, spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {i: r for i, r in enumerate(root) if i != r}
    assert components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Fingerprints.


def brute_sketch(spark, text):
    """The 64 least of the hashes of five words in a row, one after the other."""
    w = text.lower().split()
    runs = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    rows = spark.createDataFrame([(list(r),) for r in runs] or [(["none"],)], "w array<string>").select(F.shiftrightunsigned(F.xxhash64("w"), 16)).collect()
    return sorted(r[0] for r in rows)[:64] if runs else []


def brute_likeness(a, b):
    u = sorted({*a, *b})[:64]
    return len({*u} & {*a} & {*b}) / len(u) if u else 1.0


def test_fingerprints_against_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(150))
    docs = [(1, "a b c d e f"), (2, "é" * 10), (3, None), (4, ""), (5, "a b c d e f"), (6, "one two three four five six seven eight"), (7, many), (8, many + " end"), (None, "last one")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(docs, DOCS)).collect()}
    order = sorted(docs, key=lambda d: -1 if d[0] is None else d[0], reverse=True)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, after = (brute_sketch(spark, x) for x in (t, edited, nxt))
        assert got[d].fingerprint == "".join(f"{x:012x}" for x in own) and got[d].edited_fingerprint == "".join(f"{x:012x}" for x in other)
        assert abs(got[d].near_edited - brute_likeness(own, other)) < 1e-12 and abs(got[d].near_next - brute_likeness(own, after)) < 1e-12
    assert got[1].fingerprint == got[5].fingerprint and got[6].n_shingles == 4


@pytest.mark.parametrize("size", [3, 1000])
def test_next_documents_over_many_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "ROWS_A_RANGE", size)
    docs = [(i * 7 % 101, f"t{i * 7 % 101}") for i in range(101)] + [(50, "t50")] * 60 + [(60, f"u{i}") for i in range(40)] + [(None, "n"), (None, "n"), (2**62, "big"), (2**62 + 1, "bigger")]
    got = fingerprints.with_next(spark.createDataFrame(docs, DOCS).repartition(3), ["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(docs) == Counter((r.next_doc_id, r.next_text) for r in got)
    place = lambda d: -1 if d is None else d
    steps = sorted({d for d, _ in docs}, key=place, reverse=True)
    after = dict(zip(steps, steps[1:] + steps[:1], strict=True))
    for d in steps:
        out = Counter(r.next_doc_id for r in got if r.doc_id == d)
        n = sum(x == d for x, _ in docs)
        assert out == Counter({d: n - 1, after[d]: 1} if n > 1 else {after[d]: 1})


def test_sketch_estimates_merge_and_contain(spark):
    t = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 1000), (200, 1200))]
    x = spark.createDataFrame([tuple(t)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = x.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(fingerprints.merge(F.col("a"), F.col("b"))).alias("n")).first()
    assert abs(r.j - 0.665) < 0.25 and abs(r.c - 0.8) < 0.3 and 700 < r.n < 1800


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(None, "abc def")], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    wide = spark.createDataFrame([(7, "a", "x"), (7, "b", "y"), (7, "b", "y")], "doc_id bigint, text string, fingerprint string")
    assert fingerprints.fingerprints(wide).count() == 3


# Mixing and shards.


def test_mixing_meets_its_targets(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    got = mixing.mix(docs, labels).collect()
    share = sum(r.rate * r.n_tokens * r.posteriors[1] for r in got) / sum(r.rate * r.n_tokens for r in got)
    assert abs(share - mixing.TARGETS["quality=1"]) < 0.02 and min(r.rate for r in got) >= 0
    assert all(abs(sum(r.posteriors) - 1) < 1e-9 and abs(r.copies - r.rate) < 1 for r in got)
    assert mixing.mixed(docs, labels).columns == docs.columns


def test_mixing_follows_other_targets_like_numpy(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    targets = {"quality=1": 0.5, "quality=0": 0.5}
    got = mixing.mix(docs, labels, targets, budget=0.5).collect()
    p, t = np.array([r.posteriors for r in got]), np.array([r.n_tokens for r in got], float)
    rate, whole = np.full(len(got), 0.5), (t[:, None] * p).sum(0)
    want = 0.5 * whole.sum() * np.array([0.5, 0.5])
    for _ in range(mixing.ROUNDS):
        now = ((rate * t)[:, None] * p).sum(0)
        if (abs(now - want) <= mixing.CLOSE * want).all():
            break
        rate = np.maximum(0, rate - p @ ((now - want) / whole))
    assert np.allclose(rate, [r.rate for r in got], atol=1e-6)


def brute_features(t):
    t = t or ""
    words, n = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w], len(t)
    share = lambda chars: sum(c in chars for c in t) / max(n, 1)
    return [np.log1p(n), share(mixing._MARKS) ** 0.5, share(mixing._UPPER) ** 0.5, ((len(t.encode()) - n) / max(n, 1)) ** 0.5, len(set(words)) / max(len(words), 1), np.log1p(n / max(len(words), 1))], len(words)


def test_posteriors_against_numpy(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: brute_features(r.text) for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    groups = [np.array([rows[d][0] for d, q in quality.items() if q == k]) for k in (0, 1)]
    f = np.array([x for x, _ in rows.values()])
    s = np.zeros((len(f), 2))
    for k, g in enumerate(groups):
        mu, v = g.mean(0), g.var(0) + 1e-3
        s[:, k] = np.log(len(g) / len(quality)) - mixing.SHARPNESS * 0.5 * (np.log(v).sum() + ((f - mu) ** 2 / v).sum(1))
    p = np.exp(s - s.max(1)[:, None])
    p /= p.sum(1)[:, None]
    got = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    assert np.allclose([got[d].posteriors for d in rows], p, atol=1e-9) and [got[d].n_tokens for d in rows] == [n for _, n in rows.values()]
    assert [got[d].domain for d in rows] == [f"quality={k}" for k in p.argmax(1)]


def test_targets_that_cannot_be_met_are_told(spark, caplog):
    docs = spark.createDataFrame([(i, "same words here") for i in range(20)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    plan = mixing.fit(mixing._slim(docs), labels)
    assert plan.gap > mixing.CLOSE and len(plan.history) < mixing.ROUNDS and "missed" in caplog.text


def test_mixing_of_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z")], "doc_id bigint, text string, rate string")
    assert mixing.mixed(docs, labels).count() == 3 and mixing.mixed(docs.limit(0), labels).count() == 0


@given(st.lists(st.integers(0, 2**63 - 1), min_size=1, max_size=50), st.integers(1, 60))
def test_one_more_shard_takes_rows_only_into_itself(keys, n):
    a, b = (sharding.jump(np.array(keys, np.uint64), k) for k in (n, n + 1))
    assert ((a == b) | (b == n)).all() and (a < n).all() and (a >= 0).all()


def test_layout(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", 20)
    docs = [(i, "é" * (i % 5)) for i in range(200)] + [(7, None), (None, "x")] + [(5, "same")] * 60
    got = sharding.layout(spark.createDataFrame(docs, DOCS)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in docs)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.layout(spark.createDataFrame([], DOCS)).count() == 0
