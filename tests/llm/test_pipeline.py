"""The pipeline against plain Python of its stages, and the queries against their SQL."""

import math
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from foliospark.llm import decontam, licenses, mixing, neardup, pii, queries, secret_scans, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, component_id string, rate string"


def corpus():
    """Documents with nulls, repeated ids and rows, copies, near copies, leaks, insults, odd texts, and columns whose names
    operators use themselves."""
    g = np.random.default_rng(12)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(g.choice(words, n))
    base, leak = some(80), some(30)
    texts = [(i, some(int(g.integers(5, 90)))) for i in range(120)]
    texts += [(200 + i, base.replace(f"w{i} ", "zz ")) for i in range(8)] + [(300, base), (300, base), (299, base), (None, base), (301, None), (302, ""), (None, None), (303, "a"), (303, "a")]
    texts += [(400 + i, f"{some(20)} {leak[: 60 + 10 * i]} {some(5)}") for i in range(6)]
    texts += [(500 + i, f"{some(12)} {x} {some(12)}") for i, x in enumerate(["you idiot", "kill you", "an idiot.", "not a stupid zork", "zork zork zork you", "UPPER CASE ### $$$ %%%"] * 4)]
    texts += [(600, "x" * 200_000), (601, "é ü " * 3000), (7, some(40)), (7, some(41))]
    docs = [(d, t, "en", "web", None if t is None else len(t), "s", "c", "r") for d, t in texts]
    labels = [(d, int(g.integers(2)), int(d is not None and 500 <= d < 600 and (d - 500) % 6 in (0, 4))) for d in sorted({d for d, _ in texts if d is not None})] + [(None, 1, 1), (9999, 1, 0), (500, 1, None)]
    return docs, labels, [(1, leak), (2, "w1 w2"), (3, None), (4, "")]


def plain_score(model, text):
    kinds = {w: k for k, x in toxicity.SEEDS.items() for w in x.split()}
    weight = 0.0
    for clause in re.split(r"[.!?;\n]", text or ""):
        seen = []
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(clause)):
            k, b = kinds.get(w), w.encode()
            if b in model.words and k in (None, toxicity.INSULT, toxicity.THREAT):
                seen.append((toxicity.INSULT if k is None else k, model.words[b]))
            elif k is not None:
                seen.append((k, toxicity.SEED_WEIGHT))
            else:
                seen.append((toxicity.INSULT, next((model.stems[b[:n]] for n in (7, 6, 5, 4) if len(b) > n and b[:n] in model.stems), 0.0)))
        for i, (k, x) in enumerate(seen):
            before = {y for y, _ in seen[:i]}
            aimed = toxicity.TARGET in {y for y, _ in seen}
            if k == toxicity.INSULT or k == toxicity.THREAT and aimed:
                weight += x * (1 if aimed else 0.5) * (0.25 if toxicity.NEGATION in before else 1) * (0.5 if toxicity.REPORT in before else 1)
    return 1 / (1 + math.exp(-(model.a + model.b * math.log1p(weight))))


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_chance(d, t):
    h = xxhash.xxh64(b"mix", seed=42).intdigest()
    h = h if d is None else xxhash.xxh64(struct.pack("<q", d), seed=h).intdigest()
    h = h if t is None else xxhash.xxh64(t.encode(), seed=h).intdigest()
    return (h >> 11) / 2**53


def plain_shard(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def plain_pipeline(docs, labels, bench, model):
    from test_corpus import brute_features, brute_hits

    docs = [r for r in docs if plain_score(model, r[1]) < toxicity.THRESHOLD]
    sets = []
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                was = group[i]
                group = [group[j] if x == was else x for x in group]
    chosen, kept = {}, []
    for i, r in enumerate(docs):
        if not sets[i]:
            kept.append(r)
            continue
        th = xxhash.xxh64(r[1].encode(), seed=42).intdigest()
        rank = (r[0] is None, r[0] or 0, th - (1 << 64 if th >> 63 else 0))
        chosen[group[i]] = min(chosen.get(group[i], (rank, r)), (rank, r), key=lambda x: x[0])
    docs = kept + [r for _, r in chosen.values()]
    docs = [r for r, h in zip(docs, brute_hits([r[:2] for r in docs], bench), strict=True) if not h[-1]]
    f, tokens = (np.array(x) for x in zip(*((f, n) for f, n in (brute_features(r[1]) for r in docs)), strict=True))
    at = [(i, q) for i, r in enumerate(docs) for q in {y for d, y, _ in labels if d is not None and d == r[0]}]
    s = np.zeros((len(docs), 2))
    for k in (0, 1):
        own = f[[i for i, q in at if q == k]]
        mu, v = own.mean(0), own.var(0) + 1e-3
        s[:, k] = math.log(len(own) / len(at)) - mixing.SHARPNESS * 0.5 * (np.log(v).sum() + ((f - mu) ** 2 / v).sum(1))
    p = np.exp(s - s.max(1)[:, None])
    p /= p.sum(1)[:, None]
    share = np.array([mixing.TARGETS[f"quality={k}"] for k in (0, 1)])
    share /= share.sum()
    whole = (tokens[:, None] * p).sum(0)
    budget = (whole / share).min() / whole.sum()
    wanted, rate, best, since = budget * whole.sum() * share, np.full(len(docs), budget), math.inf, 0
    for n in range(mixing.ROUNDS + 1):
        now = ((rate * tokens)[:, None] * p).sum(0)
        gap = (abs(now - wanted) / wanted).max()
        best, since = (gap, 0) if gap < best * 0.999 else (best, since + 1)
        if gap <= mixing.CLOSE or n == mixing.ROUNDS or since >= mixing.STALLED:
            break
        rate = np.maximum(0, rate - p @ ((now - wanted) / whole))
    copies = [math.floor(x + plain_chance(*r[:2])) for x, r in zip(rate, docs, strict=True)]
    return Counter((*r[:5], *r[6:], plain_shard(r[0] or 0, sharding.SHARDS)) for r, n in zip(docs, copies, strict=True) for _ in range(n))


def test_pipeline_against_plain_python(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.learn(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert [c for c in got.columns if c != "shard"] == [c.split()[0] for c in SCHEMA.split(", ") if c != "shard string"]
    want = plain_pipeline(docs, labels, bench, model)
    assert Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars", "component_id", "rate", "shard")) for r in got.collect()) == want
    assert 60 < sum(want.values()) < len(docs)


def test_pipeline_of_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Each operator on a table: rows (doc_id, ...) come out for each that goes in.
ROW_BY_ROW = {
    "licences": licenses.scan_licenses, "repeats": suffix_dedup.deduplicate, "leaks": lambda d: decontam.contamination(d, d.selectExpr("doc_id as item_id", "text").limit(0)), "mixing": lambda d: mixing.mix(d, d.selectExpr("doc_id", "1 as quality", "0 as toxic").limit(0)),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Model({}, {})), "personal data": pii.find_personal_data, "secrets": secret_scans.scan_secrets, "near duplicates": neardup.near_duplicates, "shards": sharding.layout,
}


@pytest.mark.parametrize("name", sorted(ROW_BY_ROW))
def test_odd_tables(spark, name):
    """Nulls, empty and very long texts, ties and repeated rows; extra columns of names that operators use; no rows."""
    long = "word " * 400_000
    rows = [(1, None, 1), (None, "a b c d e f", 2), (None, "a b c d e f", 2), (2, "", 3), (2, "", 3), (3, long, 4), (3, "\x00 İ ﬁ 😀", 5), (3, "a b c d e f", 6)]
    wide = ", ".join(f"{c} int" for c in ("n_words", "spans", "score", "rate", "th", "shard", "slot", "n", "pos", "set_key", "bands", "_words", "labels", "n_hit", "held_out"))
    docs = spark.createDataFrame([(d, t, *[x] * 15) for d, t, x in rows], f"doc_id bigint, text string, {wide}")
    got = ROW_BY_ROW[name](docs)
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(d for d, _, _ in rows)
    assert ROW_BY_ROW[name](docs.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = stage(spark, now, tables)
        after = {r.doc_id for r in now.select("doc_id").collect()}
        assert after <= before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    out = now.collect()
    assert out and all(0 <= r.shard < 24 for r in out)
    assert sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, tables).collect()) == sorted((r.doc_id, r.shard) for r in out)


def test_stages_leave_nothing_behind(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    once = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, tables)
    assert neardup.near_duplicates(once).where("not kept").isEmpty()
    clean = dict(corpus_pipeline.STAGES)["decontamination"](spark, once, tables)
    assert decontam.contamination(clean, bench).where("contaminated").isEmpty()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, tables).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got[columns].itertuples(index=False, name=None))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))
