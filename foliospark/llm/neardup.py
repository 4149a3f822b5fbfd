"""Near duplicates: HyperMinHash sketches banded to find candidates, links confirmed on full shingle sets, and
connected components of the links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Written, components, flat, scan, table
from .decontam import _mixed, hashed, rolling

#: Registers of a sketch (leading zeros and 10 mantissa bits in 16), and registers of a band. Texts as alike as 0.8
#: miss all 32 bands with chance (1 - 0.8^4)^32 = 5e-8.
REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
SHINGLE, PERCENT = 5, 80
#: Turns in which buckets' leaders are compared with their nodes, and a node's best leaders that are confirmed. After that,
#: buckets of up to SMALL nodes are paired, larger ones compared block by block of about BLOCK.
TURNS, STARS, SMALL, BLOCK = 2, 3, 16, 1024
#: Least hashes of a set that decide within a block.
LOWEST = 512
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.frombuffer(LOWER, np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word that white space parts, lower-cased, and where each text's words start (with the end)."""
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.nonzero(word & (~before | cut[:-1]))[0]
    ends = np.nonzero(word & (~after | cut[1:]))[0] + 1
    return hashed(_LOWER[data], starts, ends - starts), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of shingle words; of all words if there are fewer."""
    h, first = word_hashes(*flat(column))
    runs = rolling(h, shingle)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        yield np.unique(runs[a : b - shingle + 1]) if n >= shingle else rolling(h[a:b], int(n)) + np.uint64(n) if n else np.empty(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers: of the hashes that fall in a bucket the least, as leading zeros and the bits that follow."""
    least = np.full((len(sets), REGISTERS), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            if len(s):
                v = _mixed(s * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(11)
                order = np.argsort(v)[::-1]
                least[i, (s[order] & np.uint64(REGISTERS - 1)).astype(np.int64)] = v[order]
    empty = least == np.uint64(0xFFFFFFFFFFFFFFFF)
    v = np.where(empty, np.uint64(1), np.maximum(least, np.uint64(1)))
    zeros = (53 - np.frexp(v.astype(np.float64))[1]).astype(np.uint64)
    bits = (v << zeros) >> np.uint64(52 - MANTISSA) & np.uint64((1 << MANTISSA) - 1)
    return np.where(empty, np.uint16(0xFFFF), ((zeros << np.uint64(MANTISSA)) | bits).astype(np.uint16))


#: Chance that two registers with different least hashes look alike.
COLLISION = 2.0**-MANTISSA / 3


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of the sketches in each row, without chance collisions, and registers in use."""
    used = (a != 0xFFFF) | (b != 0xFFFF)
    n = used.sum(-1)
    same = ((a == b) & used).sum(-1) / np.maximum(n, 1)
    return np.maximum(0, (same - COLLISION) / (1 - COLLISION)), n


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair may reach percent: by its sizes, and unless its estimate lies six deviations lower."""
    s = percent / 100
    est, n = estimate(a, b)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (est >= s - 6 * np.sqrt(s * (1 - s) / np.maximum(n, 1)) - 0.01)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, set_key (of the whole set; null for an empty one) and bands of each row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(b.column("text"), shingle))
        bands = registers(sets).view(np.int64)
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "th": b.column("th"), "n_shingles": np.array([len(s) for s in sets], np.int64), "set_key": pa.array(keys, pa.binary()), "bands": listed})

    return scan(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), run, "doc_id bigint, th bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _sketches(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(len(x), REGISTERS)


class Links:
    """Confirms pairs of set keys on full sets; keeps the sets that it has read once."""

    def __init__(self, docs: DataFrame, reps: DataFrame, written: Written, shingle: int, percent: int) -> None:
        self.docs, self.reps, self.written, self.shingle, self.percent = docs, reps, written, shingle, percent
        self.sets: DataFrame | None = None

    def _read(self, needed: DataFrame) -> None:
        shingle = self.shingle
        if self.sets is not None:
            needed = needed.join(self.sets.select("set_key"), "set_key", "left_anti")
        rows = self.docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
        wanted = needed.join(self.reps.select("set_key", "doc_id", "th"), "set_key").select(F.col("doc_id").alias("d"), F.col("th").alias("t"))
        rows = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.d) & (rows.th == wanted.t), "left_semi").select("text")

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s.tobytes() for s in shingle_sets(b.column("text"), shingle)]
            return pa.RecordBatch.from_pydict({"set_key": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "hashes": sets})

        got = self.written.put(scan(rows, run, "set_key binary, hashes binary").dropDuplicates(["set_key"]))
        known, self.sets = self.sets, got if self.sets is None else self.written.put(self.sets.unionByName(got))
        if known is not None:
            self.written.drop(known)
            self.written.drop(got)

    def lowest(self, needed: DataFrame) -> DataFrame:
        """(set_key, low): the LOWEST least hashes of each set, 32 bits of each, sorted."""
        self._read(needed)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            low = [np.sort((np.frombuffer(x, np.uint64)[:LOWEST] >> np.uint64(31)).astype(np.uint32)).tobytes() for x in b.column("hashes").to_pylist()]
            return pa.RecordBatch.from_pydict({"set_key": b.column("set_key"), "low": pa.array(low, pa.binary())})

        return scan(self.sets, run, "set_key binary, low binary")

    def confirm(self, pairs: DataFrame, best: int | None = None) -> DataFrame:
        """The pairs (a, b) of which 100 * intersection >= percent * union; with best, of those b's best by their sketches."""
        percent = self.percent
        r = self.reps.select("set_key", "n_shingles", "bands")
        wide = pairs.join(r.toDF("a", "n_a", "s_a"), "a").join(r.toDF("b", "n_b", "s_b"), "b")

        def sieve(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y = _sketches(b.column("s_a")), _sketches(b.column("s_b"))
            ok = likely(x, y, b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), percent)
            return b.select(["a", "b"]).append_column("est", pa.array(estimate(x, y)[0])).filter(pa.array(ok))

        left = scan(wide, sieve, "a binary, b binary, est double")
        if best is not None:
            top = F.slice(F.sort_array(F.collect_list(F.struct("est", "a")), False), 1, best)
            left = left.groupBy("b").agg(top.alias("top")).select(F.explode("top.a").alias("a"), "b")
        left = self.written.put(left.select("a", "b"))
        self._read(left.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())
        both = left.join(self.sets.toDF("a", "h_a"), "a").join(self.sets.toDF("b", "h_b"), "b")

        def compare(b: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for x, y in zip(b.column("h_a").to_pylist(), b.column("h_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * n >= percent * (len(x) + len(y) - n))
            return b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        out = self.written.put(scan(both, compare, "a binary, b binary"))
        self.written.drop(left)
        return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs (doc_id, text): n_shingles, component_id (the least doc_id that links reach), kept.

    Equal sets are one node, so copies make no pairs. Nodes that share a band are candidates. In the first turns each node
    is compared with the leaders of its buckets, and the best by their sketches are confirmed on full sets, so a group of
    near copies costs a few pairs a node. Buckets that still hold several components have all their likely pairs across
    components confirmed. No step gathers a bucket or a component in one task or on the driver.
    A null or empty text has no shingles, is linked with nothing and kept. A row without doc_id takes part; it is kept
    only if no row of its component has a doc_id. Rows with equal doc_id share a decision only if their sets are linked.
    """
    return decided(docs, shingle, percent).drop("th")


def labelled(docs: DataFrame, written: Written, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs, and a row of each set: set_key, doc_id and th of its first row, component."""
    docs = docs.select("doc_id", "text")
    sig = written.put(signatures(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("f")
    slim = sig.where("set_key is not null").groupBy("set_key").agg(first, F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands"))
    reps = written.put(slim.select("set_key", "f.doc_id", "f.th", "n_shingles", "bands"))
    bands = reps.select("set_key", F.posexplode("bands").alias("band", "value")).where("value <> -1")
    buckets = bands.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = base = written.put(bands.join(buckets, ["band", "value"]).select("band", "value", "n", "set_key", F.col("set_key").alias("component")))
    known = Links(docs, reps, written, shingle, percent)
    found = docs.sparkSession.createDataFrame([], "id binary, component binary")
    for turn in range(TURNS + 1):
        # Buckets whose nodes are all linked already have nothing to add.
        split = written.put(members.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "value"))
        members = members.join(split, ["band", "value"])
        if turn:
            members = written.put(members)
            written.drop(base)
            written.drop(split)
            base = members
            if members.isEmpty():
                break
        pairs = written.put((stars(members, turn) if turn < TURNS else across(members, reps, known, percent)).distinct())
        more, before = known.confirm(pairs, STARS if turn < TURNS else None), found
        found = written.put(merged(docs.sparkSession, found, more, written))
        for x in (pairs, more, *([before] if turn else [])):
            written.drop(x)
        if turn < TURNS:
            own = members.join(found, members.set_key == found.id, "left")
            members = own.select("band", "value", "n", "set_key", F.coalesce(found.component, "set_key").alias("component"))
    label = reps.join(found, reps.set_key == found.id, "left").select("set_key", "doc_id", "th", F.coalesce("component", "set_key").alias("component"))
    return sig, written.put(label)


def decided(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of near_duplicates, with the hash th of their texts."""
    written = Written(docs.sparkSession)
    sig, label = labelled(docs, written, shingle, percent)
    ids = written.put(label.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    final = written.put(label.join(ids, "component").select("set_key", "component_id"))
    written.keep(sig, final)
    out = sig.select("doc_id", "th", "n_shingles", "set_key").join(final, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "th", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def stars(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's leader, another one each turn, with the nodes of other components: a few pairs a node."""
    lead = members.groupBy("band", "value").agg(F.min(F.struct(F.xxhash64("set_key", "band", F.lit(turn)), "set_key", "component")).alias("p")).select("band", "value", F.col("p.set_key").alias("a"), F.col("p.component").alias("ca"))
    return members.join(lead, ["band", "value"]).where("component <> ca").select("a", F.col("set_key").alias("b"))


def merged(spark: SparkSession, found: DataFrame, more: DataFrame, written: Written) -> DataFrame:
    """found (id, component) with the links more: only components that more joins are worked on."""

    def name(x: DataFrame, k: str) -> DataFrame:
        return x.join(found.toDF("id", f"c{k}"), F.col(k) == F.col("id"), "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k)).drop("id")

    joined = components(spark, name(name(more, "a"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), written).toDF("was", "now")
    alone = joined.join(found.select(F.col("id").alias("was")), "was", "left_anti").select(F.col("was").alias("id"), F.col("was").alias("component"))
    return found.unionByName(alone).join(joined, F.col("component") == F.col("was"), "left").select("id", F.coalesce("now", "component").alias("component"))


def across(members: DataFrame, reps: DataFrame, known: Links, percent: int) -> DataFrame:
    """All pairs of different components within buckets that may be links. Small buckets are joined with themselves. In a
    large one the nodes outside its largest component meet all nodes, block by block of about BLOCK, each pair in the
    first band that it shares. Short hashes of sets up to LOWEST decide there; only pairs that they let pass leave a task."""
    few = members.where(F.col("n") <= SMALL).select("band", "value", "set_key", "component")
    pairs = few.toDF("band", "value", "a", "ca").join(few.toDF("band", "value", "b", "cb"), ["band", "value"]).where("a < b and ca <> cb").select("a", "b")
    large = members.where(F.col("n") > SMALL)
    sizes = known.written.put(large.groupBy("band", "value", "component").agg(F.count("*").alias("k")).groupBy("band", "value").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("all")))
    # What a node carries is put together once for each node, not once for each of its buckets.
    keys = large.select("set_key").distinct()
    nodes = known.written.put(known.lowest(keys).join(reps.select("set_key", "n_shingles", "bands"), "set_key"))
    own = large.join(sizes, ["band", "value"]).join(nodes, "set_key")
    minor = F.col("component") != F.col("top.component")
    block = lambda n: F.pmod(F.xxhash64("set_key"), F.greatest(F.ceil(n / BLOCK), F.lit(1))).cast("int")
    last = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int") - 1
    n_minor, n_all = F.col("all") - F.col("top.k"), F.col("all")
    columns = ["band", "value", "i", "j", "side", "set_key", "n_shingles", "bands", "low", "component"]
    left = own.where(minor).withColumn("i", block(n_minor)).withColumn("j", F.explode(F.sequence(F.lit(0), last(n_all)))).withColumn("side", F.lit(0)).select(columns)
    right = own.withColumn("j", block(n_all)).withColumn("i", F.explode(F.sequence(F.lit(0), last(n_minor)))).withColumn("side", F.lit(1)).select(columns)

    def run(t: pa.Table) -> pa.Table:
        keys, low = t.column("set_key").to_pylist(), [np.frombuffer(x, np.uint32) for x in t.column("low").to_pylist()]
        s = np.concatenate([_sketches(c) for c in t.column("bands").chunks])
        wide, band = s.view(np.int64), t.column("band")[0].as_py()
        n, side = t.column("n_shingles").to_numpy(), t.column("side").to_numpy()
        component = pd.factorize(pd.Series(t.column("component").to_pylist()))[0]
        y_all = np.nonzero(side == 1)[0]
        earlier = wide[:, :band].copy()
        earlier[earlier == -1] = 0  # empty registers aren't shared
        a, b = [], []
        for x in np.nonzero(side == 0)[0]:
            y = y_all[component[y_all] != component[x]]
            y = y[likely(s[x][None], s[y], n[x], n[y], percent)] if len(y) else y
            y = y[~((earlier[y] == earlier[x]) & (earlier[x] != 0)).any(1)] if len(y) else y  # seen in an earlier band
            if not len(y):
                continue
            whole = (n[y] <= LOWEST) & (n[x] <= LOWEST)
            cat = np.concatenate([low[k] for k in y])
            at = np.searchsorted(low[x], cat)
            same = low[x][np.minimum(at, len(low[x]) - 1)] == cat
            starts = np.cumsum([0] + [len(low[k]) for k in y[:-1]])
            both = np.add.reduceat(same.astype(np.int64), starts)
            union = n[x] + n[y] - both
            for k in np.nonzero(~whole | (100 * (both + 3) >= percent * (union - 3)))[0]:
                if component[y[k]] != component[x]:
                    a.append(min(keys[x], keys[y[k]]))
                    b.append(max(keys[x], keys[y[k]]))
                    if whole[k] and 100 * (both[k] - 3) >= percent * (union[k] + 3):  # linked whatever short hashes hide
                        component[component == component[y[k]]] = component[x]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return pairs.unionByName(left.unionByName(right).groupBy("band", "value", "i", "j").applyInArrow(run, "a binary, b binary"))


def _of(docs: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose doc_id (null or not) and hash of the text are among pairs (d, t), or aren't."""
    return docs.join(pairs, docs["doc_id"].eqNullSafe(pairs["d"]) & (F.xxhash64(docs["text"]) == pairs["t"]), how)


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, without those with a doc_id that near_duplicates would not keep."""
    gone = decided(docs, shingle, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    return _of(docs, gone, "left_anti")


def one_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Exactly one row of each component that near_duplicates finds, with all columns, and all rows without shingles.

    It is a row with the least doc_id, with none only if no row of the component has one; then by the hash of its text.
    Of rows with equal doc_id and text the one whose columns have the least hash stays, so copies meet in an aggregation
    that tasks begin on their own rows, not in one task.
    """
    written = Written(docs.sparkSession)
    sig, label = labelled(docs, written, shingle, percent)
    best = label.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("f"))
    best = best.select(F.col("f.doc_id").alias("d"), F.col("f.th").alias("t"), F.lit(True).alias("best"))
    pairs = sig.where("set_key is not null").groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    known = pairs.join(best, pairs["doc_id"].eqNullSafe(best["d"]) & (pairs["th"] == best["t"]), "left").where("best is null or n > 1")
    gone = written.put(known.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("best").isNotNull().alias("tie")))
    ties = written.put(gone.where("tie").select("d", "t"))
    written.keep(gone, ties)
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    least = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*hashable)).alias("row")
    first = _of(docs, ties, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(least).select("row.*")
    return _of(docs, gone.select("d", "t"), "left_anti").unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: near duplicates among all documents, by four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


