"""Benchmark decontamination: suffix arrays over training words, in which every benchmark suffix is searched for its longest
verbatim matches; documents with long enough ones go."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Written, flat, hex_sha256, parts, scan, table

#: Words of a window, and bytes of benchmark text that are broadcast at once.
WINDOW, BLOCK_BYTES = 10, 32 << 20
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[b for b in range(256) if 48 <= b <= 57 or 97 <= LOWER[b] <= 122 or b >= 128]] = True
_LOWER = np.frombuffer(LOWER, np.uint8)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, its text's number, and a 64-bit hash of its lower-cased bytes."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = _IS_WORD[data]
    prev = np.empty_like(word)
    prev[1:], prev[:1] = word[:-1], False
    prev[edge[:-1]] = False
    starts = np.nonzero(word & ~prev)[0]
    nxt = np.empty_like(word)
    nxt[:-1], nxt[-1:] = word[1:], False
    nxt[edge[1:]] = False
    ends = np.nonzero(word & ~nxt)[0] + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    length = ends - starts
    return starts, ends, doc, hashed(_LOWER[data], starts, length)


def hashed(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """63-bit hash of each stretch of bytes, eight bytes at a time, the longest stretches first."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]).tobytes(), strides=(1,))
    live = np.argsort(-np.minimum(length, 32767).astype(np.int16), kind="stable") if not len(length) or length.max() < 32767 else np.argsort(-length, kind="stable")
    sizes, begin = length[live], starts[live]
    x, i = np.zeros(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while m := int(np.searchsorted(-sizes, -i, "left")):
            v = eight[begin[:m] + i] & _KEEP[np.minimum(sizes[:m] - i, 8)]
            x[:m] = _mixed((x[:m] ^ v) * _BASE[0])
            i += 8
        h = np.empty(len(starts), np.uint64)
        h[live] = x
        return _mixed(h ^ length.astype(np.uint64)) >> np.uint64(1)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row, for all places where n words are left."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out + h[i : i + len(out)]) * _BASE[1]
        return _mixed(out)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The places of symbols over 0, sorted by the symbols that follow, each up to the next 0; the last symbol is 0.

    Doubling: places in groups by their first 1, 2, 4, ... symbols; each round sorts only groups that aren't told apart yet.
    Places whose stretch up to the 0 is the same stand together in any order.
    """
    at = np.nonzero(symbols > 0)[0]
    zeros = np.nonzero(symbols == 0)[0]
    left = zeros[np.searchsorted(zeros, at)] - at  # symbols up to the 0
    room = np.zeros(len(symbols), np.int64)
    room[at] = left
    sa = at[np.argsort(symbols[at], kind="stable")]
    rank = np.zeros(len(symbols), np.int64)
    new = np.r_[True, symbols[sa[1:]] != symbols[sa[:-1]]] if len(sa) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
    rank[sa] = first + 1
    open_ = np.nonzero(~(new & np.r_[new[1:], True]))[0] if len(sa) else np.empty(0, np.int64)
    k = 1
    while True:
        open_ = open_[room[sa[open_]] >= k]
        if not len(open_):
            return sa
        own = sa[open_]
        group, nxt = rank[own], rank[own + k]
        o = np.argsort(group * (len(sa) + 1) + nxt, kind="stable")
        own, group, nxt = own[o], group[o], nxt[o]
        sa[open_] = own
        new = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        rank[own] = open_[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))] + 1
        open_ = open_[~(new & np.r_[new[1:], True])]
        k *= 2


class Shard:
    """The training words of one batch of documents with their suffix array. Words that no test has end a suffix, since no
    match goes on beyond them."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, vocabulary: np.ndarray) -> None:
        known = np.searchsorted(vocabulary, h)
        symbol = np.where(vocabulary[np.minimum(known, len(vocabulary) - 1)] == h, known + 1, 0)
        #: Words with a 0 behind each document; place i of the batch's words stands at i + doc[i].
        self.symbols = np.zeros(len(h) + (int(doc[-1]) if len(doc) else 0) + 1, np.int64)
        self.symbols[np.arange(len(h)) + doc] = symbol
        self.doc = doc
        self.sa = suffix_array(self.symbols)
        self.word_of = np.cumsum(np.bincount(np.arange(len(h)) + doc, minlength=len(self.symbols))) - 1
        self.starts = np.searchsorted(self.symbols[self.sa], np.arange(len(vocabulary) + 2))

    def _before(self, tests: np.ndarray, at: np.ndarray, places: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of the suffix at places against the test suffix at at, both cut to depth words, and how many words they share."""
        sign, same = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, d = np.arange(len(at)), 0
        while len(live):
            live = live[depth[live] > d]
            x, y = self.symbols[places[live] + d], tests[at[live] + d]
            sign[live] = np.sign(x - y)
            live = live[x == y]
            d += 1
            same[live] = d
        return sign, same

    def bound(self, tests: np.ndarray, at: np.ndarray, depth: np.ndarray, upper: bool = False) -> np.ndarray:
        """Binary search of all test suffixes at once: how many suffixes of the shard come before each, or (upper) not after it."""
        low, high = self.starts[tests[at]].copy(), self.starts[tests[at] + 1].copy()
        live = np.nonzero(low < high)[0]
        while len(live):
            mid = (low[live] + high[live]) // 2
            sign, _ = self._before(tests, at[live], self.sa[mid], depth[live])
            right = sign <= 0 if upper else sign < 0
            low[live[right]], high[live[~right]] = mid[right] + 1, mid[~right]
            live = live[low[live] < high[live]]
        return low

    def longest(self, tests: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of each test suffix, the words of its longest verbatim match in the shard."""
        place = self.bound(tests, at, left)
        out = np.zeros(len(at), np.int64)
        for p, ok in ((place - 1, place > 0), (place, place < len(self.sa))):
            i = np.nonzero(ok)[0]
            out[i] = np.maximum(out[i], self._before(tests, at[i], self.sa[p[i]], left[i])[1])
        return out

    def places(self, tests: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the suffix array whose suffixes begin with depth words of each test suffix."""
        return self.bound(tests, at, depth), self.bound(tests, at, depth, True)


class Tests:
    """The words of a block of benchmark items as numbers within their vocabulary. left: words from each place to its item's
    end; window: words of the window that begins at a place, 0 where none does."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0] + [len(t) for t in texts])
        _, _, self.item, h = words_of(data, offsets)
        self.ids = ids
        self.vocabulary, number = np.unique(h, return_inverse=True)
        self.words = np.r_[number.astype(np.int64) + 1, 0]
        self.left = np.searchsorted(self.item, self.item, "right") - np.arange(len(h))
        size = np.bincount(self.item, minlength=len(texts))[self.item] if len(h) else self.left
        whole = np.minimum(size, window)
        self.window = np.where(self.left >= whole, whole, 0)

    def matches(self, doc: np.ndarray, h: np.ndarray) -> tuple[Shard, np.ndarray]:
        """The shard of a batch's words, and the longest match there of every test suffix."""
        shard = Shard(h, doc, self.vocabulary)
        return shard, shard.longest(self.words, np.arange(len(self.left)), self.left)


def blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Broadcast]:
    """The benchmark in broadcast blocks of about BLOCK_BYTES of text, by a hash of the item: one if all of it is no larger.
    The driver holds a block at a time; at least one item is in each."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select("item_id", "text").where("text is not null")
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = own.collect()
        tests = Tests(["" if r[0] is None else str(r[0]) for r in rows], [r[1].encode() for r in rows], window)
        if len(tests.left):
            yield sc.broadcast(tests)


def hits(column: pa.Array, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]], list[tuple[int, str, int, int]]]:
    """Of a batch: the text of each word, whether it lies inside an occurrence of a window, where each text's words start;
    of each text the items whose windows occur, and its longest verbatim match: words, item, the item's first word, the text's."""
    _, _, doc, h = words_of(*flat(column))
    first = np.searchsorted(doc, np.arange(len(column) + 1))
    items: list[set[str]] = [set() for _ in range(len(column))]
    best: list[tuple[int, str, int, int]] = [(0, "", 0, 0)] * len(column)
    edge = np.zeros(len(h) + 1, np.int64)
    if not len(h):
        return doc, np.zeros(0, bool), first, items, best
    shard, longest = tests.matches(doc, h)
    at = np.nonzero((tests.window > 0) & (longest >= tests.window))[0]
    low, high = shard.places(tests.words, at, tests.window[at])
    own = np.searchsorted(tests.item, np.arange(len(tests.ids)))
    seen: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        seen.setdefault((a, b), []).append(int(at[k]))
    for (a, b), suffixes in seen.items():
        places = shard.word_of[shard.sa[a:b]]
        n = int(tests.window[suffixes[0]])
        np.add.at(edge, places, 1)
        np.add.at(edge, places + n, -1)
        names = {tests.ids[tests.item[i]] for i in suffixes}
        for d in np.unique(doc[places]).tolist():
            items[d] |= names
        spelled = sorted((tests.ids[tests.item[i]], int(i - own[tests.item[i]]), i) for i in suffixes)
        most, which = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        for k, (_, _, i) in enumerate(spelled):  # of equally long matches that of the last item by name
            _, same = shard._before(tests.words, np.full(b - a, i), shard.sa[a:b], np.full(b - a, tests.left[i]))
            which[same >= most] = k
            most = np.maximum(most, same)
        for p, m, k in zip(places.tolist(), most.tolist(), which.tolist(), strict=True):
            d = int(doc[p])
            best[d] = max(best[d], (m, *spelled[k][:2], int(p - first[d])))
    return doc, np.cumsum(edge[:-1]) > 0, first, items, best


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, longest_item string, longest_item_word bigint, longest_word bigint"
_LONGEST = ["longest", "longest_item", "longest_item_word", "longest_word"]


def _rows(ids: pa.Array, words: np.ndarray, hit: np.ndarray, items: list, best: list) -> pa.RecordBatch:
    none = [x[0] == 0 for x in best]
    cols = {"doc_id": ids, "n_words": words.astype(np.int64), "n_hit": hit.astype(np.int64), "n_items": np.array([len(x) for x in items], np.int64), "items_sha256": [hex_sha256(",".join(sorted(x)).encode()) for x in items], "contaminated": hit > 0}
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_pydict(cols | {k: pa.array([None if e else x[i] for e, x in zip(none, best, strict=True)], t) for i, (k, t) in enumerate(zip(_LONGEST, kinds, strict=True))})


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[Broadcast | None, DataFrame | None]:
    """A benchmark of one block, broadcast; or of a larger one what each block hits, written block by block: doc_id, th (hash
    of the text), runs of hit words, items and longest match."""
    all_ = blocks(benchmark, window)
    one, two = next(all_, None), next(all_, None)
    if two is None:
        return one, None
    written, found = Written(docs.sparkSession), None
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    for tests in itertools.chain([one, two], all_):

        def run(b: pa.RecordBatch, tests: Broadcast = tests) -> pa.RecordBatch:
            doc, hit, first, items, best = hits(b.column("text"), tests.value)
            some = np.nonzero(np.bincount(doc[hit], minlength=b.num_rows))[0]
            runs = []
            for d in some:
                step = np.diff(np.r_[0, hit[first[d] : first[d + 1]].astype(np.int8), 0])
                runs.append([{"s": int(s), "e": int(e)} for s, e in zip(np.nonzero(step == 1)[0], np.nonzero(step == -1)[0], strict=True)])
            take = pa.array(some)
            cols = {"runs": pa.array(runs, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), "items": pa.array([sorted(items[d]) for d in some], pa.list_(pa.string())), "best": pa.array([dict(zip(_LONGEST, best[d], strict=True)) for d in some], pa.struct([(_LONGEST[0], pa.int64()), (_LONGEST[1], pa.string()), (_LONGEST[2], pa.int64()), (_LONGEST[3], pa.int64())]))}
            return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(take), "th": b.column("th").take(take)} | cols)

        part = written.put(scan(rows, run, "doc_id bigint, th bigint, runs array<struct<s:bigint,e:bigint>>, items array<string>, best struct<longest:bigint,longest_item:string,longest_item_word:bigint,longest_word:bigint>"))
        found = part if found is None else found.unionByName(part)
        tests.destroy()
    whole = found.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("best").alias("best"))
    return None, written.only(whole.toDF("d", "t", "runs", "items", "best"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of docs (doc_id, text): see SCHEMA. One pass over docs for each block of the benchmark; of one block no
    shuffle.

    Each batch of documents is a shard with a suffix array over its words, in which every suffix of the benchmark
    (item_id, text) is searched; windows occur where matches are long enough. The longest_ columns tell a document's
    longest verbatim match among those: its words, item, and first word in the item and in the document. An item with
    fewer words than a window is one window; items without words have none. Null texts have no words. Repeated items count
    once by id; an item without id counts under an empty id. An empty benchmark contaminates nothing. Words are told by
    63-bit hashes.
    """
    one, found = _found(docs, benchmark, window)
    if found is None:

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            if one is None:
                doc = words_of(*flat(b.column("text")))[2]
                n = np.bincount(doc, minlength=b.num_rows)
                return _rows(b.column("doc_id"), n, np.zeros_like(n), [set()] * b.num_rows, [(0, "", 0, 0)] * b.num_rows)
            doc, hit, _, items, best = hits(b.column("text"), one.value)
            return _rows(b.column("doc_id"), np.bincount(doc, minlength=b.num_rows), np.bincount(doc[hit], minlength=b.num_rows), items, best)

        return scan(docs.select("doc_id", "text"), run, SCHEMA)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    rows = rows.join(found, rows.doc_id.eqNullSafe(found.d) & (rows.th == found.t), "left").select("doc_id", "text", "runs", "items", "best")

    def put(b: pa.RecordBatch) -> pa.RecordBatch:
        doc = words_of(*flat(b.column("text")))[2]
        words = np.bincount(doc, minlength=b.num_rows)
        hit = np.zeros(b.num_rows, np.int64)
        for i, runs in enumerate(b.column("runs").to_pylist()):
            mask = np.zeros(words[i], bool)
            for x in runs or []:
                mask[x["s"] : x["e"]] = True
            hit[i] = mask.sum()
        best = [tuple(x[k] for k in _LONGEST) if x else (0, "", 0, 0) for x in b.column("best").to_pylist()]
        return _rows(b.column("doc_id"), words, hit, [set(x or []) for x in b.column("items").to_pylist()], best)

    return scan(rows, put, SCHEMA)


def longest_matches(docs: DataFrame, benchmark: DataFrame, shortest: int = 5) -> DataFrame:
    """Of each place of the benchmark (item_id, item_word) its longest verbatim matches of at least shortest words in all of
    docs: n_words, and each location (doc_id, word). Shards tell their longest matches; the longest of all shards stay."""
    found = None
    for tests in blocks(benchmark, 1):

        def run(b: pa.RecordBatch, tests: Broadcast = tests) -> pa.RecordBatch:
            t: Tests = tests.value
            _, _, doc, h = words_of(*flat(b.column("text")))
            first, own = np.searchsorted(doc, np.arange(b.num_rows)), np.searchsorted(t.item, np.arange(len(t.ids)))
            out: list[list] = [[], [], [], [], []]
            if len(h):
                shard, n = t.matches(doc, h)
                at = np.nonzero(n >= shortest)[0]
                for i, low, high in zip(at, *shard.places(t.words, at, n[at]), strict=True):
                    places = shard.word_of[shard.sa[low:high]]
                    for column, values in zip(out, ([t.ids[t.item[i]]] * len(places), [int(i - own[t.item[i]])] * len(places), [int(n[i])] * len(places), doc[places].tolist(), (places - first[doc[places]]).tolist()), strict=True):
                        column += values
            return pa.RecordBatch.from_pydict({"item_id": pa.array(out[0], pa.string()), "item_word": pa.array(out[1], pa.int64()), "n_words": pa.array(out[2], pa.int64()), "doc_id": b.column("doc_id").take(pa.array(out[3], pa.int64())), "word": pa.array(out[4], pa.int64())})

        part = scan(docs.select("doc_id", "text"), run, "item_id string, item_word bigint, n_words bigint, doc_id bigint, word bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id string, item_word bigint, n_words bigint, doc_id bigint, word bigint")
    found = Written(docs.sparkSession).put(found)
    most = found.groupBy("item_id", "item_word").agg(F.max("n_words").alias("n_words"))
    return found.join(most, ["item_id", "item_word", "n_words"]).select("item_id", "item_word", "n_words", "doc_id", "word")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark."""
    one, found = _found(docs, benchmark, window)
    if found is not None:
        return docs.join(found.select("d", "t"), docs["doc_id"].eqNullSafe(F.col("d")) & (F.xxhash64(docs["text"]) == F.col("t")), "left_anti")
    if one is None:
        return docs

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        doc, hit, *_ = hits(b.column("text"), one.value)
        return b.filter(pa.array(np.bincount(doc[hit], minlength=b.num_rows) == 0))

    return docs.mapInArrow(lambda it: (x for b in parts(it) if (x := run(b)).num_rows), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: benchmark windows in all documents."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(*_LONGEST)


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
      FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(s) WHERE len(w) > 0),
p AS (SELECT DISTINCT n FROM i),
o AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM d, p, unnest(range(1, len(w) - n + 2)) AS u(s)),
h AS (SELECT o.doc_id, o.n, o.s, i.item_id FROM o JOIN i ON o.n = i.n AND o.win = i.win),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM h, unnest(range(s, s + n)) AS u(pos) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
