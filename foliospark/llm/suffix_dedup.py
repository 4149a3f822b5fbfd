"""Removal of repeated byte strings: suffix arrays by linear grouping, within groups of surroundings that can repeat.

The suffix array is built in two phases: groups of suffixes with a common Lyndon prefix are processed in descending
order by pointers to previous smaller groups, then each group's order is emitted. One array over a corpus would have to be
built in one place, and in Python takes microseconds a symbol. So content-chosen anchors deal strings out: equal strings
have equal anchors at equal places. Surroundings of anchors that repeat as a whole are counted; of those that differ, the
blocks of 32 bytes are the symbols of a suffix array, in which runs of equal blocks are neighbours, and the bytes around
such runs are compared. The result is that of one array over all bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Written, flat, hex_sha256, scan, table
from .decontam import _mixed

#: Bytes of a string that may not repeat; bytes of an anchor; bytes of a block, a symbol of the suffix arrays of surroundings.
LENGTH, GRAM, BLOCK = 400, 32, 32
#: Different surroundings of the same anchor that one task compares at once, and of them rows that the driver sees to sort more.
GROUP, SAMPLE = 4096, 20_000
#: Contexts that a task holds in memory at once, about, where groups are small.
AT_ONCE = 1024
#: Bytes hashed at once in a task.
PIECE = 2 << 20


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order, by grouping of Lyndon prefixes."""
    t = [c + 1 for c in text] + [0]
    n = len(t)
    sa = sorted(range(n), key=t.__getitem__)
    place, link, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(sa):
        if i and t[s] != t[sa[i - 1]]:
            start = i
        place[s], link[s] = i, start
        size[start] += 1
    prev = [-1] * n
    end = n
    while end > 0:
        start = link[sa[end - 1]]
        count: dict[int, int] = {}
        for s in sorted(sa[start:end]):
            p = s - 1
            while p >= 0 and link[p] >= start:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, c in count.items():
            by_count.setdefault(c, {}).setdefault(link[p], []).append(p)
        for c in sorted(by_count, reverse=True):
            for g, own in by_count[c].items():
                if len(own) == size[g]:
                    continue
                new = g + size[g] - len(own)
                for k, p in enumerate(own):  # to the end of their group, which becomes a group of its own
                    to, was = g + size[g] - 1 - k, place[p]
                    other = sa[to]
                    sa[was], sa[to] = other, p
                    place[other], place[p] = was, to
                for p in own:
                    link[p] = new
                size[g] -= len(own)
                size[new] = len(own)
        end = start
    out, front, placed = [-1] * n, {}, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = link[s]
            out[g + front.get(g, 0)] = s
            front[g] = front.get(g, 0) + 1
            placed[s] = True
            s = prev[s]
    return out[1:]


def common_prefixes(text: bytes | list[int], sa: list[int]) -> list[int]:
    """Of each suffix in order, how many symbols it shares with the one before it."""
    n, rank, out, h = len(sa), [0] * len(sa), [0] * len(sa), 0
    for i, s in enumerate(sa):
        rank[s] = i
    for s in range(n):
        if rank[s]:
            q = sa[rank[s] - 1]
            while s + h < n and q + h < n and text[s + h] == text[q + h]:
                h += 1
            out[rank[s]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def repeated(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each text, which bytes lie in a string of that length that also starts elsewhere; for texts that fit one task."""
    joined, first = [], []
    for i, x in enumerate(texts):
        first.append(len(joined))
        joined += [*x, 256 + i]
    sa = suffix_array(joined)
    lcp = common_prefixes(joined, sa) + [0]
    out = [np.zeros(len(x), bool) for x in texts]
    where = np.searchsorted(first, np.arange(len(joined)), "right") - 1
    for i, s in enumerate(sa):
        if lcp[i] >= length or lcp[i + 1] >= length:
            d = where[s]
            out[d][s - first[d] : s - first[d] + length] = True
    return out


# The distributed pass. Every string of LENGTH bytes has an anchor: the leftmost of its GRAM-byte pieces with the least
# hash. Equal strings have it at equal offsets, so only strings around anchors with equal bytes need be compared.


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the anchors of one piece of text."""
    n = len(data) - gram + 1
    w = length - gram + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    eight = np.array(np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)))
    with np.errstate(over="ignore"):
        h = _mixed(eight[:n])
        for k in range(8, gram, 8):
            h = _mixed((h ^ eight[k : k + n]) * np.uint64(0x9E3779B97F4A7C15))
    del eight
    blocks = -(-n // w) + 1
    key = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[:n] = h & ~np.uint64(1023)
    key = key.reshape(blocks, w) | np.arange(w, dtype=np.uint64)
    low = np.minimum.accumulate(key, axis=1).ravel()
    high = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    del key
    p = np.arange(n - w + 1)
    a, b = high[p], low[p + w - 1]
    left = (a & ~np.uint64(1023)) <= (b & ~np.uint64(1023))
    at = np.where(left, p // w * w + (a & np.uint64(1023)).astype(np.int64), (p + w - 1) // w * w + (b & np.uint64(1023)).astype(np.int64))
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, h[at] >> np.uint64(1)


def _pieces(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """anchors of a text of any size, piece by piece; pieces overlap so that each string lies in one."""
    if len(data) <= PIECE:
        return anchors(data, length)
    found = [(at + s, h) for s in range(0, len(data) - length + 1, PIECE - length + 1) for at, h in [anchors(data[s : s + PIECE], length)]]
    at, keep = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
    return at, np.concatenate([h for _, h in found])[keep]


def _digest(data: bytes, a: int, b: int) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=a.to_bytes(8, "little"), person=b.to_bytes(8, "little")).digest()


def find_anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of each row with length bytes at least: its anchors, their hashes, and a digest of all that strings with the anchor can hold."""
    reach = length - GRAM

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat(b.column("text"))
        ids, ths = b.column("doc_id").to_pylist(), b.column("th").to_pylist()
        out: dict[str, list] = {k: [] for k in ("doc_id", "th", "n", "pos", "g", "u")}
        for i in range(b.num_rows):
            x = data[offsets[i] : offsets[i + 1]]
            if len(x) < length:
                continue
            at, h = _pieces(x, length)
            raw = x.tobytes()
            u = [_digest(raw[max(0, p - reach) : p + length], min(p, reach), 0) for p in at.tolist()]
            for k, v in zip(out, (ids[i], ths[i], len(raw), at.astype(np.int32), h.astype(np.int64), u), strict=True):
                out[k].append(v)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], pa.int64()), "th": pa.array(out["th"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "pos": pa.array(out["pos"], pa.list_(pa.int32())), "g": pa.array(out["g"], pa.list_(pa.int64())), "u": pa.array(out["u"], pa.list_(pa.binary()))})

    return scan(docs.select("doc_id", "th", "text"), run, "doc_id bigint, th bigint, n bigint, pos array<int>, g array<bigint>, u array<binary>")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Of each wanted anchor (doc_id, th, pos, g, lone): the bytes before it that strings with it can hold, last one first
    (left), and those from it on (right)."""
    reach = length - GRAM
    own = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "g", "lone")).alias("anchors")).toDF("d", "t", "anchors")
    rows = docs.join(own, docs.doc_id.eqNullSafe(own.d) & (docs.th == own.t)).select("doc_id", "th", "text", "anchors").dropDuplicates(["doc_id", "th"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("doc_id", "th", "pos", "g", "lone", "left", "right")}
        for d, t, x, anchors in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("anchors").to_pylist(), strict=True):
            for a in anchors:
                p = a["pos"]
                for k, v in zip(out, (d, t, p, a["g"], a["lone"], x[max(0, p - reach) : p][::-1], x[p : p + length]), strict=True):
                    out[k].append(v)
        kinds = {"doc_id": pa.int64(), "th": pa.int64(), "pos": pa.int32(), "g": pa.int64(), "lone": pa.bool_(), "left": pa.binary(), "right": pa.binary()}
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return scan(rows, run, "doc_id bigint, th bigint, pos int, g bigint, lone boolean, left binary, right binary")


def _packed(x: np.ndarray) -> list[np.ndarray]:
    """The columns of rows of bytes as numbers of eight bytes that sort as the bytes do."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, : x.shape[1]] = x
    return list(np.ascontiguousarray(wide.view(">u8").T.astype(np.uint64)))


def _sorted_prefixes(group: np.ndarray, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group, then bytes (of which size count), and what each shares with the one before; -1 where a group begins."""
    order = np.lexsort((size, *_packed(x)[::-1], group))
    y = x[order]
    differ = y[1:] != y[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    shared = np.minimum(shared, np.minimum(size[order][1:], size[order][:-1]))
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.r_[-1, shared]


def _classes(ids: np.ndarray, shared: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and classes of the places from which run symbols in a row occur at that place of other rows too: rows of
    ids are texts of symbols (shared: which occur twice), and equal runs are neighbours in their suffix array."""
    n = shared.shape[1]
    ahead = np.zeros((len(ids), n + 1), np.int64)
    for k in range(n - 1, -1, -1):
        ahead[:, k] = np.where(shared[:, k], ahead[:, k + 1] + 1, 0)
    starts = ahead[:, :n] >= run
    used = np.zeros(shared.shape, bool)
    for k in range(run):
        used[:, k:] |= starts[:, : n - k]
    text = np.zeros((len(ids), n + 1), np.int64)  # 0 parts the runs
    text[:, :n][used] = ids[used] + 1
    flat_text = text.ravel()
    keep = np.r_[False, (flat_text[1:] != 0) | (flat_text[:-1] != 0)] | (flat_text != 0)
    where = np.nonzero(keep)[0]
    symbols = flat_text[where]
    if not len(where):
        return (np.empty(0, np.int64),) * 3
    sa = np.array(suffix_array(symbols.tolist()), np.int64)
    begins = np.zeros((len(ids), n + 1), bool)
    begins[:, :n] = starts
    sa = sa[begins.ravel()[where[sa]]]
    same = np.ones(max(0, len(sa) - 1), bool)
    for k in range(run):
        same &= symbols[sa[1:] + k] == symbols[sa[:-1] + k]
    group = np.cumsum(np.r_[0, ~same]) if len(sa) else np.empty(0, np.int64)
    many = np.bincount(group, minlength=1)[group] > 1 if len(sa) else np.empty(0, bool)
    at = where[sa[many]]
    return at // (n + 1), at % (n + 1), group[many]


def _repeated_starts(left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """Of each context and each place of a string in it, whether that string also stands at the same place of another one.

    Contexts are cut into blocks. A string holds a run of whole blocks, the same for all strings that begin within one
    block; the suffix array of the blocks tells which contexts share such a run. Of those, the bytes before and after the
    run are compared. No digest decides.
    """
    reach, m = length - GRAM, len(left)
    run = (length - BLOCK + 1) // BLOCK
    rest, columns = length - run * BLOCK, -(-(reach + length) // BLOCK)
    pad = 2 * BLOCK
    x = np.zeros((m, pad + columns * BLOCK + pad), np.uint8)  # the place p of a string is column pad + p
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        c = a[::-1] + b
        x[i, pad + reach - len(a) : pad + reach - len(a) + len(c)] = np.frombuffer(c, np.uint8)
    begin = reach - np.array([len(a) for a in left], np.int64)
    end = reach + np.array([len(b) for b in right], np.int64)
    blocks = np.ascontiguousarray(x[:, pad : pad + columns * BLOCK]).reshape(-1, BLOCK)
    k = np.tile(np.arange(columns), m)
    parts = [k, *_packed(blocks)]
    order = np.lexsort(parts)
    new = np.zeros(len(order), bool)
    for p in parts:
        new[1:] |= p[order][1:] != p[order][:-1]
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new)
    whole = ((np.arange(columns) * BLOCK >= begin[:, None]) & ((np.arange(columns) + 1) * BLOCK <= end[:, None])).ravel()
    shared = whole & (np.bincount(ids[whole], minlength=len(ids) + 1)[ids] > 1)
    out = np.zeros((m, reach + 1), bool)
    row, first, group = _classes(ids.reshape(m, columns), shared.reshape(m, columns), run)
    if not len(row):
        return out
    edge = first * BLOCK
    before = x[row[:, None], (pad + edge - 1)[:, None] - np.arange(BLOCK - 1)]
    after = x[row[:, None], (pad + edge + run * BLOCK)[:, None] + np.arange(rest)]
    n_before = np.clip(edge - begin[row], 0, BLOCK - 1)
    n_after = np.clip(end[row] - edge - run * BLOCK, 0, rest)
    by_before, same_before = _sorted_prefixes(group, before, n_before)
    by_after, same_after = _sorted_prefixes(group, after, n_after)
    names = np.empty((2, len(row)), np.int64)
    for n in range(BLOCK):
        ok = np.nonzero((n_before >= n) & (n_after >= rest - n) & (edge - n <= reach))[0]
        if len(ok) < 2:
            continue
        names[0][by_before] = np.cumsum(same_before < n)
        names[1][by_after] = np.cumsum(same_after < rest - n)
        key = names[0][ok] * (len(row) + 1) + names[1][ok]
        o = np.argsort(key)
        same = key[o][1:] == key[o][:-1]
        twice = ok[o[np.r_[False, same] | np.r_[same, False]]]
        out[row[twice], edge[twice] - n] = True
    return out


def _stretches(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of each run of true places."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Stretches of lone anchors that other anchors of the same bytes repeat. Anchors of the same bytes meet in one task, GROUP
    at most; small groups are compared together, about AT_ONCE contexts of them."""
    reach = length - GRAM

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (x.slice(i, AT_ONCE) for x in batches for i in range(0, x.num_rows, AT_ONCE)):
            held.append(b)
            if sum(x.num_rows for x in held) < AT_ONCE:
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g = t.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield t.slice(0, cut)
            held = [t.slice(cut)]
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            pos = b.column("pos").to_numpy().astype(np.int64)
            found = _repeated_starts(b.column("left").to_pylist(), b.column("right").to_pylist(), length)
            row, first, last = _stretches(found & b.column("lone").to_numpy(zero_copy_only=False)[:, None])
            take = pa.array(row)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(take), "th": b.column("th").take(take), "s": (pos[row] - reach + first).astype(np.int32), "e": pos[row] - reach + last + length})

    return contexts.repartition("g").sortWithinPartitions("g").mapInArrow(run, "doc_id bigint, th bigint, s int, e bigint")


def _prefix(x: bytes, y: bytes) -> int:
    """How many bytes x and y share at their start."""
    n = min(len(x), len(y))
    differ = np.frombuffer(x, np.uint8)[:n] != np.frombuffer(y, np.uint8)[:n]
    return int(differ.argmax()) if differ.any() else n


def _bounds(contexts: DataFrame, n_rows: int, by: str, other: str) -> list[tuple[int, bytes, bytes]]:
    """Where the order of contexts is parted into ranges of about GROUP, or into SAMPLE / 4 larger ones: from about SAMPLE
    rows, by a hash, so that the driver holds no more however many there are."""
    rows = contexts.select("g", by, other)
    if n_rows > SAMPLE:
        rows = contexts.where(F.pmod(F.xxhash64("doc_id", "th", "pos"), F.lit(n_rows // SAMPLE)) == 0).select("g", by, other)
    found = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in rows.collect())
    n = min(-(-n_rows // GROUP), SAMPLE // 4)
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def _in_order(contexts: DataFrame, n_rows: int, length: int, by: str, written: Written) -> DataFrame:
    """contexts in the order of their anchors' bytes and of side by, in ranges, compared with those near them in that order.

    Of each context: found (bits: the places whose strings repeat near it) and shared: of by, the most bytes that it may
    have in common with contexts that it was not compared with. Contexts that share some bytes of a side stand together,
    so those are the two on the far sides of its chunk's ends.
    """
    other = "left" if by == "right" else "right"
    bounds = contexts.sparkSession.sparkContext.broadcast(_bounds(contexts, n_rows, by, other))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        at = [bisect.bisect_right(bounds.value, x) for x in zip(*(b.column(c).to_pylist() for c in ("g", by, other)), strict=True)]
        return b.append_column("part", pa.array(at, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k = -1, 0
        for whole in batches:
            parts = whole.column("part").to_numpy()
            edges = [0, *(np.nonzero(np.diff(parts))[0] + 1).tolist(), whole.num_rows]
            for b in (whole.slice(i, min(GROUP, high - i)) for low, high in itertools.pairwise(edges) for i in range(low, high, GROUP)):
                k, last = (k + 1 if b.column("part")[0].as_py() == last else 0), b.column("part")[0].as_py()
                side = b.column(by).to_pylist()
                found = np.packbits(_repeated_starts(b.column("left").to_pylist(), b.column("right").to_pylist(), length), axis=1)
                g = b.column("g").to_pylist()
                to_first = [_prefix(x, side[0]) if y == g[0] else -1 for x, y in zip(side, g, strict=True)]
                to_last = [_prefix(x, side[-1]) if y == g[-1] else -1 for x, y in zip(side, g, strict=True)]
                ends: list = [None] * b.num_rows
                ends[0] = [side[0], None if b.num_rows > 1 else side[0]]
                if b.num_rows > 1:
                    ends[-1] = [None, side[-1]]
                own = {c: b.column(c) for c in ("doc_id", "th", "pos", "g")}
                yield pa.RecordBatch.from_pydict(own | {"chunk": pa.array([(last << 32) + k] * b.num_rows, pa.int64()), "found": pa.array([x.tobytes() for x in found], pa.binary()), "to_first": pa.array(to_first, pa.int32()), "to_last": pa.array(to_last, pa.int32()), "ends": pa.array(ends, pa.list_(pa.binary()))})

    columns = "doc_id bigint, th bigint, pos int, g bigint, lone boolean, left binary, right binary"
    dealt = scan(contexts, part, columns + ", part int").repartition("part").sortWithinPartitions("part", "g", by, other)
    rows = written.put(dealt.mapInArrow(run, "doc_id bigint, th bigint, pos int, g bigint, chunk bigint, found binary, to_first int, to_last int, ends array<binary>"))
    ends = rows.where("ends is not null").select("g", "chunk", F.posexplode("ends").alias("last", "mine")).where("mine is not null")
    w = Window.partitionBy("g").orderBy("chunk", "last")
    theirs = F.when(F.col("last") == 0, F.lag("mine").over(w)).otherwise(F.lead("mine").over(w))
    ends = ends.withColumn("theirs", theirs).where("theirs is not null")

    def meet(b: pa.RecordBatch) -> pa.RecordBatch:
        same = [_prefix(x, y) for x, y in zip(b.column("mine").to_pylist(), b.column("theirs").to_pylist(), strict=True)]
        return b.select(["chunk", "last"]).append_column("same", pa.array(same, pa.int32()))

    over = scan(ends.select("chunk", "last", "mine", "theirs"), meet, "chunk bigint, last int, same int")
    over = over.groupBy("chunk").agg(F.max(F.when(F.col("last") == 0, F.col("same"))).alias("same_first"), F.max(F.when(F.col("last") == 1, F.col("same"))).alias("same_last"))
    shared = F.greatest(F.least("to_first", F.coalesce("same_first", F.lit(-1))), F.least("to_last", F.coalesce("same_last", F.lit(-1))))
    return rows.join(over, "chunk", "left").select("doc_id", "th", "pos", "g", "found", shared.alias("shared"))


def _bits(found: np.ndarray) -> pa.Array:
    """Rows of truth values as lists of numbers of 63 bits each."""
    wide = np.zeros((len(found), -(-found.shape[1] // 63), 63), np.int64)
    wide.reshape(len(found), -1)[:, : found.shape[1]] = found
    n = (wide << np.arange(63)).sum(2)
    return pa.ListArray.from_arrays(np.arange(0, n.size + 1, n.shape[1], dtype=np.int32), n.ravel())


def _unbits(column: pa.Array, size: int) -> np.ndarray:
    n = np.array(column.to_pylist(), np.int64).reshape(len(column), -1)
    return ((n[:, :, None] >> np.arange(63)) & 1).astype(bool).reshape(len(column), -1)[:, :size]


def _strings(contexts: DataFrame, length: int) -> DataFrame:
    """The strings of each context with as many bytes before the anchor as wanted (bits) says: where each starts, and its
    digest (with that number)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row, start, key = [], [], []
        wanted = _unbits(b.column("wanted"), length - GRAM + 1)
        for i, (x, y, p) in enumerate(zip(*(b.column(c).to_pylist() for c in ("left", "right", "pos")), strict=True)):
            a, x = len(x), x[::-1] + y
            for d in np.nonzero(wanted[i])[0].tolist():
                if max(0, a + length - len(x)) <= d <= a:
                    row.append(i)
                    start.append(p - d)
                    key.append(_digest(x[a - d : a - d + length], d, 1))
        at = pa.array(row, pa.int32())
        return pa.RecordBatch.from_pydict({k: b.column(k).take(at) for k in ("doc_id", "th")} | {"start": pa.array(start, pa.int32()), "key": pa.array(key, pa.binary())})

    return scan(contexts, run, "doc_id bigint, th bigint, start int, key binary")


def _by_order(docs: DataFrame, wanted: DataFrame, length: int, written: Written) -> DataFrame:
    """As _compared for groups of any size: contexts are sorted in the cluster by what follows the anchor, and by what precedes
    it, and compared with those near them in either order. A string that no context near repeats can only repeat if
    contexts beyond both chunks share its bytes after and before the anchor; such strings alone are counted by digests."""
    reach = length - GRAM
    contexts = written.put(_contexts(docs, wanted, length))
    n = contexts.count()
    key = ["doc_id", "th", "pos"]
    r = written.put(_in_order(contexts, n, length, "right", written))
    l = written.put(_in_order(contexts, n, length, "left", written)).toDF(*(f"l_{c}" for c in r.columns))  # noqa: E741
    lone = contexts.select(*(F.col(c).alias(f"c_{c}") for c in key), "lone", F.octet_length("left").alias("n_left"), F.octet_length("right").alias("n_right"))
    match = lambda p: F.col("doc_id").eqNullSafe(F.col(f"{p}_doc_id")) & (F.col("th") == F.col(f"{p}_th")) & (F.col("pos") == F.col(f"{p}_pos"))
    both = r.join(l, match("l")).join(lone, match("c")).select(*key, "g", "lone", "n_left", "n_right", "found", "l_found", "shared", "l_shared")

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = lambda c: np.unpackbits(np.array([np.frombuffer(x, np.uint8) for x in b.column(c).to_pylist()]), axis=1)[:, : reach + 1].astype(bool)
        of = lambda c: b.column(c).to_numpy().astype(np.int64)
        found, pos = bits("found") | bits("l_found"), of("pos")
        most, least = np.minimum(of("l_shared"), of("n_left")), length - np.minimum(of("shared"), of("n_right"))
        d = reach - np.arange(reach + 1)  # bytes before the anchor
        lone = b.column("lone").to_numpy(zero_copy_only=False)
        row, first, last = _stretches(found & lone[:, None])
        spans: list[list] = [[] for _ in range(b.num_rows)]
        for i, f, t in zip(row.tolist(), first.tolist(), last.tolist(), strict=True):
            spans[i].append({"s": int(pos[i]) - reach + f, "e": int(pos[i]) - reach + t + length})
        open_ = ~found & (d <= most[:, None]) & (d >= least[:, None]) & lone[:, None]
        cols = {"spans": pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int64())]))), "least": pa.array(least, pa.int32()), "most": pa.array(most, pa.int32()), "open": pa.array(open_.any(1)), "wanted": _bits(open_[:, ::-1])}
        return pa.RecordBatch.from_pydict({k: b.column(k) for k in (*key, "g")} | cols)

    state = written.put(scan(both, settle, "doc_id bigint, th bigint, pos int, g bigint, spans array<struct<s:int,e:bigint>>, least int, most int, open boolean, wanted array<bigint>"))
    out = state.select("doc_id", "th", F.explode("spans").alias("x")).select("doc_id", "th", "x.s", "x.e")
    open_ = state.where("open")
    if open_.isEmpty():
        return out
    asked = open_.groupBy("g").agg(F.array(*(F.bit_or(F.col("wanted")[i]) for i in range(-(-(reach + 1) // 63)))).alias("asked"))

    def overlap(b: pa.RecordBatch) -> pa.RecordBatch:
        d = np.arange(reach + 1)
        may = (d >= b.column("least").to_numpy()[:, None]) & (d <= b.column("most").to_numpy()[:, None])
        both = _unbits(b.column("asked"), reach + 1) & may
        return b.select(key).append_column("wanted", _bits(both)).filter(pa.array(both.any(1)))

    held = scan(state.join(asked, "g").select(*key, "least", "most", "asked"), overlap, "doc_id bigint, th bigint, pos int, wanted array<bigint>")

    def bytes_of(x: DataFrame) -> DataFrame:
        x = x.select(*(F.col(c).alias(f"c_{c}") for c in key), "wanted")
        return contexts.join(x, match("c")).select("doc_id", "th", "pos", "left", "right", "wanted")

    counted = written.put(_twice(_strings(bytes_of(held), length), "key"))
    own = _strings(bytes_of(open_), length)
    return out.unionByName(own.join(counted, "key").select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + length).cast("bigint").alias("e")))


def _twice(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)


def repeats(docs: DataFrame, length: int = LENGTH, written: Written | None = None) -> DataFrame:
    """Stretches (doc_id, th, s, e) of documents (doc_id, text, th: a hash of the text) that repeat, with overlaps.

    Anchors whose whole surroundings repeat are settled; of those, one represents all, so strings that a third of all
    documents share stay cheap. The others are compared with all different surroundings of the same bytes: up to GROUP of
    them in a task, more of them in the order of a distributed sort (see _by_order), which no group's size holds up.
    """
    written = written or Written(docs.sparkSession)
    reach = length - GRAM
    found = written.put(find_anchors(docs, length))
    each = found.select("doc_id", "th", "n", F.explode(F.arrays_zip("pos", "g", "u")).alias("x")).select("doc_id", "th", "n", "x.pos", "x.g", "x.u")
    by_u = written.put(each.groupBy("u").agg(F.min("g").alias("g"), F.count("*").alias("k"), F.min(F.struct("doc_id", "th", "pos")).alias("x")))
    written.tidy()
    settled = by_u.where("k > 1").select("u")
    sure = each.join(settled, "u").select("doc_id", "th", F.greatest(F.col("pos") - reach, F.lit(0)).alias("s"), F.least((F.col("pos") + length).cast("bigint"), "n").alias("e"))
    sure = written.put(sure)
    written.tidy()
    lone = F.col("k") == 1
    # Written, so that the join reads both sides from shuffles of their own and Spark can split a common anchor's rows.
    by_g = written.put(by_u.groupBy("g").agg(F.count("*").alias("kinds"), F.count(F.when(lone, 1)).alias("lone")).where("kinds > 1 and lone > 0").select("g", "kinds"))
    wanted = written.put(by_u.join(by_g, "g").select("x.doc_id", "x.th", "x.pos", "g", "kinds", lone.alias("lone")))
    for x in (found, by_u, by_g):
        written.drop(x)
    near = written.put(_compared(_contexts(docs, wanted.where(F.col("kinds") <= GROUP), length), length))
    written.tidy()
    out = sure.unionByName(near)
    large = wanted.where(F.col("kinds") > GROUP)
    return out if large.isEmpty() else out.unionByName(_by_order(docs, large, length, written))


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept (the bytes left) and kept_sha256.

    Removed is each byte in a string of length bytes that also starts anywhere else in the texts, as they are given.
    Null texts count as empty; texts under length lose nothing; equal texts lose all. Results are exact but for
    collisions of 128-bit digests, and of 64-bit hashes of different texts of one doc_id.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    written = Written(docs.sparkSession)
    found = repeats(docs, length, written).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")).toDF("d", "t", "spans")
    found = written.only(found)
    rows = docs.join(found, docs.doc_id.eqNullSafe(found.d) & (docs.th == found.t), "left").select("doc_id", "text", "spans")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
        for x, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
            x = x or b""
            kept, last, n, removed = [], 0, 0, 0
            runs: list[list[int]] = []
            for s, e in sorted((y["s"], y["e"]) for y in spans or []):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            for s, e in runs:
                kept.append(x[last:s])
                last, n, removed = e, n + 1, removed + e - s
            kept.append(x[last:])
            left = b"".join(kept)
            for k, v in zip(out, (len(x), removed, n, left, hex_sha256(left)), strict=True):
                out[k].append(v)
        types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {k: pa.array(out[k], t) for k, t in types.items()})

    return scan(rows, run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: strings of 400 bytes that repeat, out of all documents."""
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")
