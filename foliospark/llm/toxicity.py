"""Toxicity: weighted transducers for insult, threat, target, negation and reported speech, composed into two machines that
read each clause of a text, one forwards and one backwards over what the first puts out; the weights of the clauses that
they match make the score. Lexicon and scale are learned from labelled rows."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORDS, Written, flat, held_out, parts, scan, table
from .decontam import _IS_WORD

THRESHOLD = 0.3
#: Most labelled rows to learn from; of a learned entry: least toxic texts, least odds against clean texts at the lower
#: end of a 90 % interval.
SAMPLE, SUPPORT, ODDS = 20_000, 6, 12.0
#: Bytes of a learned beginning of a word.
STEMS = (4, 5, 6, 7)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MATCH = range(7)
SEEDS = {
    INSULT: "idiot idiots moron morons loser losers stupid dumb pathetic worthless scum trash disgusting imbecile fool jerk creep bastard vermin filth freak clown idiota imbécil estúpido estúpida basura escoria asqueroso dumm dummkopf arschloch abschaum widerlich versager stupide imbécile crétin connard ordure minable dégoûtant",
    THREAT: "kill destroy hurt beat stab shoot strangle punish matar golpear destruir töten schlagen vernichten tuer frapper détruire",
    TARGET: "you your yours u ya they them their he she him her tu te ti usted ustedes vosotros du dich dir ihr euch sie vous toi",
    NEGATION: "not no never neither nor nobody isn aren wasn weren don doesn didn won wouldn cannot nunca jamás tampoco nicht kein keine keinen nie niemals pas jamais aucun aucune",
    REPORT: "said says saying claimed claims reported reports wrote quoted quote called calls allegedly dijo dicen informó sagte sagt behauptet berichtet dit disait déclaré rapporte",
}
#: What a seed counts before labels say otherwise, and what each mark does to the weight of a match.
SEED_WEIGHT, FACTORS = 1.5, {"negated": 0.25, "reported": 0.5, "aimed": 1.0, "bare": 0.5}


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step(state, symbol) gives the next state and the symbol put out. Symbols are (class, marks)."""

    arcs: dict = field(hash=False)
    start: int = 0

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds what this one puts out to other."""
        names, order, arcs = {(self.start, other.start): 0}, [(self.start, other.start)], {}
        for a, b in order:
            for (s, symbol), (to, out) in self.arcs.items():
                if s == a and (b, out) in other.arcs:
                    to2, out2 = other.arcs[b, out]
                    if (to, to2) not in names:
                        names[to, to2] = len(order)
                        order.append((to, to2))
                    arcs[names[a, b], symbol] = (names[to, to2], out2)
        return Transducer(arcs)


#: All marks that a symbol may bear.
_MARKS = [frozenset(x) for n in range(4) for x in itertools.combinations(("negated", "reported", "aimed"), n)]


def _marker(trigger: int, mark: str) -> Transducer:
    """Marks insults and threats that come behind trigger in the clause, in the direction of reading."""
    arcs = {}
    for state in (0, 1):
        for kind in range(6):
            for marks in _MARKS:
                arcs[state, (kind, marks)] = (int(state or kind == trigger), (kind, marks | {mark} if state and kind in (INSULT, THREAT) else marks))
    return Transducer(arcs)


def _pattern(kind: int, needs: frozenset[str], else_: str | None) -> Transducer:
    """Rewrites a symbol of that kind to a match with its marks, where it bears needs; where not, to a match that also bears
    else_, or to OTHER, which is none. Matches of other patterns pass."""
    arcs = {}
    for k in (*range(6), MATCH):
        for marks in [m | x for m in _MARKS for x in (frozenset(), frozenset({"bare"}))]:
            out = (k, marks)
            if k == kind:
                out = (MATCH, marks) if needs <= marks else (MATCH, marks | {else_}) if else_ else (OTHER, frozenset())
            arcs[0, (k, marks)] = (0, out)
    return Transducer(arcs)


def machines() -> tuple[Transducer, Transducer]:
    """Over the word classes of a clause, forwards: negation, reported speech, targets before a word. Over what that puts out,
    backwards: targets behind a word, then the patterns. An insult matches with a target on either side, and with less
    weight without one; a threat only with one."""
    aimed = frozenset({"aimed"})
    return _marker(NEGATION, "negated").compose(_marker(REPORT, "reported")).compose(_marker(TARGET, "aimed")), _marker(TARGET, "aimed").compose(_pattern(INSULT, aimed, "bare")).compose(_pattern(THREAT, aimed, None))


@dataclass
class Model:
    """Weights of whole words and of beginnings (by their UTF-8 bytes, at most 8 count), and the scale: logistic of a + b log(1 + x)."""

    words: dict[bytes, float]
    stems: dict[bytes, float]
    a: float = -3.0
    b: float = 3.0

    def __post_init__(self) -> None:
        kinds = {w.encode(): k for k, text in SEEDS.items() for w in text.split()}
        entries = {w: (k, SEED_WEIGHT if k in (INSULT, THREAT) else 0.0) for w, k in kinds.items()}
        for w, x in self.words.items():
            if entries.get(w, (INSULT,))[0] in (INSULT, THREAT):
                entries[w] = (entries.get(w, (INSULT,))[0], x)
        #: By the first eight bytes: candidates; longer words are told apart by the whole word.
        self.by_word = {w: v for w, v in entries.items() if v[1] > 0 or v[0] not in (INSULT, THREAT)}
        self.heads = np.unique(np.array([_head(w) for w in self.by_word], np.uint64))
        self.stem_keys = {n: np.unique(np.array([_head(s) for s in self.stems if len(s) == n], np.uint64)) for n in STEMS}
        self.clear = np.unique(np.array([_head(w) for w, (k, _) in self.by_word.items() if k in (INSULT, THREAT)], np.uint64))
        self.forwards, self.backwards = (m.arcs for m in machines())

    def __getstate__(self):
        return (self.words, self.stems, self.a, self.b)

    def __setstate__(self, x):
        self.words, self.stems, self.a, self.b = x
        self.__post_init__()

    def weigh(self, column: pa.Array) -> np.ndarray:
        """Of each text: the sum of its clauses' weights."""
        data, offsets = flat(column)
        out = np.zeros(len(column))
        if not len(data):
            return out
        starts, length, eight = _words(data, offsets)
        head = eight[starts] & _KEEP[np.minimum(length, 8)]
        strong = _among(head, self.clear)
        for n, keys in self.stem_keys.items():
            if len(keys):
                strong |= (length > n) & _among(eight[starts] & _KEEP[n], keys)
        first = np.searchsorted(starts, offsets)
        events = np.nonzero(strong)[0]
        for d in np.unique(np.searchsorted(first, events, "right") - 1):
            low, high = int(first[d]), int(first[d + 1])
            own = low + np.nonzero(strong[low:high] | _among(head[low:high], self.heads))[0]
            text = data[offsets[d] : offsets[d + 1]].tobytes().translate(LOWER)
            clause = np.cumsum(_END[data[offsets[d] : offsets[d + 1]]])[starts[own] - offsets[d]]
            out[d] = self._read(text, (starts[own] - offsets[d]).tolist(), length[own].tolist(), clause.tolist())
        return out

    def entry(self, word: bytes) -> tuple[int, float]:
        """Class and weight of a word: its own, or that of its longest learned beginning."""
        if found := self.by_word.get(word):
            return found
        for n in reversed(STEMS):
            if len(word) > n and (x := self.stems.get(word[:n])):
                return INSULT, x
        return OTHER, 0.0

    def clause(self, symbols: list[tuple[int, float]]) -> float:
        """The weight of a clause, given as classes and weights of its words in order: that of all its matches."""
        state, marked = 0, []
        for kind, _ in symbols:
            state, out = self.forwards[state, (kind, frozenset())]
            marked.append(out)
        state, total = 0, 0.0
        for symbol, (_, weight) in zip(reversed(marked), reversed(symbols), strict=True):
            state, (kind, marks) = self.backwards[state, symbol]
            if kind == MATCH:
                total += weight * math.prod(FACTORS[x] for x in marks)
        return total

    def _read(self, text: bytes, starts: list[int], length: list[int], clause: list[int]) -> float:
        entries = [self.entry(text[s : s + n]) for s, n in zip(starts, length, strict=True)]
        return sum(self.clause([x for _, x in own]) for _, own in itertools.groupby(zip(clause, entries, strict=True), key=lambda x: x[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a + self.b * np.log1p(x))))


_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_END = np.zeros(256, np.int32)
_END[[ord(c) for c in ".!?;\n"]] = 1


def _head(word: bytes) -> int:
    return int.from_bytes(word[:8], "little")


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and bytes of each word, and for each byte the eight lower-cased bytes from there on."""
    word = _IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    starts = np.nonzero(word & (~before | cut[:-1]))[0]
    after = np.zeros_like(word)
    after[:-1] = word[1:]
    ends = np.nonzero(word & (~after | cut[1:]))[0] + 1
    low = np.concatenate([np.frombuffer(LOWER, np.uint8)[data], np.zeros(16, np.uint8)])
    return starts, ends - starts, np.ndarray((len(data) + 1,), "<u8", low.tobytes(), strides=(1,))


def _shapes(text: bytes) -> set[bytes]:
    words = set(text.translate(WORDS).split())
    return {b"=" + w for w in words} | {w[:n] for w in words for n in STEMS if len(w) > n}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled rows, those that are not held out, the first by a hash of doc_id.

    Of documents that share a doc_id the least text counts; equal texts count once, as toxic if any is. The sample is
    written once. Words and beginnings of words, whole whatever their length, are counted where the rows are; only those
    with enough toxic texts and odds reach the driver, and two numbers for each row of the sample. Without toxic or clean
    rows, the seeds and the default scale stay.
    """
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").where("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    written = Written(docs.sparkSession)
    own = written.put(own.groupBy("text").agg(F.max("toxic").alias("toxic")))
    total = {bool(r[0]): r[1] for r in own.groupBy("toxic").count().collect()}
    n_toxic, n_clean = total.get(True, 0), total.get(False, 0)
    if not n_toxic or not n_clean:
        written.keep()
        return Model({}, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            seen: Counter = Counter()
            clean: Counter = Counter()
            for text, toxic in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("toxic").to_pylist(), strict=True):
                (seen if toxic else clean).update(_shapes(text or b""))
            keys = list(seen.keys() | clean.keys())
            yield pa.RecordBatch.from_pydict({"shape": pa.array(keys, pa.binary()), "toxic": pa.array([seen[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})

    found = own.mapInArrow(count, "shape binary, toxic bigint, clean bigint").groupBy("shape").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = (F.col("t") + 0.5) / (n_toxic + 1) / ((F.col("c") + 0.5) / (n_clean + 1))
    least = F.log("odds") - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = found.withColumn("odds", odds).where((F.col("t") >= SUPPORT) & (least >= math.log(ODDS))).orderBy(F.desc("odds"), "shape").collect()
    known = {bytes(r["shape"]): math.log(r["odds"]) for r in best}
    model = Model({k[1:]: x for k, x in known.items() if k[:1] == b"="}, {k: x for k, x in known.items() if k[:1] != b"="})

    def weigh(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"x": model.weigh(b.column("text")), "toxic": b.column("toxic").cast(pa.int32())})

    pairs = scan(own.withColumn("toxic", F.col("toxic").cast("int")), weigh, "x double, toxic int").collect()
    written.keep()
    x, y = np.log1p(np.array([r[0] for r in pairs])), np.array([float(bool(r[1])) for r in pairs])
    w = np.zeros(2)
    z = np.column_stack([np.ones_like(x), x])
    for _ in range(30):  # Newton, with a little ridge for labels that the weights tell apart
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(2), z.T @ (p - y) + 0.5 * w)
    model.a, model.b = float(w[0]), float(w[1])
    return model


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of docs (doc_id, text): see SCHEMA. One pass over whole texts, no shuffle. The text alone decides a
    score; null texts count as empty, and empty texts get the score of texts without any match."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(model.weigh(b.column("text")))
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return scan(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), run, SCHEMA)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score under threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield b.filter(pa.array(model.score(model.weigh(b.column("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
