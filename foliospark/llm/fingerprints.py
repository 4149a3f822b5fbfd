"""Document fingerprints: the k smallest shingle hashes of a text, as DataFrame expressions alone.

Such sketches merge (merge), and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Hashes that a sketch keeps, bits of a hash, words of a shingle.
K, BITS, SHINGLE = 64, 48, 5
#: Documents of a range in which next documents are looked up, and the most ranges (the driver holds a number for each);
#: with more documents, ranges are larger.
ROWS_A_RANGE, MOST_RANGES = 1_000, 20_000


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once although use may read it often."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The k smallest distinct hashes of runs of shingle words, ascending; of all words if there are fewer; none if no words.

    Words are what white space parts, lower-cased. A null text counts as empty.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    short = lambda h: F.shiftrightunsigned(h, 64 - BITS)

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))), lambda i: short(F.xxhash64(F.slice(w, i, shingle))))
        return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(runs)), 1, k)).otherwise(F.array().cast("array<bigint>"))

    return _once(words, hashes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common shingles among all of both: exact if neither sketch is full; 1 for two empty ones."""
    return _once(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """How many distinct shingles: exact below k, else from the k-th smallest hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**BITS) / F.element_at(a, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has: null for an empty a."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def encoded(a: Column) -> Column:
    """A sketch as hex digits, BITS / 4 for each hash."""
    return F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), "")


def _part(heads: list[float], place: Column) -> Column:
    """How many of the ascending heads lie before place: first among every so-manieth, then among those between two of them."""
    size = max(1, math.isqrt(len(heads)))
    chunks = [heads[i : i + size] for i in range(0, len(heads), size)]
    listed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    before = lambda x: F.size(F.filter(x, lambda h: h < place))
    chunk = F.least(before(listed([c[-1] for c in chunks], "array<double>")), F.lit(len(chunks) - 1))
    return _once(chunk, lambda c: c * size + before(F.get(listed(chunks, "array<array<double>>"), c)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text and more), and as next_<column> those of the next row by descending doc_id (null last; then crc32 of
    text); the first row's after the last row.

    Ranges of that order hold about ROWS_A_RANGE rows; the first row of a range is also put at the end of the range
    before it, so each range is worked out alone and texts move once. Equal rows may stand in any order. Where rows of one
    doc_id and text fill more than a range, they are counted first, where they are, and expanded last: each but one of
    them is followed by its equal.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    #: One number that follows the order of (doc_id, crc32), so that ranges can also part a much repeated doc_id.
    place = F.coalesce(F.col("doc_id").cast("double") + F.crc32(text) / F.lit(2.0**32 + 1), F.lit(-2.0e19) + F.crc32(text) * F.lit(4096.0))
    parts = min(MOST_RANGES, max(1, docs.count() // ROWS_A_RANGE))
    marks = docs.select(place.alias("p")).agg(F.percentile_approx("p", [(i + 1) / parts for i in range(parts)], max(10_000, 20 * parts)), F.max("p")).first()
    met = Counter(marks[0] or [])
    heads = sorted({*met, *([] if marks[1] is None else [marks[1]])}) or [0.0]
    hot = sorted(x for x, n in met.items() if n > 1)
    rows = docs.withColumn("_place", place).withColumn("_n", F.lit(1).cast("bigint"))
    if hot:
        among = F.array_contains(F.from_json(F.lit(json.dumps(hot)), "array<double>"), F.col("_place"))
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        counted = rows.where(among).groupBy("doc_id", "text", "_place").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in rest))
        rows = rows.where(~among).unionByName(counted)
    n, bounds = len(heads), F.from_json(F.lit(json.dumps(heads)), "array<double>")
    here = F.struct(F.col("_part").alias("part"), F.lit(0).alias("copy"))
    before = F.struct(((F.col("_part") + 1) % n).alias("part"), F.lit(1).alias("copy"))
    is_head = F.get(bounds, F.col("_part")) == F.col("_place")
    rows = rows.withColumn("_part", _part(heads, F.col("_place"))).withColumn("_put", F.explode(F.when(is_head, F.array(here, before)).otherwise(F.array(here))))
    w = Window.partitionBy("_put.part").orderBy("_put.copy", F.col("doc_id").desc_nulls_last(), F.col("_place").desc(), F.xxhash64("text"))
    rows = rows.withColumn("_next", F.lead(F.struct(*columns)).over(w)).where("_put.copy = 0")
    if hot:
        rows = rows.withColumn("_next", F.explode(F.concat(F.array(F.col("_next")), F.array_repeat(F.struct(*columns), (F.col("_n") - 1).cast("int")))))
    return rows.select(*docs.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """A row per row of docs (doc_id, text): fingerprints of the text and of the text whose last third gives way to the
    start of the next document's, and how alike they are. Null texts count as empty; a lone document follows itself; an empty
    table gives no rows; texts of any length are read whole. Repeated rows give a row each, and follow each other."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("own", sketch(F.col("text"), k))
    rows = with_next(own, ["text", "own"])
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited_text", F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))")))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited_text"), k).alias("edited"))
    return rows.select("doc_id", "n_chars", "edited_sha256", encoded(F.col("own")).alias("fingerprint"), encoded(F.col("edited")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("edited"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"), F.round(distinct_shingles(F.col("own"), k)).cast("bigint").alias("n_shingles"), containment(F.col("own"), F.col("edited"), k).alias("kept_in_edited"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprints of all documents and their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
