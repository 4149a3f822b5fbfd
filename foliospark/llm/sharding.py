"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scan, table

SHARDS = 24
#: Rows that one task numbers, about.
ROWS_A_RANGE = 20_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key. With one shard more, a key stays or moves to the new shard. Needs shards >= 1."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(k), np.int64)
    live = np.arange(len(k))
    with np.errstate(over="ignore"):
        while len(live):
            k[live] = k[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = (at[live] + 1) * (2.0**31 / ((k[live] >> np.uint64(33)).astype(np.float64) + 1.0))
            live, step = live[step < shards], step[step < shards]
            at[live] = step.astype(np.int64)
    return at.astype(np.int32)


def shard_of(key, shards: int):
    """Column: the shard of a bigint key; a null key counts as 0."""

    @F.pandas_udf("int")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(jump(x.fillna(0).to_numpy().astype(np.int64).view(np.uint64), shards))

    return of(F.coalesce(key, F.lit(0).cast("bigint")))


def with_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """docs and the shard of each row. No shuffle. A column of that name is replaced; null keys go where 0 goes."""
    return docs.withColumn(name, shard_of(F.col(key), shards))


def layout(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row per row of docs: shard, slot within the shard, and the shard with one shard more.

    Slots number a shard's rows from 0 without gaps, by doc_id (null first), crc32 and size of the text. Equal rows
    are counted before any shuffle and expanded last. Ranges of (doc_id, crc32) split the numbering, a much repeated
    doc_id too, so no task numbers a whole shard; a small table of counts gives each range its first slot.
    Null texts have size 8 and crc32 0; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)) + F.col("text_crc32") / F.lit(2.0**32 + 1)
    n = docs.count()
    parts = int(min(2048, max(1, n // ROWS_A_RANGE)))
    marks = docs.select((F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)) + F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")) / F.lit(2.0**32 + 1)).alias("v")).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = np.array(marks or [], float)

    def put(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        at = np.searchsorted(bounds, b.column("place").to_numpy(zero_copy_only=False), "right").astype(np.int32)
        cols = {k: b.column(k) for k in ("doc_id", "size", "text_crc32", "n")}
        return pa.RecordBatch.from_pydict(cols | {"shard": jump(keys, shards), "grown_shard": jump(keys, shards + 1), "part": at})

    placed = scan(rows.withColumn("place", place), put, "doc_id bigint, size bigint, text_crc32 bigint, n bigint, shard int, grown_shard int, part int")
    first = placed.groupBy("shard", "part").agg(F.sum("n").alias("n_part"))
    first = first.selectExpr("shard", "part", "sum(n_part) over (partition by shard order by part) - n_part as first_slot")
    inner = placed.selectExpr("*", "sum(n) over (partition by shard, part order by doc_id nulls first, text_crc32, size rows unbounded preceding) - n as lead_n")
    out = inner.join(first, ["shard", "part"]).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first_slot") + F.col("lead_n") + F.col("i")).cast("bigint").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents into shards 0 to 23 by doc_id."""
    return layout(table(spark, sf_dir, "documents"))
