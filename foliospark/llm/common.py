"""What the operators share: reading texts in Arrow batches, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only, as a table for bytes.translate.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of words of the form [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing; others become spaces.
WORDS = bytes(LOWER[b] if 48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Bytes of texts that a task works on at once; a longer text is worked on alone.
PART_BYTES = 4 << 20


def parts(batches: Iterator[pa.RecordBatch], most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about most bytes, one row at least; no row is copied."""
    for b in batches:
        if b.nbytes <= most:
            if b.num_rows:
                yield b
            continue
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(size) - size) // most
        for low, high in zip(starts := np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]), [*starts[1:], b.num_rows], strict=True):
            yield b.slice(low, high - low)


def scan(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies fn to each Arrow batch, in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            if (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts in one array, and where each text starts (with the end)."""
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master gets a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Written:
    """Tables in the shared folder. Each can be dropped once nothing reads it any more; those that results still read go when
    the process ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/foliospark-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        atexit.register(self._end)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(self.paths.pop(id(df)))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        try:
            self._delete(self.top)
        except Exception:  # the session is gone already, and with it what could read the tables
            pass

    def keep(self, *tables: DataFrame) -> None:
        """Drops all tables but these."""
        for key in self.paths.keys() - {id(x) for x in tables}:
            self._delete(self.paths.pop(key))
        self.tidy()

    def only(self, df: DataFrame) -> DataFrame:
        """As put, and drops all tables before it."""
        out = self.put(df)
        self.keep(out)
        return out

    def tidy(self) -> None:
        """Lets Spark delete shuffle files that no table needs any more, which it does only as objects are collected."""
        gc.collect()
        self.spark._jvm.System.gc()


def held_out(doc_id="doc_id"):
    """True for rows whose crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def components(spark: SparkSession, links: DataFrame, written: Written | None = None) -> DataFrame:
    """Connected components of links (a, b: equal types, no nulls): rows (id, component), the smallest id reachable.

    Alternates the large-star and small-star steps, so that rounds grow with the logarithm of the longest path
    and no node gathers its neighbours in one row; each round is written and the one before is dropped. It ends when each
    node is linked with one smaller node, and none of those with another: counts that are summed before they move tell.
    """
    written = written or Written(spark)

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # Written, so that Spark can split the rows of a much linked node in the join, or send a small table to all tasks.
        low = written.put(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        lows.append(low)
        joined = both.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.where("a <> low").select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        down = e.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up"), (F.col("b") > F.col("a")).alias("wrong"))
        up = e.select(F.col("b").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up"), F.lit(False).alias("wrong"))
        each = down.unionByName(up).groupBy("id").agg(F.sum("down").alias("down"), F.sum("up").alias("up"), F.max("wrong").alias("wrong"))
        return each.where("down > 1 or down > 0 and up > 0 or wrong").isEmpty()

    now = written.put(links.select("a", "b").where("a <> b").distinct())
    while not settled(now):
        lows: list[DataFrame] = []
        nxt = written.put(star(star(now, True), False))
        for x in (now, *lows):
            written.drop(x)
        now = nxt
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
