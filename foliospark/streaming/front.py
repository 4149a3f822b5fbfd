"""Documents as they arrive: new files or rows are checked or indexed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.parse import nodes
from ..operators.search import Index
from ..plans.validate import validate

FILES = "path string, modificationTime timestamp, length long, content binary"


def markdown_stream(spark: SparkSession, folder: str, per_batch: int = 10_000) -> DataFrame:
    """(path, mtime, size, source) of files as they appear. A file that changes under its name is not seen again; for
    that, refresh an Index."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.where(F.lower("path").rlike(r"\.(md|markdown)\z")).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").alias("source"))


def validate_stream(docs: DataFrame, schema: str, resources: dict | None = None, key: str = "path") -> DataFrame:
    """Diagnostics of a stream of documents: the check needs no state, so it is the same plan as for a table."""
    return validate(docs, schema, resources, key)


def nodes_stream(docs: DataFrame, key: str = "path") -> DataFrame:
    return nodes(docs, key)


def index_stream(docs: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Adds each batch of files to the index in folder. A batch that runs again finds its files indexed and changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        Index(batch.sparkSession, folder).refresh(batch, complete=False)

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
