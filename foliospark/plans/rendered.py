"""Markdown documents made from the relational test tables: a document per key, its lines in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line items of an order are ordered by these, which together are unique.
LINES = ("l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(rows: DataFrame, key: str, order: tuple[str, ...], text: Column, head: Column | None = None, gap: str = "\n", dealt: bool = False) -> DataFrame:
    """(doc_id, source): the head of each key and the texts of its rows, which null leaves out. dealt: rows of a key are
    together already."""
    listed = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("_text")))))
    own = [F.first(head).alias("_head")] if head is not None else []
    x = (rows if dealt else _dealt(rows, key)).groupBy(F.col(key).alias("doc_id")).agg(listed.alias("_x"), *own)
    body = F.transform("_x", lambda r: r["_text"])
    return x.select("doc_id", F.concat_ws(gap, *([F.col("_head")] if own else []), body).alias("source"))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by key. Parsing takes far longer than a text's size tells, so its partitions are stated rather than merged by size."""
    return rows.repartition(_width(rows.sparkSession), key)


def _width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its line items, orders without any included, each order's together: both tables move once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINES, "l_quantity", "l_returnflag", "l_shipdate")
    return _dealt(orders, "o_orderkey").join(_dealt(lines, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")


def order_documents(spark: SparkSession, sf_dir: str, text: Column, gap: str = "\n") -> DataFrame:
    """# Order k and a text for each line item."""
    head = F.concat(F.lit("# Order "), F.col("o_orderkey").cast("string"))
    return joined(order_lines(spark, sf_dir), "o_orderkey", LINES, F.when(F.col("l_orderkey").isNotNull(), text), head, gap, dealt=True)


def line_heading() -> Column:
    return F.concat(F.lit("## Line "), F.col("l_linenumber").cast("string"), F.lit(" - "), F.date_format("l_shipdate", "yyyy-MM-dd"))


def flag_heading() -> Column:
    return F.concat(F.lit("## "), F.col("l_returnflag"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, spread."""
    return spread(_parts(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type")


def brand_documents(spark: SparkSession, sf_dir: str, text: Column, head: Column | None = None, gap: str = "\n") -> DataFrame:
    return joined(_parts(spark, sf_dir), "p_brand", ("p_partkey",), text, head, gap)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out row by row: the rows of a file lie in as many partitions as it has row groups, whatever its size and number of
    partitions, and take far longer to parse than their size tells."""
    return df.repartition(_width(df.sparkSession))


def event_documents(spark: SparkSession, sf_dir: str, *lines: Column) -> DataFrame:
    """Frontmatter of the given lines, of which null leaves one out."""
    e = spread(table(spark, sf_dir, "events")).withColumn("k", F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("doc_id"), F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit("## Body"), F.lit("")).alias("source"))
