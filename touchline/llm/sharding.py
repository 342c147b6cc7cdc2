"""Contiguous shards of near equal bytes, from global prefix sums of sizes.

Documents stay in order of doc_id. Only ids, sizes and checksums are sorted, never texts: they are dealt into ranges of doc_id,
each range sums up its own rows, and the ranges' totals, one short row a range, give where each range begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import scratch
from touchline.llm.ordering import bounds, range_of


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    docs needs doc_id and text. size is the text's UTF-8 bytes (null: none) plus 1. The whole corpus, in order of doc_id (null ids
    first, ties by size and checksum), is cut where the running size passes an equal share: a document belongs to the shard in
    which its middle byte falls, so a shard's size differs from the equal share by less than the largest document. slot counts a
    shard's documents from 0. Texts are never split, and equal texts under different ids go where their ids go. More shards than
    documents leave shards empty; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"))
    thin = scratch.table(thin, "sizes")
    rows = thin.withColumn("range", range_of("doc_id", bounds(thin, "doc_id")))
    totals = sorted(rows.groupBy("range").agg(F.sum("size"), F.count("*")).collect())
    starts, size, count = [], 0, 0
    for number, range_size, range_count in totals:
        starts.append((number, size, count))
        size, count = size + range_size, count + range_count
    spark = docs.sparkSession
    begin = F.broadcast(spark.createDataFrame(starts, "range int, size_before long, rows_before long"))  # one row a range, at most MOST_RANGES
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("*", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("in_range"), (F.row_number().over(order) - 1).alias("row_in_range"))
    placed = placed.join(begin, "range")
    middle = F.expr("2 * (size_before + in_range) + size")
    placed = placed.withColumns({"shard": F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2 * max(size, 1)))).cast("int"), "row": F.col("rows_before") + F.col("row_in_range")})
    placed = scratch.table(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    scratch.drop(thin)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first")))  # one row a shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
