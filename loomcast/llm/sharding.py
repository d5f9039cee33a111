"""Contiguous shards of nearly equal bytes, by prefix sums over all rows. DataFrame functions only.

Rows are put in order of id by a range partitioning and written with their sizes. The totals of each
partition give the bytes and rows before it; a running sum inside the partition does the rest. A row belongs
to the shard in which the middle of its bytes lies, so a shard is off its target by less than one row.

Nulls and empties: a null text has no bytes and the checksum 0; a row weighs its bytes plus ``overhead``.
Null ids come first. Rows with equal ids are ordered by size and checksum and may lie in two neighbouring
shards; rows equal in all of these are alike. An empty table gives an empty result. Other columns are ignored. A very
long text is one row of its shard: a shard can exceed its target by one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomcast.llm.storage import stored


def byte_shards(docs: DataFrame, shards: int, overhead: int = 8, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards-1) and slot (0, 1, ... within the shard)."""
    text = F.col(text_col).cast("string")
    order = ["doc_id", "size", "text_crc32"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
                       F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    # the random column deals rows with one id over many partitions; it is written, so a rerun cannot change it
    rows = rows.withColumn("_deal", F.rand(7))
    sorted_rows = stored(rows.repartitionByRange(*order, "_deal").sortWithinPartitions(*order, "_deal")
                         .withColumn("_part", F.spark_partition_id()))

    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = sorted_rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")) \
        .select("_part",
                F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
                F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
                F.sum("_bytes").over(everything).alias("_all"))  # one row per partition
    running = Window.partitionBy("_part").orderBy(*order, "_deal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sorted_rows.withColumn("_end", F.sum("size").over(running)).withColumn("_row", F.count(F.lit(1)).over(running)) \
        .join(totals, "_part") \
        .withColumn("_end", F.col("_end") + F.col("_bytes_before")) \
        .withColumn("_row", F.col("_row") + F.col("_rows_before") - 1) \
        .withColumn("shard", F.expr(f"cast((2 * _end - size) * {shards} div (2 * _all) as int)")) \
        .select("doc_id", "size", "text_crc32", "shard", "_row", "_part")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row per shard
    return placed.join(first, "shard") \
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))
