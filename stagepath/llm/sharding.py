"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagepath.llm.common import shuffle_partitions
from stagepath.staging import Staging


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one for its separator; 1 for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def contiguous_shards(
    docs: DataFrame, staging: Staging, shards: int = 8, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Cuts the documents, in the order of `key`, into shards of nearly equal bytes.

    Each row's size is known after one scan; only keys, sizes and checksums are
    dealt out by range into slices. The slices' totals, added up in order, say how
    many bytes lie before each slice, and a running sum within a slice does the
    rest. A row belongs to the shard in whose equal share of all bytes its middle
    lies, so shards differ by no more than a row at either end.

    NULL keys come first. Rows with equal keys are ordered by checksum and size, and
    full repeats by their place in the input; they may lie on both sides of a
    cut. Empty and NULL texts have size 1. Other columns are left aside. An empty
    table gives no rows; with fewer rows than shards some shards stay empty.

    Returns key, size, text_crc32, shard and slot (the place in the shard from 0).
    """
    order = ["_key", "text_crc32", "size", "_seen"]
    sized = docs.select(
        F.col(key).alias("_key"),
        byte_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("_seen", F.monotonically_increasing_id())
    sized = staging.save(sized, "sizes")
    # The tie-breakers let one key's rows spread over many slices.
    slices = staging.save(
        sized.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "slices",
    )

    in_order = Window.orderBy("_slice")  # one row per slice
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slices.groupBy("_slice")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_slice",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(in_order.rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
        )
    )
    within = Window.partitionBy("_slice").orderBy(*order)
    start = F.col("_bytes_before") + F.coalesce(
        F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = (
        slices.join(offsets, "_slice")
        .withColumn("_start", start)
        .withColumn("_row", F.col("_rows_before") + F.row_number().over(within) - 1)
        .withColumn(
            "shard",
            F.expr(f"cast((2 * _start + size) * {shards} div (2 * _total) as int)"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
    )
